"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Pieces are dealt at random into buckets of about `bucket_pieces`, which are
packed apart: best-fit decreasing first, then local search between the bins
that are not full.  The search moves one document or two, or exchanges them for one or
two, until that raises the sum of squared fills no more or no bin fewer is
possible, so the emptiest bins drain and vanish.  Bins that stay underfull are opened once more and
packed again over several buckets together.

Nulls and repeats: a null text is an empty one (one piece holding the end id);
null or repeated doc_ids are kept as they are, each row apart; an empty table
gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import held, release
from .storage import Scratch

PIECES = "piece int, start long, length long, ids_crc32 long"
#: Chunks between spaces, and words among them, whose ids a worker keeps.
CHUNKS, WORDS = 600_000, 1_000_000
#: What lower-casing by the tokenizer and by Python might treat differently.
_BEYOND_LATIN = re.compile("[\u0130]|[^\x00-\u024f]")
#: Characters that Python's split takes for white space and the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]").search
#: Words that every step before the merges leaves as they are.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: 0x100 + n for n, b in enumerate(sorted(set(range(256)).difference(_PRINTABLE)))}


class WordEncoder:
    """Ids of texts for a tokenizer that lower-cases, drops white space and never merges across it.

    Distinct chunks between spaces are encoded once per worker and looked up
    after that.  A text of Latin letters without combining marks is the same
    as its lower case, and a full stop or comma behind a letter is encoded by
    itself, so the variants share the ids of their word.  A text with one of
    U+001C to U+001F, which Python's split takes for white space and the
    tokenizer does not, is encoded whole.
    """

    def __init__(self, path: str, words_kept: int = WORDS, chunks_kept: int = CHUNKS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.words_kept, self.chunks_kept = words_kept, chunks_kept
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.tails = {c: self._encoded(c) for c in ".,"}
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self.learn)

    @classmethod
    def of(cls, path: str, words_kept: int) -> WordEncoder:
        """The encoder that this worker keeps for all its tasks; another one frees it."""
        name = f"encoder {words_kept} {path}"
        if name not in held:
            release(name)
            held[name] = cls(path, words_kept, words_kept * CHUNKS // WORDS)
        return held[name]

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for n, text in enumerate(texts):
            if n % 256 == 0 and (len(self.words) > self.words_kept or len(self.chunks) > self.chunks_kept):
                self.words.clear()
                self.chunks.clear()
            yield self._encoded(text) if _ODD_SPACE(text) else b"".join(map(self.chunks.__getitem__, _lowered(text).split()))

    def learn(self, chunk: str) -> bytes:
        """The ids of a chunk between spaces that is not known yet."""
        word, tail = chunk, b""
        if chunk[-1] in self.tails and "a" <= chunk[-2:-1] <= "ÿ" and chunk[-2].isalpha():
            word, tail = chunk[:-1], self.tails[chunk[-1]]
        ids = self.words.get(word)
        if ids is None:
            if _PLAIN(word):
                ids = array("I", [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
            else:
                ids = self._encoded(word)
            self.words[word] = ids
        return ids + tail if tail else ids


class _Chunks(dict):
    """Ids by chunk; one that is missing is learnt as it is looked up, so a text is gone over once."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.learn(chunk)
        return ids


def _lowered(text: str) -> str:
    """The text in lower case where Python's is the tokenizer's, which is for characters up to U+024F but U+0130."""
    if not text.isascii():
        try:
            text.encode("latin-1")  # far faster than a search
        except UnicodeEncodeError:
            if _BEYOND_LATIN.search(text):
                return text
    return text.lower()


def pieces(docs: DataFrame, tokenizer: str, limit: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", words_kept: int = WORDS, between_tasks: bool = True) -> DataFrame:
    """One row per piece of at most `limit` tokens of each document, its end id included; a worker keeps its words for its next task only with `between_tasks`."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.of(tokenizer, words_kept)
        last = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows, columns = [], ([], [], [], [])
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for row, ids in enumerate(encode(texts)):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append(row)
                    for column, value in zip(columns, (piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        if not between_tasks:
            del encode
            release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc_id {id_type}, {PIECES}")


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes where the least room stays."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms: list[int] = []  # sorted rooms that some bin has
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            number, room = len(bins), limit
            bins.append([])
        else:
            room = rooms[at]
            number = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bins[number].append(item)
        left = room - size
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(number)
    return bins


class _Room:
    """What each bin could give up, nothing to two items, and the room it would then have; one slot of flat arrays a bin."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, limit: int) -> None:
        self.bins, self.lengths, self.limit = bins, lengths, limit
        self.lay([0] * len(bins))

    def lay(self, wanted: list[int]) -> None:
        slots = [max(w, 2 * (1 + len(b) + len(b) * (len(b) - 1) // 2)) for w, b in zip(wanted, self.bins, strict=True)]
        self.start = np.append(0, np.cumsum(slots))
        self.owner = np.repeat(np.arange(len(slots)), slots)
        self.gone, self.room = np.zeros(self.start[-1], np.int64), np.full(self.start[-1], -1)
        for n in range(len(self.bins)):
            self.put(n)

    def sums(self, n: int) -> np.ndarray:
        size = self.lengths[self.bins[n]]
        i, j = np.triu_indices(len(size), 1)
        return np.concatenate([size, size[i] + size[j]])

    def items(self, n: int, total: int) -> list[int]:
        """One or two items of a bin, or none, of that total length."""
        seen: dict[int, int] = {}
        for item in self.bins[n]:
            size = int(self.lengths[item])
            if size == total:
                return [item]
            if total - size in seen:
                return [seen[total - size], item]
            seen[size] = item
        return []

    def put(self, n: int) -> None:
        out = np.append(0, self.sums(n)) if self.bins[n] else np.zeros(0, np.int64)
        begin, end = int(self.start[n]), int(self.start[n + 1])
        if len(out) > end - begin:
            self.lay([2 * len(out) if n == m else int(w) for m, w in enumerate(np.diff(self.start))])
            return
        self.room[begin:end] = -1
        self.gone[begin : begin + len(out)] = out
        if len(out):
            self.room[begin : begin + len(out)] = out + self.limit - int(self.lengths[self.bins[n]].sum())

    def best(self, low: int, fill: np.ndarray) -> tuple[int, int, int] | None:
        """(fuller bin, length out of it, length into it): the exchange with `low` that fills a fuller bin most."""
        sums = np.append(0, np.unique(self.sums(low)))
        gain = sums[np.maximum(np.searchsorted(sums, self.room, "right") - 1, 0)] - self.gone
        gain[(self.room < 0) | (fill[self.owner] < fill[low])] = 0
        gain[self.start[low] : self.start[low + 1]] = 0
        at = int(gain.argmax())
        return (int(self.owner[at]), int(self.gone[at]), int(gain[at] + self.gone[at])) if gain[at] > 0 else None


def local_search(bins: list[list[int]], lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Raises the sum of squared fills by moves and exchanges until no bin fewer is possible or nothing helps."""
    least = -(-int(lengths.sum()) // limit)
    under = [list(b) for b in bins if int(lengths[b].sum()) < limit]
    full = [b for b in bins if int(lengths[b].sum()) >= limit]
    least -= len(full)
    fill = np.array([int(lengths[b].sum()) for b in under], np.int64)
    left = len(under)
    moved = left > least
    room = _Room(under, lengths, limit) if moved else None
    while moved and left > least:
        moved = False
        for low in np.argsort(fill, kind="stable").tolist():
            while under[low] and fill[low] < limit and (found := room.best(low, fill)):
                high, out, into = found
                given, taken = room.items(high, out), room.items(low, into)
                for source, target, items in ((high, low, given), (low, high, taken)):
                    for item in items:
                        under[source].remove(item)
                        under[target].append(item)
                fill[high], fill[low], moved = fill[high] + into - out, fill[low] + out - into, True
                room.put(high)
                room.put(low)
            if not under[low] and fill[low] == 0:
                left = sum(map(bool, under))
                if left <= least:
                    break
    return full + [b for b in under if b]


def _packed(frame: pd.DataFrame, limit: int, settle: int) -> pd.DataFrame:
    frame = frame.sort_values("uid").reset_index(drop=True)
    lengths = frame["length"].to_numpy()
    bins = local_search(best_fit_decreasing(lengths, limit), lengths, limit)
    number, offset, fill = (np.zeros(len(frame), np.int64) for _ in range(3))
    for n, items in enumerate(bins):
        number[items], ends = n, np.cumsum(lengths[items])
        offset[items], fill[items] = ends - lengths[items], ends[-1]
    frame["sequence_id"], frame["offset"] = number, offset
    frame["settled"] = fill >= settle
    return frame


def pack(docs: DataFrame, *, tokenizer: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", bucket_pieces: int = 2048, merge_buckets: int = 16, words_kept: int = WORDS, between_tasks: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A worker keeps the ids of `words_kept` words, about 300 bytes each.  Only
    pieces' lengths are shuffled, never texts.  A task holds about
    `bucket_pieces` rows in the first round and at most `merge_buckets` times
    as many in the second.
    """
    scratch = Scratch(docs.sparkSession)
    cut = pieces(docs, tokenizer, limit, end_id, id_col, text_col, words_kept, between_tasks)
    cut = scratch.keep(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    buckets = max(1, -(-cut.count() // bucket_pieces))
    fields = f"{cut.schema['doc_id'].dataType.simpleString()}, {PIECES}, uid long, bucket int, sequence_id long, offset long, settled boolean"
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"))
    first = scratch.keep(dealt.groupBy("bucket").applyInPandas(lambda f: _packed(f, limit, limit), f"doc_id {fields}"), "first")
    again = first.where("not settled").drop("sequence_id", "offset", "settled").withColumn("bucket", (F.col("bucket") / merge_buckets).cast("int"))
    second = again.groupBy("bucket").applyInPandas(lambda f: _packed(f, limit, limit), f"doc_id {fields}")
    place = F.col("bucket").cast("long") * (1 << 32) + F.col("sequence_id")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = first.where("settled").withColumn("sequence_id", place * 2)
    rest = second.withColumn("sequence_id", place * 2 + 1)
    return done.select(columns).unionByName(rest.select(columns))
