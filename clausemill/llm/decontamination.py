"""Benchmark decontamination by winnowing.

Of every `window` + 1 - `gram` successive k-gram hashes the least is kept (the
later one of equals), in items and documents alike, so a span of `window`
words that both hold leaves at least one fingerprint in common.  Each common
fingerprint is then extended to the windows around it, which are looked up
whole.  Items of fewer than `window` words are one window of their own length,
below what winnowing guarantees; those are looked up at every position.

The items' index is sent to the executors only while their texts stay within
`most_bytes`.  Larger sets are joined instead: the fingerprints and windows of
the items become tables, bitmaps of fixed size of both leave out nearly all
document windows that no item has, and the rest meet the items' windows in a
join by hash.  Documents are read once in either case, and both give the same
rows.

Nulls and repeats: a null text has no words; an item with null id is not an
item; items may share texts and ids; repeated document rows are answered one
by one; empty tables give rows without hits, or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import _STEP, LOWER, U64, WORD, bounded, mix, slices, span_hashes, words
from .prefilter import key_bits, maybe_in
from .storage import Scratch, restored, whole_row

_MASK = (1 << 20) - 1


def grams(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each of the places on."""
    with np.errstate(over="ignore"):
        value = np.full(len(at), U64(k))
        for j in range(k):
            value += hashes[at + j] * _STEP[j]
    return mix(value)


def winnow(hashes: np.ndarray, rows: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the fingerprints of all rows."""
    whole = len(hashes) - window + 1
    if whole <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    value = grams(hashes, np.arange(len(hashes) - k + 1), k)
    best, place = value[:whole].copy(), np.arange(whole)
    for j in range(1, window - k + 1):
        other = value[j : j + whole]
        less = other <= best
        best[less], place[less] = other[less], np.flatnonzero(less) + j
    place = np.unique(place[rows[:whole] == rows[window - 1 :]])
    return place, value[place]


class Index:
    """Fingerprints and windows of a set of items."""

    def __init__(self, items: list[tuple[str, str]], k: int, window: int) -> None:
        self.k, self.window = k, window
        names = [name for name, _ in items]
        found: list[tuple[int, np.ndarray, np.ndarray]] = []  # window length, hashes, item numbers
        prints = []
        for first, content, offsets in slices(pa.array([text for _, text in items], pa.large_string())):
            content = LOWER[content]
            starts, ends, rows = words(content, offsets, WORD)
            hashes = span_hashes(content, starts, ends)
            prints.append(winnow(hashes, rows, k, window)[1])
            count = np.bincount(rows, minlength=len(offsets) - 1)
            begin = np.cumsum(count) - count
            for m in range(1, window):
                short = np.flatnonzero(count == m)
                if len(short):
                    found.append((m, grams(hashes, begin[short], m), short + first))
            at = np.flatnonzero(rows[: max(0, len(rows) - window + 1)] == rows[window - 1 :])
            found.append((window, grams(hashes, at, window), rows[at] + first))
        self.prints = np.unique(np.concatenate([*prints, np.zeros(0, U64)]))
        self.bits = np.zeros(_MASK + 1, bool)
        self.bits[(self.prints & U64(_MASK)).astype(np.int64)] = True
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in {m for m, *_ in found}:
            value = np.concatenate([v for n, v, _ in found if n == m])
            item = np.concatenate([i for n, _, i in found if n == m])
            order = np.lexsort((item, value))
            unique, begin = np.unique(value[order], return_index=True)
            self.tables[m] = unique, np.append(begin, len(order)), item[order]
        self.names = names

    def hits(self, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places of occurring windows, their numbers in the table of that length)."""
        for m, (unique, *_) in self.tables.items():
            whole = len(rows) - m + 1
            if whole <= 0 or not len(unique):
                continue
            if m == self.window:
                place, value = winnow(hashes, rows, self.k, m)
                near = self.bits[(value & U64(_MASK)).astype(np.int64)]
                place, value = place[near], value[near]
                place = place[self.prints[np.minimum(np.searchsorted(self.prints, value), len(self.prints) - 1)] == value] if len(self.prints) else place[:0]
                at = np.unique((place[:, None] - np.arange(m - self.k + 1)).ravel())
                at = at[(at >= 0) & (at < whole)]
            else:
                at = np.arange(whole)
            at = at[rows[at] == rows[at + m - 1]]
            value = grams(hashes, at, m)
            number = np.minimum(np.searchsorted(unique, value), len(unique) - 1)
            same = unique[number] == value
            if same.any():
                yield m, at[same], number[same]

    def scan(self, content: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]], np.ndarray, np.ndarray]:
        """Words of each row, whether each word is hit, items of the rows that have any, rows and first words."""
        content = LOWER[content]
        starts, ends, rows = words(content, offsets, WORD)
        hashes = span_hashes(content, starts, ends)
        count = np.bincount(rows, minlength=len(offsets) - 1)
        change = np.zeros(len(rows) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for m, at, number in self.hits(hashes, rows):
            np.add.at(change, at, 1)
            np.add.at(change, at + m, -1)
            _, bound, item = self.tables[m]
            pairs = np.unique(np.stack([rows[at], number]), axis=1)
            for row, n in pairs.T.tolist():
                items.setdefault(row, set()).update(self.names[i] for i in item[bound[n] : bound[n + 1]])
        return count, np.cumsum(change[:-1]) > 0, items, starts, ends


def _known(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("item is not null")


def _sent(docs: DataFrame, known: DataFrame, k: int, window: int) -> DataFrame:
    """The rows with words, hit words, items and hit spans (of words and bytes), by an index that each executor gets."""
    index = Index([tuple(r) for r in known.collect()], k, window)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @bounded
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, names, spans = [], [], [], []
            for _, content, offsets in slices(batch.column("text")):
                count, hit, items, starts, ends = shared.value.scan(content, offsets)
                begin = np.cumsum(count) - count
                total = np.append(0, np.cumsum(hit))
                n_words += count.tolist()
                n_hit += (total[begin + count] - total[begin]).tolist()
                for row in range(len(count)):
                    names.append(sorted(items.get(row, ())))
                    part = hit[begin[row] : begin[row] + count[row]] if row in items else hit[:0]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8))).reshape(-1, 2)
                    spans.append([{"word": int(a), "words": int(b - a), "byte": int(starts[begin[row] + a] - offsets[row]), "bytes": int(ends[begin[row] + b - 1] - starts[begin[row] + a])} for a, b in edges])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([(f, pa.int64()) for f in ("word", "words", "byte", "bytes")])))],
                names=[*batch.schema.names, "n_words", "n_hit", "items", "spans"],
            )

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, *T.StructType.fromDDL("n_words long, n_hit long, items array<string>, spans array<struct<word: long, words: long, byte: long, bytes: long>>").fields]))


#: Sorted spans as maximal ones.
_JOINED = """aggregate(spans, cast(array() as array<struct<word: bigint, words: bigint, byte: bigint, bytes: bigint>>), (done, s) -> if(
    size(done) > 0 and element_at(done, -1).word + element_at(done, -1).words >= s.word,
        concat(slice(done, 1, size(done) - 1), array(named_struct(
        'word', element_at(done, -1).word, 'words', greatest(element_at(done, -1).words, s.word + s.words - element_at(done, -1).word),
        'byte', element_at(done, -1).byte, 'bytes', greatest(element_at(done, -1).bytes, s.byte + s.bytes - element_at(done, -1).byte)))),
        concat(done, array(s))))"""


def _keyed(value: np.ndarray, m: int) -> np.ndarray:
    """The key of windows of m words by their hashes."""
    with np.errstate(over="ignore"):
        return mix(value + U64(m))


def _met(docs: DataFrame, known: DataFrame, k: int, window: int, scratch: Scratch) -> DataFrame:
    """What `_sent` gives, by joins of written tables."""

    @bounded
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content, offsets in slices(batch.column(1)):
                content = LOWER[content]
                starts, ends, rows = words(content, offsets, WORD)
                hashes = span_hashes(content, starts, ends)
                count = np.bincount(rows, minlength=len(offsets) - 1)
                begin, out = np.cumsum(count) - count, []
                for m in range(1, window):
                    short = np.flatnonzero(count == m)
                    out.append((short, grams(hashes, begin[short], m), np.full(len(short), m)))
                at = np.flatnonzero(rows[: max(0, len(rows) - window + 1)] == rows[window - 1 :])
                out.append((rows[at], grams(hashes, at, window), np.full(len(at), window)))
                place, value = winnow(hashes, rows, k, window)
                out.append((rows[place], value, np.zeros(len(place), np.int64)))
                row, value, m = (np.concatenate(c) for c in zip(*out, strict=True))
                with np.errstate(over="ignore"):
                    key = np.where(m > 0, mix(value + m.astype(U64)), value)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first)), pa.array(m, pa.int32()), pa.array(key.view(np.int64))], names=["item", "m", "key"])

    parts = scratch.keep(known.mapInArrow(cut, "item string, m int, key long").distinct(), "items")
    prints = docs.sparkSession.sparkContext.broadcast(key_bits(parts.where("m = 0").select("key")))
    wholes = docs.sparkSession.sparkContext.broadcast(key_bits(parts.where("m > 0").select("key")))
    lengths = sorted(r["m"] for r in parts.where("m > 0").select("m").distinct().collect())

    @bounded
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("key", pa.int64()), *((f, pa.int64()) for f in ("word", "words", "byte", "bytes"))]))
        for batch in batches:
            n_words, found = [], []
            for _, content, offsets in slices(batch.column("text")):
                content = LOWER[content]
                starts, ends, rows = words(content, offsets, WORD)
                hashes = span_hashes(content, starts, ends)
                count = np.bincount(rows, minlength=len(offsets) - 1)
                begin, mine = np.cumsum(count) - count, [[] for _ in range(len(count))]
                for m in lengths:
                    whole = len(rows) - m + 1
                    if whole <= 0:
                        continue
                    at = np.arange(whole)
                    if m == window:
                        place, value = winnow(hashes, rows, k, m)
                        place = place[maybe_in(prints.value, value.view(np.int64))]
                        at = np.unique((place[:, None] - np.arange(m - k + 1)).ravel())
                        at = at[(at >= 0) & (at < whole)]
                    at = at[rows[at] == rows[at + m - 1]]
                    key = _keyed(grams(hashes, at, m), m).view(np.int64)
                    near = maybe_in(wholes.value, key)
                    for x, p, r in zip(key[near].tolist(), at[near].tolist(), rows[at[near]].tolist(), strict=True):
                        mine[r].append({"key": x, "word": p - int(begin[r]), "words": m, "byte": int(starts[p] - offsets[r]), "bytes": int(ends[p + m - 1] - starts[p])})
                n_words += count.tolist()
                found += mine
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(found, kind)], names=[*batch.schema.names, "n_words", "found"])

    base = docs.mapInArrow(scan, T.StructType([*docs.schema.fields, *T.StructType.fromDDL("n_words long, found array<struct<key: long, word: long, words: long, byte: long, bytes: long>>").fields]))
    base = scratch.keep(base.withColumn("uid", F.monotonically_increasing_id()), "base")
    hits = base.select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    sure = scratch.keep(hits.join(parts.where("m > 0").select("key", F.col("m").cast("long").alias("words")).distinct(), ["key", "words"]), "hits")
    spans = sure.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("word", "words", "byte", "bytes"))).alias("spans")).withColumn("spans", F.expr(_JOINED))
    names = sure.select("uid", "key").distinct().join(parts.where("m > 0").select("key", "item"), "key").groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = base.drop("found").join(spans, "uid", "left").join(names, "uid", "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.words)")).select(*docs.columns, "n_words", "n_hit", "items", "spans")


def _reported(docs: DataFrame, items: DataFrame, gram: int, window: int, most_bytes: int, item_col: str, item_text_col: str) -> DataFrame:
    known = _known(items, item_col, item_text_col)
    size = known.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return _sent(docs, known, gram, window) if size <= most_bytes else _met(docs, known, gram, window, Scratch(docs.sparkSession))


def contamination(docs: DataFrame, items: DataFrame, *, gram: int = 5, window: int = 10, most_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids with an occurring window), spans (maximal runs of hit words and their bytes)."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _reported(named, items, gram, window, most_bytes, item_col, item_text_col).select("doc_id", "n_words", "n_hit", "items", "spans")


def remove_hits(docs: DataFrame, items: DataFrame, *, most_share: float = 0.5, text_col: str = "text", gram: int = 5, window: int = 10, most_bytes: int = 64 << 20, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without the hit spans of their texts; one of which more than `most_share` is hit goes whole.

    Rows without hits keep every column as it is.  `spans` is in bytes, so the
    text is cut as binary and decoded again; words never split a character.
    """
    packed = docs.select(F.col(text_col).alias("text"), whole_row(docs, text_col).alias("row"))
    report = _reported(packed, items, gram, window, most_bytes, item_col, item_text_col)
    found = report.where(F.col("n_hit") <= most_share * F.col("n_words"))
    kept = F.expr("""decode(unhex(array_join(transform(sequence(0, size(spans)), i -> hex(substring(cast(text as binary),
        cast(if(i = 0, 0L, spans[i - 1].byte + spans[i - 1].bytes) as int) + 1,
        cast(if(i = size(spans), octet_length(text), spans[i].byte) - if(i = 0, 0L, spans[i - 1].byte + spans[i - 1].bytes) as int)))), '')), 'UTF-8')""")
    found = found.withColumn("text", F.when(F.col("n_hit") > 0, kept).otherwise(F.col("text")))
    return found.select(*restored(docs, **{text_col: F.col("text")}))
