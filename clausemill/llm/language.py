"""Language of texts: script ranges narrow the candidates, Viterbi labels spans.

A word's bytes are scored by a naive Bayes model over n-grams of 1 to 4 bytes.
Languages whose training text hardly uses a word's script are no candidates
for it, unless no language uses it.  Viterbi with a fixed penalty for each
switch then labels every word of a text; runs of one label are the spans, and
the language with most words is the text's.

The model is fitted on the whole texts of at most `sample` different documents
of each language, those of least text hash; every document is labelled by its
whole text.  Any number of languages up to 65,535 can be told apart.

Nulls and repeats: a text that is null or has no letter is `und`, with score 0;
a null language trains nothing; repeated rows are answered one by one; without
training rows every text is `und`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, U64, _bytes_in, bounded, mix, slices, span_hashes, words
from .storage import restored, whole_row

WORD = _bytes_in((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
ASCII_LETTER = _bytes_in((0x41, 0x5A), (0x61, 0x7A))
BUCKETS = 1 << 16

# First bytes of UTF-8 for ranges of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xCA)],
    "greek": [(0xCD, 0xCF)],
    "cyrillic": [(0xD0, 0xD4)],
    "armenian and hebrew": [(0xD5, 0xD7)],
    "arabic": [(0xD8, 0xDD)],
    "indic and southeast asian": [(0xE0, 0xE1)],
    "kana": [(0xE3, 0xE3)],
    "han": [(0xE4, 0xE9)],
    "hangul": [(0xEA, 0xED)],
}
#: Script number of each byte, from 1; 0 where it tells nothing.
SCRIPT = np.zeros(256, np.int64)
for _n, _ranges in enumerate(SCRIPTS.values(), 1):
    for _low, _high in _ranges:
        SCRIPT[_low : _high + 1] = _n


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (bucket, language): centred log probabilities
    allowed: np.ndarray  # (script, language)
    penalty: float


def _grams(content: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word number) of the n-grams of the words, spaces around them counted in."""
    lengths = ends - starts + 2
    first = np.cumsum(lengths) - lengths
    padded = np.full(int(lengths.sum()), 0x20, np.uint8)
    number = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(len(padded)) - first[number]
    inner = (place > 0) & (place < lengths[number] - 1)
    padded[inner] = content[(starts[number] + place - 1)[inner]]
    left = lengths[number] - place
    code = np.zeros(len(padded), np.uint32)
    for n in range(1, 5):
        code[: len(padded) - n + 1] = code[: len(padded) - n + 1] << np.uint32(8) | padded[n - 1 :]
        fits = left >= n
        if n == 1:
            fits &= inner
        bucket = (mix(code[fits].astype(U64) + U64(n << 40)) >> U64(48)).astype(np.int64)
        yield bucket, number[fits]


def _scripts(content: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The highest script number within each word; words are in order of place."""
    return np.maximum.reduceat(np.append(SCRIPT[content], 0), np.stack([starts, ends], 1).ravel())[::2] if len(starts) else starts


def sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """lang, text: of each language the `sample` different texts of least hash, each once and whole."""
    known = labelled.where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    place = F.pmod("h", F.lit(1 << 30))
    texts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    # hashes below a share of their range that surely holds the sample, and little more
    below = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int((1 << 30) * min(1.0, 2 * sample / max(n, 1))))) for lang, n in texts.items()], F.lit(0))
    few = known.where(place <= below).select("lang", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "h")
    bounded_size = len(texts) * sample <= 1 << 20
    return known.join(F.broadcast(chosen) if bounded_size else chosen, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")


def fit(labelled: DataFrame, *, sample: int = 1500, penalty: float = 12.0, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model from text and language of a DataFrame; texts are counted where they are, and only the counts come to the driver."""
    chosen = sampled(labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")), sample)

    @bounded
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            whose = np.array(batch.column(0).to_pylist(), object)
            for lang in set(whose.tolist()):
                total = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1, np.int64))
                for _, content, offsets in slices(batch.column(1).filter(pa.array(whose == lang))):
                    content = LOWER[content]
                    starts, ends, _ = words(content, offsets, WORD)
                    total[BUCKETS:] += np.bincount(_scripts(content, starts, ends), minlength=len(SCRIPTS) + 1)
                    for bucket, _ in _grams(content, starts, ends):
                        total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "place", "times"])
            if not len(at):
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([0], pa.int32()), pa.array([0], pa.int64())], names=["lang", "place", "times"])

    counted = chosen.mapInArrow(count, "lang string, place int, times long").groupBy("lang", "place").agg(F.sum("times").alias("times")).toPandas()
    langs = sorted(counted["lang"].unique())
    both = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(langs)))
    both[counted["place"].to_numpy(np.int64), np.searchsorted(np.array(langs, object), counted["lang"].to_numpy(object)) if langs else []] = counted["times"]
    total, used = both[:BUCKETS], both[BUCKETS:]
    table = np.log((total + 0.1) / (total.sum(0) + 0.1 * BUCKETS))
    table -= table.mean(1, keepdims=True) if langs else 0
    allowed = used >= 0.005 * used.sum(0, keepdims=True)
    allowed[0] = True
    allowed[~allowed.any(1)] = True
    return Model(langs, table.astype(np.float32), allowed, penalty)


def word_scores(model: Model, content: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(word, language) of the words of a slice; equal words are scored once."""
    _, first, back = np.unique(span_hashes(content, starts, ends), return_index=True, return_inverse=True)
    order = np.argsort(first)  # in order of place, as _scripts needs them
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    first, back = first[order], rank[back]
    own_starts, own_ends = starts[first], ends[first]
    total = np.zeros((len(first), len(model.langs)), np.float32)
    for bucket, number in _grams(content, own_starts, own_ends):
        for lang in range(len(model.langs)):
            total[:, lang] += np.bincount(number, weights=model.table[bucket, lang], minlength=len(first))
    total[~model.allowed[_scripts(content, own_starts, own_ends)]] = -1e4
    return total[back]


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The label of each word; all texts step forward at once, the longest first."""
    n_langs = scores.shape[1]
    if n_langs > 1 << 16:
        raise ValueError("more than 65,535 languages")
    kind = np.uint8 if n_langs <= 256 else np.uint16
    order = np.argsort(-counts, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    steps = int(counts.max(initial=0))
    live = np.searchsorted(-counts[order], -np.arange(steps), "left")  # texts longer than t words
    base = np.cumsum(live) - live
    row = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = base[pos] + rank[row]
    by_step = np.empty_like(scores)
    by_step[at] = scores
    origin = np.empty((len(row), n_langs), kind)
    own = np.arange(n_langs, dtype=kind)
    best = np.zeros((len(counts), n_langs), np.float32)
    for t in range(steps):
        n, begin = live[t], base[t]
        if t:
            top = best[:n].argmax(1)
            least = best[np.arange(n), top][:, None] - penalty
            switch = best[:n] < least
            origin[begin : begin + n] = np.where(switch, top[:, None].astype(kind), own)
            best[:n] = np.where(switch, least, best[:n])
        best[:n] += by_step[begin : begin + n]
    labels = np.empty(len(row), kind)
    now = best.argmax(1).astype(kind)
    for t in range(steps - 1, -1, -1):
        n, begin = live[t], base[t]
        labels[begin : begin + n] = now[:n]
        if t:
            now[:n] = origin[np.arange(begin, begin + n), now[:n]]
    return labels[at]


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False, most_cells: int = 1_500_000) -> DataFrame:
    """doc_id, lang_pred, score (share of the words), spans (language, words) of every row; with `keep_rows` also the text and, as `row`, all other columns."""
    langs = np.array([*model.langs, "und"], object)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([whole_row(docs, text_col).alias("row")] if keep_rows else []))
    carried = [f for f in given.schema.fields if keep_rows or f.name != "text"]

    def label(texts: pa.Array, scores: list[np.ndarray], counts: np.ndarray, plain: np.ndarray) -> list[pa.Array]:
        lettered = plain.copy()
        for i in np.flatnonzero(~plain & (counts > 0)):
            lettered[i] = any(c.isalpha() for c in texts[int(i)].as_py())
        labels = viterbi(np.concatenate(scores), counts, model.penalty).astype(np.int64)
        row = np.repeat(np.arange(len(counts)), counts)
        votes = np.bincount(row * len(model.langs) + labels, minlength=len(counts) * len(model.langs)).reshape(len(counts), -1)
        top = np.where(lettered, votes.argmax(1), len(model.langs))
        share = np.where(lettered, votes.max(1) / np.maximum(counts, 1), 0.0)
        begin = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
        runs = np.diff(np.append(begin, len(row)))
        at = pa.array(np.searchsorted(row[begin], np.arange(len(counts) + 1)), pa.int32())
        spans = pa.StructArray.from_arrays([pa.array(langs[labels[begin]], pa.string()), pa.array(runs, pa.int64())], names=["lang", "words"])
        return [pa.array(langs[top], pa.string()), pa.array(share, pa.float64()), pa.ListArray.from_arrays(at, spans)]

    def unknown(rows: int) -> list[pa.Array]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
        return [pa.array(["und"] * rows, pa.string()), pa.array([0.0] * rows, pa.float64()), pa.array([[]] * rows, kind)]

    @bounded
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(f.name for f in carried), "lang_pred", "score", "spans"]
        for batch in batches:
            column = batch.column("text")
            if not model.langs:
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in carried), *unknown(len(column))], names=names)
                continue
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # scores, words, ASCII letters of some rows
            first = 0

            def done(first: int) -> pa.RecordBatch:
                scores, counts, plain = zip(*held, strict=True)
                n = np.concatenate(counts)
                out = label(column.slice(first, len(n)), list(scores), n, np.concatenate(plain))
                return pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(first, len(n)) for f in carried), *out], names=names)

            for _, content, offsets in slices(column):
                total = np.append(0, np.cumsum(ASCII_LETTER[content]))
                content = LOWER[content]
                starts, ends, rows = words(content, offsets, WORD)
                held.append((word_scores(model, content, starts, ends), np.bincount(rows, minlength=len(offsets) - 1), total[offsets[1:]] > total[offsets[:-1]]))
                if sum(s.size for s, *_ in held) > most_cells:
                    yield done(first)
                    first += sum(len(c) for _, c, _ in held)
                    held = []
            if held:
                yield done(first)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried)
    return given.mapInArrow(run, f"{kinds}, lang_pred string, score double, spans array<struct<lang: string, words: long>>")


def accepted(docs: DataFrame, model: Model, *, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents of which a language has at least `least_score` of the words, with that as their language."""
    found = identify(docs, model, id_col=id_col, text_col=text_col, keep_rows=True).where((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    return found.select(*restored(docs, **{lang_col: F.col("lang_pred"), text_col: F.col("text")}))
