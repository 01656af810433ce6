"""Substring dedup: paragraphs by content-defined anchors, MinHash bands, exact verification.

Repeated passages start anywhere in a line, so line feeds don't bound the
paragraphs.  A word whose hash (with the next two) is the least among its
`radius` neighbours on both sides is an anchor, and the `size` words from an
anchor on are a paragraph.  Anchors depend on nearby words only, so copies of a
passage have the same ones inside.  A paragraph's keys are its whole hash and
`bands` bands of two MinHash values over its word 5-grams.  Two values a band
find nearly every paragraph of Jaccard similarity 0.8, and a passage of over 50
words holds several.

For each key a task sends on one leader, the least document, and links the
others to it, so no list of a key is longer than the number of tasks.  Linked
documents are compared whole: paragraphs that share a key are laid on each other
and extended over words that differ, and passages of at least `least_words`
words whose own 5-grams have Jaccard similarity `percent` count.  Where a text
shares a key but no passage around it with the key's leader, the paragraph gets
longer keys, which hold `LONGER` words more in any split of them before and
behind it, and is compared with the leaders of these as well.  What shares a
longer key shares at least `size` + LONGER words, so those comparisons succeed,
and no further round is needed.  The greater document of a pair loses the
passage, so the least copy of each stays.  Documents that passages connect form
components.

Documents are known by the 64-bit hash of their text, so equal texts are one
class, compared once; all but its least doc_id lose the whole text.

Nulls and repeats: a null text has no words; a null id belongs to the class of
its text, after all others; repeated rows are copies; texts of less than
`least_words` words have no passages; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import _STEP, FEW_BYTES, LOWER, NOT_SPACE, U64, bounded, mix, packed, slices, span_hashes, unpacked, words
from .components import connected
from .decontamination import grams
from .jaccard_join import _pack, _unpack
from .prefilter import key_bits, maybe_in
from .storage import BATCH_ROWS, Scratch, carried, restored, whole_row

GRAM = 5
#: A passage of fewer words is not one.  Passages of over 50 words are looked for; a word or two at their ends may have changed.
LEAST_WORDS = 48
#: Words of all documents for each part of the keys that one task merges.
PART_WORDS = 16_000_000
#: Words that a longer key holds besides its paragraph, and the step by which these are split into words before and behind it.
LONGER, SPLIT = 24, 4
_PASSAGE = "x long, x_start int, x_words int, y long, y_start int, y_words int"


def anchors(hashes: np.ndarray, rows: np.ndarray, size: int, radius: int) -> np.ndarray:
    """Places of the first words of paragraphs."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value = grams(hashes, np.arange(len(hashes) - 2), 3)
    low = np.full(len(value) + 2 * radius, ~U64(0))
    low[radius : radius + len(value)] = value
    own = low[radius : radius + n]
    near = low[: len(low) - radius + 1].copy()  # the least of `radius` values from each place on
    for j in range(1, radius):
        np.minimum(near, low[j : j + len(near)], out=near)
    least = (own < near[:n]) & (own <= near[radius + 1 : radius + 1 + n])  # of equal ones the first
    return np.flatnonzero(least & (rows[:n] == rows[size - 1 :]))


def keys(hashes: np.ndarray, at: np.ndarray, size: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """((paragraph, key), (paragraph, 5-gram)) for paragraphs at the places."""
    found = np.empty((len(at), bands + 1), U64)
    every = grams(hashes, np.arange(max(0, len(hashes) - GRAM + 1)), GRAM)
    inside = at[:, None] + np.arange(size - GRAM + 1)
    pieces = every[inside] if len(at) else np.zeros((0, size - GRAM + 1), U64)
    found[:, 0] = grams(hashes, at, size) if len(at) else 0
    if len(at):
        with np.errstate(over="ignore"):
            for band in range(bands):
                both = U64(band + 1)
                for j in (1, 2):
                    both = both * U64(0x9E3779B97F4A7C15) + (pieces * (mix(np.array([2 * band + j], U64)) | U64(1))).min(1)
                found[:, band + 1] = mix(both)
    return found, pieces


def _word_hashes(content: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    content = LOWER[content]
    starts, ends, rows = words(content, offsets, NOT_SPACE)
    return span_hashes(content, starts, ends), rows, starts, ends


def links(named: DataFrame, parts: int, size: int, radius: int, bands: int) -> DataFrame:
    """x, y: texts of which a paragraph shares a key with one of y, the least text of that key; from fp and text."""

    def held(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, their least texts, links to these)."""
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        new = np.append(True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])) if len(key) else np.zeros(0, bool)
        key, fp = key[new], fp[new]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        leader = np.repeat(fp[begin], np.diff(np.append(begin, len(key))))
        apart = fp != leader
        return key[begin], fp[begin], np.unique(np.stack([fp[apart], leader[apart]], 1), axis=0)

    def row(part: int, columns: list[np.ndarray], fps: np.ndarray) -> pa.RecordBatch:
        data = _pack(columns) if len(columns[0]) else b""
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(columns[0])], pa.int64()), pa.array([data], pa.binary()), pa.array([fps.tobytes()], pa.binary())], names=["part", "n_rows", "data", "fps"])

    @bounded
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        have: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, fp, linked = held(*(np.concatenate(c) for c in zip(*have, strict=True)))
            have.clear()
            part = ((key >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
            bound = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(bound)):
                fps, index = np.unique(fp[bound[p] : bound[p + 1]], return_inverse=True)
                yield row(int(p), [key[bound[p] : bound[p + 1]], index.astype(np.uint32)], fps)
            for n in range(0, len(linked), 20_000):
                some = linked[n : n + 20_000]
                yield row(int(mix(some[:1, 0])[0] % U64(parts)), [np.zeros(0, U64)], some)

        for batch in batches:
            fps = batch.column(0).to_numpy().view(U64)
            for first, content, offsets in slices(batch.column(1), FEW_BYTES):
                own = fps[first : first + len(offsets) - 1]
                fresh = np.zeros(len(own), bool)
                for i, x in enumerate(own.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                hashes, rows, _, _ = _word_hashes(content, offsets)
                at = anchors(hashes, rows, size, radius)
                at = at[fresh[rows[at]]] if len(at) else at
                found, _ = keys(hashes, at, size, bands)
                have.append((found.ravel(), np.repeat(own[rows[at]] if len(at) else own[:0], bands + 1)))
                if sum(len(k) for k, _ in have) > 500_000:
                    yield from flush()
        if have:
            yield from flush()

    @bounded
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, linked = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros((0, 2), U64)]
        for batch in batches:
            for rows, data, fps in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                known = np.frombuffer(fps, U64)
                if rows:
                    k, index = _unpack(data, rows, [U64, np.uint32])
                    key.append(k)
                    fp.append(known[index])
                else:
                    linked.append(known.reshape(-1, 2))
        linked.append(held(np.concatenate(key), np.concatenate(fp))[2])
        pairs = np.unique(np.concatenate(linked), axis=0)
        for n in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[n : n + 50_000, i]).view(np.int64)) for i in (0, 1)], names=["x", "y"])

    return named.mapInArrow(scan, "part int, n_rows long, data binary, fps binary").repartitionById(parts, F.col("part")).mapInArrow(merge, "x long, y long")


def _aligned(same: np.ndarray, percent: int, least: int) -> list[tuple[int, int]]:
    """(begin, end) on a diagonal, longest first: stretches of `least` words or more whose 5-grams, place by place, have Jaccard similarity of `percent`; `same` tells where words agree."""
    n = len(same) - GRAM + 1
    if n <= 0:
        return []
    whole = same[:n].copy()  # places where a whole 5-gram agrees
    for j in range(1, GRAM):
        whole &= same[j : j + n]
    change = np.flatnonzero(whole[1:] != whole[:-1]) + 1
    begin = change if not whole[0] else np.append(0, change)
    begin = begin.reshape(-1, 2) if len(begin) % 2 == 0 else np.append(begin, n).reshape(-1, 2)
    if not len(begin):
        return []
    begin, end = begin[:, 0], begin[:, 1] + GRAM - 1
    grams_before = np.concatenate([[0], np.cumsum(end - begin - GRAM + 1)])
    # of N 5-grams M agree: M / (2N - M) is enough where (100 + percent) * M >= 2 * percent * N
    from_ = (100 + percent) * grams_before[:-1] - 2 * percent * begin
    to = (100 + percent) * grams_before[1:] - 2 * percent * (end - GRAM + 1)
    found, open_ = [], [(0, len(begin))]
    while open_:
        low, high = open_.pop()
        if low >= high:
            continue
        best = np.maximum.accumulate(to[low:high][::-1])  # of the stretches that end last
        back = np.searchsorted(best, from_[low:high])
        last = high - 1 - back
        ok = (back < len(best)) & (last >= np.arange(low, high))
        words_of = np.where(ok, end[np.maximum(last, 0)] - begin[low:high], 0)
        i = int(words_of.argmax())
        if words_of[i] < least:
            continue
        found.append((int(begin[low + i]), int(end[last[i]])))
        open_ += [(low, low + i), (int(last[i]) + 1, high)]
    return sorted(found, key=lambda s: s[0] - s[1])


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the sets of 5-grams of two passages are similar enough."""
    a, b = (np.unique(grams(h, np.arange(max(0, len(h) - GRAM + 1)), GRAM)) for h in (x, y))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def common(*args, **kwargs) -> list[tuple[int, int, int, int]]:
    """(start, words, start in y, words in y) of the passages that two texts share, given by the hashes of their words."""
    return compared(*args, **kwargs)[0]


def compared(x: np.ndarray, y: np.ndarray, size: int, radius: int, bands: int, percent: int, least_words: int, of_y: tuple | None = None) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passages as of `common`, shared keys, whether these are whole paragraphs outside all passages, the places in x and in y of their paragraphs)."""
    at_x, at_y = (anchors(h, np.zeros(len(h), np.int64), size, radius) for h in (x, y))
    (key_x, _), (key_y, _) = keys(x, at_x, size, bands), of_y or keys(y, at_y, size, bands)
    order = np.argsort(key_y.ravel(), kind="stable")
    sorted_y = key_y.ravel()[order]
    low, high = (np.searchsorted(sorted_y, key_x.ravel(), side) for side in ("left", "right"))
    times = high - low
    hit = np.repeat(np.arange(len(times)), times)
    other = order[np.repeat(low, times) + np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times)]
    spans: list[tuple[int, int, int, int]] = []
    shifts = set(np.unique(at_x[hit // key_x.shape[1]] - at_y[other // key_x.shape[1]]).tolist())
    near: set[int] = set()
    for least, some in ((size, shifts), (GRAM, near)):  # then the shifts next to those found, for words put in or left out
        for shift in sorted(some):
            a, b = max(0, shift), min(len(x), len(y) + shift)
            found = [(a + s, a + e, a + s - shift, a + e - shift) for s, e in _aligned(x[a:b] == y[a - shift : b - shift], percent, least)] if a < b else []
            spans += found
            if some is shifts and found:
                near |= {shift + n for n in (-2, -1, 1, 2)} - shifts
    merged: list[list[int]] = []
    for span in sorted(set(spans)):
        if merged and span[1] <= merged[-1][1]:
            continue
        if merged and span[0] <= merged[-1][1] + 8:  # words put in or left out between the two
            a, b, c, d = merged[-1][0], span[1], min(merged[-1][2], span[2]), max(merged[-1][3], span[3])
            if d - c <= 2 * (b - a) and _alike(x[a:b], y[c:d], percent):
                merged[-1] = [a, b, c, d]
                continue
        merged.append(list(span))
    merged = [m for m in merged if m[1] - m[0] >= least_words]
    hit = np.flatnonzero(times)
    place, place_y = at_x[hit // key_x.shape[1]], at_y[order[low[hit]] // key_x.shape[1]]
    outside = hit % key_x.shape[1] == 0  # longer keys hold the whole paragraph
    for a, b, _, _ in merged:
        outside &= (place + size // 2 < a) | (place + size // 2 >= b)
    return [(a, b - a, c, d - c) for a, b, c, d in merged], key_x.ravel()[hit], outside, place, place_y


def longer_keys(key: np.ndarray, place: np.ndarray, hashes: np.ndarray, size: int, own: int) -> np.ndarray:
    """(paragraph, longer key) for keys of paragraphs at the places of a text; beyond its ends stands what no other text has."""
    ends = mix(np.array([own], U64) + np.arange(2 * LONGER, dtype=U64))
    wide = np.concatenate([ends[:LONGER], hashes, ends[LONGER:]])
    blocks = np.arange(0, LONGER, SPLIT)
    with np.errstate(over="ignore"):
        # hashes of SPLIT words each, from the paragraph outwards, and of the first 0, 1, 2, ... of these together
        outward = [grams(wide, (place[:, None] + LONGER + at).ravel(), SPLIT).reshape(len(key), -1) for at in (-SPLIT - blocks, size + blocks)]
        summed = [np.concatenate([np.zeros((len(key), 1), U64), np.cumsum(h * _STEP[n : n + len(blocks)], axis=1, dtype=U64)], axis=1) for h, n in zip(outward, (0, len(blocks)), strict=True)]
        return mix(key[:, None] + summed[0] + summed[1][:, ::-1])


def _unsigned(column: str) -> Column:
    """An order of 64-bit values as unsigned ones, which is that of the leaders."""
    return F.col(column).bitwiseXOR(F.lit(-(1 << 63)))


def verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, settings: tuple, longer: bool, most: int = 64) -> DataFrame:
    """The passages that x and y of each pair share; and, with `longer`, longer keys of x and of y for keys that they share outside all passages."""
    size, radius, bands, percent, least_words = settings
    pairs = scratch.keep(pairs, "pairs")
    many = scratch.keep(pairs.groupBy("y").agg((F.count("*") / most).cast("int").alias("deal")), "many")
    dealt = scratch.keep(pairs.join(many, "y").select("x", "y", F.pmod(F.xxhash64("x"), F.col("deal") + 1).cast("int").alias("run")), "dealt")
    ours = dealt.select("y", "run").distinct().select("y", "run", F.lit(0).alias("other"), F.col("y").alias("fp"))
    met = ours.unionByName(dealt.select("y", "run", F.lit(1).alias("other"), F.col("x").alias("fp"))).join(texts, "fp")
    met = met.select("y", "run", "other", "fp", "text").repartition("y", "run").sortWithinPartitions("y", "run", "other", "fp")

    @bounded
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, mine, of_mine, told = None, np.zeros(0, U64), None, set()
        for batch in batches:
            y, other, fp = (batch.column(i).to_numpy() for i in (0, 2, 3))
            out: list[tuple] = []
            for row0, content, offsets in slices(unpacked(batch.column(4)), FEW_BYTES):
                hashes, rows, _, _ = _word_hashes(content, offsets)
                bound = np.searchsorted(rows, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    at, own = row0 + i, hashes[bound[i] : bound[i + 1]]
                    if not other[at]:
                        whose, mine, told = y[at], own.copy(), set()
                        of_mine = keys(mine, anchors(mine, np.zeros(len(mine), np.int64), size, radius), size, bands)
                    elif whose == y[at]:
                        x = int(fp[at])
                        spans, key, outside, place, place_y = compared(own, mine, size, radius, bands, percent, least_words, of_mine)
                        out += [(x, a, n, int(whose), b, m, None) for a, n, b, m in spans]
                        if longer and outside.any():
                            more = longer_keys(key[outside], place[outside], own, size, x & (1 << 64) - 1)
                            out.append((x, None, None, int(whose), None, None, np.unique(more).view(np.int64).tolist()))
                            new = np.array([k not in told for k in key[outside].tolist()], bool)
                            if new.any():  # those of the leader too, once
                                told.update(key[outside].tolist())
                                more = longer_keys(key[outside][new], place_y[outside][new], mine, size, int(whose) & (1 << 64) - 1)
                                out.append((int(whose), None, None, int(whose), None, None, np.unique(more).view(np.int64).tolist()))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (*(pa.int64(), pa.int32(), pa.int32()) * 2, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["x", "x_start", "x_words", "y", "y_start", "y_words", "longer"])

    return met.mapInArrow(compare, f"{_PASSAGE}, longer array<long>")


def repeated(docs: DataFrame, scratch: Scratch, *, size: int = 24, radius: int = 6, bands: int = 3, percent: int = 80, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, fp, n_words; passages: x, x_start, x_words, y, y_start, y_words with y the text whose copy stays)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.xxhash64(text).alias("fp"), text.alias("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("fp"), F.md5(text.cast("binary")).alias("check"), F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long").alias("n_words"))
    rows = scratch.keep(rows, "rows")
    # a task merges the keys of one part in memory, so the parts grow with the words
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows.agg(F.sum("n_words")).first()[0] or 0) // PART_WORDS))
    pairs = scratch.keep(links(named, parts, size, radius, bands), "links")
    pairs = scratch.keep(pairs.distinct(), "distinct")
    needed = scratch.keep(pairs.select(F.col("x").alias("fp")).unionByName(pairs.select(F.col("y").alias("fp"))).distinct(), "needed")

    wanted = spark.sparkContext.broadcast(key_bits(needed))

    @bounded
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keep, fps = [], batch.column(0).to_numpy()
            for i in np.flatnonzero(maybe_in(wanted.value, fps)).tolist():
                if (x := int(fps[i])) not in seen:
                    seen.add(x)
                    keep.append(i)
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), packed(some.column(1))], names=["fp", "text"])

    texts = named.mapInArrow(first, "fp long, text binary").join(needed, "fp", "left_semi").dropDuplicates(["fp"])
    texts = scratch.keep(texts, "texts")
    settings = (size, radius, bands, percent, least_words)
    met = scratch.keep(verified(pairs, texts, scratch, settings, True), "met")
    # texts that share a key but no passage with its leader are compared with the leaders of longer keys
    left = met.where("longer is not null").select("x", (F.col("x") != F.col("y")).alias("asks"), F.explode("longer").alias("key"))
    leaders = left.groupBy("key").agg(F.min(F.struct(_unsigned("x"), "x"))["x"].alias("y"), F.max("asks").alias("asked"), F.max("x").alias("most"), F.min("x").alias("least"))
    leaders = scratch.keep(leaders.where("asked and most <> least").select("key", "y"), "leaders")
    again = left.join(leaders, "key").where("x <> y").select("x", "y").distinct().join(pairs, ["x", "y"], "left_anti")
    again = scratch.keep(again, "again")
    found = met.where("longer is null").drop("longer")
    if not again.isEmpty():
        found = found.unionByName(scratch.keep(verified(again, texts, scratch, settings, False).drop("longer"), "met-again"))
    found = scratch.keep(found.distinct(), "found")
    scratch.drop("links", "distinct", "needed", "texts", "pairs", "dealt", "many", "met", "leaders", "again", *[n for n in scratch.paths if n == "met-again"])
    return rows, found


def find(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, start_word, words, kept_doc_id, component_id, removed: one row for each repeated passage of each document.

    A passage that stays is listed once too, with kept_doc_id its own.  Of
    equal texts all rows but one are listed as removed whole, also where they
    have equal ids or none.
    """
    scratch = Scratch(docs.sparkSession)
    rows, found = repeated(docs, scratch, **settings)
    least = settings.get("least_words", LEAST_WORDS)
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.max("n_words").alias("n_words"))
    classes = scratch.keep(classes, "classes")
    groups = scratch.keep(connected(found.select("x", "y"), scratch, "groups"), "groups")
    # the text that a passage is compared with may lose it in its turn to a lesser one
    lost = found.select(F.col("x").alias("fp"), F.col("x_start").alias("start_word"), F.col("x_words").alias("words"), "y", "y_start", "y_words")
    again = found.select(F.col("x").alias("z"), F.col("x_start").alias("z_start"), F.col("x_words").alias("z_words"), F.col("y").alias("next"))
    shared = F.least(F.col("y_start") + F.col("y_words"), F.col("z_start") + F.col("z_words")) - F.greatest("y_start", "z_start")
    met = scratch.keep(lost.join(again, (F.col("y") == F.col("z")) & (2 * shared > F.col("y_words")), "left"), "met")
    lost = met.groupBy("fp", "start_word", "words").agg(F.min(F.coalesce("next", "y")).alias("other")).withColumn("removed", F.lit(True))
    kept = met.where("next is null").select(F.col("y").alias("fp"), F.col("y_start").alias("start_word"), F.col("y_words").alias("words"), F.col("y").alias("other"), F.lit(False).alias("removed")).distinct()
    copies = classes.where((F.col("n") > 1) & (F.col("n_words") >= least)).select("fp", F.lit(0).alias("start_word"), F.col("n_words").cast("int").alias("words"), F.col("fp").alias("other"), F.lit(False).alias("removed"))
    spans = lost.unionByName(kept).unionByName(copies)
    spans = spans.join(classes.select(F.col("fp").alias("other"), F.col("first_id").alias("other_id")), "other")
    spans = spans.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    spans = scratch.keep(spans.join(classes.select("fp", "first_id", "n"), "fp"), "spans")
    ids = scratch.keep(spans.groupBy("component").agg(F.min("first_id").alias("component_id")), "component_ids")
    spans = scratch.keep(spans.join(ids, "component"), "known")
    own = spans.select(F.col("first_id").alias("doc_id"), "start_word", "words", F.col("other_id").alias("kept_doc_id"), "component_id", "removed")
    whole = spans.where("n > 1").groupBy("fp").agg(F.first("first_id").alias("first_id"), F.first("component_id").alias("component_id"))
    whole = scratch.keep(whole, "whole")
    rows = rows.where(F.col("n_words") >= least).groupBy("fp", "doc_id", "n_words").agg(F.count("*").cast("int").alias("n")).join(whole, "fp")
    rows = rows.withColumn("n", F.col("n") - F.col("doc_id").eqNullSafe(F.col("first_id")).cast("int")).where("n > 0")
    whole = rows.withColumn("n", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
    whole = whole.select("doc_id", F.lit(0).alias("start_word"), F.col("n_words").cast("int").alias("words"), F.col("first_id").alias("kept_doc_id"), "component_id", F.lit(True).alias("removed"))
    return own.unionByName(whole)


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_left: int = 10, **settings) -> DataFrame:
    """The documents without the passages that stay elsewhere; one with fewer than `least_left` words after a removal goes.

    Of equal texts (by two hashes, of 64 and 128 bits) one row of the least id
    stays, or one of those without an id where none has any.
    """
    scratch = Scratch(docs.sparkSession)
    rows, found = repeated(docs, scratch, id_col=id_col, text_col=text_col, **settings)
    cuts = found.groupBy(F.col("x").alias("fp")).agg(F.collect_set(F.struct(F.col("x_start").alias("start"), F.col("x_words").alias("words"))).alias("cuts"))
    cuts = scratch.keep(cuts, "cuts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = docs.select(F.xxhash64(text).alias("fp"), whole_row(docs, text_col).alias("row"), F.col(text_col).alias("text"))
    copies = rows.groupBy("fp", "check").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.max("n_words").alias("n_words"))
    copies = copies.where((F.col("n") > 1) & (F.col("n_words") >= settings.get("least_words", LEAST_WORDS))).groupBy("fp").agg(F.collect_list(F.struct("check", "first_id")).alias("firsts"))
    known = scratch.keep(copies.join(cuts, "fp", "full"), "known")  # one join of the texts
    bits = docs.sparkSession.sparkContext.broadcast(key_bits(known.select("fp")))

    def marked(doubt: bool) -> DataFrame:
        """The texts that may be on the exact list, or the others."""

        @bounded
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, BATCH_ROWS):
                    some = batch.slice(first, BATCH_ROWS)
                    yield some.filter(pa.array(maybe_in(bits.value, some.column(0).to_numpy()) == doubt))

        return full.mapInArrow(run, full.schema)

    # texts that surely lose nothing stay where they are; the others meet the exact list
    open_rows = marked(True).withColumn("own", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    joined = open_rows.join(known, "fp", "left").withColumn("first", F.get(F.filter("firsts", lambda f: f["check"] == F.col("own")), F.lit(0)))
    single = joined.where("first is null").select("row", "text", "cuts")
    # one row of each group of copies stays, also of those with equal ids
    stay = joined.where(F.col("first").isNotNull() & carried(docs, id_col).eqNullSafe(F.col("first.first_id"))).dropDuplicates(["own"])
    # sent on, or a task would hold the worker that marks and the one that cuts at once
    joined = single.unionByName(stay.select("row", "text", "cuts")).hint("rebalance")

    @bounded
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, left = [], []
            cuts = batch.column(2).to_pylist()
            for i, spans in enumerate(cuts):
                if not spans:
                    out.append(batch.column(1)[i].as_py())
                    left.append(-1)
                    continue
                data = batch.column(1)[i].as_py().encode()
                content = np.frombuffer(data, np.uint8)
                starts, ends, _ = words(content, np.array([0, len(content)]), NOT_SPACE)
                gone = np.zeros(len(starts) + 1, np.int64)
                for s in spans:
                    gone[s["start"]] += 1
                    gone[s["start"] + s["words"]] -= 1
                stay = np.cumsum(gone[:-1]) == 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], stay, [False]]).astype(np.int8))).reshape(-1, 2)
                out.append(b" ".join(data[starts[a] : ends[b - 1]] for a, b in edges).decode())
                left.append(int(stay.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(left, pa.int64())], names=["row", "text", "left"])

    done = joined.mapInArrow(cut, T.StructType([*joined.schema.fields[:2], T.StructField("left", T.LongType())])).where((F.col("left") < 0) | (F.col("left") >= least_left))
    whole = marked(False).select("row", "text")
    return done.select("row", "text").unionByName(whole).select(*restored(docs, **{text_col: F.col("text")}))
