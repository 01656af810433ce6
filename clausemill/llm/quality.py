"""Quality rules from the frequency of lines across the documents of a host.

A line counts by its words in lower case (A-Z), so spacing and case do not
tell lines apart.  A line that occurs in more than `most_docs` documents of a
host and in more than `most_share` of them is boilerplate there and goes.  A
document that thereby loses all but `least_words` words, or all but
`least_share` of its words, is depleted and rejected.

Nulls and repeats: a null text has no words and fails the base rules; a null
host is a host of its own; rows of one id count once towards a line's
documents, rows without an id count each; every row has its own result; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _P, _P_INVERSE, LOWER, NOT_SPACE, U64, _bytes_in, _power, mix, shingles, slices, span_hashes, words
from .storage import Scratch

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
NEWLINE = _bytes_in((0x0A, 0x0A))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags))
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many hold the same (row, key), for each."""
    if not len(key):
        return np.zeros(0, np.int64)
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    begin = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])))
    times = np.diff(np.append(begin, len(k)))
    out = np.empty(len(k), np.int64)
    out[order] = np.repeat(times, times)
    return out


def measure(content: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(statistics of each row, and row, hash and words of each distinct normalised line with a word)."""
    n_rows = len(offsets) - 1
    starts, ends, rows = words(content, offsets, NOT_SPACE)
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    stats = {"n_words": np.diff(first)}
    inside = NOT_SPACE[content]
    stats["word_chars"] = _per_row(inside & ((content & 0xC0) != 0x80), offsets)
    stats["n_symbols"] = _per_row(SYMBOL[content], offsets)

    # lines: from the start of a row or behind a line feed, to the next
    feeds = np.flatnonzero(NEWLINE[content])
    begin = np.union1d(offsets[:-1][np.diff(offsets) > 0], feeds + 1)
    begin = begin[begin < len(content)]
    line_of = np.searchsorted(begin, starts, "right") - 1
    line, w0 = np.unique(line_of, return_index=True)
    w1 = np.append(w0[1:], len(starts))
    line_row = rows[w0]
    line_start = begin[line]
    bound = np.searchsorted(feeds, line_start)
    line_end = np.append(feeds, len(content))[bound] if len(line) else line_start
    line_end = np.minimum(line_end, offsets[line_row + 1]) if len(line) else line_end
    whole = span_hashes(content, line_start, line_end)
    same = _repeats(whole, line_row)
    stats["n_dup_lines"] = np.bincount(line_row, minlength=n_rows) - np.rint(np.bincount(line_row, weights=1 / same, minlength=n_rows) if len(same) else np.zeros(n_rows)).astype(np.int64)

    exact = span_hashes(content, starts, ends)
    windows = np.flatnonzero(rows[: max(0, len(rows) - 2)] == rows[2:])
    key, key_row = shingles(exact, rows, 3, n_rows)
    full = np.diff(first)[key_row] >= 3 if len(key) else np.zeros(0, bool)
    often = windows[_repeats(key[full], key_row[full]) > 1]
    change = np.zeros(len(rows) + 1, np.int64)
    np.add.at(change, often, 1)
    np.add.at(change, often + 3, -1)
    stats["n_repeat_words"] = _per_row(np.cumsum(change[:-1]) > 0, first)

    low = span_hashes(LOWER[content], starts, ends)
    with np.errstate(over="ignore"):
        total = np.zeros(len(low) + 1, U64)
        np.cumsum(low * _power(_P, len(low)), out=total[1:])
        norm = mix((total[w1] - total[w0]) * _power(_P_INVERSE, len(low) + 1)[w0] + (w1 - w0).astype(U64))
    order = np.lexsort((norm, line_row))
    norm, norm_row, norm_words = norm[order], line_row[order], (w1 - w0)[order]
    new = np.flatnonzero(np.append(True, (norm[1:] != norm[:-1]) | (norm_row[1:] != norm_row[:-1]))) if len(norm) else np.zeros(0, np.int64)
    sums = np.add.reduceat(norm_words, new) if len(new) else norm_words
    return stats, norm_row[new], norm[new], sums


def judge(docs: DataFrame, *, most_docs: int = 20, most_share: float = 0.01, least_words: int = 50, least_share: float = 0.3, least_base_words: int = 50, most_repeated: int = 50, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the statistics, removed_words, base_failed, kept of every row."""
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\x00")).alias("host"), F.col(text_col).alias("text"))
    id_type = named.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in STATS]
            counts, hashes, sizes = [], [], []
            for _, content, offsets in slices(batch.column(2)):
                stats, row, norm, sums = measure(content, offsets)
                for held, name in zip(found, STATS, strict=True):
                    held.append(stats[name])
                counts.append(np.bincount(row, minlength=len(offsets) - 1))
                hashes.append(norm.view(np.int64))
                sizes.append(sums)
            if not counts:
                continue
            at = pa.array(np.append(0, np.cumsum(np.concatenate(counts))), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(c), pa.int64())) for c in (hashes, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.concatenate(c), pa.int64()) for c in found), *lists], names=["doc_id", "host", *STATS, "lines", "sizes"])

    measured = named.mapInArrow(scan, f"doc_id {id_type}, host string, {', '.join(f'{s} long' for s in STATS)}, lines array<long>, sizes array<long>")
    measured = scratch.keep(measured.withColumn("uid", F.monotonically_increasing_id()), "measured")
    lines = measured.select("uid", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("l")).select("uid", "host", F.col("l.lines").alias("line"), F.col("l.sizes").alias("words"))
    hosts = measured.groupBy("host").agg(F.count("*").alias("docs"))
    # rows bound documents from above, so few lines need their documents told apart
    many = scratch.keep(lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > most_docs).select("host", "line"), "many")
    named_rows = measured.select("uid", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\x00"), F.col("uid"))).alias("document"))
    repeats = scratch.keep(named_rows.groupBy("document").agg(F.count("*").alias("n"), F.min("uid").alias("first")).where("n > 1").select("document", "first"), "repeats")
    # a repeated document stands under its first row
    first_of = named_rows.join(repeats, "document").select("uid", "first")
    whose = lines.join(many, ["host", "line"]).join(first_of, "uid", "left").select("host", "line", F.coalesce("first", "uid").alias("document"))
    often = whose.distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > most_docs)
    often = scratch.keep(often.join(hosts, "host").where(F.col("n") > most_share * F.col("docs")).select("host", "line"), "often")
    removed = lines.join(often, ["host", "line"]).groupBy("uid").agg(F.sum("words").alias("removed_words"))
    out = measured.drop("lines", "sizes").join(removed, "uid", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < least_base_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return out.select("doc_id", *STATS, "removed_words", failed.alias("base_failed"), (~failed & (left >= least_words) & (left >= least_share * F.col("n_words"))).alias("kept"))
