"""N-gram Jaccard join: T-occurrence search over shingle sets, spread over the cluster.

A document whose set holds n shingles links only with sets that share at least
T = ceil(percent * n / 100) of them.  As in DivideSkip, its T - c longest
inverted lists are set aside as long ones, so every partner must occur in c
of the remaining n - T + c short lists (c = `least_short`, or T where that is
less; of two documents the lesser c holds).  The short lists are merged by
shuffled sorted runs; the partners found there often enough are then probed for
in the long lists by binary search in sorted sets, and those reaching the
required overlap stay.

Lists are ordered by length, as counted over the whole corpus, for shingles in
at least `heavy` documents; the rest order by hash.  Any one order gives whole
results; this one keeps frequent passages out of the short lists.  The table
of long lists that the executors get holds at most `most_heavy` entries (the
longest ones), each 8 bytes.

Documents with equal sets form one class, which takes part once.  Within lists,
no pairs of members are formed at first: each class is compared with the one
central class that shares most of its short lists.  Only pairs that are still
in different components after that are compared as well, so a group of near
copies costs about one comparison a member, and no link that joins two
components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import FEW_BYTES, LOWER, NOT_SPACE, U64, bounded, mix, packed, row_sums, shingles, slices, span_hashes, unpacked, words
from .components import connected
from .prefilter import key_bits, maybe_in
from .storage import BATCH_ROWS, Scratch, carried, restored, whole_row

#: Shingles of all documents for each part that one task merges.
PART_SHINGLES = 8_000_000
POSTING = "shingle long, fp long, n int, pos int, light int"
_KINDS = {"shingle": U64, "fp": U64, "n": np.uint32, "pos": np.uint32, "light": np.uint32}


def row_sets(content: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, row): the sets of all rows, ordered by row and shingle."""
    content = LOWER[content]
    starts, ends, rows = words(content, offsets, NOT_SPACE)
    value, row = shingles(span_hashes(content, starts, ends), rows, k, len(offsets) - 1)
    first = np.argsort(value)
    order = first[np.argsort(row[first].astype(np.uint16) if len(offsets) < 1 << 16 else row[first], kind="stable")]
    value, row = value[order], row[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
    return value, row


def fingerprints(value: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit fingerprint) of each row's set; 0 for an empty one."""
    size = np.bincount(row, minlength=n_rows)
    with np.errstate(over="ignore"):
        return size, np.where(size > 0, mix(row_sums(mix(value), row, n_rows) + size.astype(U64)), U64(0))


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of unsigned integers as compressed planes of bytes; the first is in order and kept as steps."""
    first = columns[0].copy()
    first[1:] -= columns[0][:-1]
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in (first, *columns[1:]))
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, rows: int, kinds: list) -> list[np.ndarray]:
    planes, at, columns = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        columns.append(np.ascontiguousarray(planes[at : at + rows * width].reshape(width, rows).T).view(kind).ravel())
        at += rows * width
    columns[0] = np.cumsum(columns[0], dtype=columns[0].dtype)
    return columns


def _blocks(part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each part: its rows, ordered by the first column, packed."""
    order = np.lexsort((columns[0], part))
    part, columns = part[order], [c[order] for c in columns]
    found, begin = np.unique(part, return_index=True)
    ends = np.append(begin, len(part))[1:]
    data = [_pack([c[a:b] for c in columns]) for a, b in zip(begin, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(ends - begin, pa.int64()), pa.array(data, pa.binary())], names=["part", "n_rows", "data"])


_BLOCKS = "part int, n_rows long, data binary"


def _new(fp: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows are the first of their class in this task; empty sets are not."""
    fresh = np.zeros(len(fp), bool)
    for i, x in enumerate(fp.tolist()):
        if x and x not in seen:
            seen.add(x)
            fresh[i] = True
    return fresh


def _text(docs: DataFrame) -> DataFrame:
    return docs.select("text")


def heavy_lists(docs: DataFrame, k: int, parts: int, heavy: int, most_heavy: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(upper halves of hashes, their document counts) of the longest lists, in order.

    Counts are over all documents, copies within a task once.  Tasks send their
    counts as sorted runs, not row by row.
    """

    @bounded
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            bucket, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return _blocks((bucket.astype(U64) * U64(parts) >> U64(32)).astype(np.int32), [bucket, times.astype(np.uint32)])

        for batch in batches:
            for _, content, offsets in slices(batch.column(0), FEW_BYTES):
                value, row = row_sets(content, offsets, k)
                fresh = _new(fingerprints(value, row, len(offsets) - 1)[1], seen)
                held.append((value[fresh[row]] >> U64(32)).astype(np.uint32))
                if sum(map(len, held)) > 2_000_000:
                    yield flush()
        if held:
            yield flush()

    @bounded
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, times = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for batch in batches:
            for rows, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for held, column in zip((bucket, times), _unpack(data, rows, [np.uint32, np.uint32]), strict=True):
                    held.append(column)
        all_buckets = np.concatenate(bucket)
        order = np.argsort(all_buckets, kind="stable")
        all_buckets, all_times = all_buckets[order], np.concatenate(times)[order].astype(np.int64)
        begin = np.flatnonzero(np.append(True, all_buckets[1:] != all_buckets[:-1])) if len(all_buckets) else np.zeros(0, np.int64)
        sums = np.add.reduceat(all_times, begin) if len(begin) else all_times
        much = sums >= heavy
        yield pa.RecordBatch.from_arrays([pa.array(all_buckets[begin[much]], pa.int64()), pa.array(sums[much], pa.int64())], names=["bucket", "df"])

    counted = _text(docs).mapInArrow(count, _BLOCKS).repartitionById(parts, F.col("part")).mapInArrow(total, "bucket long, df long")
    counted = scratch.keep(counted, "heavy")
    longest = counted.groupBy("df").count().orderBy(F.desc("df"))
    least, taken = 1 << 62, 0
    for df, lists in longest.limit(1 << 16).collect():  # distinct lengths, the longest first
        if taken + lists > most_heavy:
            break
        least, taken = df, taken + lists
    found = counted.where(F.col("df") >= least).toPandas().sort_values("bucket")
    return found["bucket"].to_numpy().astype(np.uint32), found["df"].to_numpy().astype(np.uint32)


def short_lists(docs: DataFrame, k: int, percent: int, least_short: int, parts: int, heavy: tuple[np.ndarray, np.ndarray], salt: int = 2048) -> DataFrame:
    """Postings of the short lists that hold two classes or more.

    A long list that is still among some documents' short ones is dealt over
    several tasks of about `salt` postings each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    @bounded
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, df = shared.value
        seen: set[int] = set()
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            return _blocks(columns[0].astype(np.int32), columns[1:])

        for batch in batches:
            for _, content, offsets in slices(batch.column(0), FEW_BYTES):
                value, row = row_sets(content, offsets, k)
                size, fp = fingerprints(value, row, len(offsets) - 1)
                fresh = _new(fp, seen)[row]
                value, row = value[fresh], row[fresh]
                if not len(value):
                    continue
                top = (value >> U64(32)).astype(np.uint32)
                length = np.zeros(len(value), np.uint32)
                if len(bucket):
                    at = np.minimum(np.searchsorted(bucket, top), len(bucket) - 1)
                    length = np.where(bucket[at] == top, df[at], np.uint32(0))
                order = np.lexsort((value, length, row))
                value, row, length = value[order], row[order], length[order]
                begin = np.searchsorted(row, np.arange(len(offsets)))
                pos = np.arange(len(row)) - begin[row]
                n = size[row]
                needed = -(-percent * n // 100)
                short = pos < n - needed + np.minimum(least_short, needed)
                light = np.bincount(row, weights=length == 0, minlength=len(offsets) - 1)[row]
                value, row, pos, n, light, length = (c[short] for c in (value, row, pos, n, light, length))
                with np.errstate(over="ignore"):
                    dealt = value + mix(fp[row] % (1 + length // np.uint32(salt)).astype(U64) + U64(1)) * (length > 0).astype(U64)
                part = (mix(dealt) >> U64(32)) * U64(parts) >> U64(32)
                held.append([part, value, fp[row], n.astype(np.uint32), pos.astype(np.uint32), light.astype(np.uint32)])
                if sum(len(h[0]) for h in held) > 700_000:
                    yield flush()
        if held:
            yield flush()

    @bounded
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = []
        for batch in batches:
            for rows, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs.append(_unpack(data, rows, list(_KINDS.values())))
        if not runs:
            return
        columns = [np.concatenate(c) for c in zip(*runs, strict=True)]
        order = np.lexsort((columns[1], columns[0]))
        columns = [c[order] for c in columns]
        value, fp = columns[:2]
        new = np.append(True, (value[1:] != value[:-1]) | (fp[1:] != fp[:-1]))
        columns = [c[new] for c in columns]
        value = columns[0]
        begin = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        length = np.diff(np.append(begin, len(value)))
        keep = np.repeat(length > 1, length)
        bucket, _ = shared.value
        if len(bucket):
            top = (value >> U64(32)).astype(np.uint32)
            keep |= bucket[np.minimum(np.searchsorted(bucket, top), len(bucket) - 1)] == top
        columns = [c[keep] for c in columns]
        for at in range(0, len(columns[0]), 50_000):
            part = [c[at : at + 50_000] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U64 else c.astype(np.int32)) for c in part], names=list(_KINDS))

    return _text(docs).mapInArrow(post, _BLOCKS).repartitionById(parts, F.col("part")).mapInArrow(merge, POSTING)


def class_texts(docs: DataFrame, k: int, bits: np.ndarray) -> DataFrame:
    """fp, text of the first document of each class in each task, but for most of those that the bitmap tells are not wanted."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @bounded
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for row0, content, offsets in slices(batch.column(0), FEW_BYTES):
                value, row = row_sets(content, offsets, k)
                fp = fingerprints(value, row, len(offsets) - 1)[1]
                at = np.flatnonzero(_new(fp, seen) & maybe_in(shared.value, fp.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), packed(batch.column(0).take(pa.array(at + row0)))], names=["fp", "text"])

    return _text(docs).mapInArrow(first, "fp long, text binary")


def linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch, name: str, most: int = 64) -> DataFrame:
    """Those (a, b) whose sets reach the similarity.

    Texts are read again and only those of classes in a pair are sent.  Each b
    goes along with the text of its a, by runs of about `most` partners of one
    a, and its members are searched for in a's sorted set.
    """
    pairs = scratch.keep(pairs, f"{name}-pairs")
    many = scratch.keep(pairs.groupBy("a").agg((F.count("*") / most).cast("int").alias("deal")), f"{name}-many")
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("deal") + 1).cast("int").alias("run"))
    dealt = scratch.keep(dealt, f"{name}-dealt")
    ours = dealt.select("a", "run").distinct().select("a", "run", F.lit(0).alias("other"), F.col("a").alias("fp"))
    theirs = dealt.select("a", "run", F.lit(1).alias("other"), F.col("b").alias("fp"))
    # one text a class, though each task that has one sends it; the aggregate leaves them where the join needs them
    texts = class_texts(docs, k, key_bits(pairs.select(F.explode(F.array("a", "b"))))).dropDuplicates(["fp"])
    met = ours.unionByName(theirs).join(texts, "fp").select("a", "run", "other", F.col("fp").alias("b"), "text")
    met = met.repartition("a", "run").sortWithinPartitions("a", "run", "other", "b")

    @bounded
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, mine = None, np.zeros(0, U64)
        for batch in batches:
            a, other, b = (batch.column(i).to_numpy() for i in (0, 2, 3))
            found = []
            for row0, content, offsets in slices(unpacked(batch.column(4)), FEW_BYTES):
                value, row = row_sets(content, offsets, k)
                begin = np.searchsorted(row, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    at, theirs = row0 + i, value[begin[i] : begin[i + 1]]
                    if not other[at]:
                        whose, mine = a[at], theirs
                    elif whose == a[at] and len(mine):
                        both = int((mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs).sum())
                        if 100 * both >= percent * (len(mine) + len(theirs) - both):
                            found.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(a[found], pa.int64()), pa.array(b[found], pa.int64())], names=["a", "b"])

    return met.mapInArrow(probe, "a long, b long")


def _solved(named: DataFrame, scratch: Scratch, k: int, percent: int, heavy: int, most_heavy: int, least_short: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, fp of every row; node, component of every class that links)."""
    spark = named.sparkSession
    id_type = named.schema["doc_id"].dataType.simpleString()

    @bounded
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(*row_sets(content, offsets, k), len(offsets) - 1) for _, content, offsets in slices(batch.column(1), FEW_BYTES)]
            if found:
                size, fp = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "n_shingles", "fp"])

    rows = scratch.keep(named.mapInArrow(sets, f"doc_id {id_type}, n_shingles long, fp long"), "rows")
    # a task merges the runs of one part in memory, so the parts grow with the shingles
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows.agg(F.sum("n_shingles")).first()[0] or 0) // PART_SHINGLES))
    posted = short_lists(named, k, percent, least_short, parts, heavy_lists(named, k, parts, heavy, most_heavy, scratch))
    posted = scratch.keep(posted, "posted")

    def least(*n: str) -> Column:
        """In how many short lists sets of these sizes must meet."""
        return F.least(*(F.least(F.lit(least_short), F.ceil(F.col(x) * percent / 100)) for x in n), F.lit(least_short))

    needed = posted.groupBy("fp").agg(F.count("*").alias("met"), F.first("n").alias("n")).where(F.col("met") >= least("n"))
    enough = named.sparkSession.sparkContext.broadcast(key_bits(scratch.keep(needed.select("fp"), "needed")))

    def strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(enough.value, batch.column(1).to_numpy())))

    # classes that meet too seldom have no partner; the bitmap leaves nearly all of them out
    lists = scratch.keep(posted.mapInArrow(strong, POSTING), "lists")

    centre = scratch.keep(lists.groupBy("shingle").agg(F.min(F.struct((F.col("light") / F.col("n")).alias("share"), "fp", "n")).alias("c")), "centre")
    like = F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent
    votes = lists.join(centre, "shingle").where((F.col("fp") != F.col("c.fp")) & like).groupBy("fp", F.col("c.fp").alias("centre"), "n", F.col("c.n").alias("m")).count().where(F.col("count") >= least("n", "m"))
    star = votes.groupBy("fp").agg(F.max(F.struct("count", "centre")).alias("best")).select(F.col("best.centre").alias("a"), F.col("fp").alias("b"))
    first = scratch.keep(linked(star, named, k, percent, scratch, "star"), "first")

    groups = scratch.keep(connected(first, scratch, "groups"), "grouped")
    labelled = lists.join(groups, F.col("fp") == F.col("node"), "left").withColumn("group", F.coalesce("component", "fp")).drop("node", "component")
    labelled = scratch.keep(labelled, "labelled")
    mixed = labelled.groupBy("shingle").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.min(F.struct((F.col("light") / F.col("n")).alias("share"), "fp", "group"))["group"].alias("main"))
    mixed = scratch.keep(mixed.where("low <> high").select("shingle", "main"), "mixed")
    apart = scratch.keep(labelled.join(mixed, "shingle"), "apart")
    apart = apart.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100))  # the first common shingle is among these
    x, y = apart.where("group <> main").alias("x"), apart.alias("y")
    most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))  # what sets can share from their first common shingle on
    could = (most * 100 >= (F.col("x.n") + F.col("y.n") - most) * percent) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    once = (F.col("y.group") == F.col("y.main")) | (F.col("x.fp") < F.col("y.fp"))
    rest = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.group") != F.col("y.group")) & could & once)
    rest = rest.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()
    second = scratch.keep(linked(rest, named, k, percent, scratch, "rest"), "second")

    final = scratch.keep(connected(first.unionByName(second), scratch, "final"), "final")
    scratch.drop("heavy", "posted", "lists", "needed", "labelled", "apart", "mixed", "centre")
    return rows, final


def near_components(docs: DataFrame, *, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text", heavy: int = 16, most_heavy: int = 1 << 20, least_short: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) of every row.

    Nulls and repeats: a text that is null or without words has no shingles and
    stays alone with its own id; repeated rows are equal texts, thus linked; a
    null id takes part in links and gets the least id of its component, null
    where that has none; an empty table gives no rows.  Classes are told apart
    by a 64-bit fingerprint of their sets and their sizes.
    """
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, final = _solved(named, scratch, k, percent, heavy, most_heavy, least_short)
    classes = rows.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = classes.join(final, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    classes = scratch.keep(classes, "classes")
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    members = scratch.keep(classes.join(scratch.keep(ids, "ids"), "component").select("fp", "component_id"), "members")
    out = rows.where("n_shingles > 0").join(members, "fp").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", heavy: int = 16, most_heavy: int = 1 << 20, least_short: int = 8) -> DataFrame:
    """The documents without near copies: of each component the row of least id stays (null last), of equal ones any.

    Documents without words link with nothing, so all of them stay.
    """
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, final = _solved(named, scratch, k, percent, heavy, most_heavy, least_short)
    classes = rows.where("n_shingles > 0").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"))
    classes = classes.join(final, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    best = scratch.keep(classes.groupBy("component").agg(F.min(F.struct("least", "fp")).alias("b")).select("b.fp", F.col("b.least.doc_id").alias("stay")), "best")

    # rows whose class and id are surely none of those that go stay where they are; the others meet the exact list
    name = F.col("fp").bitwiseXOR(F.xxhash64("doc_id"))
    goes = rows.where("n_shingles > 0").join(best.withColumnRenamed("fp", "bfp"), (F.col("fp") == F.col("bfp")) & F.col("doc_id").eqNullSafe(F.col("stay")), "left")
    repeats = rows.where("n_shingles > 0").groupBy("fp", "doc_id").count().where("count > 1").select(name.alias("k"))
    goes = scratch.keep(goes.where("bfp is null").select(name.alias("k")).unionByName(repeats), "goes")
    bits = docs.sparkSession.sparkContext.broadcast(key_bits(goes))
    whole = docs.select(F.col(text_col).alias("text"), whole_row(docs, text_col).alias("row"), F.xxhash64(id_col).alias("h"))

    def marked(doubt: bool) -> DataFrame:
        """The rows that meet the exact list, or the others, with their classes: one worker a task finds both."""

        @bounded
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, BATCH_ROWS):
                    some = batch.slice(first, BATCH_ROWS)
                    fp = np.concatenate([fingerprints(*row_sets(content, offsets, k), len(offsets) - 1)[1] for _, content, offsets in slices(some.column(0), FEW_BYTES)]).view(np.int64)
                    found = (fp != 0) & maybe_in(bits.value, fp ^ some.column(2).to_numpy())
                    at = pa.array(np.flatnonzero(found if doubt else ~found))
                    yield pa.RecordBatch.from_arrays([pa.array(fp).take(at), some.column(0).take(at), some.column(1).take(at)], names=["fp", "text", "row"])

        return whole.mapInArrow(run, T.StructType([T.StructField("fp", T.LongType()), *whole.schema.fields[:2]]))

    # the id is a key of the join as well, so a large class of copies is dealt over all tasks
    open_rows = marked(True).withColumn("id", carried(docs, id_col)).alias("m")
    kept = open_rows.join(best.alias("b"), (F.col("m.fp") == F.col("b.fp")) & F.col("m.id").eqNullSafe(F.col("b.stay"))).select("m.fp", "text", "row").dropDuplicates(["fp"])
    kept = marked(False).select("fp", "text", "row").unionByName(kept)
    return kept.select(*restored(docs, **{text_col: F.col("text")}))
