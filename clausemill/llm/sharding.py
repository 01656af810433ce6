"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group that must not be split.  Each bucket of
groups is reduced by differencing to one partial partition: two partitions of
the largest spread are combined, the heaviest part of one with the lightest of
the other, until one is left.  The buckets' partial partitions, a few numbers
each, are then combined in the same way, which fixes the shard of every part of
every bucket.  Differencing may combine partitions in any order, so the result
is one of whole differencing too; only the order of combining is less greedy.

Nulls and repeats: a null text has size 1 and the group of the empty text;
null and repeated ids are kept row by row; fewer groups than shards leave
shards empty; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch


#: Buckets of groups, and runs of rows, are larger beyond this many, so what the driver holds stays bounded.
MOST_BUCKETS = 1 << 16


def difference(sums: np.ndarray) -> np.ndarray:
    """(partition, part) -> part of the combined partition, for partial partitions given by their parts' sums.

    Each row of `sums` may be in any order.  Within a row, parts go to
    different parts of the result.
    """
    count, parts = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    heap = [(-int(row.max() - row.min()), n) for n, row in enumerate(sums)]
    heapq.heapify(heap)
    totals = {n: sums[n][order[n]].astype(np.int64) for n in range(count)}
    # a tree of combinations; where[n]: for a node, its parts' places in the parent
    parent: dict[int, tuple[int, np.ndarray]] = {}
    new = count
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = totals.pop(a) + totals.pop(b)[::-1]
        sort = np.argsort(-total, kind="stable")
        place = np.empty(parts, np.int64)
        place[sort] = np.arange(parts)
        parent[a], parent[b] = (new, place), (new, place[::-1])
        totals[new] = total[sort]
        heapq.heappush(heap, (-int(total.max() - total.min()), new))
        new += 1
    at = np.empty((max(new, count), parts), np.int64)
    for n in range(new - 1, -1, -1):
        at[n] = at[parent[n][0]][parent[n][1]] if n in parent else np.arange(parts)
    out = np.empty((count, parts), np.int64)
    np.put_along_axis(out, order, at[:count], axis=1)
    return out


def _halves(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each group of one bucket."""
    sums = np.zeros((len(sizes), parts), np.int64)
    sums[:, 0] = sizes
    return difference(sums)[:, 0]


def shard(docs: DataFrame, *, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", bucket_groups: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; the law is `bytes`.

    The driver holds `shards` numbers for each bucket of about `bucket_groups`
    groups, of which there are at most MOST_BUCKETS; rows are numbered within
    shards by as many runs at most.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("key"),
    )
    rows = scratch.keep(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    groups = scratch.keep(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    buckets = max(1, min(MOST_BUCKETS, -(-groups.count() // bucket_groups)))

    def halve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        return frame.assign(part=_halves(frame["bytes"].to_numpy(), shards).astype(np.int32))

    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    dealt = scratch.keep(dealt.groupBy("bucket").applyInPandas(halve, "key string, bytes long, bucket int, part int"), "dealt")
    table = dealt.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes")).toPandas()
    sums = np.zeros((buckets, shards), np.int64)
    sums[table["bucket"], table["part"]] = table["bytes"]
    places = difference(sums)
    fixed = docs.sparkSession.createDataFrame([(b, p, int(places[b, p])) for b in range(buckets) for p in range(shards)], "bucket int, part int, shard int")
    placed = scratch.keep(dealt.join(F.broadcast(fixed) if buckets * shards <= 1 << 18 else fixed, ["bucket", "part"]).select("key", "shard"), "placed")

    runs = max(1, min(MOST_BUCKETS // shards, -(-rows.count() // (shards * bucket_groups))))
    sharded = rows.join(placed, "key").withColumn("run", F.pmod(F.xxhash64("uid"), F.lit(runs)).cast("int"))
    sharded = scratch.keep(sharded.drop("key"), "sharded")
    counts = sharded.groupBy("shard", "run").count().toPandas().sort_values(["shard", "run"])
    counts["base"] = counts.groupby("shard")["count"].cumsum() - counts["count"]
    bases = docs.sparkSession.createDataFrame([tuple(map(int, r)) for r in counts[["shard", "run", "base"]].itertuples(index=False)], "shard int, run int, base long")
    local = F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "uid"))
    numbered = sharded.withColumn("local", local).join(F.broadcast(bases) if len(counts) <= 1 << 18 else bases, ["shard", "run"])
    scratch.drop("rows", "groups", "dealt", "placed")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("local") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
