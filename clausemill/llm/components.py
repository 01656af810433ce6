"""Connected components by alternating large-star and small-star rounds.

Each round halves the depth at least, so the rounds grow with the logarithm of
the longest path.  A node's neighbours are never gathered: a round takes the
least neighbour with an aggregate and sends it back over a join, whose hot
keys adaptive execution can split because both sides come from tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a batch as node and root: never more rows than it has edges."""
    for frame in frames:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        found = [(x, root(x)) for x in parent]
        yield pd.DataFrame(np.array([p for p in found if p[0] != p[1]], np.int64).reshape(-1, 2), columns=["u", "v"])


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (its least node) of every node that has an edge to another.

    Nulls and loops are left out; repeated edges count once; without edges the
    result is empty.
    """
    ends = edges.toDF("u", "v").where("u <> v")
    now = scratch.keep(ends.mapInPandas(_forest, "u long, v long").distinct(), f"{name}-0")
    state, turn = None, 0
    while True:
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if not count or (count, total) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state, turn = (count, total), turn + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-{turn}-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large, f"{name}-{turn}-large")
        down = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{turn}-down")
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.toDF("u", "v")).distinct()
        now = scratch.keep(small, f"{name}-{turn}")
