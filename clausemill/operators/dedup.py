"""Structural and semantic dedup of rules.

Semantic dedup keeps a rule unless an earlier kept one of its block is close
enough, and maps it to the first such.  That is the lexicographically first
maximal independent set of the graph of close pairs, found here in rounds: a
rule whose earlier neighbours are all dropped stays, its neighbours go.  Only
close pairs are ever shuffled, never a block as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_text, or_empty
from ..lineage import ensure_checkpoints
from .rules import SLOTS, fields


def signature(*, strict: bool = False) -> Column:
    """sha1 over a rule's normalised meaning; citation and span count only if strict."""
    f = fields()

    def listed(c: str, ordered: bool) -> Column:
        values = F.transform(F.coalesce(f[c], F.array().cast("array<string>")), norm_text)
        return F.array_join(values if ordered else F.array_sort(values), "\x1e")

    parts = [listed("requirements", True), norm_text(f["hazard"]), listed("exceptions", False), listed("conditions", False), F.lower(F.trim(or_empty(f["severity"])))]
    parts += [listed(c, False) for c in SLOTS] + [norm_text(f["doc"])]
    if strict:
        parts += [norm_text(f["citation"]), norm_text(f["span_id"])]
    return F.sha1(F.concat_ws("\x1f", *parts).cast("binary"))


def structural(rules: DataFrame, *, strict: bool = False) -> DataFrame:
    """Adds kept_rule_id: of rules with one signature the id of the first."""
    signed = rules.withColumn("signature", signature(strict=strict))
    first = signed.groupBy("signature").agg(F.min(F.struct("seq", "rule_id"))["rule_id"].alias("kept_rule_id"))
    return signed.join(first, "signature")


def provenance(structured: DataFrame) -> DataFrame:
    """kept_rule_id, span_id: the spans that led to each kept rule, each once."""
    return structured.select("kept_rule_id", F.col("source.span_id").alias("span_id")).where("coalesce(span_id, '') <> ''").distinct()


def block_key(doc: Column, *slots: Column, doc_as_block: bool = True) -> Column:
    """Rules are compared only where document and scope agree."""
    return F.concat_ws("\x1f", F.lower(or_empty(doc)) if doc_as_block else F.lit(""), *[F.array_join(F.array_sort(s), "\x1e") for s in slots])


def similar_pairs(items: DataFrame, threshold: float, *, seq: str = "seq", block: str = "block", vector: str = "vector", tile: int = 1024) -> DataFrame:
    """a, b, block, sim of the pairs of a block at or above the threshold; a null vector, or one of length 0, is like none.

    A block of more than `tile` items is cut into tiles by hash, and each pair
    of tiles is a group of its own, so a hot block spreads over many tasks and
    no task holds more than two tiles.  A group is one product of matrices.
    """
    given = items.select(F.col(seq).alias("seq"), F.col(block).alias("block"), F.transform(vector, lambda x: x.cast("double")).alias("vector")).where("seq is not null and block is not null and vector is not null")
    sizes = given.groupBy("block").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    cut = given.join(sizes, "block").withColumn("mine", F.pmod(F.xxhash64("seq"), "tiles").cast("int"))
    # a tile meets itself once, and each other tile once
    met = cut.select("block", "seq", "vector", "mine", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    met = met.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")).select("block", "low", "high", "mine", "seq", "vector")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        units = np.array(frame["vector"].tolist(), np.float64).reshape(len(frame), -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            units = units / np.sqrt((units * units).sum(1, keepdims=True))
        frame, units = frame[np.isfinite(units).all(1)], units[np.isfinite(units).all(1)]
        name, own = frame["seq"].to_numpy(), (frame["mine"] == frame["low"]).to_numpy()
        alone = len(frame) > 0 and frame["low"].iat[0] == frame["high"].iat[0]
        x, y = (np.arange(len(frame)),) * 2 if alone else (np.flatnonzero(own), np.flatnonzero(~own))
        sim = units[x] @ units[y].T
        i, j = np.nonzero(sim >= threshold)
        first, second, sim = name[x[i]], name[y[j]], sim[i, j]
        keep = first < second if alone else np.ones(len(first), bool)
        low, high = np.minimum(first, second)[keep], np.maximum(first, second)[keep]
        return pd.DataFrame({"a": low, "b": high, "block": frame["block"].iloc[0] if len(frame) else None, "sim": sim[keep]})

    kind, of_block = (given.schema[c].dataType.simpleString() for c in ("seq", "block"))
    return met.groupBy("block", "low", "high").applyInPandas(compare, f"a {kind}, b {kind}, block {of_block}, sim double")


def greedy(pairs: DataFrame) -> DataFrame:
    """b, kept: the items that go, each with the first kept item that is like it.

    Rounds go on until no pair is undecided; their number grows with the
    longest chain of ever later neighbours, not with the rows.
    """
    ensure_checkpoints(pairs.sparkSession)
    close = pairs.select("a", "b").distinct().checkpoint()  # the join of all pairs runs once
    todo, gone = close, None
    while not todo.isEmpty():
        later = todo.select(F.col("b").alias("n")).distinct()
        kept = todo.select(F.col("a").alias("n")).distinct().join(later, "n", "left_anti")
        lost = todo.join(kept, todo["a"] == kept["n"], "left_semi").groupBy("b").agg(F.min("a").alias("kept")).checkpoint()
        gone = lost if gone is None else gone.unionByName(lost)
        todo = todo.join(lost.select("b"), "b", "left_anti").join(lost.select(F.col("b").alias("a")), "a", "left_anti").checkpoint()
    if gone is None:
        return pairs.select("b", F.col("a").alias("kept")).limit(0)
    # an item goes in the round of its first kept neighbour that is decided; an earlier one may be decided later
    everyone = close.join(gone.select(F.col("b").alias("a")), "a", "left_anti")
    return everyone.join(gone.select("b"), "b", "left_semi").groupBy("b").agg(F.min("a").alias("kept"))


def top_pairs(pairs: DataFrame, dropped: DataFrame, k: int = 200) -> DataFrame:
    """The k likest of the pairs that the greedy pass compares: a is kept, b not yet taken by an earlier one."""
    compared = pairs.join(dropped.select(F.col("b").alias("a")), "a", "left_anti").join(dropped, "b", "left").where("kept is null or kept >= a")
    return compared.orderBy(F.desc(F.round("sim", 9)), "a", "b").limit(k).select("a", "b", "sim")


def without(items: DataFrame, dropped: DataFrame, seq: str = "seq") -> DataFrame:
    return items.join(dropped.select(F.col("b").alias(seq)), seq, "left_anti")
