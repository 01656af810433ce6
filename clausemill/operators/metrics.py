"""Scores of predicted rules against gold spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import ensure_checkpoints

OVERLAP_SLOTS = ("scope.actor", "scope.domain", "scope.context")


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two lists of tokens; two empty ones are alike."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def overlap(a: Column, b: Column) -> Column:
    """1 where the lists share a token or both are empty, else 0."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(F.size(F.array_intersect(a, b)) > 0, 1.0).otherwise(0.0)


def macro(*scores: Column) -> Column:
    return reduce(lambda a, b: a + b, scores) / len(scores)


def best_rule(scored: DataFrame, span: str = "span_id", rule: str = "rule_id", score: str = "macro_f1") -> DataFrame:
    """The best rule of each span; of equals the least id."""
    return scored.groupBy(span).agg(F.max(score).alias(score), F.min_by(rule, F.struct(-F.col(score), F.col(rule))).alias(rule))


def summary(gold: DataFrame, best: DataFrame, span: str = "span_id") -> DataFrame:
    """Means over gold spans; a span without prediction scores 0."""
    joined = gold.join(best, span, "left")
    return joined.agg(
        F.count("*").alias("gold_spans"),
        F.round(F.avg(F.coalesce("macro_f1", F.lit(0.0))), 6).alias("se_slot_f1"),
        F.round(F.avg(F.col("macro_f1").isNotNull().cast("double")), 6).alias("coverage"),
        F.round(F.avg(F.coalesce("test_correct", F.lit(0)).cast("double")), 6).alias("test_acc"),
        F.round(F.avg(F.coalesce("signals_f1", F.lit(0.0))), 6).alias("sig_f1"),
    )


def pr_curve(scored: DataFrame, gold_count: Column | int) -> DataFrame:
    """k, tp, fp, precision, recall after each span, best score first; k = 0 is (1, 0).

    The running sums need one order over all rows.  They are taken within
    ranges of the score first, whose totals (a row for each range) are then
    added, so no task sees more than one range.
    """
    spark = scored.sparkSession
    ensure_checkpoints(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scored.select("span_id", "score", F.col("hit").cast("long").alias("hit")).repartitionByRange(parts, F.desc("score"), "span_id")
    ranged = ranged.withColumn("part", F.spark_partition_id()).checkpoint()
    totals = ranged.groupBy("part").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h0"))
    local = Window.partitionBy("part").orderBy(F.desc("score"), "span_id").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("k", F.count("*").over(local)).withColumn("tp", F.sum("hit").over(local)).join(F.broadcast(bases), "part")
    k, tp = F.col("k") + F.col("n0"), F.col("tp") + F.col("h0")
    gold = F.lit(gold_count) if isinstance(gold_count, int) else gold_count
    rows = out.select(k.alias("k"), "span_id", "score", tp.alias("tp"), (k - tp).alias("fp"), (tp / k).alias("precision"), (tp / gold).alias("recall"))
    return rows.unionByName(spark.sql("SELECT 0L AS k, '' AS span_id, CAST(NULL AS DOUBLE) AS score, 0L AS tp, 0L AS fp, 1.0D AS precision, 0.0D AS recall"))


def auprc(curve: DataFrame, gold_count: int) -> DataFrame:
    """Step integral of precision over recall: recall rises by 1 / gold at each hit."""
    steps = curve.where("k > 0")
    rise = steps.alias("x").join(steps.select((F.col("k") + 1).alias("k"), F.col("tp").alias("tp0")).alias("y"), "k", "left")
    gain = (F.col("tp") - F.coalesce("tp0", F.lit(0))) / gold_count
    return rise.agg(F.round(F.sum(gain * F.col("precision")), 6).alias("auprc"))


def operating_point(scored: DataFrame, gold_count: int) -> DataFrame:
    """Precision, recall, F1 of taking every prediction."""
    tp, n = F.sum(F.col("hit").cast("long")), F.count("*")
    p, r = tp / n, tp / F.lit(gold_count)
    return scored.agg(tp.alias("tp"), (n - tp).alias("fp"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r), 6).alias("f1"))


def mcnemar(paired: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts and the exact two-sided binomial p-value."""
    counts = paired.agg(F.sum((F.col(a) & ~F.col(b)).cast("long")).alias("b"), F.sum((~F.col(a) & F.col(b)).cast("long")).alias("c"))
    n, m = F.col("b") + F.col("c"), F.least("b", "c")
    # log of n choose i, as running sums of logs
    tail = F.aggregate(
        F.sequence(F.lit(1), F.greatest(m, F.lit(1))),
        F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("sum")),
        lambda s, i: F.struct((s["log"] + F.log(((n - i + 1) / i).cast("double"))).alias("log"), F.when(i <= m, s["sum"] + F.exp(s["log"] + F.log(((n - i + 1) / i).cast("double")))).otherwise(s["sum"]).alias("sum")),
    )["sum"]
    p = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail * F.pow(F.lit(0.5), n)))
    return counts.select("b", "c", F.round(p, 6).alias("p_value"))


def bootstrap(scored: DataFrame, value: str, *, rounds: int = 200, seed: int = 7) -> DataFrame:
    """Mean and 95 % interval by Poisson weights drawn from hashes, so no row is sent twice."""
    drawn = scored.select(value, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"), "span_id")
    u = (F.pmod(F.xxhash64("span_id", "r", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    weight = reduce(lambda a, b: a + b, [(u > s).cast("int") for s in steps])
    means = drawn.withColumn("w", weight).groupBy("r").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def permutation(paired: DataFrame, a: str, b: str, *, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """b, c, p_value: the paired permutation test of a difference in hits.

    Swapping the two systems on a pair flips its sign, so only discordant pairs
    matter, and a round needs the number of flips alone: a sum of signs drawn
    from hashes of the pair's number, made without sending a row.
    """
    counts = paired.agg(F.sum((F.col(a) & ~F.col(b)).cast("long")).alias("b"), F.sum((~F.col(a) & F.col(b)).cast("long")).alias("c"))
    n, observed = F.coalesce(F.col("b") + F.col("c"), F.lit(0)), F.abs(F.coalesce(F.col("b") - F.col("c"), F.lit(0)))
    tries = counts.select("b", "c", n.alias("n"), observed.alias("observed"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r"))
    sign = F.expr(f"""aggregate(sequence(0, cast(floor(n / 32) as int)), 0L, (s, i) -> s + bit_count(
        xxhash64({seed}, r, i) & if((i + 1) * 32 <= n, 4294967295L, shiftleft(1L, cast(n % 32 as int)) - 1L)))""")
    flipped = F.abs(2 * sign - F.col("n"))
    return tries.groupBy("b", "c").agg(((F.count_if(flipped >= F.col("observed")) + 1) / F.lit(rounds + 1)).alias("p_value"))


def across_seeds(scored: DataFrame, value: str, system: str = "system", seed: str = "seed") -> DataFrame:
    """system, mean, sd, seeds: mean and spread of each seed's mean."""
    each = scored.groupBy(system, seed).agg(F.avg(value).alias("m"))
    return each.groupBy(system).agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("sd"), F.count("*").alias("seeds"))
