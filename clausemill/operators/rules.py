"""Operators on rules: splitting, normalising, judging, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.text import canonical_list, non_blank, norm_phrase, or_empty, repaired_token, strip
from ..lineage import ensure_checkpoints
from ..schema import LISTS, REPAIR_DEFAULT, SEVERITIES

SLOTS = ("actor", "data_domain", "context")


def fields() -> dict[str, Column]:
    """A flat view of a rule's columns, for text functions."""
    flat = {c: F.col(c) for c in ("rule_id", "hazard", "severity", *LISTS)}
    return flat | {c: F.col("scope")[c] for c in SLOTS} | {c: F.col("source")[c] for c in ("doc", "citation", "span_id")}


def split_composite(rules: DataFrame) -> DataFrame:
    """One rule for each requirement; a split rule loses its id."""
    many = F.size("requirements") > 1
    parts = F.when(many, F.transform("requirements", lambda r: F.array(r))).otherwise(F.array("requirements"))
    out = rules.withColumn("many", many).select("*", F.posexplode(parts).alias("part", "one"))
    return out.withColumn("requirements", F.col("one")).withColumn("rule_id", F.when(~F.col("many"), F.col("rule_id"))).drop("one", "many")


def normalised(rules: DataFrame) -> DataFrame:
    """Trimmed entries, canonical scope, lower-case severity or one inferred from context; what is wrong goes to `error`."""
    clean = {c: non_blank(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip)) for c in LISTS}
    out = rules.withColumns(clean)
    text = F.concat_ws(" ", "hazard", "requirements")
    known = F.lower(strip(or_empty(F.col("severity"))))
    severity = F.when(known.isin(*SEVERITIES), known).otherwise(C.context_severity(F.col("source.doc"), F.col("source.citation"), text))
    scope = F.struct(*[canonical_list(F.col("scope")[c], c).alias(c) for c in SLOTS])
    out = out.withColumn("severity", severity).withColumn("scope", scope)
    return out.withColumn("error", F.when(F.col("source").isNull(), F.lit("Schema validation failed: source")))


def judged(rules: DataFrame) -> DataFrame:
    """Adds `issues`: content first, then scope."""
    f = fields()
    found = C.semantic_issues(f["requirements"], f["exceptions"], f["conditions"], f["hazard"])
    return rules.withColumn("issues", merged_issues(found, F.array_compact(F.array(C.scope_issue(*[f[c] for c in SLOTS])))))


def merged_issues(first: Column, second: Column) -> Column:
    return F.array_distinct(F.concat(first, second))


def repaired(rules: DataFrame) -> DataFrame:
    """The repair step's scope (with its defaults) and hazard."""

    def slot(c: str) -> Column:
        found = F.filter(F.transform(F.col("scope")[c], lambda t: repaired_token(t, c)), lambda x: x.isNotNull())
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(REPAIR_DEFAULT[c])))

    return rules.withColumn("scope", F.struct(*[slot(c).alias(c) for c in SLOTS])).withColumn("hazard", F.coalesce(F.nullif(strip(or_empty(F.col("hazard"))), F.lit("")), F.lit("Unspecified hazard")))


def distinct_payloads(rules: DataFrame, key: Column, order: str = "seq") -> DataFrame:
    """Of rules with equal keys the first."""
    first = rules.groupBy(key.alias("_key")).agg(F.min(order).alias("_first"))
    return rules.withColumn("_key", key).join(first, "_key").where(F.col(order) == F.col("_first")).drop("_key", "_first")


_POLARITY = r"\b(must not|may not|shall not|must|shall|may|should|prohibited?|forbid(den)?)\b"


def conflicts(rules: DataFrame, *, useful: bool = False, tile: int = 4096) -> DataFrame:
    """earlier, later, key: rules with one predicate and opposite polarity.

    By default the predicate is the normalised requirement, polarity words
    included.  `useful` is an extension: without those words, and only where
    scopes overlap (an empty slot overlaps with any).

    Rules of one key, polarity and scope are a class.  Classes are compared,
    then their members are paired in tiles, so a hot key spreads over all
    tasks and none holds more than two tiles.  Two rules that state a key once
    each meet once; only those that state it more often need a distinct.
    """
    rows = rules.select("seq", "rule_id", F.col("scope") if useful else F.lit(0).alias("scope"), F.explode("requirements").alias("requirement"))
    phrase = norm_phrase(F.col("requirement"))
    rows = rows.withColumn("negative", C.is_negative(F.array("requirement")))
    rows = rows.withColumn("key", norm_phrase(F.regexp_replace(phrase, _POLARITY, " ")) if useful else phrase).where("key <> '' and seq is not null")
    ensure_checkpoints(rules.sparkSession)
    stated = rows.groupBy("key", "negative", "scope", "rule_id").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    times = F.count("*").over(Window.partitionBy("key", "rule_id"))
    stated = stated.withColumn("once", (times == 1) & (F.col("low") == F.col("high"))).checkpoint()
    classes = stated.groupBy("key", "negative", "scope").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    met = classes.where("not negative").select("key", F.col("scope").alias("scope0"), F.col("tiles").alias("tiles0")).join(classes.where("negative").select("key", F.col("scope").alias("scope1"), F.col("tiles").alias("tiles1")), "key")
    if useful:
        for c in SLOTS:
            x, y = F.col(f"scope0.{c}"), F.col(f"scope1.{c}")
            met = met.where((F.size(x) <= 0) | (F.size(y) <= 0) | F.arrays_overlap(x, y))
    for n in (0, 1):
        met = met.withColumn(f"tile{n}", F.explode(F.sequence(F.lit(0), F.col(f"tiles{n}") - 1)))
    of_class = classes.select(F.col("key").alias("_key"), F.col("negative").alias("_negative"), F.col("scope").alias("_scope"), "tiles")
    placed = stated.join(of_class, (F.col("key") == F.col("_key")) & (F.col("negative") == F.col("_negative")) & F.col("scope").eqNullSafe(F.col("_scope")))
    placed = placed.withColumn("_tile", F.pmod(F.xxhash64("rule_id"), "tiles").cast("int")).select("_key", "_scope", "_tile", "negative", "rule_id", "low", "high", "once")
    # a number of parts that adaptive execution keeps: what is read is little, what is made of it is not
    parts = max(int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * rules.sparkSession.sparkContext.defaultParallelism)

    def side(n: int, some: str) -> DataFrame:
        """The rules of a polarity that `some` takes, once for each pair of tiles that they are in."""
        own = placed.where(("negative" if n else "not negative") + some).select("_key", "_scope", "_tile", *[F.col(c).alias(f"{c}{n}") for c in ("rule_id", "low", "high")])
        found = met.join(own, (F.col("key") == F.col("_key")) & F.col(f"scope{n}").eqNullSafe(F.col("_scope")) & (F.col(f"tile{n}") == F.col("_tile")))
        return found.select(F.struct("key", "scope0", "tile0", "scope1", "tile1").alias(f"piece{n}"), *[f"{c}{n}" for c in ("rule_id", "low", "high")]).repartition(parts, f"piece{n}")

    def paired(some0: str, some1: str) -> DataFrame:
        return side(0, some0).join(side(1, some1), F.col("piece0") == F.col("piece1"))

    first = F.col("low0") < F.col("low1")
    either = [F.when(first, F.col(f"rule_id{n}")).otherwise(F.col(f"rule_id{1 - n}")).alias(c) for n, c in enumerate(("earlier", "later"))]
    found = paired(" and once", " and once").where("low0 <> low1").select(*either, F.col("piece0.key").alias("key"))
    if stated.where("not once").isEmpty():
        return found
    again = paired(" and not once", "").unionByName(paired(" and once", " and not once"))
    ways = [again.where(f"low{n} < high{1 - n}").select(F.col(f"rule_id{n}").alias("earlier"), F.col(f"rule_id{1 - n}").alias("later"), F.col("piece0.key").alias("key")) for n in (0, 1)]
    return found.unionByName(ways[0].unionByName(ways[1]).distinct())


def semi(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    return rules.join(wanted, "rule_id", "left_semi")


def by_severity(rules: DataFrame) -> DataFrame:
    """Rules with their place, the gravest first; equal ones in order."""
    return rules.withColumn("place", F.row_number().over(Window.orderBy(C.severity_rank(F.col("severity")).desc(), "seq")))
