"""Run-time enforcement: risk, rule tables, verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.text import requirement_text
from .rules import fields


def enforcement_table(rules: DataFrame) -> DataFrame:
    """Flat table of the rules whose only evidence is input and output."""
    kept = rules.where(C.checks_io_only(F.col("testability.evidence_signals")))
    severity = F.lower(F.coalesce(F.nullif("severity", F.lit("")), F.lit("medium")))
    return kept.select("seq", F.coalesce("rule_id", F.lit("(no-id)")).alias("rule_id"), requirement_text(fields()).alias("requirement"), severity.alias("severity"), F.col("scope.data_domain").alias("data_domain"))


def evaluations(turns: DataFrame, rules: DataFrame, violates: Column, *, most_rules: int = 20_000) -> DataFrame:
    """Every turn against every rule: seq of the rule, rank, whether it is violated.

    Rules are a small table by nature; they are sent to all executors only
    while there are at most `most_rules`, else Spark chooses the join.
    """
    rules = rules.select("rule_id", "requirement", C.severity_rank(F.col("severity")).alias("severity_rank"), F.col("seq").alias("rule_seq"))
    few = rules.limit(most_rules + 1).count() <= most_rules
    met = turns.crossJoin(F.broadcast(rules) if few else rules)
    return met.withColumn("violated", violates)


def controlling(evaluated: DataFrame, *keys: str) -> DataFrame:
    """The gravest violation of each turn, the first of equals, and how many there are."""
    bad = evaluated.where("violated")
    worst = F.min(F.struct((-F.col("severity_rank")).alias("r"), "rule_seq", "rule_id"))
    return bad.groupBy(*keys).agg(worst.alias("w"), F.count("*").alias("violations")).select(*keys, F.col("w.rule_id").alias("rule_id"), (-F.col("w.r")).alias("severity_rank"), "violations")


def first_fail(evaluated: DataFrame, *keys: str) -> DataFrame:
    """The rules applied to each turn when checking stops at the first that fails."""
    order = Window.partitionBy(*keys).orderBy(F.desc("severity_rank"), "rule_seq")
    before = F.coalesce(F.max(F.col("violated").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return evaluated.withColumn("failed", before).where("failed = 0").drop("failed")


@dataclass
class Verdicts:
    """Every turn against every rule, where a class of the turn and one of the rule decide the verdict.

    Each pair of classes meets once; counts, gravest and first violations are
    then found by class and carried to turns and rules.  No turn meets all
    rules, so the work grows with turns and rules, not with their product.
    What the classes leave open is for `evaluations`.  A null verdict is no violation.
    """

    turns: DataFrame
    rules: DataFrame
    pairs: DataFrame

    @classmethod
    def of(cls, turns: DataFrame, rules: DataFrame, turn_class: Column, rule_class: Column, violates: Column) -> Verdicts:
        """`violates` is a condition on the columns turn_class and rule_class; `rule_class` may name seq."""
        turns = turns.withColumn("turn_class", turn_class)
        rules = rules.select("rule_id", C.severity_rank(F.col("severity")).alias("severity_rank"), F.col("seq").alias("rule_seq"), rule_class.alias("rule_class"))
        pairs = turns.select("turn_class").distinct().crossJoin(rules.select("rule_class").distinct())
        return cls(turns, rules, pairs.withColumn("violated", F.coalesce(violates, F.lit(False))))

    def by_rule(self) -> DataFrame:
        """rule_id, n, bad: the turns that each rule met and those that violate it."""
        said = self.turns.groupBy("turn_class").agg(F.count("*").alias("k"))
        of_class = _met(self.pairs, said, "turn_class").groupBy("rule_class").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("violated"), F.col("k")).otherwise(0)).alias("bad"))
        return _met(self.rules, of_class, "rule_class").groupBy("rule_id").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def controlling(self, *keys: str) -> DataFrame:
        """As `controlling` of all evaluations."""
        worst = F.min(F.struct((-F.col("severity_rank")).alias("r"), "rule_seq", "rule_id"))
        of_rules = self.rules.groupBy("rule_class").agg(worst.alias("w"), F.count("*").alias("k"))
        of_turns = _met(self.pairs.where("violated"), of_rules, "rule_class").groupBy("turn_class").agg(F.min("w").alias("w"), F.sum("k").alias("k"))
        found = _met(self.turns, of_turns, "turn_class").groupBy(*keys).agg(F.min("w").alias("w"), F.sum("k").alias("violations"))
        return found.select(*keys, F.col("w.rule_id").alias("rule_id"), (-F.col("w.r")).alias("severity_rank"), "violations")

    def applied(self, *keys: str) -> DataFrame:
        """keys, applied: how many rows `first_fail` of all evaluations has for each turn."""
        ranked = self.rules.select((-F.col("severity_rank")).alias("r"), "rule_seq", "rule_class")
        firsts = ranked.groupBy("rule_class").agg(F.min(F.struct("r", "rule_seq")).alias("first"))
        of_turns = _met(self.pairs.where("violated"), firsts, "rule_class").groupBy("turn_class").agg(F.min("first").alias("first"))
        # the rules before each class's first one: those of graver ranks, and the earlier ones of its rank
        ranks = ranked.groupBy("r").agg(F.count("*").alias("k"))
        graver = ranks.select("r").alias("a").join(ranks.alias("b"), F.col("b.r") < F.col("a.r"), "left").groupBy("a.r").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("graver"))
        both = ranked.select("r", "rule_seq", F.lit(1).alias("rule")).unionByName(firsts.select("first.r", "first.rule_seq", F.lit(0).alias("rule")))
        earlier = F.sum("rule").over(Window.partitionBy("r").orderBy("rule_seq", "rule").rowsBetween(Window.unboundedPreceding, 0))
        before = both.withColumn("earlier", earlier).where("rule = 0").join(graver, "r").select(F.struct("r", "rule_seq").alias("first"), (F.col("earlier") + F.col("graver")).alias("before")).distinct()
        stops = of_turns.join(before, "first").select("turn_class", "before")
        turns = _met(self.turns, stops, "turn_class", "left").groupBy(*keys).agg(F.count("*").alias("copies"), F.min("before").alias("before"))
        counted = turns.crossJoin(F.broadcast(ranks.agg(F.sum("k").alias("all")).where("all > 0")))
        return counted.select(*keys, F.coalesce(F.col("copies") * F.col("before") + 1, F.col("copies") * F.col("all")).alias("applied"))


def _met(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joined on a key in which null equals null."""
    return left.join(right.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), how).drop("_key")


def decisions(turns: DataFrame, worst: DataFrame, rules: DataFrame, *keys: str, mode: str = "block") -> DataFrame:
    """ok, block or revise for each turn, with the requirement of the controlling rule."""
    named = worst.join(rules.select("rule_id", "requirement"), "rule_id", "left")
    decision = F.when(F.col("rule_id").isNull(), "ok").otherwise(mode)
    return turns.join(named, list(keys), "left").select(*keys, decision.alias("decision"), "rule_id", F.coalesce("violations", F.lit(0)).alias("violations"), "requirement")


def test_cases(rules: DataFrame) -> DataFrame:
    """rule_id, category, number, prompt: one row for each example."""
    sides = [rules.select("rule_id", F.lit(name).alias("category"), F.posexplode(f"examples.{name.lower()}").alias("number", "prompt")) for name in ("BENIGN", "ADVERSARIAL")]
    return sides[0].unionByName(sides[1])


def pytest_files(rules: DataFrame) -> DataFrame:
    """path, body of a generated test module for each rule; a driver writes them."""
    from ..functions.text import file_slug

    name = file_slug(F.coalesce("rule_id", F.lit("rule")))
    body = F.format_string(
        'RULE_ID = "%s"\nROLE = "%s"\nREQUIREMENT = """%s"""\n\n\ndef test_%s(agent, judge):\n    for category, prompts in EXAMPLES.items():\n        for prompt in prompts:\n            assert judge(REQUIREMENT, category, prompt, agent(ROLE, prompt))\n\n\nEXAMPLES = %s\n',
        F.col("rule_id"), C.role_of(F.col("scope.data_domain")), requirement_text(fields()), name, F.to_json("examples"),
    )
    return rules.select(F.concat(F.lit("test_"), name, F.lit(".py")).alias("path"), body.alias("body"))
