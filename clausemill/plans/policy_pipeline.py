"""Spans to candidates, rules, cleaned rules (structural, then semantic dedup), testability tags, examples and the enforcement table.

Every stage is checkpointed before the next reads it, so models are asked once.  Outputs are frames; writing them to files is the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonrules as J
from ..functions.text import clause_text, rule_hash, semantic_string, stable_id
from ..lineage import ensure_checkpoints
from ..operators import dedup, guard, mining, rules
from ..providers import request

TAG = "testable string, reason string, evidence_signals array<string>"


def _answers(rows: DataFrame, provider, op: str, prompt, n: int = 1) -> DataFrame:
    asked = rows.withColumns(dict(zip(("request_id", "op", "prompt", "n"), request(op, prompt, n), strict=True)))
    ensure_checkpoints(rows.sparkSession)
    answers = provider.complete(asked.select("request_id", "op", "prompt", "n")).checkpoint()
    return asked.join(answers, "request_id", "left").drop("request_id", "op", "prompt", "n")


def extract(candidates: DataFrame, provider, *, repair: bool = True) -> DataFrame:
    """Rules of candidates; a rule that fails keeps its error, the others of its span stay."""
    asked = _answers(candidates, provider, "extract", F.col("text")).withColumn("parsed", J.parse_rules(F.col("raw")))
    each = asked.select("seq", "span_id", "doc_id", F.coalesce("error", "parsed.error").alias("error"), F.posexplode_outer("parsed.rules").alias("part", "r"))
    source = F.struct(F.coalesce("r.source.doc", "doc_id").alias("doc"), F.coalesce("r.source.citation", F.lit("")).alias("citation"), F.coalesce("r.source.span_id", "span_id").alias("span_id"))
    flat = each.where("r is not null").select("seq", "error", source.alias("source"), "r.rule_id", "r.scope", "r.hazard", "r.conditions", "r.exceptions", "r.requirements", "r.evidence", "r.severity")
    made = rules.judged(rules.normalised(rules.split_composite(flat)))
    if repair:
        made = rules.judged(rules.repaired(made))
    name = F.concat(stable_id(F.col("source.doc"), F.col("source.span_id")), F.lit("-r"), rule_hash(rules.fields()))
    return made.withColumn("rule_id", F.coalesce("rule_id", name))


def tag(cleaned: DataFrame, provider) -> DataFrame:
    """Adds is_testable and testability; what can't be read leaves a null tag and its error."""
    text = clause_text(rules.fields(), [])
    asked = _answers(cleaned.drop("error", "issues"), provider, "testability", text)
    said = F.from_json(F.coalesce(J.outer_object(F.col("raw")), F.lit("{}")), TAG)
    verdict = F.when(F.lower(said["testable"]).isin("true", "false"), F.lower(said["testable"]) == "true")
    failed = F.when(verdict.isNull(), F.coalesce("error", F.lit("no verdict")))
    return asked.withColumn("is_testable", verdict).withColumn("testability", F.struct(F.left(said["reason"], F.lit(200)).alias("reason"), said["evidence_signals"].alias("evidence_signals"), failed.alias("error"))).drop("raw", "error")


def examples(tagged: DataFrame, provider, n: int = 5) -> DataFrame:
    """n benign and n adversarial prompts for rules that input and output can check."""
    from ..functions.classify import checks_io

    kept = tagged.where(checks_io(F.col("is_testable"), F.col("testability.evidence_signals")))
    asked = _answers(kept, provider, "examples", clause_text(rules.fields(), []), n)
    return asked.withColumn("examples", J.parse_examples(F.col("raw"), n)).drop("raw", "error")


def deduplicated(extracted: DataFrame, *, strict: bool = False, embed=None, threshold: float = 0.85, doc_block: bool = True, preview: int = 0) -> dict[str, DataFrame]:
    """cleaned, duplicates, provenance and, with `preview`, the likest pairs.

    `embed` maps seq, text to seq, vector and turns semantic dedup on: of the
    rules that structural dedup keeps, one goes where an earlier kept rule of
    its block is at least `threshold` similar.
    """
    structured = dedup.structural(extracted.where("error is null and size(issues) = 0"), strict=strict).checkpoint()
    kept = rules.distinct_payloads(structured.where("rule_id = kept_rule_id"), F.col("rule_id")).drop("kept_rule_id", "signature")
    gone = structured.where("rule_id <> kept_rule_id").select(F.col("rule_id").alias("duplicate_rule_id"), "kept_rule_id")
    led = dedup.provenance(structured)
    out = {"cleaned": kept, "duplicates": gone, "provenance": led}
    if embed is None:
        return out
    f = rules.fields()
    kept = kept.checkpoint()
    texts = kept.select("seq", semantic_string(f).alias("text"), dedup.block_key(f["doc"], *[f[c] for c in rules.SLOTS], doc_as_block=doc_block).alias("block"))
    pairs = dedup.similar_pairs(texts.select("seq", "block").join(embed(texts.select("seq", "text")), "seq"), threshold).checkpoint()
    dropped = dedup.greedy(pairs).checkpoint()
    names = kept.select("seq", "rule_id")
    merged = dropped.join(names.toDF("b", "duplicate_rule_id"), "b").join(names.toDF("kept", "kept_rule_id"), "kept").select("duplicate_rule_id", "kept_rule_id").checkpoint()
    moved = merged.select(F.col("duplicate_rule_id").alias("kept_rule_id"), F.col("kept_rule_id").alias("final"))

    def final(frame: DataFrame) -> DataFrame:
        return frame.join(moved, "kept_rule_id", "left").withColumn("kept_rule_id", F.coalesce("final", "kept_rule_id")).drop("final")

    out = {"cleaned": dedup.without(kept, dropped), "duplicates": final(gone).select("duplicate_rule_id", "kept_rule_id").unionByName(merged), "provenance": final(led).select("kept_rule_id", "span_id").distinct()}
    if preview:
        likest = dedup.top_pairs(pairs, dropped, preview)
        out["pairs"] = likest.join(names.toDF("a", "a_rule_id"), "a").join(names.toDF("b", "b_rule_id"), "b").select("sim", "a_rule_id", "b_rule_id")
    return out


def run(spark: SparkSession, spans: DataFrame, provider, *, mine: bool = True, strict: bool = False, target_n: int = 5, keep_informative: bool = False, include_tables: bool = False, ctx_window: int = 2, embed=None, threshold: float = 0.85, doc_block: bool = True, preview: int = 0) -> dict[str, DataFrame]:
    """All stages; the result names each stage's frame.  With `embed` dedup is semantic as well."""
    ensure_checkpoints(spark)
    found = mining.candidates(spans, keep_informative=keep_informative, include_tables=include_tables, ctx_window=ctx_window) if mine else mining.passthrough(spans)
    found = found.checkpoint()
    extracted = extract(found, provider).checkpoint()
    clean = deduplicated(extracted, strict=strict, embed=embed, threshold=threshold, doc_block=doc_block, preview=preview)
    tagged = tag(clean["cleaned"], provider).checkpoint()
    exemplified = examples(tagged, provider, target_n).checkpoint()
    return clean | {
        "candidates": found, "extracted": extracted, "tagged": tagged, "examples": exemplified, "test_cases": guard.test_cases(exemplified), "enforcement": guard.enforcement_table(tagged),
    }
