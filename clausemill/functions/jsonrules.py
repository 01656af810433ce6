"""Parsing, checking and repairing of rules and examples that a model wrote as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LISTS, REQUIRED, RULE_STRUCT, SEVERITIES
from .text import once, or_empty, strip

TRAILING_ARRAY = r"(?s)\[\s*\{.*\}\s*\]\s*$"
FIRST_ARRAY = r"(?s)\[\s*\{.*?\}\s*\]"
OUTER_OBJECT = r"(?s)\{.*\}"
NOT_FOUND = "No JSON array found in model output."


def parse_rules(raw: Column) -> Column:
    """struct(rules, error): an object with `rules`, else the array at the end, else the first array."""
    text = strip(or_empty(raw))
    kind = f"array<{RULE_STRUCT}>"
    whole = F.from_json(text, f"rules {kind}")["rules"]
    arrays = [F.when(F.regexp_extract(text, p, 0) != "", F.from_json(F.regexp_extract(text, p, 0), kind)) for p in (TRAILING_ARRAY, FIRST_ARRAY)]
    rules = F.coalesce(whole, *arrays)
    return F.struct(rules.alias("rules"), F.when(rules.isNull(), F.lit(NOT_FOUND)).alias("error"))


def parse_examples(raw: Column, n: int) -> Column:
    """struct(benign, adversarial) if the text, its fenced part or its outer braces hold just n non-blank entries of each; else null."""
    text = strip(or_empty(raw))
    fenced = F.when(text.startswith("```"), strip(F.regexp_replace(text, "^`+|`+$", "")))

    def read(source: Column) -> Column:
        found = F.from_json(source, "benign array<string>, adversarial array<string>")
        clean = [F.filter(F.transform(found[c], strip), lambda x: x.isNotNull() & (x != "")) for c in ("benign", "adversarial")]
        return F.when((F.size(clean[0]) == n) & (F.size(clean[1]) == n), F.struct(clean[0].alias("benign"), clean[1].alias("adversarial")))

    return F.coalesce(read(text), read(fenced), read(F.nullif(F.regexp_extract(text, OUTER_OBJECT, 0), F.lit(""))))


def outer_object(raw: Column) -> Column:
    """The text from the first opening to the last closing brace, or null."""
    return F.nullif(F.regexp_extract(or_empty(raw), OUTER_OBJECT, 0), F.lit(""))


def as_array(value: Column) -> Column:
    """A JSON value, or plain text, as an array of strings: null gives none, a scalar one."""
    text = strip(value)
    scalar = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x string")["x"]
    return (
        F.when(text.isNull() | (text == "null"), F.array().cast("array<string>"))
        .when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), F.array(value)))
        .otherwise(F.array(F.coalesce(scalar, value)))
    )


def _listed(raw: Column, path: str) -> Column:
    """An array field; what is a scalar becomes an array, what is missing an empty one."""

    def entries(value: Column) -> Column:
        return F.when(value.isNull() | (value == ""), F.array().cast("array<string>")).when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(value))

    return once(F.get_json_object(raw, path), entries)


def missing_fields(raw: Column) -> Column:
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.filter(F.array(*map(F.lit, REQUIRED)), lambda k: ~F.array_contains(keys, k))


def rule_errors(raw: Column) -> Column:
    """Why a JSON text is no rule: parse, missing and unknown fields, severity, scalars for arrays."""
    keys = F.json_object_keys(raw)
    missing = F.transform(missing_fields(raw), lambda k: F.concat(F.lit("Missing required field: '"), k, F.lit("'")))
    extra = F.transform(F.array_except(keys, F.array(*map(F.lit, REQUIRED))), lambda k: F.concat(F.lit("Unknown field: '"), k, F.lit("'")))
    severity = F.get_json_object(raw, "$.severity")
    wrong = F.when(severity.isNotNull() & ~severity.isin(*SEVERITIES), F.array(F.concat(F.lit("severity '"), severity, F.lit("' is not known")))).otherwise(F.array().cast("array<string>"))
    scalars = [F.when(F.get_json_object(raw, f"$.{c}").isNotNull() & ~F.get_json_object(raw, f"$.{c}").startswith("["), F.lit(f"'{c}' must be an array")) for c in (*LISTS, "scope.actor", "scope.data_domain", "scope.context")]
    return F.when(keys.isNull(), F.array(F.lit("JSON parse error"))).otherwise(F.concat(missing, extra, wrong, F.array_compact(F.array(*scalars))))


def filled(raw: Column) -> Column:
    """The rule with empty, valid values for all fields that are missing; an unreadable text gives an empty rule."""
    slots = {c: _listed(raw, f"$.scope.{c}") for c in ("actor", "data_domain", "context")}
    return F.struct(
        F.get_json_object(raw, "$.rule_id").alias("rule_id"),
        F.struct(*[or_empty(F.get_json_object(raw, f"$.source.{c}")).alias(c) for c in ("doc", "citation", "span_id")]).alias("source"),
        F.struct(*[v.alias(c) for c, v in slots.items()]).alias("scope"),
        or_empty(F.get_json_object(raw, "$.hazard")).alias("hazard"),
        *[_listed(raw, f"$.{c}").alias(c) for c in LISTS],
        F.coalesce(F.get_json_object(raw, "$.severity"), F.lit("medium")).alias("severity"),
    )


def pruned(raw: Column) -> Column:
    """The rule with known fields only, trimmed and distinct entries, and a severity that is known."""
    rule = filled(raw)
    severity = F.lower(strip(or_empty(F.get_json_object(raw, "$.severity"))))
    hazard = strip(rule["hazard"])
    return F.struct(
        rule["rule_id"].alias("rule_id"),
        rule["source"].alias("source"),
        F.struct(*[F.array_distinct(rule["scope"][c]).alias(c) for c in ("actor", "data_domain", "context")]).alias("scope"),
        hazard.alias("hazard"),
        *[F.array_distinct(F.filter(F.transform(rule[c], strip), lambda x: x.isNotNull() & (x != ""))).alias(c) for c in LISTS],
        once(severity, lambda s: F.when(s.isin(*SEVERITIES), s).when(hazard != "", "high").otherwise("medium")).alias("severity"),
    )
