"""Predicates and scores of clauses, rules and prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SIGNALS as SIGNAL_NAMES
from . import patterns as P
from .text import norm_phrase, or_empty

CORE_TYPES = ("obligation", "prohibition", "exception", "exemption")


def has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def normative_section(path: Column) -> Column:
    """False where the section's path tells of examples or notes and of no requirement."""
    joined = or_empty(F.array_join(path, " / ", ""))
    return ~(has(joined, P.INFORMATIVE) & ~has(joined, P.NORMATIVE))


def clause_type(text: Column) -> Column:
    t = F.lower(text)
    plain_may = has(F.regexp_replace(t, P.MAY_WITH, " "), P.PLAIN_MAY)
    return (
        F.when(has(t, P.EXEMPTION), "exemption")
        .when(has(t, P.EXCEPTION), "exception")
        .when(has(t, P.PROHIBITED), "prohibition")
        .when(has(t, P.DEFINITION), "definition")
        .when(has(t, P.DEONTIC) & ~plain_may, "obligation")
        .otherwise("other")
    )


def clause_severity(text: Column) -> Column:
    return F.when(has(text, P.SEVERE_UPPER) | has(text, P.SEVERE), "high").otherwise("medium")


def cross_references(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(P.CROSS_REFERENCE), F.lit(0)), lambda x: F.trim(x))))


def deadline(text: Column) -> Column:
    cue, value, unit = (F.regexp_extract(text, P.DEADLINE, i) for i in (1, 2, 3))
    return F.when(cue != "", F.struct(cue.alias("cue"), value.try_cast("int").alias("value"), unit.alias("unit")))


def threshold(text: Column) -> Column:
    cmp, value, unit = (F.regexp_extract(text, P.THRESHOLD, i) for i in (1, 2, 3))
    return F.when(cmp != "", F.struct(cmp.alias("cmp"), value.alias("value"), unit.alias("unit")))


def cues(text: Column) -> Column:
    found = [F.when(has(text, p), F.lit(P.CUES[name])) for name, p in (("deontic", P.DEONTIC), ("exception", P.EXCEPTION), ("exemption", P.EXEMPTION))]
    return F.array_compact(F.array(*found))


def confidence(text: Column, kind: Column, n_cues: Column, normative: Column) -> Column:
    score = (
        F.when(kind.isin(*CORE_TYPES), 0.4).otherwise(0.2)
        + F.least(F.lit(0.2), n_cues * 0.05)
        + F.when(normative, 0.2).otherwise(0.0)
        - F.when(kind == "definition", 0.2).otherwise(0.0)
        - F.when(F.lower(text).contains("example:") | text.contains("“") | text.contains("”"), 0.05).otherwise(0.0)
    )
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.round(score, 2)))


def minable(text: Column) -> Column:
    """Rows that the miner looks at: not blank, not administrative, no "may not apply"."""
    return (text != "") & ~has(text, P.ADMINISTRATIVE) & ~has(text, P.EPISTEMIC)


def context_severity(doc: Column, citation: Column, text: Column) -> Column:
    d, c, t = (F.lower(or_empty(x)) for x in (doc, citation, text))

    def said(words, *where) -> Column:
        return any_of(x.contains(w) for w in words for x in where)

    return (
        F.when(said(P.HINTS["critical"], d, c, t), "critical")
        .when(said(P.HINTS["regulation"], d, c), "high")
        .when(said(P.HINTS["guidance"], d, c), "medium")
        .when(said(P.HINTS["escalation"], t), "high")
        .otherwise("medium")
    )


def is_negative(requirements: Column) -> Column:
    joined = F.lower(or_empty(F.array_join(requirements, " ")))
    return any_of(joined.contains(w) for w in P.NEGATIVE)


def semantic_issues(requirements: Column, exceptions: Column, conditions: Column, hazard: Column) -> Column:
    """What is wrong with a rule's content, in a fixed order."""
    both = F.array_sort(F.array_intersect(F.transform(requirements, norm_phrase), F.transform(exceptions, norm_phrase)))
    listed = F.concat(F.lit("['"), F.array_join(F.slice(both, 1, 2), "', '"), F.lit("']"))
    issues = [
        F.when(is_negative(requirements) & ~F.exists(conditions, lambda x: F.trim(x) != ""), F.lit("Prohibition without conditions[]")),
        F.when(F.size(both) > 0, F.concat(F.lit("Requirement/exception conflict on: "), listed)),
        F.when(F.trim(or_empty(hazard)) == "", F.lit("Missing hazard")),
    ]
    return F.array_compact(F.array(*issues))


def scope_issue(*slots: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, [F.size(s) <= 0 for s in slots]), F.lit("Missing scope fields"))


def evidence_issues(span_id: Column, evidence: Column, domains: list[str]) -> Column:
    """The evidence gate, which callers switch on: source, evidence, hosts of web addresses."""
    from .text import url_host

    kept = F.filter(F.transform(evidence, lambda x: F.trim(or_empty(x))), lambda x: x != "")

    def host_issue(x: Column) -> Column:
        host = url_host(x)
        good = any_of(host.endswith(d.lower().lstrip(".")) for d in domains) if domains else F.lit(True)
        return F.when(F.lower(x).contains("http") & host.isNull(), F.concat(F.lit("Evidence URL has no valid hostname: "), x)).when(F.lower(x).contains("http") & ~good, F.concat(F.lit("Evidence URL host not allowed: "), x))

    first = F.array(F.when(F.trim(or_empty(span_id)) == "", F.lit("Missing source.span_id")), F.when(F.size(kept) == 0, F.lit("Missing evidence[]")))
    return F.array_compact(F.concat(first, F.transform(kept, host_issue)) if domains else first)


def actionable_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.ACTIONABLE), F.lit(0))


def bounds(text: Column) -> Column:
    """Who, what and when a clause names."""
    return F.struct(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias(n) for n, p in (("actor", P.BOUND_ACTOR), ("data", P.BOUND_DATA), ("condition", P.BOUND_CONDITION))])


def evidence_signals(text: Column) -> Column:
    t = F.lower(text)
    return F.array_compact(F.array(*[F.when(has(t, p), F.lit(name)) for name, p in P.SIGNALS.items()]))


def observable(signals: Column) -> Column:
    return F.size(F.array_intersect(signals, F.array(*map(F.lit, SIGNAL_NAMES)))) > 0


def testable(text: Column) -> Column:
    """Actionable, bounded and observable."""
    bounded = any_of(has(text, p) for p in (P.BOUND_ACTOR, P.BOUND_DATA, P.BOUND_CONDITION))
    return has(text, P.ACTIONABLE) & bounded & observable(evidence_signals(text))


def repaired_severity(requirements: Column, hazard: Column) -> Column:
    both = F.lower(F.concat(requirements, F.lit(" "), hazard))
    return (
        F.when(has(both, P.REPAIR_CRITICAL), "critical")
        .when(has(requirements, P.SEVERE_UPPER) | has(both, P.REPAIR_HIGH), "high")
        .when(has(both, P.REPAIR_MEDIUM), "medium")
        .otherwise("low")
    )


def _names(signals: Column) -> Column:
    return F.transform(F.coalesce(signals, F.array().cast("array<string>")), lambda s: F.lower(F.trim(s)))


def checks_io(testable: Column, signals: Column) -> Column:
    return F.coalesce(testable, F.lit(False)) & F.array_contains(_names(signals), "io_check")


def checks_io_only(signals: Column) -> Column:
    return (F.size(_names(signals)) == 1) & (F.get(_names(signals), F.lit(0)) == "io_check")


def risk_score(text: Column) -> Column:
    """How risky a prompt looks, from 0 to 1 in thousandths."""
    t = F.trim(or_empty(text))
    low = F.lower(t)
    parts = []
    for name, (once, more, pattern) in P.RISKS.items():
        possible = reduce(lambda a, b: a & b, [any_of(low.contains(x) for x in some) for some in P.RISK_LITERALS[name]])
        hits = F.regexp_count(t, F.lit(pattern))
        # literals are looked for first, so most texts meet no pattern; hits are counted once
        some_hits = F.when(possible, F.least(hits, F.lit(2))).otherwise(0)
        parts.append(F.element_at(F.array(F.lit(0.0), F.lit(once + more), F.lit(once + 2 * more)), some_hits + 1))
    parts += [F.when(has(t, p), weight).otherwise(0.0) for weight, p in P.SHAPES.values()]
    total = reduce(lambda a, b: a + b, parts) - F.when(has(t, P.DEFUSER[1]), P.DEFUSER[0]).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 3)))


def risk_category(score: Column) -> Column:
    return F.when(score >= 0.6, "ADVERSARIAL").otherwise("BENIGN")


def role_of(data_domain: Column) -> Column:
    return F.when(F.array_contains(data_domain, "code"), "code").otherwise("support")


def severity_rank(severity: Column) -> Column:
    s = F.lower(or_empty(severity))
    return F.when(s == "critical", 3).when(s == "high", 2).when(s == "low", 0).otherwise(1)


def days(value: Column, unit: Column) -> Column:
    """An extension: a deadline in days."""
    u = F.lower(unit)
    return value * F.when(u.startswith("day"), 1).when(u.startswith("week"), 7).when(u.startswith("month"), 30).otherwise(365)
