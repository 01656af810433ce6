"""Quirks of the clause patterns, one by one."""

import pytest
from pyspark.sql import functions as F

from clausemill.functions import classify as C
from clausemill.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("The provider shall retain logs.", "obligation"),
        ("Staff may choose and must report.", "other"),
        ("Staff may only read; must report.", "obligation"),
        ("Users must not share data.", "prohibition"),
        ("A deployer shall not be required to log.", "exemption"),
        ("Data is kept when the law asks.", "exception"),
        ("if (a) applies", "other"),
        ("Output means a response.", "definition"),
        ("Nothing here.", "other"),
        ("", "other"),
    ],
)
def test_clause_type(spark, text, kind):
    assert value(spark, C.clause_type(F.lit(text))) == kind


def test_lower_case_prohibited_is_medium(spark):
    assert value(spark, C.clause_severity(F.lit("it is prohibited"))) == "medium"
    assert value(spark, C.clause_severity(F.lit("PROHIBITED"))) == "high"


def test_percent_sign_never_ends_a_threshold(spark):
    assert value(spark, C.threshold(F.lit("at least 10% of users"))) is None
    assert value(spark, C.threshold(F.lit("at least 1,000.5 users")))["value"] == "1,000.5"


def test_deadline(spark):
    assert tuple(value(spark, C.deadline(F.lit("within 30 days")))) == ("within", 30, "days")


def test_section_sign_behind_a_space_is_no_reference(spark):
    assert value(spark, C.cross_references(F.lit("see § 164 and Section 4.1, Article 3(2)"))) == ["Article 3(2)", "Section 4.1"]


def test_risk_score(spark):
    assert value(spark, C.risk_score(F.lit(None).cast("string"))) == 0.0
    assert value(spark, C.risk_score(F.lit("my ssn is 123-45-6789"))) == 1.0
    assert value(spark, C.risk_score(F.lit("token"))) == 0.8
    assert value(spark, C.risk_category(F.lit(0.6))) == "ADVERSARIAL"


@pytest.mark.parametrize(
    ("slot", "phrase", "token"),
    [
        ("actor", "DPO", "privacy"), ("actor", "SRE", "maintainer"), ("actor", "end-user", "user"), ("actor", "Business Associate", "business associate"), ("actor", "astronaut", None),
        ("data_domain", "logs", "telemetry"), ("data_domain", "phi", "PHI"), ("data_domain", "photos", "image"), ("data_domain", "", None),
        ("context", "pre-production", "prod"), ("context", "regulated", "regulated"), ("context", "on-prem", "onprem"),
    ],
)
def test_canonical_tokens(spark, slot, phrase, token):
    assert value(spark, T.canonical(F.lit(phrase), slot)) == token


def test_canonical_list_keeps_first_use(spark):
    assert value(spark, T.canonical_list(F.array(F.lit("patients"), F.lit("Company"), F.lit("customer")), "actor")) == ["user", "org"]
    assert value(spark, T.canonical_list(F.lit(None).cast("array<string>"), "actor")) == []


def test_sentences_split_behind_initials_too(spark):
    assert value(spark, T.sentences(F.lit(" One. Two! (three) J. Smith. end "))) == ["One.", "Two!", "(three) J.", "Smith. end"]


def test_slug_of_nothing(spark):
    assert value(spark, T.slug(F.lit(" --- "))) == "section"


def test_fallback_doc(spark):
    assert value(spark, T.fallback_doc(F.lit(""), F.lit("/data/NIST/out/x.jsonl"), F.lit("d/s"))) == "NIST"
    assert value(spark, T.fallback_doc(F.lit(""), F.lit("/data/out/run/x.candidates.jsonl"), F.lit("d/s"))) == "x"
