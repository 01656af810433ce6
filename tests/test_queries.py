"""Every query of the policy engine against its SQL, on small tables."""

import pytest

from clausemill.plans import queries as policy
from clausemill.plans import relational  # noqa: F401

#: Queries that may be empty on the smallest tables.
MAY_BE_EMPTY = {"topk_pairs", "greedy_dedup", "similar_pairs", "repeating_lines"}


@pytest.mark.parametrize("name", sorted(policy.ORACLE_SQL))
def test_matches_sql(name, same):
    rows = same(policy.QUERIES[name], policy.ORACLE_SQL[name])
    assert rows > 0 or name in MAY_BE_EMPTY


def test_only_known_queries_have_no_sql():
    assert set(policy.QUERIES) - set(policy.ORACLE_SQL) == {"bootstrap_interval", "policy_pipeline"}


def test_bootstrap_interval_holds_the_mean(spark, sf_dir):
    row = policy.QUERIES["bootstrap_interval"](spark, sf_dir).first()
    assert row["low"] < row["mean"] < row["high"]


def test_stream_guard_counts_events_once(spark, sf_dir):
    rows = policy.QUERIES["stream_guard"](spark, sf_dir).collect()
    assert sum(r["n"] for r in rows) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
