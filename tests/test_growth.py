"""Larger tables and hot groups, for which the work must not grow faster than what goes in and comes out."""

import re
import time

import pytest
from pyspark.sql import functions as F

from clausemill.functions import text as T
from clausemill.operators import guard, ingest, mining, rules
from clausemill.plans import queries as policy
from clausemill.plans import relational  # noqa: F401


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with 60,000 parts and 40,000 turns of users: 800 million pairs with the 20,000 rules that the guard enforces."""
    folder = tmp_path_factory.mktemp("many")
    spark.range(60_000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{folder}/part.parquet")
    spark.range(40_000).select((F.col("id") / 2).cast("long").alias("conv_id"), (F.col("id") % 2).alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text")).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_verdicts_do_not_meet_every_turn_with_every_rule(spark, many):
    began = time.monotonic()
    enforced = [n for n in range(60_000) if n % 6 in (0, 4)]
    turns = [(n // 2, n % 2) for n in range(40_000)]
    said = [0] * 23
    for conv, turn in turns:
        said[(conv * 7 + turn * 3) % 23] += 1
    counts = {r["rule_id"]: (r["n"], r["bad"]) for r in policy.QUERIES["evaluate_rules"](spark, many).collect()}
    assert counts == {f"r{n}": (40_000, said[-n % 23]) for n in enforced}
    rank = {0: 2, 1: 1, 2: 3, 3: 1, 4: 0}
    order = sorted(enforced, key=lambda n: (-rank[n % 5], n))
    first, found = {}, [0] * 23
    for place, n in enumerate(order):
        first.setdefault(-n % 23, (place, n))
        found[-n % 23] += 1
    applied = {(r["conv_id"], r["turn"]): r["applied"] for r in policy.QUERIES["first_fail"](spark, many).collect()}
    assert applied == {k: first[(k[0] * 7 + k[1] * 3) % 23][0] + 1 for k in turns}
    worst = {(r["conv_id"], r["turn"]): (r["rule_id"], r["violations"], r["decision"]) for r in policy.QUERIES["rule_lookup"](spark, many).collect()}
    assert worst == {(c, t): (f"r{first[(c * 7 + t * 3) % 23][1]}", found[(c * 7 + t * 3) % 23], "block") for c, t in turns}
    assert time.monotonic() - began < 100


def test_verdicts_by_class_equal_those_of_all_pairs(spark):
    """Null classes, turns that come twice, rules of one id, turns that violate nothing; and no rule at all."""
    turns = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, None), (None, 2), (4, 4)], "conv long, turn long")
    rules = spark.createDataFrame([(n, f"r{n % 7}", "x", ["critical", "low", "high", None][n % 4]) for n in range(20)], "seq long, rule_id string, requirement string, severity string")
    for table in (rules, rules.where("seq < 0")):
        every = guard.evaluations(turns, table, (F.col("conv") + F.col("turn") + F.col("rule_seq")) % 9 == 0)
        by = guard.Verdicts.of(turns, table, F.col("conv") + F.col("turn"), F.col("seq"), (F.col("turn_class") + F.col("rule_class")) % 9 == 0)

        def same(a, b):
            assert sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.select(*a.columns).collect())))

        same(every.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if("violated").alias("bad")), by.by_rule())
        same(guard.controlling(every, "conv", "turn"), by.controlling("conv", "turn"))
        same(guard.first_fail(every, "conv", "turn").groupBy("conv", "turn").agg(F.count("*").alias("applied")), by.applied("conv", "turn"))


def test_conflicts_of_a_hot_key_are_those_of_all_pairs(spark):
    """Against plain loops: rules that state a key twice, in both polarities or with several scopes, ids that come twice, null ids and null slots."""
    import random

    draw = random.Random(5)
    texts = ["Users must log", "Users must not log", "users MUST not log!", "users must-not log", "Users may not log", "Keep it", None, ""]
    slots = [[], ["a"], ["b"], ["a", "b"], None]
    kind = "seq long, rule_id string, scope struct<actor: array<string>, data_domain: array<string>, context: array<string>>, requirements array<string>"
    given = [(n if draw.random() < 0.97 else None, draw.choice([f"r{n}", f"r{n % 9}", None]) if n % 3 else f"r{n}", tuple(draw.choice(slots) for _ in range(3)), [draw.choice(texts) for _ in range(draw.randint(0, 3))]) for n in range(90)]
    frame = spark.createDataFrame(given, kind)

    def plain(useful):
        rows = [(n, r, scope, t, any(w in t.lower() for w in relational.P.NEGATIVE)) for n, r, scope, ts in given for t in ts if t and n is not None]

        def key(t):
            k = " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
            return " ".join(w for w in k.replace("must not", "").replace("may not", "").split() if w not in ("must", "may")) if useful else k

        def overlap(x, y):
            return all(a is not None and b is not None and (not a or not b or set(a) & set(b)) or a == [] or b == [] for a, b in zip(x, y, strict=True))

        return {(a[1], b[1], key(a[3])) for a in rows for b in rows if a[0] < b[0] and a[4] != b[4] and key(a[3]) == key(b[3]) and (not useful or overlap(a[2], b[2]))}

    for useful in (False, True):
        for tile in (3, 4096):
            got = [tuple(r) for r in rules.conflicts(frame, useful=useful, tile=tile).collect()]
            assert len(got) == len(set(got)) and set(got) == plain(useful)


def test_a_hot_key_is_spread_over_many_tasks(spark):
    rows = spark.range(20_000).select(F.col("id").alias("seq"), F.concat(F.lit("r"), "id").alias("rule_id"), F.array(F.when(F.col("id") % 2 == 0, "Users must-not ship").otherwise("Users must not ship")).alias("requirements"), F.lit(0).alias("scope"))
    tasks = [r["count"] for r in rules.conflicts(rows, tile=1000).groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(tasks) == 10_000 * 10_000 and max(tasks) < sum(tasks) / 4


def test_contents_of_a_long_document(spark):
    """40,000 entries of one document, whose paths a fold over growing lists would copy 40,000 times."""
    began = time.monotonic()
    toc = spark.range(40_000).select(F.lit("d").alias("doc_id"), F.col("id").alias("seq"), F.col("id").cast("int").alias("page"), (F.col("id") % 7 + 1).cast("int").alias("level"), F.concat(F.lit("t"), "id").alias("title"))
    got = {r["page"]: r["path"] for r in ingest.toc_paths(toc).collect()}
    assert got == {n: [f"t{m}" for m in range(n - n % 7, n + 1)] for n in range(40_000)}
    assert time.monotonic() - began < 60


def test_contents_with_nulls_and_many_documents(spark):
    rows = [(doc, n, n % 4, [1, 2, None, 2, 5, 3, 1, 1][n], f"{doc}{n}" if n != 4 else None) for doc in ("a", "b", None) for n in range(8)]
    toc = spark.createDataFrame(rows, "doc_id string, seq long, page int, level int, title string").repartition(3)
    got = {(r["doc_id"], r["page"]): r["path"] for r in ingest.toc_paths(toc).collect()}
    assert got == {(d, p): w for d in ("a", "b", None) for p, w in {0: [f"{d}3", None], 1: [f"{d}3", f"{d}5"], 2: [f"{d}6"], 3: [f"{d}7"]}.items()}


def test_long_lists_are_cut_in_one_pass(spark):
    """12 texts of 60,000 words, each of which would be split anew for every run of four."""
    began = time.monotonic()
    texts = spark.range(12).repartition(4).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_001)), lambda i: i.cast("string")), " ").alias("text"))
    runs = texts.select(F.explode(T.chunked(F.split("text", " "), 4)).alias("run"))
    assert tuple(runs.agg(F.count("*"), F.sum(F.size("run")), F.sum(F.get("run", F.lit(3)).cast("long"))).first()) == (12 * 15_001, 12 * 60_001, 12 * sum(range(4, 60_001, 4)))
    assert time.monotonic() - began < 20


@pytest.mark.parametrize("name", ["normalize_rules", "prune_rule", "fill_defaults", "counterfactuals"])
def test_a_small_file_of_parts_is_work_for_all_tasks(spark, sf_dir, name):
    assert spark.read.parquet(f"{sf_dir}/part.parquet").rdd.getNumPartitions() == 1
    assert policy.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_values_are_computed_once(spark):
    """As often as a value is named; nulls pass through."""
    rows = spark.createDataFrame([("  Service  Providers ",), ("",), (None,), ("PHI",), ("astronaut",)], "v string")
    got = [tuple(r) for r in rows.select(T.canonical(F.col("v"), "actor"), T.canonical(F.col("v"), "data_domain")).collect()]
    assert got == [("provider", None), (None, None), (None, None), (None, "PHI"), (None, None)]
    shown = rows.select(T.canonical(F.col("v"), "actor").alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("translate") <= 4


def test_columns_of_pages_with_nulls_and_equal_edges(spark):
    import random

    draw = random.Random(2)
    rows = [(n, draw.choice(["a", "b", None]), draw.choice([0, 1, None]), draw.choice([1.0, 2.0, 3.0, None]), draw.choice([5.0, 6.0, None])) for n in range(200)]
    got = {r["seq"]: r["place"] for r in ingest.in_columns(spark.createDataFrame(rows, "seq long, doc_id string, page int, x0 double, y0 double"), task_rows=10).collect()}
    low = lambda x: (x is not None, x)  # noqa: E731  nulls first
    for doc, page in {(r[1], r[2]) for r in rows}:
        own = [r for r in rows if r[1:3] == (doc, page)]
        edges = sorted(r[3] for r in own if r[3] is not None)
        middle = (edges[(len(edges) - 1) // 2] + edges[len(edges) // 2]) / 2
        order = sorted(own, key=lambda r: (low(None if r[3] is None else r[3] > middle), low(r[4]), low(r[3]), r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(own) + 1))


def test_a_large_page_is_ranked_by_many_tasks(spark):
    rows = spark.range(40_000).select(F.lit("d").alias("doc_id"), F.lit(0).alias("page"), F.col("id").alias("seq"), (F.col("id") % 40).cast("double").alias("x0"), (F.col("id") % 900).cast("double").alias("y0"))
    tasks = [r["count"] for r in ingest.in_columns(rows, task_rows=2000).groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(tasks) == 40_000 and max(tasks) < 8000


def test_pages_are_numbered_on_through_a_section(spark):
    """Pages that come twice count their groups in turn; the query shows four digits, the operator all."""
    rows = [("d", p, ["Body"], f"One {n}. Two. Three.") for n, p in enumerate([0, 2, 1, 2])] + [("d", 3, ["Body"], "A. " * 10_000), ("d", 3, ["Other"], "B."), ("d", 4, ["Body"], None)]
    pages = spark.createDataFrame(rows, "doc_id string, page int, section_path array<string>, text string")
    got = sorted((r["page"], int(r["span_id"].rpartition("_")[2])) for r in ingest.spans_from_pages(pages, group_n=2).where("section = 'Body'").collect())
    assert got == [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6), (2, 7), (2, 8)] + [(3, 9 + n) for n in range(5000)]


def test_page_spans_match_their_sql_beyond_four_digits(spark, tmp_path):
    import duckdb

    spark.range(11).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("Go on. "), 4000).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = duck.execute(f"SELECT span_id, page, h, group_size FROM ({policy.ORACLE_SQL['page_spans']})").fetchall()
    assert len(want) == 11_000 and sorted(want) == sorted(tuple(r) for r in policy.QUERIES["page_spans"](spark, str(tmp_path)).collect())


def test_texts_do_not_pass_through_the_windows_of_a_bucket(spark, tmp_path):
    """Candidates of one bucket with texts of 2000 letters are told apart, and find their texts and contexts, without a sort of the texts."""
    texts = spark.range(6000).select(F.col("id").alias("seq"), F.concat(F.lit("d/s"), "id").alias("span_id"), F.lit("d").alias("doc_id"), F.lit("sentence").alias("kind"), F.array(F.lit("Part")).alias("section_path"), F.lit(0).alias("page"), F.lit(0).alias("sent_index"), F.concat(F.lit("Users must log "), (F.col("id") % 50).cast("string"), F.lit("."), F.repeat(F.lit("x"), 2000)).alias("text"))
    found = mining.candidates(texts)
    got = {r["seq"]: ([x[15:17] for x in r["context_prev"]], r["text"][15:17], [x[15:17] for x in r["context_next"]]) for r in found.collect()}
    assert {k: v for k, v in got.items() if 2 <= k < 47} == {n: ([f"{n - 2}."[:2], f"{n - 1}."[:2]], f"{n}."[:2], [f"{n + 1}."[:2], f"{n + 2}."[:2]]) for n in range(2, 47)}
    assert len(got) == 50 and "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_an_answer_is_looked_for_once_in_mending(spark, sf_dir):
    """Not once for each field that is read from it."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = policy.QUERIES["mended_rules"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert 1 <= len(re.findall(r"\$\.rule\b(?!_)", plan)) <= 2
