"""Order-dependent operators against plain loops, and the model boundary."""

import json
import random

import pytest
from pyspark.sql import functions as F

from clausemill.functions import jsonrules as J
from clausemill.operators import dedup, ingest, metrics, mining, rules
from clausemill.plans.policy_pipeline import run
from clausemill.providers import Http, Registry, Replay, Rules, Service, judge_verdict, recorded, request
from clausemill.sources import loaders, sinks

SPANS = "seq long, span_id string, doc_id string, kind string, section_path array<string>, page int, sent_index int, text string"


def spans(spark, texts, **more):
    row = {"doc_id": "d", "kind": "sentence", "section_path": ["Part"], "page": 0, "sent_index": 0} | more
    return spark.createDataFrame([(n, f"d/s{n}", row["doc_id"], row["kind"], row["section_path"], row["page"], row["sent_index"], t) for n, t in enumerate(texts)], SPANS)


def test_bullets_chain_types(spark):
    rows = spans(spark, ["The user shall act:", "(a) log data", "- includes a gate that must run", "(c) keep it", "This document is old.", "(d) more"])
    got = {r["seq"]: (r["type"], r["inherited_from"]) for r in mining.classified(mining.in_buckets(rows)).collect()}
    assert got[1] == ("obligation", "d/s0")
    assert got[2] == ("obligation", "d/s0")
    assert got[3] == ("obligation", "d/s2")  # the inherited row has a cue, so it is the next source
    assert 4 not in got
    assert got[5] == ("obligation", "d/s2")


def test_context_counts_rows_that_are_not_mined(spark):
    rows = spans(spark, ["Users must act now.", "", "This document ends.", "Users must not act."])
    got = {r["seq"]: (r["context_prev"], r["context_next"]) for r in mining.candidates(rows).collect()}
    assert got[0] == ([], ["", "This document ends."])
    assert got[3] == (["", "This document ends."], [])


def test_prohibition_without_actor_goes(spark):
    assert mining.candidates(spans(spark, ["Access must not be granted."])).count() == 0


def test_nulls_and_empty_spans(spark):
    assert mining.candidates(spans(spark, [])).count() == 0
    odd = spans(spark, [None, "Users must act."], doc_id=None, section_path=None, page=None, sent_index=None)
    assert [r["seq"] for r in mining.candidates(odd).collect()] == [1]


def test_greedy_keeps_the_first_of_chains(spark):
    random.seed(3)
    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60) if random.random() < 0.08]
    near = {b: {a for a, x in pairs if x == b} for b in range(60)}
    kept, want = set(), {}
    for i in range(60):
        found = sorted(near[i] & kept)
        if found:
            want[i] = found[0]
        else:
            kept.add(i)
    got = {r["b"]: r["kept"] for r in dedup.greedy(spark.createDataFrame([(a, b, 0.9) for a, b in pairs], "a long, b long, sim double")).collect()}
    assert got == want
    assert dedup.greedy(spark.createDataFrame([], "a long, b long, sim double")).count() == 0


def test_zero_vectors_are_like_none(spark):
    items = spark.createDataFrame([(1, "x", [0.0, 0.0]), (2, "x", [1.0, 0.0]), (3, "x", [2.0, 0.0]), (4, "y", [1.0, 0.0])], "seq long, block string, vector array<float>")
    assert [tuple(r) for r in dedup.similar_pairs(items, 0.9).select("a", "b").collect()] == [(2, 3)]


def test_pr_curve_with_ties(spark):
    scored = spark.createDataFrame([("a", 0.9, True), ("b", 0.9, False), ("c", 0.5, True)], "span_id string, score double, hit boolean")
    rows = [tuple(r) for r in metrics.pr_curve(scored, 2).orderBy("k").select("k", "span_id", "tp", "fp").collect()]
    assert rows == [(0, "", 0, 0), (1, "a", 1, 0), (2, "b", 1, 1), (3, "c", 2, 1)]
    assert abs(metrics.auprc(metrics.pr_curve(scored, 2), 2).first()[0] - (0.5 + 0.5 * 2 / 3)) < 1e-5


def test_mcnemar_is_exact(spark):
    rows = spark.createDataFrame([(True, False)] * 6 + [(False, True)] * 1 + [(True, True)] * 4, "a boolean, b boolean")
    assert tuple(metrics.mcnemar(rows, "a", "b").first()) == (6, 1, 0.125)


def test_split_rules_lose_their_id(spark):
    rows = spark.createDataFrame([("r", ["a", "b"]), ("s", ["c"]), ("t", [])], "rule_id string, requirements array<string>")
    assert sorted((str(r["rule_id"]), r["requirements"]) for r in rules.split_composite(rows).collect()) == [("None", ["a"]), ("None", ["b"]), ("s", ["c"]), ("t", [])]


def test_model_text_is_parsed_or_an_error(spark):
    raws = ['{"rules": []}', 'x [{"rule_id": "a"}]', '[{"rule_id":"b"}] and more', "", None]
    rows = spark.createDataFrame([(n, r) for n, r in enumerate(raws)], "n int, raw string").select("n", J.parse_rules(F.col("raw")).alias("p")).orderBy("n").collect()
    assert [None if r["p"]["rules"] is None else [x["rule_id"] for x in r["p"]["rules"]] for r in rows] == [[], ["a"], ["b"], None, None]
    assert rows[4]["p"]["error"]


def test_a_false_string_is_false(spark):
    rows = spark.createDataFrame([('{"pass":"false","reason":"r"}',), ("junk",), ('{"pass":true}',)], "raw string").select(judge_verdict(F.col("raw")).alias("v")).collect()
    assert [r["v"]["pass"] for r in rows] == [False, True, True]


def test_pipeline_with_replay(spark):
    clause = "The provider shall redact the response output."
    table = recorded([("extract", clause, {"rules": [{"hazard": "Leak", "severity": "High", "requirements": [clause], "scope": {"actor": ["company"]}}]})])
    stages = run(spark, spans(spark, [clause]), Replay(spark.createDataFrame(table, "request_id string, raw string")))
    rule = stages["cleaned"].first()
    assert (rule["severity"], rule["scope"]["actor"], rule["hazard"]) == ("high", ["org"], "Leak")
    tag = stages["tagged"].first()
    assert tag["is_testable"] is None and tag["testability"]["error"] == "not recorded"


def test_pipeline_with_rules(spark):
    stages = run(spark, spans(spark, ["The provider shall log every response output.", "The provider shall log every response output!"]), Rules(), target_n=2)
    assert stages["cleaned"].count() == 1 and stages["duplicates"].count() == 1
    assert stages["test_cases"].count() == 4


def test_http_errors_are_rows(spark):
    def call(op, prompt, n):
        if prompt == "bad":
            raise ValueError("no")
        return prompt * n

    asked = spark.createDataFrame([("bad",), ("x",)], "p string").select(*request("extract", F.col("p"), 2))
    got = sorted((r["raw"] or "", r["error"] or "") for r in Http(call, attempts=2, pause=0.0).complete(asked).collect())
    assert got[1] == ("xx", "") and "no" in got[0][1]


def test_loaders_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"rule_id": "a"}, {"rule_id": "b"}]))
    (tmp_path / "b.json").write_text(json.dumps({"rules": [{"rule_id": "c"}]}))
    (tmp_path / "c.jsonl").write_text('{"rule": {"rule_id": "d"}}\n\n{"rule_id": "e"}\n{"rules": [{"rule_id": "f"}, {"rule_id": "g"}]}\n')
    found = loaders.rules(spark, *(str(tmp_path / f) for f in ("a.json", "b.json", "c.jsonl")))
    assert [r["rule_id"] for r in found.orderBy("seq").collect()] == list("abcdefg")
    (tmp_path / "s.jsonl").write_text('{"span_id": "x/1", "text": "t"}\n\nnot json\n')
    assert [r["span_id"] for r in loaders.json_lines(spark, str(tmp_path / "s.jsonl")).collect()] == ["x/1"]
    assert sinks.rule_list(found.drop("seq"), str(tmp_path / "out.yaml")) == 7
    sinks.tab_separated(spark.createDataFrame([(0.5, "a")], "sim double, id string"), str(tmp_path / "tsv"))
    assert "0.5000\ta" in "".join(p.read_text() for p in (tmp_path / "tsv").glob("part-*"))


def test_rules_of_many_files_keep_their_order(spark, tmp_path):
    inputs = []
    for side in "ab":
        folder = tmp_path / f"{side}.jsonl"
        folder.mkdir()
        for n in range(40):  # sizes that Spark would order otherwise
            (folder / f"{n:03}.jsonl").write_text("".join(json.dumps({"rule_id": f"{side}{n:03}-{i}", "hazard": "h" * (n * 7 % 40)}) + "\n" for i in range(1 + n % 3)))
        inputs.append(str(folder))
    found = loaders.rules(spark, *inputs)
    want = [f"{side}{n:03}-{i}" for side in "ab" for n in range(40) for i in range(1 + n % 3)]
    assert [r["rule_id"] for r in found.orderBy("seq").collect()] == want
    assert found.select("seq").distinct().count() == len(want)
    lines = loaders.json_lines(spark, inputs[0], "rule_id string")
    assert [r["rule_id"] for r in lines.orderBy("seq").collect()] == want[: len(want) // 2]


def test_repeating_lines_follow_each_documents_length(spark):
    rows = [("long", page, "Header") for page in range(4)] + [("long", 5, "x"), ("long", 11, "y")] + [("short", page, "Header") for page in range(2)]
    found = ingest.repeating(spark.createDataFrame(rows, "doc_id string, page int, line string"))
    assert {r["doc_id"]: r["times"] for r in found.collect()} == {"short": 2}


def test_toc_paths_of_any_depth(spark):
    levels = [1, 2, 3, 4, 5, 6, 7, 8, 2, 9, None]
    toc = spark.createDataFrame([("d", n, n, level, f"t{n}") for n, level in enumerate(levels) if level], "doc_id string, seq long, page int, level int, title string")
    got = {r["page"]: r["path"] for r in ingest.toc_paths(toc).collect()}
    assert got[7] == [f"t{n}" for n in range(8)] and got[8] == ["t0", "t8"] and got[9] == ["t0", "t8", "t9"]


def test_similar_pairs_over_many_tiles(spark):
    import numpy as np

    vectors = np.random.default_rng(1).normal(size=(60, 4)).round(3)
    rows = [(n, "x", v.tolist()) for n, v in enumerate(vectors)] + [(100, "x", None), (101, None, [1.0])]
    items = spark.createDataFrame(rows, "seq long, block string, vector array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if unit[a] @ unit[b] >= 0.8}
    for tile in (7, 1000):
        got = [(r["a"], r["b"]) for r in dedup.similar_pairs(items, 0.8, tile=tile).collect()]
        assert set(got) == want and len(got) == len(want)
    assert dedup.similar_pairs(items.limit(0), 0.8).count() == 0


def test_semantic_dedup_moves_provenance(spark):
    from clausemill.plans.policy_pipeline import deduplicated

    source = "struct<doc: string, citation: string, span_id: string>"
    scope = "struct<actor: array<string>, data_domain: array<string>, context: array<string>>"
    schema = f"seq long, rule_id string, source {source}, scope {scope}, hazard string, conditions array<string>, exceptions array<string>, requirements array<string>, evidence array<string>, severity string, error string, issues array<string>"
    rows = [(n, f"r{n}", ("d", "c", f"s{n}"), (["org"], [], []), "h", [], [], [text], [], "low", None, []) for n, text in enumerate(["log it", "keep a log", "log it", "delete it"])]
    extracted = spark.createDataFrame(rows, schema)
    near = {0: [1.0, 0.0], 1: [0.99, 0.1], 3: [0.0, 1.0]}

    def embed(texts):
        return texts.join(spark.createDataFrame([(k, v) for k, v in near.items()], "seq long, vector array<double>"), "seq").select("seq", "vector")

    got = deduplicated(extracted, embed=embed, threshold=0.9, preview=5)
    assert sorted(r["rule_id"] for r in got["cleaned"].collect()) == ["r0", "r3"]
    assert {r["duplicate_rule_id"]: r["kept_rule_id"] for r in got["duplicates"].collect()} == {"r1": "r0", "r2": "r0"}
    assert {(r["kept_rule_id"], r["span_id"]) for r in got["provenance"].collect()} == {("r0", "s0"), ("r0", "s1"), ("r0", "s2"), ("r3", "s3")}
    assert [(r["a_rule_id"], r["b_rule_id"]) for r in got["pairs"].collect()] == [("r0", "r1")]
    assert sorted(r["rule_id"] for r in deduplicated(extracted)["cleaned"].collect()) == ["r0", "r1", "r3"]


def test_permutation_test_on_clear_and_unclear_cases(spark):
    clear = spark.createDataFrame([(True, False)] * 70 + [(False, True)] * 2, "a boolean, b boolean")
    even = spark.createDataFrame([(True, False)] * 20 + [(False, True)] * 20, "a boolean, b boolean")
    assert metrics.permutation(clear, "a", "b").first()["p_value"] < 0.01
    assert metrics.permutation(even, "a", "b").first()["p_value"] > 0.8
    assert metrics.permutation(clear.limit(0), "a", "b").first()["p_value"] == 1.0


def test_pages_become_spans(spark):
    kind = "doc_id string, page int, seq long, x0 double, y0 double, x1 double, y1 double, height double, size double, text string, error string"

    def line(doc, page, seq, x, y, size, text):
        return (doc, page, seq, float(x), float(y), float(x + 100), float(y + 10), 800.0, float(size), text, None)

    rows = [("broken", 0, 0, *[None] * 6, None, "no PDF")]
    for page in range(4):
        rows += [line("a", page, 10 * page, 50, 100, 9, "Running head"), line("a", page, 10 * page + 1, 50, 10, 9, "in the margin")]
        rows += [line("a", page, 10 * page + 2, 50, 200, 9, f"Users must log {page}. Staff shall act."), line("a", page, 10 * page + 3, 400, 120, 9, f"Right column {page}.")]
        rows += [line("a", page, 10 * page + 4, 50, 740, 5, "1 a footnote")]
    rows += [line("a", 1, 15 + n, 50, 150 + 12 * n, 20, "More in large type" if n else "Big Heading") for n in range(4)]  # the limit is the median of six sizes
    rows += [line("a", 2, 25, 50, 300, 9, "Table 3 shows rows")]
    spans = ingest.assembled(spark.createDataFrame(rows, kind), tables=spark.createDataFrame([("a", 2, 0, [["x", " y"], ["1", None]])], "doc_id string, page int, nth int, rows array<array<string>>"), figures=spark.createDataFrame([("a", 3, 1, " ")], "doc_id string, page int, nth int, summary string"), group_n=2)
    got = {r["span_id"]: r for r in spans.collect()}
    text = " ".join(r["text"] for r in got.values())
    assert "Running head" not in text and "margin" not in text and "footnote" not in text
    assert [r["text"] for r in got.values() if r["kind"] == "error"] == ["Extraction error: no PDF"]
    assert got["a/big-heading/table_3_00"]["text"] == "x, y\n1, " and got["a/big-heading/caption_3_00"]["text"] == "Table 3 shows rows"
    assert got["a/big-heading/figure_4_01_summary"]["text"] == "(no summary)"
    assert any(r["section_path"] == ["Big Heading"] and "Users must log 1." in r["text"] for r in got.values())
    toc = spark.createDataFrame([("a", 0, 0, 1, "One"), ("a", 1, 2, 2, "Two")], "doc_id string, seq long, page int, level int, title string")
    listed = ingest.assembled(spark.createDataFrame(rows, kind), toc=toc)
    assert {tuple(r["section_path"]) for r in listed.where("kind = 'sentence'").collect()} == {("One",), ("One", "Two")}


def test_command_line_writes_all_stages(spark, tmp_path):
    from clausemill.__main__ import main

    (tmp_path / "spans.jsonl").write_text("".join(json.dumps({"span_id": f"d/s{n}", "doc_id": "d", "kind": "sentence", "section": "Part", "section_path": ["Part"], "page": 1, "text": t}) + "\n" for n, t in enumerate(["The provider shall log every response output.", "Plain remark."])))
    written = main([str(tmp_path / "spans.jsonl"), str(tmp_path / "out"), "--target-n", "2"])
    assert written["candidates"] == written["cleaned"] == 1 and written["test_cases"] == 4


def test_registry_probes_models():
    class Client:
        def __init__(self, key):
            self.key = key

        def models(self):
            return ["other-1", "fam-broken", "fam-good"]

        def ask(self, model, text):
            if model in ("fam-broken", "gone"):
                raise OSError("no")

    known = Registry(some=Service("SOME_KEY", Client, families=("fam",), preferred=("fam-last",)))
    client = known.client("Some", {"SOME_KEY": "k"})
    assert client.key == "k"
    assert known.model("some", client) == "fam-good" and known.model("some", client, "other-1") == "other-1" and known.model("some", client, "gone") == "fam-good"
    with pytest.raises(ValueError, match="Unknown provider"):
        known.client("none")
    with pytest.raises(RuntimeError, match="SOME_KEY"):
        known.client("some", {})
