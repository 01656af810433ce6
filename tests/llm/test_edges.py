"""Odd inputs: nulls in any column, repeated rows, empty tables, clashing names, very long texts and conversations."""

import hashlib
import random

from pyspark.sql import functions as F

from clausemill.llm import chat, warc
from clausemill.llm.storage import Scratch


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]) + str(r.randrange(50)) for _ in range(n))


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    import corpus_pipeline

    text = prose(1, 300)
    rows = [(None, text, None, None, None), (None, text, "en", "a", 1), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, prose(2, 80), None, None, 5), (3, prose(2, 80), None, None, 5), (4, "12 34", "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("fp", "row", "left", "key", "uid", "x.y`z"):
        docs = docs.withColumn(name, F.lit("mine"))
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40").select("doc_id", "text", "lang", "source", "n_chars")
    for name in ("fp", "row", "left", "key", "uid", "x.y`z"):
        known = known.withColumn(name, F.lit("mine"))
    kept = {"language": None, "near_copies": 2, "passages": 2, "benchmark": None}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = docs.unionByName(known.withColumn("doc_id", F.col("doc_id") + 1000)) if name == "language" else docs
        out = stage(spark, given, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.where("doc_id is null or doc_id < 1000").collect()
        assert all(r["fp"] == "mine" and r["x.y`z"] == "mine" for r in rows)
        if kept[name]:  # of the copies without an id one stays, and one of those with id 3
            assert len([r for r in rows if r["text"] == text]) == 1 and len([r for r in rows if r["doc_id"] == 3]) == 1, name
        assert stage(spark, given.limit(0), sf_dir).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(packed) == 7 or len({(r["doc_id"], r["piece"]) for r in packed}) >= 6


def test_a_long_conversation_and_a_long_turn(spark):
    n = 4000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 1, "user").otherwise("assistant").alias("role"), F.concat(F.lit("said "), F.col("id")).alias("text"))
    long = spark.createDataFrame([(2, 0, "user", "q"), (2, 1, "assistant", "x y " * 250_000)], "conv_id long, turn long, role string, text string")
    rows = turns.unionByName(long)
    for name in ("pos", "window", "cost", "again"):
        rows = rows.withColumn(name, F.lit(name))
    windows = chat.format_windows(rows, budget=200, history_turns=2, history_budget=60)
    assert windows.where("conv_id = 1").count() > 100
    assert windows.where("conv_id = 1").agg(F.max("cost")).first()[0] <= 200
    read = {r["conv_id"]: r for r in chat.read_windows(windows).collect()}
    assert [t["text"] for t in read[1]["turns"]] == [f"said {i}" for i in range(n)]
    assert read[1]["targets"] == [f"said {i}" for i in range(2, n, 2)]
    assert read[2]["targets"] == ["x y " * 250_000]


def test_a_long_page_and_clashing_names(spark):
    pages = spark.createDataFrame([(1, "u", "ä" * 3_000_000), (2, "v", "ä" * 3_000_000), (3, None, "short")], "page_id long, url string, html string")
    for name in ("payload", "digest", "size", "refers_to", "n"):
        pages = pages.withColumn(name, F.lit(name))
    out = {r["page_id"]: r for r in warc.read_records(warc.write_bundles(pages, Scratch(spark))).collect()}
    assert {i: (r["record_type"], r["refers_to"], r["payload_bytes"]) for i, r in out.items()} == {1: ("revisit", 2, 6_000_000), 2: ("response", None, 6_000_000), 3: ("response", None, 5)}
    assert out[2]["payload_digest"] == hashlib.sha1(("ä" * 3_000_000).encode()).hexdigest()
