"""What the Python workers of an executor hold at once."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausemill.llm import jaccard_join, passages
from clausemill.llm.storage import BATCH_ROWS, Scratch

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def workers(frame):
    """How many Python workers one task of the plan runs at once, at most."""
    most, open_ = 0, {}  # workers since the last exchange, by depth
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        if not (found := re.match(r"([\s:|+\-]*)(?:\*\s?\(\d+\)\s*)?(\w+)", line)) or "== " in line:
            continue
        depth, node = len(found[1]), found[2]
        open_ = {d: n for d, n in open_.items() if d < depth}
        above = open_[max(open_)] if open_ else 0
        open_[depth] = 0 if "Exchange" in node else above + (node in ("MapInArrow", "MapInPandas"))
        most = max(most, open_[depth])
    return most


@pytest.mark.parametrize("stage", [jaccard_join.one_of_each, passages.remove])
def test_a_task_runs_one_worker(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 300")
    assert workers(docs.mapInArrow(lambda b: b, docs.schema).where("doc_id > 1").mapInArrow(lambda b: b, docs.schema)) == 2
    assert workers(stage(docs)) == 1


def test_written_tables_send_texts_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = spark.range(0, 3 * BATCH_ROWS + 5, 1, 1)
    before = spark.conf.get(BATCH, None)
    found = Scratch(spark).keep(rows.mapInArrow(sizes, "n long"), "sizes").agg(F.max("n"), F.sum("n")).first()
    assert tuple(found) == (BATCH_ROWS, 3 * BATCH_ROWS + 5)
    assert spark.conf.get(BATCH, None) == before


@pytest.mark.parametrize(("own", "held"), [(None, str(BATCH_ROWS)), ("0", str(BATCH_ROWS)), ("500", "500")])
def test_results_of_stages_go_in_small_batches(spark, sf_dir, own, held):
    import corpus_pipeline

    before = spark.conf.get(BATCH, None)
    try:
        spark.conf.set(BATCH, own) if own else spark.conf.unset(BATCH)
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(5)
        assert corpus_pipeline.drop_benchmark_hits(spark, docs, sf_dir).columns == docs.columns
        assert spark.conf.get(BATCH) == held
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)
