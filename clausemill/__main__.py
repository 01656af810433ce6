"""The stages from spans to an enforcement table, from the command line: python -m clausemill SPANS OUT."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.policy_pipeline import run
from .providers import Replay, Rules
from .sources import loaders


def main(words: list[str] | None = None) -> dict[str, int]:
    """Writes each stage's frame as JSON lines under OUT; returns how many rows each has."""
    said = argparse.ArgumentParser(prog="clausemill", description=__doc__)
    said.add_argument("spans", help="JSONL file or folder of spans")
    said.add_argument("out", help="folder for the stages' results")
    said.add_argument("--answers", help="JSONL of recorded answers (request_id, raw); without it rules answer deterministically")
    said.add_argument("--no-mine", action="store_true", help="take every span as a candidate")
    said.add_argument("--include-tables", action="store_true")
    said.add_argument("--keep-informative", action="store_true")
    said.add_argument("--strict", action="store_true", help="citation and span count as well when rules are compared")
    said.add_argument("--ctx-window", type=int, default=2)
    said.add_argument("--target-n", type=int, default=5, help="benign and adversarial prompts for each rule")
    given = said.parse_args(words)
    spark = SparkSession.builder.appName("clausemill").getOrCreate()
    provider = Replay(spark.read.schema("request_id string, raw string").json(given.answers)) if given.answers else Rules()
    spans = loaders.json_lines(spark, given.spans)
    stages = run(spark, spans, provider, mine=not given.no_mine, strict=given.strict, target_n=given.target_n, keep_informative=given.keep_informative, include_tables=given.include_tables, ctx_window=given.ctx_window)
    written = {}
    for name, frame in stages.items():
        frame.write.mode("overwrite").json(f"{given.out}/{name}")
        written[name] = spark.read.text(f"{given.out}/{name}").count()
        print(f"{name}: {written[name]}")
    return written


if __name__ == "__main__":
    main()
