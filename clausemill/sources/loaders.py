"""Readers of spans, candidates and rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import ensure_checkpoints
from ..schema import RULE, RULE_STRUCT, SPAN


_ROWS = 33  # bits for the place of a line within its split


def _lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """value, file, start, row: lines with the split they stand in and their order there."""
    return spark.read.text(path, **options).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().bitwiseAND((1 << _ROWS) - 1).alias("row"))


def numbered(lines: DataFrame) -> DataFrame:
    """Adds `seq`, the order of reading: file by file in order of their names, then as they stand in the file.

    Only the list of splits is put in order, never the lines.
    """
    splits = lines.select("file", "start").distinct()
    splits = splits.withColumn("split", F.row_number().over(Window.orderBy("file", "start")).cast("long") - 1)
    return lines.join(splits, ["file", "start"]).withColumn("seq", F.shiftleft("split", _ROWS) + F.col("row")).drop("split")


def json_lines(spark: SparkSession, path: str, schema: str = SPAN, *, skip_bad: bool = True) -> DataFrame:
    """Records of a JSONL file; blank lines never count, bad ones are skipped or stop the run."""
    lines = numbered(_lines(spark, path)).where(F.trim("value") != "")
    mode = "PERMISSIVE" if skip_bad else "FAILFAST"
    parsed = lines.select("seq", F.from_json("value", f"{schema}, _bad string", {"mode": mode, "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad is null").select("seq", "r.*").drop("_bad")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """file, start, row, raw: each JSON line of a .jsonl file, each other file whole."""
    lines = _lines(spark, path) if path.endswith(".jsonl") else _lines(spark, path, wholetext=True)
    return lines.select("file", "start", "row", F.col("value").alias("raw")).where(F.trim("raw") != "")


def rules(spark: SparkSession, *paths: str) -> DataFrame:
    """Rules of all inputs in order: JSON lists, {"rules": [...]}, JSONL of bare or wrapped rules, YAML lists.

    `seq` counts up through the inputs as given, the files of each by name, and
    the rules as they stand.  The result is checkpointed, so it stays the same.
    """
    ensure_checkpoints(spark)
    out = None
    for number, path in enumerate(paths):
        if path.endswith((".yaml", ".yml")):
            found = yaml_rules(spark, path)
        else:
            raw = F.col("raw")
            lists = F.from_json(raw, f"array<{RULE_STRUCT}>")
            wrapped = F.from_json(raw, f"rules array<{RULE_STRUCT}>, rule {RULE_STRUCT}")
            # from_json reads an object as a list of one, so the wrappers are asked first
            each = F.coalesce(wrapped["rules"], F.when(wrapped["rule"].isNotNull(), F.array(wrapped["rule"])), F.when(F.ltrim(raw).startswith("["), lists), F.array(F.from_json(raw, RULE)))
            found = _documents(spark, path).select("file", "start", "row", F.posexplode(each).alias("pos", "r")).select("file", "start", "row", "pos", "r.*")
        found = found.withColumn("input", F.lit(number))
        out = found if out is None else out.unionByName(found)
    order = ["input", "file", "start", "row", "pos"]
    return out.orderBy(*order).withColumn("seq", F.monotonically_increasing_id()).drop(*order).checkpoint()


def yaml_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of YAML files, parsed one file at a time on the executors; needs PyYAML there."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for frame in frames:
            rows = [(file, n, json.dumps(r, default=str)) for file, content in zip(frame["path"], frame["content"], strict=True) for n, r in enumerate(yaml.safe_load(bytes(content)) or [])]
            yield pd.DataFrame(rows, columns=["file", "pos", "raw"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    zero = F.lit(0).cast("long")
    return files.mapInPandas(parse, "file string, pos int, raw string").select("file", zero.alias("start"), zero.alias("row"), "pos", F.from_json("raw", RULE).alias("r")).select("file", "start", "row", "pos", "r.*")
