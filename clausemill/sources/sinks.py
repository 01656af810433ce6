"""Writers.  Stage outputs are tables at new paths, never changed in place; the rest are exports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(frame: DataFrame, folder: str, stage: str, version: int) -> str:
    """Writes a stage's output as a version of its own; earlier ones stay as they are."""
    path = f"{folder}/{stage}/v{version:04d}"
    frame.write.mode("errorifexists").parquet(path)
    return path


def json_lines(frame: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    frame.write.mode("append").option("ignoreNullFields", "false").json(path)


def tab_separated(frame: DataFrame, path: str) -> None:
    """Reports of duplicates, provenance and similar pairs; similarities with four digits."""
    doubles = [c for c, kind in frame.dtypes if kind == "double"]
    shown = frame.withColumns({c: F.format_string("%.4f", c) for c in doubles}) if doubles else frame
    shown.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def rule_list(rules: DataFrame, path: str, most: int = 100_000) -> int:
    """A YAML list (JSON without PyYAML) of a rule set that a person edits; the driver writes it, so its size is checked."""
    rows = [json.loads(r[0]) for r in rules.select(F.to_json(F.struct(*rules.columns), {"ignoreNullFields": "false"})).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"over {most} rules: write a table instead")
    try:
        import yaml

        text = yaml.safe_dump(rows, allow_unicode=True, sort_keys=False)
    except ImportError:
        text = json.dumps(rows, ensure_ascii=False, indent=2)
    Path(path).write_text(text, encoding="utf-8")
    return len(rows)


def sheet(frame: DataFrame, path: str) -> None:
    """A CSV with a header, dots in names kept."""
    frame.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
