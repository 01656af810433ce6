"""PDF pages as blocks of text, parsed on the executors where PyMuPDF is installed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BLOCKS = "doc_id string, page int, seq long, x0 double, y0 double, x1 double, y1 double, height double, size double, text string, error string"


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of each page with its box and type size; a file that can't be read gives one row with its error."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        names = [part.split()[0] for part in BLOCKS.split(", ")]
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                doc_id, rows = file.rsplit("/", 1)[-1].rsplit(".", 1)[0], []
                try:
                    with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                        for number, page in enumerate(doc):
                            for block in page.get_text("dict")["blocks"]:
                                for line in block.get("lines", []):
                                    text = " ".join(s["text"] for s in line["spans"]).strip()
                                    size = max((s["size"] for s in line["spans"]), default=0.0)
                                    rows.append((doc_id, number, len(rows), *line["bbox"], page.rect.height, size, text, None))
                except Exception as error:  # a broken file is a row, not the end of the run
                    rows = [(doc_id, 0, 0, *[None] * 6, None, repr(error)[:300])]
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, BLOCKS)
