"""Page geometry and lines to spans: sections, repeated lines, columns, margins, footnotes, captions, tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import patterns as P
from ..functions.text import chunked, sentences, sha8, slug, strip
from ..lineage import ensure_checkpoints


def toc_paths(toc: DataFrame) -> DataFrame:
    """doc_id, page, path: each entry's titles from level 1 down; of entries on one page the last.

    The path of an entry is, for each level up to its own, the last title of
    that level since a title of a higher one: a stack, for any number of
    levels.  A document's entries pass in order and only the stack is held.
    """
    order = ("seq", "page", "level", "title")
    given = toc.select("doc_id", F.col("seq").cast("long"), F.col("page").cast("int"), F.col("level").cast("int"), "title")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, open_ = None, []
        for batch in batches:
            docs, levels, titles = (batch.column(c).to_pylist() for c in ("doc_id", "level", "title"))
            paths = []
            for doc, level, title in zip(docs, levels, titles, strict=True):
                if doc != of:
                    of, open_ = doc, []
                open_ = [x for x in open_ if x[0] is not None and level is not None and x[0] < level]
                open_.append((level, title))
                paths.append([x[1] for x in open_])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seq"), batch.column("page"), pa.array(paths, pa.list_(pa.string()))], ["doc_id", "seq", "page", "path"])

    rows = given.repartition("doc_id").sortWithinPartitions("doc_id", *order).mapInArrow(walk, StructType([given.schema[c] for c in ("doc_id", "seq", "page")] + [StructField("path", ArrayType(StringType()))]))
    return rows.groupBy("doc_id", "page").agg(F.max_by("path", "seq").alias("path"))


def heading_starts(spans: DataFrame) -> DataFrame:
    """doc_id, page, heading: the first line at or above the median of the document's six largest sizes, else the last one before, else the page's number."""
    rank = Window.partitionBy("doc_id").orderBy(F.desc("size"), "seq")
    large = spans.withColumn("nth", F.row_number().over(rank)).where("nth <= 6").groupBy("doc_id").agg(F.percentile("size", F.lit(0.5)).alias("limit"))
    fits = (F.col("size") >= F.col("limit")) & F.length(F.trim("text")).between(4, 120) & (F.size(F.split(F.trim("text"), r"\s+")) <= 18)
    pages = spans.join(large, "doc_id").groupBy("doc_id", "page").agg(F.min_by(F.when(fits, F.trim("text")), F.when(fits, F.col("seq"))).alias("own"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return pages.select("doc_id", "page", F.coalesce(F.last("own", ignorenulls=True).over(before), F.concat(F.lit("Page "), F.col("page") + 1)).alias("heading"))


def section_of(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """As-of join: the last section that starts at or before a page; before any, the first."""
    every = pages.select("doc_id", "page", F.lit(1).alias("side"), F.lit(None).cast(starts.schema["path"].dataType).alias("path")).unionByName(starts.select("doc_id", "page", F.lit(0).alias("side"), "path"))
    order = Window.partitionBy("doc_id").orderBy("page", "side")
    last = F.last("path", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("path", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return every.select("doc_id", "page", "side", F.coalesce(last, first).alias("path")).where("side = 1").drop("side")


def lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row per stripped line with its number."""
    return pages.select("doc_id", "page", F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", strip(F.col("line")))


def repeating(page_lines: DataFrame) -> DataFrame:
    """doc_id, line_hash, times of lines that come often on a document's first pages: headers and footers.

    Counts occurrences, not pages, over the first ten pages at most; the limit
    follows each document's own number of pages.
    """
    pages = page_lines.groupBy("doc_id").agg(F.least(F.lit(10), F.max("page") + 1).alias("n"))
    often = page_lines.where((F.col("page") < 10) & (F.col("line") != "")).groupBy("doc_id", "page", sha8(F.col("line")).alias("line_hash")).agg(F.count("*").alias("times"))
    often = often.join(pages, "doc_id").where("page < n").groupBy("doc_id", "line_hash", "n").agg(F.sum("times").alias("times"))
    return often.where(F.col("times") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2))).drop("n")


def without_repeating(page_lines: DataFrame, often: DataFrame) -> DataFrame:
    return page_lines.withColumn("line_hash", sha8(F.col("line"))).join(often, ["doc_id", "line_hash"], "left_anti").drop("line_hash")


def page_text(page_lines: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return page_lines.groupBy("doc_id", "page").agg(F.array_join(ordered, "\n").alias("text"))


def _beside(rows: DataFrame, few: DataFrame, keys: Sequence[str], most: int = 500_000) -> DataFrame:
    """Joined on keys in which null equals null; `few` is sent to all executors if it has at most so many rows."""
    few = few.withColumnsRenamed({k: f"_{k}" for k in keys})
    met = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(F.broadcast(few) if few.count() <= most else few, met).drop(*[f"_{k}" for k in keys])


def in_columns(blocks: DataFrame, *, task_rows: int = 500_000) -> DataFrame:
    """Adds `place`: the left column first, split at the median left edge; each from top to bottom.

    Blocks are ranked among those of one column and height only, and how many
    come before these is counted; so no task holds a page, and tasks have
    about `task_rows` blocks, however many there are.
    """
    ensure_checkpoints(blocks.sparkSession)
    page, band = ["doc_id", "page"], ["doc_id", "page", "right", "y0"]
    middles = blocks.groupBy(*page).agg(F.percentile("x0", F.lit(0.5)).alias("middle"), F.count("*").alias("blocks")).checkpoint()
    split = _beside(blocks, middles.drop("blocks"), page).withColumn("right", F.col("x0") > F.col("middle")).drop("middle")
    before = F.sum("n").over(Window.partitionBy(*page).orderBy("right", "y0").rowsBetween(Window.unboundedPreceding, -1))
    bands = split.groupBy(*band).agg(F.count("*").alias("n")).select(*band, F.coalesce(before, F.lit(0)).alias("before")).checkpoint()
    total = middles.agg(F.sum("blocks")).first()[0] or 0
    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_rows))
    nth = F.row_number().over(Window.partitionBy(*band).orderBy("x0", "seq"))
    ranked = split.repartition(parts, *band).withColumn("nth", nth)
    return _beside(ranked, bands, band).withColumn("place", (F.col("before") + F.col("nth")).cast("int")).drop("right", "before", "nth")


def inside_margins(blocks: DataFrame, *, top: float = 30, bottom: float = 50) -> DataFrame:
    """Blocks between the margins that are not blank; where none is, all that are not blank."""
    shown = blocks.where(F.trim("text") != "")
    fits = (F.col("y0") > top) & (F.col("y1") < F.col("height") - bottom)
    any_fits = F.max(fits.cast("int")).over(Window.partitionBy("doc_id", "page"))
    return shown.withColumn("fits", fits).withColumn("any_fits", any_fits).where("fits or any_fits = 0").drop("fits", "any_fits")


def without_footnotes(page_lines: DataFrame, *, share: float = 0.20, bottom: float = 0.10) -> DataFrame:
    """Lines but for those at the page's foot whose spans are all in the page's smallest type."""
    sizes = page_lines.groupBy("doc_id", "page").agg(F.array_sort(F.flatten(F.collect_list("sizes"))).alias("all"))
    at = F.greatest(F.lit(1), F.floor(F.size("all") * share)).cast("int")
    limits = sizes.select("doc_id", "page", F.get("all", at - 1).alias("limit"))
    foot = (F.col("y1") >= F.col("height") * (1 - bottom)) & F.expr("forall(sizes, s -> s <= limit)")
    return page_lines.join(limits, ["doc_id", "page"]).where(~foot).drop("limit")


def captions(blocks: DataFrame) -> DataFrame:
    kind, label = (F.regexp_extract(F.trim("text"), P.CAPTION, i) for i in (1, 2))
    return blocks.where(F.trim("text").rlike(P.CAPTION)).select("doc_id", "page", "seq", F.lower(kind).alias("kind"), label.alias("label"), F.trim("text").alias("text"))


def flat_table(rows: Column) -> Column:
    """Cells trimmed and joined by commas, rows by line feeds."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), ", ")), "\n")


def spans_from_pages(pages: DataFrame, *, group_n: int = 4) -> DataFrame:
    """Sentence groups of each page with ids that count on through a section, from 1.

    A page's number of groups tells where the next page goes on, so texts are
    numbered page by page and no task holds a section.
    """
    place = F.struct("doc_id", "section_path", "page").alias("_page")
    sizes = pages.groupBy("doc_id", "section_path", "page").agg(F.sum(F.ceil(F.size(sentences(F.col("text"))) / group_n)).alias("size"))
    earlier = Window.partitionBy("doc_id", "section_path").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(place, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    groups = pages.select("doc_id", "page", "section_path", F.posexplode(chunked(sentences(F.col("text")), group_n)).alias("group_no", "group"))
    groups = groups.withColumn("_page", place).join(starts, "_page")
    count = (F.col("start") + F.row_number().over(Window.partitionBy("_page").orderBy("group_no"))).cast("int")
    name = F.array_join(F.transform("section_path", lambda s: slug(s)), "/")
    return groups.withColumn("nth", count).select(
        F.concat("doc_id", F.lit("/"), name, F.format_string("/sent_%04d", "nth")).alias("span_id"), "doc_id", F.lit("sentence").alias("kind"),
        F.element_at("section_path", -1).alias("section"), "section_path", "page", F.array_join("group", " ").alias("text"), F.size("group").alias("group_size"), F.lit(group_n).alias("group_n"),
    )


def _numbered_spans(rows: DataFrame, kind: str, number: Column, form: str) -> DataFrame:
    """Spans of a kind whose ids hold the page (from 1) and a number on it; `rows` has doc_id, page, section_path, text."""
    name = F.array_join(F.transform("section_path", lambda s: slug(s)), "/")
    return rows.withColumn("nth", number).select(
        F.concat("doc_id", F.lit("/"), name, F.format_string(f"/{form}", F.col("page") + 1, F.col("nth"))).alias("span_id"), "doc_id", F.lit(kind).alias("kind"),
        F.element_at("section_path", -1).alias("section"), "section_path", (F.col("page") + 1).alias("page"), "text",
    )


def assembled(blocks: DataFrame, *, toc: DataFrame | None = None, tables: DataFrame | None = None, figures: DataFrame | None = None, group_n: int = 4) -> DataFrame:
    """Spans of documents from parsed lines of their pages (the rows of the PDF source): all steps of ingest in order.

    Margins, footnotes and repeated lines go; columns are read one after the
    other; sections come from `toc` (doc_id, seq, page, level, title) where a
    document has one, else from headings.  `tables` (doc_id, page, nth, rows)
    and `figures` (doc_id, page, nth, summary; what a model said) become spans
    of their own, captions and files that can't be read too.  Pages are counted
    from 0 in what is given and from 1 in spans.
    """
    failed = blocks.where("error is not null") if "error" in blocks.columns else blocks.limit(0).withColumn("error", F.lit(None).cast("string"))
    read = blocks.where("error is null").drop("error") if "error" in blocks.columns else blocks
    placed = in_columns(without_footnotes(inside_margins(read).withColumn("sizes", F.array("size"))))
    numbered = placed.select("doc_id", "page", F.col("place").alias("line_no"), strip(F.col("text")).alias("line"))
    bare = page_text(without_repeating(numbered, repeating(numbered)))
    starts = heading_starts(read).select("doc_id", "page", F.array("heading").alias("path"))
    if toc is not None:
        listed = toc_paths(toc)
        starts = starts.join(listed.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(listed)
    pages = section_of(read.select("doc_id", "page").distinct(), starts).withColumnRenamed("path", "section_path")
    sentences_ = spans_from_pages(bare.join(pages, ["doc_id", "page"]), group_n=group_n).drop("group_size", "group_n").withColumn("page", F.col("page") + 1)
    order = Window.partitionBy("doc_id", "page").orderBy("seq")
    named = captions(read).join(pages, ["doc_id", "page"])
    out = sentences_.unionByName(_numbered_spans(named, "caption", F.row_number().over(order) - 1, "caption_%d_%02d"))
    if tables is not None:
        out = out.unionByName(_numbered_spans(tables.where(F.size("rows") > 0).join(pages, ["doc_id", "page"]).withColumn("text", flat_table(F.col("rows"))), "table", F.col("nth"), "table_%d_%02d"))
    if figures is not None:
        said = F.coalesce(F.nullif(strip(F.col("summary")), F.lit("")), F.lit("(no summary)"))
        out = out.unionByName(_numbered_spans(figures.join(pages, ["doc_id", "page"]).withColumn("text", said), "figure_summary", F.col("nth"), "figure_%d_%02d_summary"))
    broken = failed.select(F.concat("doc_id", F.format_string("/page_%04d/page_%04d_error", F.col("page") + 1, F.col("page") + 1)).alias("span_id"), "doc_id", F.lit("error").alias("kind"), F.lit("").alias("section"), F.array().cast("array<string>").alias("section_path"), (F.col("page") + 1).alias("page"), F.concat(F.lit("Extraction error: "), "error").alias("text"))
    return out.unionByName(broken)


def gold_sheet(candidates: DataFrame, corpus: str = "nist") -> DataFrame:
    """Every candidate as a blank annotation row."""
    blank = ["is_testable", "scope.actor", "scope.data_domain", "scope.context", "hazard", "requirements", "exceptions", "severity"]
    name = F.coalesce("span_id", F.concat(F.lit(f"{corpus}-"), F.lpad(F.col("seq").cast("string"), 6, "0")))
    return candidates.select(name.alias("clause_id"), F.coalesce("doc", F.lit("")).alias("doc"), F.coalesce("citation", F.lit("")).alias("citation"), F.coalesce("text", F.lit("")).alias("text"), *[F.lit("").alias(c) for c in blank])
