"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts that go to and from a Python worker at once, at most.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset and everything runs in one process, as in tests, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="clausemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def whole_row(docs: DataFrame, apart: str) -> Column:
    """All columns but the one named, which goes beside them, as one with fields c0, c1, ...: no name can clash or need quoting while the row is carried along."""
    quoted = [(n, c.replace("`", "``")) for n, c in enumerate(docs.columns) if c != apart]
    return F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{n}") for n, c in quoted])


def carried(docs: DataFrame, name: str) -> Column:
    """A column out of a carried `row`."""
    return F.col("row")[f"c{docs.columns.index(name)}"]


def restored(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of `docs` out of a carried `row`, some changed; the one that went apart must be among these."""
    return [(changed[c] if c in changed else carried(docs, c)).alias(c) for c in docs.columns]


def small_batches(spark: SparkSession) -> str | None:
    """From now on batches hold `BATCH_ROWS` rows at most, a lesser setting stays; the session's own setting before."""
    own = spark.conf.get(_BATCH, None)
    if own is None or not 0 < int(own) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return own


def collect_garbage(spark: SparkSession) -> None:
    """Asks the JVM of every executor for a full collection, after which it gives most of its heap back; one short task a core."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


class Scratch:
    """Written intermediate tables of one operator.

    A task that is lost with its executor reads a written table again instead
    of computing it again.  `drop` deletes the tables that no result needs.
    While one is written, batches hold `BATCH_ROWS` rows at most, for the JVM
    and the worker of each core both keep whole ones.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        conf, own = self.spark.conf, small_batches(self.spark)
        try:
            frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            conf.unset(_BATCH) if own is None else conf.set(_BATCH, own)
        self.paths[name] = path
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
