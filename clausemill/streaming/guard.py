"""The run-time guard over a stream of turns (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C


def scored(turns: DataFrame, text: str = "text") -> DataFrame:
    """Adds risk score and category; stateless, so it works on streams and tables alike."""
    return turns.withColumn("risk", C.risk_score(F.col(text))).withColumn("category", C.risk_category(F.col("risk")))


def once(turns: DataFrame, *keys: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each turn once, within the watermark."""
    return turns.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def counts(turns: DataFrame, *, ts: str = "ts", width: str = "5 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Turns of each category in each window; rows later than the watermark are left out (None: the stream has one already)."""
    turns = turns.withWatermark(ts, late) if late else turns
    return turns.groupBy(F.window(ts, width), "category").agg(F.count("*").alias("n"), F.max("risk").alias("most"))


#: Rows of `to_table`.
VERSIONED = "start timestamp, category string, n long, most double, batch long"


def to_table(counted: DataFrame, path: str, checkpoint: str):
    """Runs a stream of counts over all that is there, and writes what each batch changed into a folder of that batch.

    Windows that the watermark never passes, such as the last ones, are written
    too.  A batch that runs again replaces what it wrote before.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/of={number}")

    return counted.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def latest(versions: DataFrame) -> DataFrame:
    """Of each window and category what the last batch said."""
    said = F.max_by(F.struct("n", "most"), "batch")
    return versions.groupBy("start", "category").agg(said.alias("v")).select("start", "category", "v.n", "v.most")


def to_results(stream: DataFrame, path: str, checkpoint: str):
    """Appends verdict rows as they come; a restarted query goes on where it stopped."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
