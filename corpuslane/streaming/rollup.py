"""The event rollups as Structured Streaming queries."""

from __future__ import annotations

from corpuslane.runtime import local_folder
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder, with the schema that the files have now."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{glob}" if glob else folder).schema).option("maxFilesPerTrigger", 8)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)


def windowed(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums by window and kind; events later than ``late`` behind the newest are dropped, repeats ignored."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    w = F.window("ts", width)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def run_available(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Runs a rollup over what is there now, in update mode, and gives the last state of every key.

    Each micro-batch appends the rows that it changed, with its number; the greatest number of a key wins. Files go to
    the shared folder of the session (spark.checkpoint.dir), or to a new local one where none is set.
    """
    spark = stream.sparkSession
    base = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or local_folder(spark)
    place = f"{base}/stream-{uuid.uuid4().hex}"
    values = [c for c in stream.columns if c not in keys]

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{place}/rows")

    stream.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{place}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")
