"""Structured Streaming over the events table: windowed counts and sessions with watermarks.

A stream reads the files that are there (trigger availableNow) and can run on; its state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path

LATE = "1 hour"


def stream(spark: SparkSession, sf_dir: str, late: str | None = LATE) -> DataFrame:
    """The events as a stream of files, with a watermark unless `late` is None."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if late else rows


def tumbling(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """window_start, event_type, n, total of each window, tumbling or sliding."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, session_start, session_end, n of each session."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_once(result: DataFrame, mode: str = "append") -> DataFrame:
    """The finished rows of a streamed aggregate over what its source holds now, as a table in the shared folder; in update mode, each change.

    Append mode: a window is told once, when the watermark has passed its end, and its state is dropped then; windows
    that may still change aren't told yet.  A batch that is run again overwrites what it wrote.
    """
    path = new_path(result.sparkSession, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return result.sparkSession.read.schema(result.schema).option("basePath", f"{path}/out").parquet(f"{path}/out").select(*result.columns)
