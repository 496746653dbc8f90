"""Streaming ingest: new files become parsed candidates. Scoring needs the whole cohort, so each micro-batch rescores from the table.

Only the stateless part runs as a stream; nothing here claims incremental scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import ingest
from rankloom.sources.readers import stream_folder


def parsed_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, fmt, raw_text, email) of readable files, as a stream."""
    from rankloom.functions import text as T

    files = stream_folder(spark, folder).where((F.col("error").isNull()) & (F.length("raw_text") >= 120))
    return files.select("stem", "fmt", "raw_text", T.first_email(F.col("raw_text")).alias("email"))


def ingest_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, rescore: Callable[[SparkSession, str], None] | None = None):
    """Takes what is in the folder now into the Parquet table ``out`` and, if asked, rescores after each batch; returns the ended query."""

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)
        if rescore:
            rescore(batch.sparkSession, out)

    q = parsed_candidates(spark, folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def daily_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily sums of a stream of events (ts, event_type, value) with a watermark; ts may come without a zone."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
