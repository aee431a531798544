"""Structured Streaming: the queue of pages to chunk, the click log, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.functions import serp


def drain(source: DataFrame, out: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write what the stream holds now, micro-batch after micro-batch, and stop.

    A batch that is run again after a failure overwrites its own folder, so nothing is
    written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_stream(spark: SparkSession, folder: str, schema, files_at_once: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def clicks(tokens: DataFrame, key: str, now_ms: int, token_col: str = "token") -> DataFrame:
    """Click rows of a batch or stream of tokens; forged and stale ones have none."""
    read = serp.read_tokens(key, now_ms)
    rows = tokens.select(read(token_col).alias("c")).select("c.*").where("timestamp_ms is not null")
    return rows.select(serp.click_id(F.col("query"), F.col("position"), F.col("target_url"), F.lit(now_ms)).alias("click_id"), "*")


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", by: str = "event_type", time_col: str = "ts") -> DataFrame:
    """Events counted in tumbling or sliding windows, with a watermark for late ones."""
    timed = events.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late)
    grouped = timed.groupBy(F.window("_t", size, slide), by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", by: str = "user_id", time_col: str = "ts") -> DataFrame:
    """Events counted in sessions that end after a gap."""
    timed = events.withColumn("_t", F.col(time_col).cast("timestamp")).withWatermark("_t", late)
    grouped = timed.groupBy(F.session_window("_t", gap), by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), by, "n")
