"""Streams: postings landing as files, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.plans.ingest import ingest
from lodestack.plugins import Embedder
from lodestack.sources.landing import Source
from lodestack.sources.store import TableStore


def landing_stream(spark: SparkSession, source: Source, path: str, lateness: str = "7 days", whole_files: bool = True) -> DataFrame:
    """New raw postings of a source's folder, each (source, external_id) once within ``lateness``."""
    payloads = spark.readStream.schema(source.schema).option("multiLine", whole_files).json(path)
    rows = source.read(payloads).withColumn("posted_at", F.timestamp_millis(F.coalesce("posted_at_ms", F.lit(0))))
    return rows.withWatermark("posted_at", lateness).dropDuplicatesWithinWatermark(["source", "external_id"]).drop("posted_at")


def ingest_stream(rows: DataFrame, store: TableStore, embedder: Embedder, now_ms, checkpoint: str) -> StreamingQuery:
    """Ingest each micro-batch; a batch that is replayed adds nothing. ``now_ms()`` gives the time of a batch."""

    def batch(part: DataFrame, _: int) -> None:
        ingest(store, part, now_ms(), embedder)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events and their sum by type and window; works on streams and tables alike."""
    windows = events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("event_type", F.col("w.start").alias("start"), "n", "value")


def sliding_counts(events: DataFrame, width: str = "90 days", slide: str = "1 day", lateness: str = "1 day", key: str = "canonical_id") -> DataFrame:
    """Events of a key in sliding windows, such as reposts of a posting in 90 days."""
    windows = events.withWatermark("ts", lateness).groupBy(F.window("ts", width, slide).alias("w"), key)
    return windows.agg(F.count("*").alias("n")).select(key, F.col("w.end").alias("end"), "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Events of a user in sessions that end after ``gap`` without one."""
    sessions = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return sessions.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
