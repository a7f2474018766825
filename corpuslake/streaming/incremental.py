"""Streaming forms of the load guard and the embedding pass. They go beyond the reference, which has no streams.

Each runs until its input is read (availableNow) with a checkpoint, so a restart goes on
where it stopped, and each micro-batch is idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.operators import embedding


def stream_runs(runs: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Crawl runs once each by their natural key; later repeats within the watermark are dropped."""
    return runs.withWatermark("started_at", watermark).dropDuplicatesWithinWatermark(["prospect_id", "started_at"])


def outcome_windows(outcomes: DataFrame, width: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """start, outcome, n: outcomes by window of event time, late rows up to the watermark included."""
    counted = outcomes.withWatermark("occurred_at", watermark).groupBy(F.window("occurred_at", width).alias("w"), "outcome").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "outcome", "n")


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Parquet files of what a stream gives until its input is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def embed_stream(chunks: DataFrame, embedder: embedding.Embedder, path: str, checkpoint: str):
    """Vectors of chunks as they come, one folder for each micro-batch, so a repeated one replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        embedding.embed(rows.filter("embedding is null"), embedder).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame, int], None]):
    """Hand each micro-batch to merge(rows, number): a batch older than what is stored must change nothing there."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
