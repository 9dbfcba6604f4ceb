"""Structured Streaming shells: entries that arrive, and usage over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def translating(entries: DataFrame, translate: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Translate each batch of new entries and append it below target, by batch, so that a repeated batch replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        translate(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return entries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(translations: DataFrame) -> DataFrame:
    """The translation of each id from its last batch."""
    return translations.groupBy("id").agg(F.max_by(F.struct("source", "target", "method"), "batch").alias("t")).select("id", "t.*")


def usage_windows(ledger: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counter totals of each window of a ledger stream (ts, counter, delta); what comes later than `late` is dropped."""
    timed = ledger.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "counter").agg(F.sum("delta").alias("total"))
    return timed.select(F.col("w.start").alias("start"), "counter", "total")
