"""Usage as an append-only ledger of counter differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage(ledger: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """counter and total of (ts, op, counter, delta); since (ts) holds resets, after the last of which it counts."""
    rows = ledger
    if since is not None:
        last = since.agg(F.max("ts")).first()[0]  # one row
        rows = rows.where(F.col("ts") > F.lit(last)) if last is not None else rows
    return rows.groupBy("counter").agg(F.sum("delta").alias("total"))
