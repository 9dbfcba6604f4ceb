"""Column expressions and plan helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.session import checkpoint

#: Rows and bytes of their texts that a side may have to be broadcast: 10 MB and 200 bytes a row at most.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 10_000_000


def blank_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of text, in order; none for null."""
    return F.coalesce(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of text after A-Z became lower case; none for null."""
    return F.coalesce(
        F.array_remove(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""),
        F.array().cast("array<string>"),
    )


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has no more than `rows` rows and no more than `size` bytes of strings and binaries."""
    texts = [F.coalesce(F.octet_length(F.to_json(F.struct(f.name)) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)), F.lit(0)).cast("long")
             for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(sum(texts, F.lit(0).cast("long")))).first()  # one row
    return n <= rows and (total or 0) <= size


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if is_small(df), else df for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows) else df


def nested() -> Column:
    """A whole row as one column, `row`: no name in it can clash with those of an operator.

    `select("row.*")` gives the row back.
    """
    return F.struct("*").alias("row")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with n, from 1, in a global order: sorted by ranges, then counted on from the partitions before.

    The driver holds one count for each partition.
    """
    at = F.monotonically_increasing_id()  # number of the partition and place in it
    rows = checkpoint(df.orderBy(*order).withColumn("n", at))
    part = F.shiftright("n", 33)
    counts = dict(rows.groupBy(part.alias("part")).count().collect())
    before, offsets = 0, []
    for k in sorted(counts):
        offsets.append((k, before))
        before += counts[k]
    known = df.sparkSession.createDataFrame(offsets or [(-1, 0)], "part long, before long")
    placed = rows.withColumn("part", part).join(F.broadcast(known), "part")
    return placed.withColumn("n", F.col("n").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before") + 1).drop("part", "before")
