"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length. Each source repeats all its documents as often as its target allows
and fills what is left from the counts: first the same share of every length, then long documents, then a
bounded knapsack over the remaining counts. Which documents of a length are taken follows a seeded order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import blank_words, numbered, small_side
from lexiflow.session import checkpoint, table

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SEED = 20240607
#: The knapsack fits the last so many words of a source's budget.
KNAPSACK_WORDS = 1 << 15
#: Each length of a source is ordered in so many parts, so that no task orders a whole source.
PARTS = 1024


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most_times: int = MOST_TIMES) -> dict[str | None, float]:
    """Target words for each source: all words shared by weight, none above most_times its size.

    Sources in code-point order, null last, take the weights in turn. What a source cannot use goes to
    the others by weight, until none is above its limit.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most_times * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = float(most_times * sizes[s])
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near below budget as can be.

    counts: documents for each length. Sums are bits of an integer; a length with n documents enters as
    1, 2, 4, ... documents at once.
    """
    lots, seen = [], [1]
    full = (1 << (budget + 1)) - 1
    for length, n in sorted(counts.items()):
        if length <= 0 or length > budget:
            continue
        lot = 1
        while n > 0 and not seen[-1] >> budget & 1:
            lot = min(lot, n)
            lots.append((length, lot))
            seen.append((seen[-1] | seen[-1] << length * lot) & full)
            n, lot = n - lot, lot * 2
    at, taken = seen[-1].bit_length() - 1, {}
    for k in range(len(lots), 0, -1):
        if not seen[k - 1] >> at & 1:
            length, lot = lots[k - 1]
            taken[length] = taken.get(length, 0) + lot
            at -= length * lot
    return taken


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take for a budget of at most their sum."""
    total = sum(k * n for k, n in counts.items())
    if not total or budget <= 0:
        return {}
    taken = {k: n * budget // total for k, n in counts.items()}
    left = budget - sum(k * n for k, n in taken.items())
    for k in sorted(counts, reverse=True):
        if left <= KNAPSACK_WORDS:
            break
        if k:
            more = min(counts[k] - taken[k], left // k)
            taken[k] += more
            left -= more * k
    if 0 < left <= KNAPSACK_WORDS:
        for k, n in knapsack({k: n - taken[k] for k, n in counts.items()}, left).items():
            taken[k] += n
    return taken


def planned(totals: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """source, source_size, target, times and budget for totals (source, size), one row each: targets() as a plan.

    All sources whose limit is below the common level of words by weight are full; what they leave raises the
    level, until no further source is. The driver holds the level and sums, not the sources.
    """
    first = F.array(*(F.lit(w) for w in weights))
    ranked = checkpoint(numbered(totals, F.col("source").asc_nulls_last()).withColumn("weight", F.get(first, ((F.col("n") - 1) % len(weights)).cast("int"))))
    limit = most_times * F.col("size")
    level, full = 0.0, -1
    while True:
        below = limit / F.col("weight") < level
        everything, held, free, now = ranked.agg(
            F.sum("size"), F.sum(F.when(below, limit)), F.sum(F.when(~below, F.col("weight"))), F.count_if(below)
        ).first()  # one row
        if now == full or not free:
            break
        level, full = (everything - (held or 0)) / free, now
    target = F.when(limit / F.col("weight") < level, limit.cast("double")).otherwise(level * F.col("weight"))
    times = F.when(F.col("size") > 0, F.least(F.lit(most_times), F.floor(F.col("target") / F.col("size")))).otherwise(0).cast("int")
    left = F.when(F.col("times") < most_times, F.floor(F.col("target") - F.col("times") * F.col("size"))).otherwise(0).cast("long")
    return ranked.withColumn("target", target).withColumn("times", times).select("source", F.col("size").alias("source_size"), "target", "times", left.alias("budget"))


def mix(docs: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken, one row for each row of docs.

    Sizes are words; null, empty and blank texts have size 0 and are never taken. A null source is a
    source of its own. Rows that repeat a doc_id are documents of their own; where only some of equal rows
    are taken, it does not matter which. Other columns are ignored; an empty table gives an empty result.
    """
    sized = checkpoint(
        docs.select(
            "doc_id",
            "source",
            F.size(blank_words(F.col("text"))).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id")).alias("lot"),
        ).withColumn("part", F.pmod(F.shiftright("lot", 17), F.lit(PARTS)).cast("int"))
    )
    plan = checkpoint(planned(sized.groupBy("source").agg(F.sum("size").alias("size")), weights, most_times).withColumnRenamed("source", "plan_source"))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        taken = fit(dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), int(pdf["budget"].iloc[0]))
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "k": [taken.get(k, 0) for k in pdf["size"].tolist()]})

    parts = sized.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    lengths = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    budgets = plan.select(F.col("plan_source").alias("s"), "budget")
    chosen = lengths.join(small_side(budgets), F.col("source").eqNullSafe(F.col("s"))).drop("s").groupBy("source").applyInPandas(fitted, "source string, size long, k long")
    before = F.sum("n").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    a, b = parts.withColumn("before", F.coalesce(before, F.lit(0))).alias("a"), chosen.alias("b")
    shares = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))).select(
        F.col("a.source").alias("s"), F.col("a.size").alias("z"), F.col("a.part").alias("p"), (F.col("k") - F.col("before")).alias("more")
    )
    turn = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("lot", "doc_id"))
    rows = sized.withColumn("turn", turn).join(
        shares, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p"))
    )
    copies = F.col("times") + F.when(F.col("turn") <= F.col("more"), 1).otherwise(0)
    return rows.join(small_side(plan), F.col("source").eqNullSafe(F.col("plan_source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken")
    )


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
