"""The suffix order of a whole corpus by a distributed difference-cover sort.

Triples at the positions 1 and 2 modulo 3 are sorted by ranges and named; where names repeat, the names are
sorted by recursion; the remaining suffixes are merged in by counting, on either side, what stands before. It
is exact, and every step is a sort by ranges or an aggregate, but each symbol is shuffled many times:
`python -m lexiflow.llm.whole_order FOLDER` prints how often. op8_suffix_dedup therefore orders suffixes
bucket by bucket (suffixes.py), which gives the same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import numbered
from lexiflow.llm.suffixes import suffix_order
from lexiflow.session import checkpoint

#: Sequences of at most so many symbols are sorted in one task.
ONE_TASK = 1 << 16


def triples(symbols: DataFrame) -> DataFrame:
    """pos, s0, s1 and s2 for each position of symbols (pos, s): three symbols, 0 beyond the end."""
    each = symbols.select(F.explode(F.array(*(F.struct((F.col("pos") - k).alias("pos"), F.lit(k).alias("k"), "s") for k in range(3)))).alias("x")).select("x.*")
    made = each.where(F.col("pos") >= 0).groupBy("pos").agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col("s"))), F.lit(0)).alias(f"s{k}") for k in range(3)))
    return made


def in_one_task(symbols: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = suffix_order(pdf.sort_values("pos")["s"].to_numpy(np.int64))
        return pd.DataFrame({"pos": order, "rank": np.arange(1, len(order) + 1)})

    return symbols.select(F.lit(0).alias("all"), "pos", "s").groupBy("all").applyInPandas(run, "pos long, rank long")


def counted(rows: DataFrame, flag: Column, *order: Column) -> DataFrame:
    """rows with n, the place in a global order, and m, the sum of the flag up to it."""
    sorted_ = checkpoint(rows.withColumn("flag", flag.cast("long")).orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before, offsets = [0, 0], []
    for k, n, m in sorted(tuple(r) for r in sorted_.groupBy(part).agg(F.count(F.lit(1)), F.sum("flag")).collect()):  # one row a partition
        offsets.append((k, *before))
        before = [before[0] + n, before[1] + m]
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets or [(-1, 0, 0)], "part long, n0 long, m0 long"))
    here = F.sum("flag").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    placed = sorted_.withColumn("part", part).withColumn("m", here).join(known, "part")
    return placed.select(*rows.columns, (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("n0") + 1).alias("n"), (F.col("m") + F.col("m0")).alias("m"))


def suffix_ranks(symbols: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """pos and rank (from 1) of all suffixes of symbols (pos from 0 without gaps, s from 1); an end comes before any symbol."""
    if symbols.limit(one_task + 1).count() <= one_task:
        return in_one_task(symbols)
    three = checkpoint(triples(symbols))
    kind = F.col("pos") % 3
    sample = three.where(kind != 0)
    names = checkpoint(numbered(sample.select("s0", "s1", "s2").distinct(), F.col("s0"), F.col("s1"), F.col("s2")))
    named = checkpoint(sample.join(names, ["s0", "s1", "s2"]).select("pos", F.col("n").alias("name")))
    ones = named.where(kind == 1).count()
    if names.count() == named.count():
        ranks = named.select("pos", F.col("name").alias("rank"))
    else:
        # The names of one residue after those of the other; the least symbol, 1, stands between them.
        place = F.when(kind == 1, F.expr("(pos - 1) div 3")).otherwise(F.expr("(pos - 2) div 3") + ones + 1)
        between = symbols.sparkSession.createDataFrame([(ones, 1)], "pos long, s long")
        below = suffix_ranks(named.select(place.alias("pos"), (F.col("name") + 1).alias("s")).union(between), one_task)
        back = F.when(F.col("pos") < ones, 3 * F.col("pos") + 1).otherwise(3 * (F.col("pos") - ones - 1) + 2)
        # The suffix that begins between them is the first of all.
        ranks = below.where(F.col("pos") != ones).select(back.alias("pos"), (F.col("rank") - 1).alias("rank"))
    ranks = checkpoint(ranks)
    none = F.lit(None).cast("long")
    parts = three.select("pos", "s0", "s1", none.alias("r0"), none.alias("r1"), none.alias("r2"))
    for k in range(3):
        parts = parts.union(ranks.select(F.col("pos") - k, none, none, *(F.col("rank") if j == k else none for j in range(3))).where(F.col("pos") >= k))
    keyed = checkpoint(parts.groupBy("pos").agg(F.max("s0").alias("s0"), F.max("s1").alias("s1"), *(F.coalesce(F.max(f"r{k}"), F.lit(0)).alias(f"r{k}") for k in range(3))))
    zero = kind == 0
    one = counted(keyed.where(kind != 2), zero, F.col("s0"), F.col("r1"))
    two = counted(keyed.where(kind != 1), zero, F.col("s0"), F.col("s1"), F.col("r2"))
    # A remaining suffix stands behind those of its own kind, m of them, and n - m of each other kind.
    rest = one.where(zero).select("pos", "n", "m").join(two.where(zero).select("pos", F.col("n").alias("n2")), "pos").select("pos", (F.col("n") + F.col("n2") - F.col("m")).alias("rank"))
    sampled = one.where(~zero).union(two.where(~zero)).select("pos", (F.col("r0") + F.col("m")).alias("rank"))
    return rest.union(sampled)


def corpus_symbols(docs: DataFrame) -> DataFrame:
    """pos and s: the bytes of all texts plus two, in the order of doc_id, each text followed by a 1."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"), size.alias("size"))
    placed = counted(rows, F.col("size"), F.col("doc_id")).withColumn("start", F.col("m") - F.col("size"))
    each = placed.select("start", F.posexplode(F.split(F.concat(F.hex("b"), F.lit("FF")), "(?<=\\G..)")).alias("i", "h"))
    number = F.conv("h", 16, 10).cast("long")
    return each.where(F.col("h") != "").select((F.col("start") + F.col("i")).alias("pos"), F.when(F.col("h") == "FF", F.lit(1)).otherwise(number + 2).alias("s"))


def main() -> None:
    """Print the bytes that the order of documents in a folder shuffles and checkpoints, as multiples of the input."""
    import glob
    import json
    import os
    import sys
    import tempfile

    from pyspark.sql import SparkSession

    folder, logs = sys.argv[1], tempfile.mkdtemp()
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{logs}").config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    path = f"{folder}/documents.parquet"
    n = suffix_ranks(corpus_symbols(spark.read.parquet(path)), 1 << 14).agg(F.count(F.lit(1))).first()[0]
    spark.stop()
    sent = 0
    for log in glob.glob(f"{logs}/*"):
        for line in open(log):
            if '"SparkListenerTaskEnd"' in line:
                sent += (json.loads(line).get("Task Metrics") or {}).get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
    size = sum(os.path.getsize(f) for f in (glob.glob(f"{path}/*.parquet") or [path]))
    print(json.dumps({"suffixes": n, "input_mb": size / 1e6, "shuffled_mb": sent / 1e6, "times_input": round(sent / size, 1), "times_text": round(sent / n, 1)}))


if __name__ == "__main__":
    main()
