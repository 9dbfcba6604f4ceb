"""Benchmark decontamination by a prefix-filtered set join (native: DataFrame functions only).

Every benchmark item is cut into windows of ten words. Containment is total, so one necessary prefix
token is enough for each window: its rarest word over all documents. Documents probe the prefix index
word by word; a probe fixes where the window would have to start, positional and length bounds discard
what does not fit into the document, and the words that stand there are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import is_small, nested, plain_words, small_side
from lexiflow.session import checkpoint, table

WINDOW = 10
#: Windows of items up to which they and the prefix index are broadcast, if they have no more than 10 MB.
BROADCAST_WINDOWS = 50_000
#: Beyond it, words are looked up by a hash of so many values first; those that occur are broadcast, 32 MB at most.
SLOTS = 1 << 22


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """win (words joined by a space) and item_id: the windows of each item, a shorter item being one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), plain_words(F.col("text")).alias("w"))
    return (
        items.where(F.size("w") > 0)
        .select(
            "item_id",
            F.explode(
                F.expr(
                    f"if(size(w) < {window}, array(w), transform(sequence(1, size(w) - {window} + 1), i -> slice(w, i, {window})))"
                )
            ).alias("w"),
        )
        .select(F.array_join("w", " ").alias("win"), "item_id")
        .distinct()
    )


def prefix_index(docs_words: DataFrame, wins: DataFrame, small: bool) -> DataFrame:
    """anchor, off, win, w, n: for each window its rarest word over all documents and that word's first place."""
    w = wins.select("win").distinct().withColumn("w", F.split("win", " "))
    at = w.select("win", F.posexplode("w").alias("off", "word"))
    vocabulary = at.select("word").distinct()
    words = docs_words.select(F.explode("words").alias("word"))
    if small:  # each document word is looked up before it is counted
        counts = words.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").count()
    else:  # counted within each task first, looked up after
        counts = words.groupBy("word").count().join(vocabulary, "word", "left_semi")
    rarest = (
        at.join(counts, "word", "left")
        .groupBy("win")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), F.col("word"), F.col("off"))).alias("m"))
    )
    return rarest.select(F.col("m.word").alias("anchor"), F.col("m.off").alias("off"), "win").withColumn("w", F.split("win", " ")).withColumn("n", F.size("w"))


def slot(word: str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, one row for each row of docs.

    Null and wordless texts have no words and are clean; null and wordless items have no window. Rows that
    repeat a doc_id, or have none, are judged each by itself. Items with a null item_id count as hits but
    not among the items. Extra columns of either table are ignored. An empty benchmark leaves all clean.
    """
    wins = checkpoint(item_windows(benchmark, window))
    small = is_small(wins, BROADCAST_WINDOWS)
    words = docs.select("doc_id", plain_words(F.col("text")).alias("words"))
    index = checkpoint(prefix_index(words, wins, small))
    rows = words.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").alias("n_words"), "words")
    start = F.col("pos") - F.col("off")
    fits = (F.col("word") == F.col("anchor")) & (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    at = F.when(F.col("win").isNotNull(), F.struct(start.alias("s"), F.col("n").alias("n"))).alias("at")
    if small:
        # The empty word ends every document and has an entry of its own: one row for each document comes back.
        none = F.lit(None).cast("string")
        end = index.sparkSession.range(1).select(F.lit("").alias("anchor"), F.lit(0).alias("off"), none.alias("win"), F.array(F.lit("")).alias("w"), F.lit(0).alias("n"))
        probes = rows.select("rid", "doc_id", "n_words", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
        same = F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("n")) == F.col("w")
        hits = probes.join(F.broadcast(index.unionByName(end)), fits & (same | (F.col("word") == "")))
        hits = hits.select("rid", "doc_id", "n_words", at, "win").join(F.broadcast(wins), "win", "left")
    else:
        # A word that shares no slot with an anchor is no probe. The others take along only the words that a
        # window around them can cover; the documents' own rows join nothing.
        slots = index.select(slot("anchor").alias("at_slot")).distinct()
        span = F.greatest(F.col("pos") - F.lit(window - 1), F.lit(0))
        probes = rows.select("rid", "doc_id", "n_words", "words", F.posexplode("words").alias("pos", "word"))
        probes = probes.join(F.broadcast(slots), slot("word") == F.col("at_slot"), "left_semi").select(
            "rid", "doc_id", "n_words", "pos", "word", span.alias("from"), F.slice("words", span + 1, F.lit(2 * window - 1)).alias("near")
        )
        same = F.slice("near", F.greatest(start - F.col("from") + 1, F.lit(1)), F.col("n")) == F.col("w")
        hits = probes.join(index, fits & same).select("rid", "doc_id", "n_words", at, "win").join(wins, "win")
        hits = hits.unionByName(rows.select("rid", "doc_id", "n_words"), allowMissingColumns=True)
    per_doc = hits.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set("at").alias("at"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    n_hit = F.size(F.array_distinct(F.flatten(F.expr("transform(at, x -> sequence(x.s, x.s + x.n - 1))")))).cast("long")
    return per_doc.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any occurrence of a window; rows that share a doc_id go together, rows without one stay."""
    gone = checkpoint(contaminated(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias("gone")).distinct())
    rows = docs.select(nested(), docs["doc_id"].alias("id"))
    return rows.join(small_side(gone), F.col("id") == F.col("gone"), "left_anti").select("row.*")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
),
h AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
