"""Quality rules judged per host (native: DataFrame functions only).

Each document gets its rule counts from column expressions inside its own row, so the texts are never
shuffled. Failures are added up per host, each host's rate is shrunk towards all hosts with a beta prior
fitted by moments, and the verdict is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import blank_words, small_side
from lexiflow.llm.shrink import strength
from lexiflow.session import checkpoint, table


def rule_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of the rules, one row for each input row.

    Null, empty and blank texts have no words and all counts 0. Repeated rows are counted each. Columns
    other than doc_id, text and `host` are ignored. Three-word windows are compared by a 64-bit hash
    within one document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        F.col(host).alias("host"),
        text.alias("text"),
        blank_words(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    windows = base.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "sort_array(if(size(words) < 3, array(), transform(sequence(0, size(words) - 3), "
            "i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) as h, i as i))))"
        ).alias("w"),
    )
    # A window stands next to its equals after the sort; a start is repeated if its hash is a neighbour's.
    twins = windows.withColumn("e", F.expr("zip_with(w, slice(w, 2, size(w)), (a, b) -> coalesce(a.h = b.h, false))"))
    starts = twins.withColumn(
        "s",
        F.expr(
            "sort_array(filter(zip_with(w, zip_with(e, concat(array(false), e), (x, y) -> x or y), "
            "(p, f) -> if(f, p.i, null)), x -> x is not null))"
        ),
    )
    return starts.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.expr(
            "aggregate(zip_with(s, slice(s, 2, size(s)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (t, x) -> t + x)"
        ).alias("n_repeat_words"),
    )


def host_verdicts(failed: DataFrame, max_rate: float = 0.6) -> DataFrame:
    """host, host_rejected for a frame (host, base_failed).

    The rate of a host is (failures + a) / (documents + a + b) with a beta prior whose mean is the rate
    of all documents and whose strength a + b follows from how far the rates of hosts scatter beyond what
    chance makes of equal hosts (see shrink.py). A null host is a host of its own.
    """
    hosts = failed.groupBy("host").agg(F.sum(F.col("base_failed").cast("long")).alias("f"), F.count(F.lit(1)).alias("n"))
    f, n = F.col("f"), F.col("n").cast("double")
    whole = hosts.agg(F.sum("f"), F.sum("n"), F.count(F.lit(1)), F.sum(n * n), F.sum(f * f / n), F.sum(1 / n)).first()  # one row
    failures, documents, groups, squares, between, inverse = (float(x or 0) for x in whole)
    mean = failures / documents if documents else 0.0
    k = strength(documents, groups - 1, squares / documents, between - documents * mean * mean, mean * (1 - mean), inverse) if documents else 0.0
    return hosts.select("host", ((f + mean * k) / (n + k) > max_rate).alias("host_rejected"))


def judge(docs: DataFrame, host: str = "source", max_rate: float = 0.6) -> DataFrame:
    """Rule counts, base_failed, host_rejected and kept for each row of docs.

    A document fails with under 50 words, or if over half its words stand in repeated three-word windows.
    It is kept if it passes and its host's shrunk failure rate is at most max_rate. An empty table gives
    an empty result; other cases are those of rule_counts().
    """
    n, r = F.col("n_words"), F.col("n_repeat_words")
    rated = checkpoint(rule_counts(docs, host).withColumn("base_failed", (n < 50) | (100 * r > 50 * n)))
    verdicts = host_verdicts(rated, max_rate).withColumnRenamed("host", "judged_host")
    return (
        rated.join(small_side(checkpoint(verdicts)), F.col("host").eqNullSafe(F.col("judged_host")), "left")
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))
        .drop("judged_host", "host")
    )


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, source, text,
         list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)
), s AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1
), c AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM s, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), r AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r
), h AS (
  SELECT source, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f, count(*) AS n FROM b GROUP BY source
), m AS (
  SELECT sum(n) AS d, count(*) - 1 AS g, sum(n * n) / sum(n) AS q, sum(1.0 / n) AS i, sum(f) / sum(n) AS m,
         sum(f * f / n) - sum(f) * (sum(f) / sum(n)) AS t
  FROM (SELECT CAST(f AS DOUBLE) AS f, CAST(n AS DOUBLE) AS n FROM h)
), v AS (SELECT *, m * (1 - m) AS v FROM m),
e AS (SELECT *, t - v * g AS e, v * (d - q - g) AS r, 3 * sqrt(2 * v * v * g + v * i) AS s FROM v),
p AS (
  SELECT m, CASE WHEN r <= 0 OR e <= s THEN 10000.0 ELSE greatest(1.0, least(10000.0, 1 / least(1.0, e / r) - 1)) END AS k FROM e
), j AS (SELECT source, (f + m * k) / (n + k) > 0.6 AS host_rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
       NOT base_failed AND NOT host_rejected AS kept
FROM b JOIN j ON b.source IS NOT DISTINCT FROM j.source
"""
