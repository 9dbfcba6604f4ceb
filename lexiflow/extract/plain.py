"""Line formats as column expressions: text, key-value files, line offsets and cue blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.text import BLANK, stripped
from lexiflow.functions.timecode import clock_ms


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """Columns `keep`, line (from 0) and raw for each line of text; CR before LF belongs to the line end."""
    return files.select(*keep, F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))


def with_offsets(files: DataFrame, *keep: str) -> DataFrame:
    """line, start, stop and eol_stop in characters of each line of text, by a running sum of lengths."""
    pieces = F.regexp_extract_all("text", F.lit(r"([^\n]*(?:\n|$))"), F.lit(1))
    split = F.when(F.col("text").endswith("\n") | (F.col("text") == ""), pieces).otherwise(F.slice(pieces, 1, F.size(pieces) - 1))
    each = files.select(*keep, F.posexplode(split).alias("line", "piece"))
    w = Window.partitionBy(*keep).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0))
    return each.select(
        *keep, "line", start.alias("start"), (start + F.length(F.regexp_replace("piece", r"\r?\n$", ""))).alias("stop"), (start + F.length("piece")).alias("eol_stop")
    )


def txt_entries(files: DataFrame, *keep: str) -> DataFrame:
    """Trimmed lines that are neither empty nor remarks: suffix, source, prefix, tail, line."""
    value = stripped(F.col("raw"))
    at = F.instr(F.col("raw"), value)
    return (
        lines(files, *keep)
        .withColumn("source", value)
        .where((F.col("source") != "") & ~F.col("source").rlike("^[#;/]"))
        .select(
            *keep,
            F.concat(F.lit("line"), F.col("line") + 1).alias("suffix"),
            "source",
            F.substring("raw", F.lit(1), at - 1).alias("prefix"),
            F.substring("raw", at + F.length("source"), F.length("raw")).alias("tail"),
            "line",
        )
    )


def matched(files: DataFrame, pattern: str, groups: str, *keep: str) -> DataFrame:
    """Columns `keep`, line and found, the groups of pattern in each line that it matches; groups: those of a piece side by side, pieces apart by \n.

    Each line is matched once for all groups: no line holds \n, so it can part them. What is exploded is not computed again above.
    """
    pieces = F.split(F.regexp_replace("raw", rf"^{pattern}$(?s:.*)", groups), "\n")
    return lines(files, *keep).select(*keep, "line", F.explode(F.array(pieces)).alias("found")).where(F.size("found") > 1)


INI = rf"({BLANK}*[^#;\[=][^=]*={BLANK}*)(.*)"


def ini_entries(files: DataFrame, *keep: str) -> DataFrame:
    """Values of `key = value` lines whose key starts with none of # ; [."""
    rest = F.col("found")[1]
    return (
        matched(files, INI, "$1\n$2", *keep)
        .withColumn("source", stripped(rest))
        .where(F.col("source") != "")
        .select(
            *keep,
            F.concat(F.lit("line"), F.col("line") + 1).alias("suffix"),
            "source",
            F.col("found")[0].alias("prefix"),
            F.substring(rest, F.length("source") + 1, F.length(rest)).alias("tail"),
            "line",
        )
    )


#: A key, then a value in double quotes, in single ones or in none; a key ends at the first colon, so the first that fits is taken.
VALUES = rf"""({BLANK}*")([^"]*)(".*)|({BLANK}*')([^']*)('.*)|({BLANK}+)([^#\s\[{{"'][^#]*?)({BLANK}*(?:#.*)?)"""
YAML = rf"({BLANK}*[A-Za-z0-9_.\- ]{{1,100}}:)(?:{VALUES})"


def yaml_entries(files: DataFrame, *keep: str) -> DataFrame:
    """Values of `key: value` lines, quoted or bare; a remark after a bare value stays behind."""
    return (
        matched(files, YAML, "$1$2$5$8\n$3$6$9\n$4$7$10", *keep)
        .select(*keep, "line", F.col("found")[0].alias("prefix"), F.col("found")[1].alias("source"), F.col("found")[2].alias("tail"))
        .where(stripped(F.col("source")) != "")
        .select(*keep, F.concat(F.lit("line"), F.col("line") + 1).alias("suffix"), "source", "prefix", "tail", "line")
    )


CUE = r"([0-9]{1,2}:[0-9]{2}:[0-9]{2}[,.][0-9]{1,3})\s*-->\s*([0-9]{1,2}:[0-9]{2}:[0-9]{2}[,.][0-9]{1,3})"


def cue_blocks(files: DataFrame, *keep: str) -> DataFrame:
    """Cues of SubRip and WebVTT: cue (from 0), begin_ms, end_ms, source, first_line, last_line.

    A time line opens a cue, a blank line ends it; text outside of cues (notes, numbers) is in none.
    """
    w = Window.partitionBy(*keep).orderBy("line")
    time = F.col("raw").rlike(CUE)
    kinds = lines(files, *keep).withColumn("mark", F.when(time, F.lit("time")).when(stripped(F.col("raw")) == "", F.lit("end")))
    # Inside a cue, a time line is text.
    block = kinds.withColumn("block", F.sum(F.when(F.col("mark") == "end", 1).otherwise(0)).over(w))
    opened = block.withColumn("opens", F.min(F.when(F.col("mark") == "time", F.col("line"))).over(Window.partitionBy(*keep, "block")))
    head = F.max_by("raw", F.col("line") == F.col("opens"))
    body = F.array_sort(F.collect_list(F.when(F.col("line") > F.col("opens"), F.struct("line", "raw"))))
    return (
        opened.where(F.col("opens").isNotNull() & (F.col("line") >= F.col("opens")) & F.coalesce(F.col("mark") != "end", F.lit(True)))
        .groupBy(*keep, "block")
        .agg(F.first("opens").alias("opens"), head.alias("head"), body.alias("body"))
        .withColumn("source", F.array_join(F.transform("body", lambda x: x.raw), "\n"))
        .where(stripped(F.col("source")) != "")
        .select(
            *keep,
            (F.row_number().over(Window.partitionBy(*keep).orderBy("opens")) - 1).alias("cue"),
            clock_ms(F.regexp_extract("head", CUE, 1)).alias("begin_ms"),
            clock_ms(F.regexp_extract("head", CUE, 2)).alias("end_ms"),
            "source",
            (F.col("opens") + 1).alias("first_line"),
            (F.col("opens") + F.size("body")).alias("last_line"),
        )
    )


def csv_delimiter(text: Column) -> Column:
    """The most frequent of comma, semicolon and tab in the first line; the earlier one on a tie, comma for none."""
    head = F.split(text, r"\r?\n", 2)[0]
    n = [F.length(head) - F.length(F.replace(head, F.lit(d))) for d in (",", ";", "\t")]
    return F.when((n[0] >= n[1]) & (n[0] >= n[2]), F.lit(",")).when(n[1] >= n[2], F.lit(";")).otherwise(F.lit("\t"))
