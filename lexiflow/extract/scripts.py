"""Strings inside script lines, by position: visual-novel scripts and source-like texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.extract.plain import lines
from lexiflow.functions.text import stripped

# Attributes that hold text, and words that open a line of commands.
TEXT_ATTRIBUTES = ("text", "name", "title", "label", "hint", "message", "caption")
COMMANDS = "import|init|define|default|label|menu|call|jump|return|if|elif|else|while|with|scene|show|hide|play|stop|screen|transform|image|style"

QUOTED = r"""(?:"[^"]*"|'[^']*')"""
ATTRIBUTE = rf"(?:[A-Za-z_][A-Za-z0-9_]*\s*=\s*{QUOTED})"


def runs(line: Column, pattern: str) -> Column:
    """array<struct<start, text>> of all matches of a pattern without groups, from the left, start counted from 0."""
    parts = F.lit(rf"((?:(?!{pattern}).)*+)({pattern})")
    gaps, found = (F.regexp_extract_all(line, parts, F.lit(k)) for k in (1, 2))
    none = F.array().cast("array<struct<start:int,text:string>>")
    return F.aggregate(
        F.zip_with(gaps, found, lambda g, t: F.struct(F.length(g).alias("gap"), t.alias("text"))),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, x: F.struct(
            (s.at + x.gap + F.length(x.text)).alias("at"), F.concat(s.out, F.array(F.struct((s.at + x.gap).alias("start"), x.text.alias("text")))).alias("out")
        ),
        lambda s: s.out,
    )


def spans(rows: DataFrame, keep: tuple[str, ...], suffix: Column, start: Column, value: Column, quote: Column) -> DataFrame:
    """The columns of a span entry; values without ink are no entries."""
    return rows.select(*keep, "line", suffix.alias("suffix"), value.alias("source"), start.cast("int").alias("start"), quote.alias("quote")).where(stripped(F.col("source")) != "").withColumn(
        "stop", F.col("start") + F.length("source")
    )


def inner(quoted: Column) -> Column:
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def named(line: Column) -> Column:
    return F.concat(F.lit("line"), line + 1)


def renpy_entries(files: DataFrame, *keep: str) -> DataFrame:
    """Quoted runs of lines that are neither remarks nor commands; the first of a line has a plain name, others one with their place."""
    said = lines(files, *keep).where(~F.col("raw").rlike(rf"^\s*(?:#|(?:{COMMANDS})\b)"))
    inked = F.filter(runs(F.col("raw"), QUOTED), lambda r: stripped(inner(r.text)) != "")
    each = said.select(*keep, "line", F.posexplode(inked).alias("nth", "r"))
    suffix = F.when(F.col("nth") == 0, named(F.col("line"))).otherwise(F.concat(named(F.col("line")), F.lit("."), F.col("r.start")))
    return spans(each, keep, suffix, F.col("r.start") + 1, inner(F.col("r.text")), F.substring("r.text", 1, 1))


def ks_entries(files: DataFrame, *keep: str) -> DataFrame:
    """Spoken lines as a whole; of tag lines the attributes that hold text. Labels, commands and remarks hold none."""
    rows = lines(files, *keep).where(~F.col("raw").rlike(r"^\s*(?:[;*@#]|//)"))
    value = stripped(F.col("raw"))
    spoken = spans(rows.where(~F.startswith(value, F.lit("["))), keep, named(F.col("line")), F.instr("raw", value) - 1, value, F.lit(""))
    tags = rows.where(F.startswith(value, F.lit("["))).select(*keep, "line", F.explode(runs(F.col("raw"), ATTRIBUTE)).alias("r"))
    name, quoted = F.regexp_extract("r.text", "^[A-Za-z0-9_]+", 0), F.regexp_extract("r.text", f"{QUOTED}$", 0)
    held = tags.where(F.lower(name).isin(*TEXT_ATTRIBUTES))
    start = F.col("r.start") + F.length("r.text") - F.length(quoted) + 1
    return spoken.unionByName(spans(held, keep, F.concat(named(F.col("line")), F.lit("."), name), start, inner(quoted), F.substring(quoted, 1, 1)))


def tjs_entries(files: DataFrame, *keep: str) -> DataFrame:
    """The quoted string that a line begins with."""
    quoted = F.regexp_extract("raw", rf"^\s*({QUOTED})", 1)
    rows = lines(files, *keep).where(quoted != "")
    return spans(rows, keep, named(F.col("line")), F.length(F.regexp_extract("raw", r"^\s*", 0)) + 1, inner(quoted), F.substring(quoted, 1, 1))
