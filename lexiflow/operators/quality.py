"""Findings about translations, as arrays of rule names in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.functions.text import SIGNAL, WIDE, placeholders

MOST_ISSUES = 300


def _listed(rules: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rules)), lambda x: x.isNotNull())


def text_warnings(source: Column, target: Column, method: Column) -> Column:
    """Rules on a pair of texts; the last two leave out what was not translated."""
    quiet = method.isin("passthrough", "skip")
    ratio = F.length(target) / F.nullif(F.length(source), F.lit(0))
    long = ~quiet & (F.length(source) >= 8) & (F.length(target) > 0)

    def ends(test) -> Column:
        return test(source) != test(target)

    breaks = [F.length(x) - F.length(F.replace(x, F.lit("\n"))) for x in (source, target)]
    return _listed(
        [
            ("placeholders", placeholders(source) != placeholders(target)),
            ("line breaks", breaks[0] != breaks[1]),
            ("leading blank", ends(lambda x: F.startswith(x, F.lit(" ")))),
            ("trailing blank", ends(lambda x: F.endswith(x, F.lit(" ")))),
            ("too long", long & (ratio > 3.5)),
            ("too short", long & (ratio < 0.2)),
            ("left over", ~quiet & (method != "api") & target.rlike("[A-Za-z]{3,}")),
        ]
    )


def label_warnings(source: Column, target: Column, method: Column, parts: Column, naive: Column, box: Column) -> Column:
    """Rules on a label that was put together from image fragments: parts, box [x, y, w, h] and the naive join."""
    quiet = method.isin("passthrough", "skip")
    letters = F.regexp_count(source, F.lit(SIGNAL.replace("0-9", "")))
    wide = F.regexp_count(target, F.lit(WIDE))
    width = (wide + (F.length(target) - wide) * 0.55) * box[3]
    same = (F.trim(target) == F.trim(naive)) & (F.trim(naive) != F.trim(source)) & (naive != "")
    return _listed(
        [
            ("few parts", parts < 2),
            ("short reading", (parts >= 3) & (letters <= 1)),
            ("joined only", ~quiet & same),
            ("overflow", ~quiet & (target != "") & (box[2] > 0) & (box[3] > 0) & (width > box[2] * 1.35)),
        ]
    )


def checked(results: DataFrame) -> DataFrame:
    return results.withColumn("warnings", text_warnings(F.col("source"), F.col("target"), F.col("method")))


def issues(results: DataFrame, ids: list[str] | None = None, most: int = MOST_ISSUES) -> DataFrame:
    """The first `most` rows with a finding in the order of ord, of some ids if given."""
    rows = checked(results)
    if ids is not None:
        rows = rows.where(F.col("id").isin(ids))
    return rows.where(F.size("warnings") > 0).orderBy("ord").limit(most)


def placeholder_differences(source: Column, target: Column) -> Column:
    """Placeholders, counted, that only one of two texts has."""
    a, b = placeholders(source), placeholders(target)
    return F.concat(F.array_except(a, b), F.array_except(b, a))
