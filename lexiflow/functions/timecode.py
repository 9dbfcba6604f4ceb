"""Subtitle times as milliseconds and back, in integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FPS = 23.976


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.expr("null").cast("bigint") if group < 0 else F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("bigint")


def fraction_ms(digits: Column) -> Column:
    """Digits after the point as milliseconds: padded to, and cut at, three."""
    return F.substring(F.rpad(digits, 3, "0"), 1, 3).cast("bigint")


def clock_ms(text: Column) -> Column:
    """h:mm:ss,fff or h:mm:ss.fff as milliseconds; null for anything else."""
    p = r"^\s*([0-9]{1,2}):([0-9]{2}):([0-9]{2})[,.]([0-9]{1,3})\s*$"
    ms = ((_int(text, p, 1) * 60 + _int(text, p, 2)) * 60 + _int(text, p, 3)) * 1000 + fraction_ms(F.regexp_extract(text, p, 4))
    return F.when(text.rlike(p), ms)


def ass_ms(text: Column) -> Column:
    """h:mm:ss.cc as milliseconds; 0 for anything else."""
    p = r"^\s*([0-9]+):([0-9]{2}):([0-9]{2})[.:]([0-9]{1,2})\s*$"
    ms = ((_int(text, p, 1) * 60 + _int(text, p, 2)) * 60 + _int(text, p, 3)) * 1000 + _int(text, p, 4) * 10
    return F.coalesce(F.when(text.rlike(p), ms), F.lit(0).cast("bigint"))


def lrc_ms(text: Column) -> Column:
    """mm:ss or mm:ss.fff as milliseconds; null for anything else."""
    p = r"^([0-9]{1,3}):([0-9]{1,2})(?:[.:]([0-9]{1,3}))?$"
    part = F.coalesce(F.nullif(F.regexp_extract(text, p, 3), F.lit("")), F.lit("0"))
    return F.when(text.rlike(p), (_int(text, p, 1) * 60 + _int(text, p, 2)) * 1000 + fraction_ms(part))


def frame_ms(frame: Column, fps: float = FPS) -> Column:
    return frame.cast("double") / F.lit(float(fps)) * 1000


def srt_stamp(ms: Column) -> Column:
    """Milliseconds as hh:mm:ss,fff; negative ones as 0."""
    t = F.greatest(F.round(ms).cast("bigint"), F.lit(0).cast("bigint"))

    def two(x: Column) -> Column:
        return F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))

    whole = F.concat_ws(":", two(F.expr("1") * F.floor(t / 3600000)), two(F.floor(t / 60000) % 60), two(F.floor(t / 1000) % 60))
    return F.concat(whole, F.lit(","), F.lpad((t % 1000).cast("string"), 3, "0"))


def vtt_stamp(ms: Column) -> Column:
    return F.replace(srt_stamp(ms), F.lit(","), F.lit("."))
