"""Boxes as arrays [x, y, w, h]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common height of two boxes as a share of the smaller height."""
    common = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    base = F.least(a[3], b[3])
    return F.when(base > 0, F.greatest(F.lit(0.0), common) / base).otherwise(F.lit(0.0))


def height_ratio(a: Column, b: Column) -> Column:
    return F.greatest(a[3], b[3]) / F.least(a[3], b[3])


def union_box(box: Column) -> Column:
    """Aggregate: the smallest box around all boxes of a group."""
    x, y = F.min(box[0]), F.min(box[1])
    return F.array(x, y, F.max(box[0] + box[2]) - x, F.max(box[1] + box[3]) - y)


def inside(part: Column, anchor: Column, slack: float = 2.0) -> Column:
    """Whether a part lies in an anchor's box, give or take `slack` pixels."""
    return (
        (part[0] >= anchor[0] - slack)
        & (part[1] >= anchor[1] - slack)
        & (part[0] + part[2] <= anchor[0] + anchor[2] + slack)
        & (part[1] + part[3] <= anchor[1] + anchor[3] + slack)
    )


def usable(box: Column) -> Column:
    """Four finite numbers with a positive width and height."""
    finite = F.forall(F.slice(box, 1, 4), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(box) >= 4) & finite & (F.get(box, F.lit(2)) > 0) & (F.get(box, F.lit(3)) > 0), F.lit(False))


def sprite_sized(width: Column, height: Column, most: int = 420_000) -> Column:
    """Whether a page is small enough to be a fragment of an interface."""
    return F.coalesce((width > 0) & (height > 0) & (width * height <= most), F.lit(False))
