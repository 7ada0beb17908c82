"""Rectangles and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def common_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    zero = F.lit(0.0)
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)


def area(a: tuple[Column, ...]) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def overlap_score(a, b) -> Column:
    """Common area over the smaller area; areas are at least 1."""
    one = F.lit(1.0)
    return common_area(a, b) / F.least(F.greatest(area(a), one), F.greatest(area(b), one))


def overlap(a, b) -> Column:
    """Whether the common area is more than a fifth of either rectangle; rectangles without area don't count."""
    c = common_area(a, b)
    return (c > 0) & ((area(a) > 0) & (c > area(a) * 0.2) | (area(b) > 0) & (c > area(b) * 0.2))


def rgb(color: Column) -> tuple[Column, Column, Column]:
    c = F.coalesce(color, F.lit(0)).cast("int")
    return F.shiftright(c, 16).bitwiseAND(255), F.shiftright(c, 8).bitwiseAND(255), c.bitwiseAND(255)


def similar_colors(a: Column, b: Column, tolerance: int = 30) -> Column:
    out = F.lit(True)
    for x, y in zip(rgb(a), rgb(b)):
        out = out & (F.abs(x - y) <= tolerance)
    return out
