"""Box algebra on four numeric columns (left, top, right, bottom)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    """Four columns of one box."""

    l: Column
    t: Column
    r: Column
    b: Column


def box(prefix: str = "", names=("xl", "yt", "xr", "yb")) -> Box:
    return Box(*(F.col(prefix + name) for name in names))


def area(a: Box) -> Column:
    return (a.r - a.l) * (a.b - a.t)


def overlaps(a: Box, b: Box) -> Column:
    """Shared area above zero; touching edges do not count."""
    return (
        (F.greatest(a.l, b.l) < F.least(a.r, b.r))
        & (F.greatest(a.t, b.t) < F.least(a.b, b.b))
    )


def shared_area(a: Box, b: Box) -> Column:
    width = F.greatest(F.lit(0), F.least(a.r, b.r) - F.greatest(a.l, b.l))
    height = F.greatest(F.lit(0), F.least(a.b, b.b) - F.greatest(a.t, b.t))
    return width * height


def overlap_fraction(a: Box, b: Box) -> Column:
    """Share of box ``a`` that lies in box ``b``."""
    return shared_area(a, b) / area(a)


def contains(outer: Box, inner: Box) -> Column:
    return (
        (outer.l <= inner.l) & (outer.t <= inner.t) & (outer.r >= inner.r) & (outer.b >= inner.b)
    )


def strictly_inside(outer: Box, inner: Box) -> Column:
    return (
        (outer.l < inner.l) & (outer.t < inner.t) & (outer.r > inner.r) & (outer.b > inner.b)
    )


def center_inside(a: Box, region: Box) -> Column:
    """Centre of ``a`` in the closed region."""
    return ((a.l + a.r) / 2).between(region.l, region.r) & ((a.t + a.b) / 2).between(
        region.t, region.b
    )


def project_box(a: Box, m) -> Column:
    """struct(l, t, r, b): bounding box of the four corners through a homography.

    ``m(row, column)`` gives a matrix element as a column.
    """
    xs, ys = [], []
    for x, y in ((a.l, a.t), (a.r, a.t), (a.r, a.b), (a.l, a.b)):
        z = m(2, 0) * x + m(2, 1) * y + m(2, 2)
        xs.append((m(0, 0) * x + m(0, 1) * y + m(0, 2)) / z)
        ys.append((m(1, 0) * x + m(1, 1) * y + m(1, 2)) / z)
    return F.struct(
        F.least(*xs).alias("l"), F.least(*ys).alias("t"),
        F.greatest(*xs).alias("r"), F.greatest(*ys).alias("b"),
    )


def page_box(mark: Box, zone: Box, sx: Column, sy: Column) -> Column:
    """Crop coordinates back to page coordinates; the crop origin was rounded
    half to even at scan scale."""
    ox, oy = F.bround(zone.l * sx), F.bround(zone.t * sy)
    return F.struct(
        ((mark.l + ox) / sx).alias("l"), ((mark.t + oy) / sy).alias("t"),
        ((mark.r + ox) / sx).alias("r"), ((mark.b + oy) / sy).alias("b"),
    )
