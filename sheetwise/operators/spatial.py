"""Box joins that stay distributed on a crowded page or question.

A box predicate alone would be a nested loop, and the page (or question) alone
as join key sends a crowded page to one task. Both sides are therefore keyed by
(page, grid cell): each box is listed in every cell it touches, and a pair is
reported only in the cell that holds the top-left corner of the shared
rectangle, so no pair appears twice and no distinct is needed afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.geometry import Box, box, overlaps

BOX = ("xl", "yt", "xr", "yb")


def with_cells(df: DataFrame, size: int, b: Box | None = None) -> DataFrame:
    """One row per grid cell the box shares area with."""
    b = b or box()

    def cells(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / size), F.ceil(high / size) - 1)

    return df.withColumn("cell_x", F.explode(cells(b.l, b.r))).withColumn(
        "cell_y", F.explode(cells(b.t, b.b))
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    size: int,
    right_box: Sequence[str],
    condition: Column | None = None,
    how: str = "inner",
) -> DataFrame:
    """Overlapping (left, right) pairs that agree on ``on``; each pair once. With
    ``how`` "left" each cell of a left box that holds no pair gives a row with nulls.

    The right side keeps its own box columns under the names ``right_box``.
    """
    a, b = box(), box(names=right_box)
    corner = (F.floor(F.greatest(a.l, b.l) / size) == F.col("cell_x")) & (
        F.floor(F.greatest(a.t, b.t) / size) == F.col("cell_y")
    )
    keep = overlaps(a, b) & corner
    if condition is not None:
        keep = keep & condition
    keys = [*on, "cell_x", "cell_y"]
    here, there = with_cells(left, size), with_cells(right, size, b)
    if how == "inner":
        return here.join(there, keys).filter(keep).drop("cell_x", "cell_y")
    # A cell without a pair must keep its row, so the whole condition belongs to the join.
    there = there.withColumnsRenamed({k: f"other_{k}" for k in keys})
    same = [F.col(k) == F.col(f"other_{k}") for k in keys]
    return here.join(there, [*same, keep], how).drop("cell_x", "cell_y", *(f"other_{k}" for k in keys))


def distinct_boxes(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct boxes with their row count, so copies of a crop cost one row.
    Box columns come out as ``b_xl`` .. ``b_yb``."""
    return (
        df.groupBy(*on, *BOX).agg(F.count(F.lit(1)).alias("n_build"))
        .select(*on, "n_build", *(F.col(c).alias("b_" + c) for c in BOX))
    )


# Boxes of one value of the keys up to which they meet there, without a grid.
FEW_BOXES = 64


def overlap_counts(
    probe: DataFrame, build: DataFrame, on: Sequence[str], *, size: int = 128
) -> DataFrame:
    """Probe rows that overlap at least one build row, with ``n_overlaps``.

    Where few build boxes share a key, rows meet by the key alone and travel once
    instead of once per cell; only the others are spread over cells.
    """
    boxes, there = distinct_boxes(build, on), [f"b_{c}" for c in BOX]
    crowds = boxes.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FEW_BOXES).select(*on)
    # A box without all four sides has no cell, so it meets nothing here either.
    few = boxes.dropna(subset=there).join(crowds, [*on], "left_anti")
    calm = probe.dropna(subset=[*BOX]).join(few, [*on]).filter(overlaps(box(), box(names=there)))
    spread = overlap_join(
        probe.join(crowds, [*on], "left_semi"), boxes.join(crowds, [*on], "left_semi"), on, size=size, right_box=there
    )
    counted = [pairs.groupBy(*probe.columns).agg(F.sum("n_build").alias("n_overlaps")) for pairs in (calm, spread)]
    return counted[0].unionByName(counted[1])
