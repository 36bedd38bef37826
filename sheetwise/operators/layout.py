"""Page layout: zones, row groups, runs, region numbers and boundary strokes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.operators.ordered import carry_forward, range_ordinal, runs
from sheetwise.operators.spatial import BOX, overlap_join
from sheetwise.session import materialise


def carry_part(headings: DataFrame, group: Sequence[str], bucket, order: Sequence[str]) -> DataFrame:
    """Headings with ``part``: their own, else the last Part before them, else 0."""
    rows = carry_forward(headings, group, bucket, order, "own_part", "part_before")
    return rows.withColumn("part", F.coalesce("own_part", "part_before", F.lit(0))).drop("part_before")


def zone_bottoms(heads: DataFrame, page_height: int, scope: Sequence[str] = ()) -> DataFrame:
    """Heads (page, column_no, y) with ``bottom``: 18 above the next head more than
    5 lower in the column, or 150 above the page end.

    Each head is in the column's order twice: as a target at y and as a question
    at y + 5. The first target behind a question is its answer, so there is no
    pairing of heads.
    """
    column = [*scope, "page", "column_no"]
    ys = heads.select(*column, "y").distinct()
    events = ys.select(*column, F.col("y").alias("at"), F.lit(0).alias("kind"), F.col("y").alias("target"), F.lit(None).cast("double").alias("y")).unionByName(
        ys.select(*column, (F.col("y") + 5).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("target"), "y")
    )
    behind = Window.partitionBy(*column).orderBy("at", "kind").rowsBetween(1, Window.unboundedFollowing)
    found = events.withColumn("next_y", F.min("target").over(behind)).filter("kind = 1").select(*column, "y", "next_y")
    bottom = F.coalesce(F.col("next_y").cast("int") - 18, F.lit(page_height - 150))
    return heads.join(found, [*column, "y"]).withColumn("bottom", bottom).drop("next_y")


def row_groups(rows: DataFrame, group: Sequence[str], gap: int = 5) -> DataFrame:
    """Runs of inked rows (group, y, pixels): a gap over 5 starts a new one; groups
    at least 7 high with at least 60 pixels stay."""
    per_y = rows.groupBy(*group, "y").agg(F.sum("pixels").alias("pixels"))
    return (
        runs(per_y, group, "y", gap).groupBy(*group, "run")
        .agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.sum("pixels").alias("pixels"))
        .filter("bottom - top >= 7 AND pixels >= 60").drop("run")
    )


def longest_run(columns: DataFrame, group: Sequence[str], width: int = 200) -> DataFrame:
    """Longest run of consecutive inked columns per mark; cancelled from 200 on."""
    inked = runs(columns.select(*group, "x").distinct(), group, "x", 1)
    lengths = inked.groupBy(*group, "run").agg(F.count(F.lit(1)).alias("n"))
    return lengths.groupBy(*group).agg(F.max("n").alias("span")).withColumn("cancelled", F.col("span") >= width)


def _around(points: DataFrame, cell: Sequence[str] = ("_cx", "_cy")) -> DataFrame:
    """Each row once for its own cell and each of the eight around it."""
    steps = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    x, y = cell
    return (
        points.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
        .withColumn(x, F.col(x) + F.col("_dx")).withColumn(y, F.col(y) + F.col("_dy")).drop("_dx", "_dy")
    )


# Points of a group up to which the selection is made in one row.
FEW_POINTS = 64


def suppress_near(points: DataFrame, group: Sequence[str], distance: int = 18) -> DataFrame:
    """Greedy selection by (score, label, x, y) descending: a point within 18 px in
    both axes of a kept one is dropped.

    A group of few points is decided in one row. Larger groups take rounds instead of a
    fold: of the open points the best of each cell is kept if no better open point is
    near it, and what is near a kept point falls. The best open point of a group is
    always kept, so rounds end, and each meets a point with at most nine others. Points
    without a position are near nothing and stay; of equal positions only the best counts.
    """
    columns = [*group, "score", "label", "x", "y"]
    nowhere = F.col("x").isNull() | F.col("y").isNull()
    best = points.filter(~nowhere).groupBy(*group, "x", "y").agg(F.max(F.struct("score", "label")).alias("top"))
    cell = lambda name: F.floor(F.col(name) / (distance + 1))
    kept = points.filter(nowhere).groupBy(*group, "x", "y").agg(F.max(F.struct("score", "label")).alias("top")).select(
        *group, "top.score", "top.label", "x", "y"
    )
    close = lambda a, b: (F.abs(a["x"] - b["x"]) <= distance) & (F.abs(a["y"] - b["y"]) <= distance)
    # Groups without a whole key go with the larger ones, where keys are compared as structs.
    few = best.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= FEW_POINTS).select(*group)
    listed = best.join(few, group).groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("top.score", "top.label", "x", "y")), asc=False).alias("_all")
    )
    chosen = F.aggregate("_all", F.slice("_all", 1, 0), lambda done, p: F.when(
        F.exists(done, lambda k: close(k, p)), done).otherwise(F.concat(done, F.array(p))))
    kept = kept.unionByName(listed.select(*group, F.inline(chosen)))
    left = materialise(best.join(few, group, "left_anti").select(
        F.struct(*group).alias("_g"), cell("x").alias("_cx"), cell("y").alias("_cy"), F.struct("top.score", "top.label", "x", "y").alias("_p")
    ), "open")
    place = ["_g", "_cx", "_cy"]
    near = close(F.col("_p"), F.col("_c"))
    while not left.isEmpty():
        first = left.groupBy(*place).agg(F.max("_p").alias("_c"))
        blocked = _around(first).join(left, place).filter(near & (F.col("_p") > F.col("_c"))).select("_g", "_c")
        chosen = materialise(first.join(blocked, ["_g", "_c"], "left_anti"), "chosen")
        kept = kept.unionByName(chosen.select("_g.*", "_c.score", "_c.label", "_c.x", "_c.y").select(*columns))
        fallen = _around(chosen).join(left, place).filter(near).select("_g", "_p")
        left = materialise(left.join(fallen, ["_g", "_p"], "left_anti"), "open")
    return kept.select(*columns)


def number_regions(regions: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Regions numbered from 1 per page by (top, left, bottom, right), equal ones by
    crop. A page is split by ranges of that order, whatever its boxes, so neither a
    crowded page nor copies of one box are a single task."""
    rows = range_ordinal(regions, [*scope, "page"], ["yt", "xl", "yb", "xr", "crop_id"], "number")
    return rows.withColumn("region_id", F.format_string("%d-ink%04d", "page", "number"))


def diagnose_boundary(crops: DataFrame, strokes: DataFrame, scope: Sequence[str] = (), size: int = 128) -> DataFrame:
    """(page, axis, edge, component, crop): strokes of at least 35 px that reach 3 px
    past a zone edge the crop touches. ``crops`` carries its zone (zl..zb)."""
    touching = F.array_compact(F.array(*(
        F.when(F.col(side) == F.col(edge), F.struct(F.lit(axis).alias("axis"), F.col(edge).alias("edge")))
        for axis, side, edge in ((0, "xl", "zl"), (0, "xr", "zr"), (1, "yt", "zt"), (1, "yb", "zb"))
    )))
    edges = crops.select(*scope, "page", "crop_id", "question_id", *BOX, F.explode(touching).alias("at")).select(
        *scope, "page", "crop_id", "question_id", *BOX, "at.axis", "at.edge"
    )
    parts = strokes.filter("stroke_area >= 35").select(
        *scope, "page", "component", *(F.col(c).alias("s_" + c) for c in BOX)
    )
    low = F.when(F.col("axis") == 0, F.col("s_xl")).otherwise(F.col("s_yt"))
    high = F.when(F.col("axis") == 0, F.col("s_xr")).otherwise(F.col("s_yb"))
    pairs = overlap_join(
        edges, parts, [*scope, "page"], size=size, right_box=[f"s_{c}" for c in BOX],
        condition=(low <= F.col("edge") - 3) & (high >= F.col("edge") + 3),
    )
    return pairs.select(*scope, "page", "axis", "edge", "component", "crop_id", "question_id").distinct()


def merge_groups(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cases (keys, component, crop_id) with ``group_id``: cases that share a crop
    merge, transitively, inside the same keys. The group is named after its lowest
    component.

    Labels spread over the case-crop graph with min aggregations (combined map-side,
    so a crop in very many cases is no hot spot). Each round is written to the shared
    folder, which cuts the lineage; rounds end when no label changes.
    """
    keys = list(keys)
    node, link = [*keys, "component"], [*keys, "crop_id"]
    edges = materialise(cases.select(*node, "crop_id").distinct(), "edges")
    labels = materialise(edges.select(*node).distinct().withColumn("label", F.col("component")), "labels")
    while True:
        by_crop = edges.join(labels, node).groupBy(*link).agg(F.min("label").alias("reach"))
        best = edges.join(by_crop, link).groupBy(*node).agg(F.min("reach").alias("best"))
        # Follow the label of the label too, which halves long chains.
        hop = labels.select(*keys, F.col("component").alias("best"), F.col("label").alias("beyond"))
        moved = (
            labels.join(best, node).join(hop, [*keys, "best"])
            .select(*node, F.col("label").alias("old"), F.least("best", "beyond").alias("label"))
        )
        moved = materialise(moved, "labels")
        labels = moved.drop("old")
        if not moved.filter("label <> old").take(1):
            return cases.join(labels.withColumnRenamed("label", "group_id"), node)


def diagnosis_summary(cases: DataFrame) -> DataFrame:
    """Cases and distinct questions per category."""
    return cases.groupBy("category").agg(
        F.count_distinct("case_id").alias("cases"), F.count_distinct("question_id").alias("questions")
    )
