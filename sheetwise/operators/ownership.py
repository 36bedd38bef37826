"""Which question owns a crop, from geometry alone.

Answer keys and labels are not inputs here, by signature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.answers import student_choices
from sheetwise.functions.gates import classify
from sheetwise.functions.geometry import area, box, shared_area
from sheetwise.operators.spatial import BOX, overlap_counts, overlap_join, with_cells

ZONE = ("zl", "zt", "zr", "zb")


def extend_column_bottoms(
    zones: DataFrame, heights: DataFrame, group: Sequence[str] = ("page",), scope: Sequence[str] = ()
) -> DataFrame:
    """Zones with the last one of each column reaching the page bottom, and a
    ``problem`` text for zones that must be refused.

    The last top of a column and how often it occurs are aggregated (partial
    first) and joined back, so one very long column is not one task.
    """
    page = [*scope, *group]
    column = [*page, "zl", "zr"]
    tops = zones.groupBy(*column, "zt").agg(F.count(F.lit(1)).alias("n"))
    last = tops.groupBy(*column).agg(F.max(F.struct("zt", "n")).alias("last"))
    rows = zones.join(last, column).join(heights.select(*page, "height"), page)
    is_last = F.col("zt") == F.col("last.zt")
    problem = F.when(
        ~((F.col("zt") >= 0) & (F.col("zt") < F.col("zb")) & (F.col("zb") <= F.col("height")) & (F.col("zl") < F.col("zr"))),
        F.lit("outside_page"),
    ).when(is_last & (F.col("last.n") > 1), F.lit("no_unique_last"))
    return (
        rows.withColumn("problem", problem)
        .withColumn("zb_before", F.col("zb"))
        .withColumn("zb", F.when(is_last, F.col("height")).otherwise(F.col("zb")))
        .drop("last", "height")
    )


def associate(
    crops: DataFrame, zones: DataFrame, minimum: float | None = None, scope: Sequence[str] = (), size: int = 512
) -> DataFrame:
    """Zones each crop shares area with.

    One row per (crop, zone hit), or one with a null question for a crop without
    any; crop columns are carried along. ``kept`` marks the hits that count,
    ``first_row`` exactly one row per crop.
    """
    if minimum is not None and not 0.5 <= minimum <= 1:
        raise ValueError("Minimum overlap must be between 0.5 and 1")
    sound = (F.col("xl") < F.col("xr")) & (F.col("yt") < F.col("yb"))
    crops = crops.withColumn(
        "xl", F.when(sound, F.col("xl")).otherwise(F.raise_error(F.lit("Invalid ink box")).cast("int"))
    )
    targets = zones.select(*scope, "page", "question_id", *ZONE)
    here, zone = box(), box(names=ZONE)
    # Without a zone its box is null, which least and greatest would pass over.
    hit = F.col("question_id").isNotNull()
    # A crop's cells keep their row where no zone is met, so crops outside every zone
    # come out of the same join and no crop travels beside its hits.
    hits = overlap_join(crops, targets, [*scope, "page"], size=size, right_box=ZONE, how="left").select(
        *crops.columns, "question_id",
        F.when(hit, shared_area(here, zone) / area(here)).alias("fraction"),
        (hit & (shared_area(here, zone) == area(here))).alias("whole"),
    )
    per_crop = Window.partitionBy(*scope, "crop_id")
    rows = hits.withColumn("first_row", F.row_number().over(per_crop.orderBy(F.col("question_id").asc_nulls_last())) == 1)
    # A cell without a hit counts only where the whole crop has none, and then once.
    rows = rows.filter("question_id IS NOT NULL OR first_row").withColumn("n_hits", F.count("question_id").over(per_crop))
    if minimum is None:
        rows = rows.withColumn("n_enough", F.lit(0))
        enough = F.lit(False)
    else:
        enough = F.coalesce(F.col("fraction") >= minimum, F.lit(False))
        rows = rows.withColumn("n_enough", F.sum(enough.cast("int")).over(per_crop))
    rows = rows.withColumn("any_whole", F.max("whole").over(per_crop))
    status = (
        F.when((F.col("n_enough") == 1) | ((F.col("n_hits") == 1) & F.col("any_whole")), F.lit("assigned"))
        .when(F.col("n_hits") > 1, F.lit("ambiguous"))
        .when(F.col("n_hits") == 1, F.lit("outside_zone"))
        .otherwise(F.lit("unassigned"))
    )
    kept = F.col("question_id").isNotNull() & ((F.col("n_enough") != 1) | enough)
    return (
        rows.withColumn("status", status).withColumn("kept", kept)
        .drop("n_enough", "any_whole", "whole")
    )


def anchor_columns(crops: DataFrame) -> DataFrame:
    """Page crops with ``anchor_ok`` (an accepted answer whoever owns it) and
    ``left_out`` (stage 1)."""
    gate = classify(
        empty=F.col("is_empty"), excluded=F.col("answer_excluded"), executed=F.col("ocr_executed"),
        text=F.col("txt"), score=F.col("score"), annotation=F.col("semantic_annotation"),
        route=F.col("route"), choice=student_choices(F.col("txt")), ownership=F.lit(False),
    )
    return crops.withColumn(
        "anchor_ok",
        (gate.reason == "candidate") & ~F.col("reread_conflict") & ~F.col("retry_ownership_review"),
    ).withColumn("left_out", F.col("is_empty") | F.col("answer_excluded"))


def enclosing_assignments(
    associated: DataFrame, share: float = 0.8, scope: Sequence[str] = (), size: int = 128
) -> DataFrame:
    """(crop, question) for uncertain crops that cover accepted answers of one
    owner only. Anchors come from the input associations, so an owner found here
    never becomes an anchor.

    An anchor covered to 80 % has its centre inside the covering crop, so an
    anchor is listed in the one cell of its centre and copies of an anchor are
    merged before the join.
    """
    if share <= 0.5:
        raise ValueError("The centre rule needs a share above one half")
    page = [*scope, "page"]
    anchors = (
        associated.filter("status = 'assigned' AND kept AND anchor_ok")
        .groupBy(*page, "question_id", *BOX).agg(F.count(F.lit(1)).alias("n_anchors"))
        .select(*page, "question_id", "n_anchors", *(F.col(c).alias("a_" + c) for c in BOX))
        .withColumn("cell_x", F.floor((F.col("a_xl") + F.col("a_xr")) / 2 / size))
        .withColumn("cell_y", F.floor((F.col("a_yt") + F.col("a_yb")) / 2 / size))
    )
    targets = with_cells(
        associated.filter("first_row AND status <> 'assigned' AND NOT left_out").select(*page, "crop_id", *BOX), size
    )
    inner, outer = box("a_"), box()
    covered = shared_area(outer, inner) / area(inner) >= share
    return (
        targets.join(anchors, [*page, "cell_x", "cell_y"]).filter(covered)
        .groupBy(*scope, "crop_id")
        .agg(F.min("question_id").alias("owner"), F.max("question_id").alias("other"), F.sum("n_anchors").alias("anchors"))
        .filter("owner = other").drop("other")
    )


def assign(associated: DataFrame, changed: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per (crop, question) that counts; crops no zone owns keep one row
    with a null question. ``ownership_review`` marks every uncertain owner."""
    crop = [*scope, "crop_id"]
    rows = associated.join(changed.select(*crop, "owner"), crop, "left")
    moved = F.col("owner").isNotNull()
    wanted = F.when(moved, F.col("first_row")).otherwise(F.col("kept") | (F.col("n_hits") == 0))
    return (
        rows.filter(wanted)
        .withColumn("question_id", F.when(moved, F.col("owner")).otherwise(F.col("question_id")))
        .withColumn("fraction", F.when(~moved, F.col("fraction")))
        .withColumn("status", F.when(moved, F.lit("assigned")).otherwise(F.col("status")))
        .withColumn("enclosed", moved)
        .withColumn("ownership_review", (F.col("status") != "assigned") | F.col("retry_ownership_review"))
        .drop("owner", "first_row", "kept")
    )


def association_summary(associated: DataFrame, assigned: DataFrame) -> DataFrame:
    """Crops, links, unassigned and not assigned, in one row each."""
    crops = associated.filter("first_row").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    links = assigned.groupBy(
        F.when(F.col("question_id").isNull(), F.lit("final:unassigned"))
        .otherwise(F.concat(F.lit("final:"), F.col("status"))).alias("status")
    ).agg(F.count(F.lit(1)).alias("n"))
    return crops.unionByName(links)


def attach_annotations(crops: DataFrame, notes: DataFrame, scope: Sequence[str] = (), size: int = 64) -> DataFrame:
    """(crop, annotation) for crops a note overlaps on its page; the last note
    wins, and a note on another image becomes a request to review it.

    ``notes`` has (page, xl..yb, note_seq, source_hash, note).
    """
    boxed = notes.select(
        *scope, "page", "note_seq", F.col("source_hash").alias("note_hash"), "note",
        *(F.col(c).alias("n_" + c) for c in BOX),
    )
    # A crop is listed in several cells; its hash would travel with each, so only crops a note meets fetch theirs.
    place = [*scope, "page", *BOX]
    pairs = overlap_join(
        crops.select(*place, "crop_id"), boxed, [*scope, "page"], size=size, right_box=[f"n_{c}" for c in BOX],
    )
    last = pairs.groupBy(*place, "crop_id").agg(
        F.max("note_seq").alias("note_seq"), F.max_by(F.struct("note_hash", "note"), "note_seq").alias("last")
    ).withColumnsRenamed({c: f"met_{c}" for c in [*place, "crop_id"]})
    same = [F.col(c) == F.col(f"met_{c}") for c in place] + [F.col("crop_id").eqNullSafe(F.col("met_crop_id"))]
    shown = F.when(F.col("last.note_hash") == F.col("source_hash"), F.col("last.note")).otherwise(
        F.lit("previous_annotation_overlap_requires_review")
    )
    return (
        crops.select(*place, "crop_id", "source_hash").join(last, same)
        .groupBy(*scope, "crop_id").agg(F.max_by(shown, "note_seq").alias("annotation"))
    )


def printed_overlap(crops: DataFrame, marks: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Crops that touch a printed choice number of their question."""
    keys = [*scope, "question_id"]
    return overlap_counts(crops.select(*keys, "crop_id", *BOX), marks.select(*keys, *BOX), keys)
