"""Decisions on one crop or one page, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetwise.functions.answers import blank

# Fixed value: circled letters that mark a protected printed choice.
CIRCLED_LETTERS = "ⓐⓑⓒⓓⓔⓕⓖⓗⓘⓙⓚⓛⓜⓝⓞⓟⓠⓡⓢⓣⓤⓥⓦⓧⓨⓩ"


def finite(value: Column) -> Column:
    """True for a real number; null, NaN and infinities are false."""
    inf = float("inf")
    return F.coalesce(
        ~F.isnan(value) & (value != F.lit(inf)) & (value != F.lit(-inf)), F.lit(False)
    )


def classify(
    *, empty, excluded, executed, text, score, annotation, route, choice, ownership
) -> Column:
    """First gate a crop fails, as struct(stage, reason); (0, 'candidate') passes all.

    ``choice`` is the parsed answer mask of ``text``, so a plan parses once. A crop whose
    recognition is not known to have run (null) is held as not executed.
    """
    gates = [
        (empty, 1, "2"),
        (excluded, 1, "9"),
        (~F.coalesce(executed, F.lit(False)), 2, "not_executed"),
        (blank(text), 2, "5"),
        (~finite(score), 2, "score_missing"),
        (score < 0.8, 2, "6"),
        (annotation.isNotNull(), 3, "11"),
        (route == "choice_mark_review", 3, "8"),
        (~route.eqNullSafe("student_candidate"), 3, "route_unknown"),
        (choice.isNull(), 3, "7"),
        (F.coalesce(ownership, F.lit(False)), 3, "15"),
    ]
    stage, reason = None, None
    for condition, number, code in gates:
        stage = F.when(condition, number) if stage is None else stage.when(condition, number)
        reason = F.when(condition, F.lit(code)) if reason is None else reason.when(condition, F.lit(code))
    return F.struct(
        stage.otherwise(0).alias("stage"), reason.otherwise(F.lit("candidate")).alias("reason")
    )


def route_candidate(overlap, largest, shaded, aligned, stage: str = "shade") -> Column:
    """One of six routes for a crop compared with the blank original."""
    if stage not in ("print", "shade"):
        raise ValueError("stage must be print or shade")
    printed = overlap >= 0.2
    small = largest <= 12
    route = F.when(~aligned, F.lit("alignment_review"))
    if stage == "shade":
        route = route.when(shaded & small & printed, F.lit("reference_print_background"))
        route = route.when(shaded & small, F.lit("mixed_shade_background"))
    return (
        route.when(printed & small, F.lit("reference_print"))
        .when(printed, F.lit("mixed_print_review"))
        .otherwise(F.lit("student_candidate"))
    )


def recognition_gate(flat, shade, empty, route, protected) -> Column:
    """struct(excluded, executed, final_route) before recognition. A protected
    choice is never excluded, an empty crop is never recognised."""
    background = route.isin("reference_print", "reference_print_background", "mixed_shade_background")
    excluded = (flat | shade | empty | background) & ~protected
    executed = ~empty & ~excluded
    final = (
        F.when(protected, F.lit("choice_mark_review"))
        .when(excluded, F.lit("excluded_after_extraction"))
        .otherwise(F.lit("student_candidate"))
    )
    return F.struct(
        excluded.alias("excluded"), executed.alias("executed"), final.alias("final_route")
    )


def flat_background(median, dark_pixels, total, largest, area, max_dark: float = 0.0) -> Column:
    """Nearly uniform gray crop, from its pixel statistics."""
    if not 0 <= max_dark <= 1:
        raise ValueError("max_dark must be between 0 and 1")
    return (
        (area >= 150)
        & (area / total >= 0.12)
        & median.between(150, 235)
        & (dark_pixels / total <= max_dark)
        & (largest >= 150)
    )


def shaded_low_ink(shaded_estimate, interior, ink_fraction, max_ink: float = 0.0566) -> Column:
    """Little ink on a broad shaded patch, from its pixel statistics."""
    if not 0 <= max_ink <= 1:
        raise ValueError("max_ink must be between 0 and 1")
    return shaded_estimate & (interior >= 150) & (ink_fraction <= max_ink)


def mixed_print(preserved, excluded, overlap, largest) -> Column:
    """Print and handwriting in one crop."""
    return ~preserved & ~excluded & (overlap >= 0.2) & (largest > 12)


def gray_residue(pixels, ink) -> Column:
    """Enough gray pixels of the original left in the crop to look at it."""
    return (pixels >= 100) & (pixels >= 0.2 * F.greatest(F.lit(1), ink))


def aligned(has_matrix, inliers, median_error) -> Column:
    """Page alignment good enough to trust positions."""
    return F.coalesce(
        has_matrix & (inliers > 30) & finite(median_error) & (median_error <= 3), F.lit(False)
    )


def normalise_size(ink_rows, ink_width, image_rows, grading_height, minimum=8, height=40):
    """struct(ink_height, skip, width): the plan for scaling a crop to one height."""
    ink_height = ink_rows * grading_height / image_rows
    width = F.greatest(F.lit(1), F.bround(ink_width * height / ink_rows).cast("int"))
    skip = (ink_rows <= 0) | (ink_height <= minimum)
    return F.struct(
        ink_height.alias("ink_height"), skip.alias("skip"), F.when(~skip, width).alias("width")
    )


def timestamp_with_offset(text: Column) -> Column:
    """ISO-8601 text that parses and states its offset."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)\z")
    return F.coalesce(shaped & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def safe_image_path(path: Column) -> Column:
    """Relative png/jpeg path that stays inside its folder on every system."""
    parts = F.split(path, "/")
    clean = F.forall(
        parts, lambda p: ~p.isin("", ".", "..") & ~p.rlike(r"[ .]\z")
    )
    return F.coalesce(
        ~path.rlike(r"[\\:*?<>|\x22\x00]")
        & (F.trim(path) != "")
        & clean
        & F.lower(path).rlike(r"[^/]\.(png|jpg|jpeg)\z"),
        F.lit(False),
    )
