"""Column functions as queries, one per rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.functions import gates
from sheetwise.functions.answers import (
    answer_string, eligible_answer, key_answer, mask_to_array, natural_key,
    required_answer_count, should_reread, student_choices, to_digit,
)
from sheetwise.functions.geometry import (
    Box, area, box, center_inside, contains, overlap_fraction, overlaps, page_box, project_box,
)
from sheetwise.functions.messages import reason_message, resolution_reason
from sheetwise.operators.review import classify_crops
from sheetwise.plans.checks import D, check, digits_of

c = F.col

def zone_box() -> Box:
    return Box(c("zl"), c("zt"), c("zr"), c("zb"))


def milli(value):
    return F.floor(value * 1000).cast("bigint")


def _stats(t):
    return t.fx_stats.select(
        "crop_id",
        gates.route_candidate(c("print_overlap"), c("largest_residual"), c("shaded"), c("page") % 31 != 0).alias("route"),
        gates.route_candidate(c("print_overlap"), c("largest_residual"), c("shaded"), c("page") % 31 != 0, "print").alias("print_route"),
    )


def _gate(t):
    flat = gates.flat_background(c("gray_median"), c("dark_pixels"), c("total_pixels"), c("largest_area"), c("gray_area"))
    shade = gates.shaded_low_ink(c("shaded"), c("gray_interior"), c("ink_fraction"))
    route = gates.route_candidate(c("print_overlap"), c("largest_residual"), c("shaded"), F.lit(True))
    gate = gates.recognition_gate(flat, shade, c("is_empty"), route, c("protected_choice"))
    return t.fx_stats.withColumn("gate", gate).select("crop_id", "gate.excluded", "gate.executed", "gate.final_route")


def _project(t):
    pages = t.fx_pages.select("page", "has_matrix", "inliers", "median_error")
    matrix = F.array(
        F.array(F.lit(1.0) + c("inliers") / 1000, c("median_error") / 100, F.lit(3.5)),
        F.array(F.lit(-0.002), F.lit(0.995), c("median_error")),
        F.array(F.lit(0.00001), c("inliers") / 10000000, F.lit(1.0)),
    )
    rows = t.fx_crops.join(pages.withColumn("matrix", matrix), "page")
    element = lambda i, j: F.element_at(F.element_at("matrix", i + 1), j + 1)
    return rows.withColumn("p", project_box(box(), element)).select(
        "crop_id", *(milli(c(f"p.{k}")).alias(k) for k in "ltrb")
    )


PROJECT_SQL = """
SELECT crop_id, CAST(floor(least(x1,x2,x3,x4)*1000) AS BIGINT) AS l, CAST(floor(least(y1,y2,y3,y4)*1000) AS BIGINT) AS t,
       CAST(floor(greatest(x1,x2,x3,x4)*1000) AS BIGINT) AS r, CAST(floor(greatest(y1,y2,y3,y4)*1000) AS BIGINT) AS b FROM (
SELECT crop_id, """ + ", ".join(
    f"((CAST(1.0 AS DOUBLE) + inliers / 1000.0::DOUBLE) * {x} + median_error / 100 * {y} + 3.5::DOUBLE) / (0.00001::DOUBLE * {x} + inliers / 10000000::DOUBLE * {y} + 1.0::DOUBLE) AS x{i}, "
    f"(-0.002::DOUBLE * {x} + 0.995::DOUBLE * {y} + median_error) / (0.00001::DOUBLE * {x} + inliers / 10000000::DOUBLE * {y} + 1.0::DOUBLE) AS y{i}"
    for i, (x, y) in enumerate((("xl", "yt"), ("xr", "yt"), ("xr", "yb"), ("xl", "yb")), 1)
) + " FROM fx_crops JOIN fx_pages USING (page)) q"


def _page_boxes(t):
    rows = t.fx_marks.join(t.fx_questions.select("question_id", "zl", "zt", "zr", "zb"), "question_id")
    sx, sy = F.lit(2480) / 1334, F.lit(3507) / 1886
    return rows.withColumn("p", page_box(box(), zone_box(), sx, sy)).select(
        "question_id", "symbol_no", *(milli(c(f"p.{k}")).alias(k) for k in "ltrb")
    )


def _size_plan(t):
    plan = gates.normalise_size(c("ink_rows"), c("ink_width"), F.lit(90), F.lit(40) + c("crop_id") % 30)
    return t.fx_stats.withColumn("plan", plan).select(
        "crop_id", milli(c("plan.ink_height")).alias("ink_height"), "plan.skip",
        F.coalesce(c("plan.width"), F.lit(-1)).alias("width"),
    )


def _box_algebra(t):
    rows = t.fx_crops.join(t.fx_questions.select(c("page"), "zl", "zt", "zr", "zb", c("question_id").alias("zone_id")), "page")
    # One row per crop: the zone of the next slot of its page, so every relation occurs.
    rows = rows.filter((c("zone_id") - c("question_id")).isin(0, 1))
    return rows.select(
        "crop_id", "zone_id", overlaps(box(), zone_box()).alias("touches"),
        milli(overlap_fraction(box(), zone_box())).alias("share"), contains(zone_box(), box()).alias("inside"),
        center_inside(box(), zone_box()).alias("center_in"), area(box()).cast("bigint").alias("box_area"),
    )


def _natural_sort(t):
    """Natural order of ids inside each page; the sort key is an int array."""
    ids = t.fx_questions.select(
        "page", F.concat(F.lit("set"), c("page") % 3, F.lit("-p1-s0-q"), c("question_id")).alias("id")
    )
    key = natural_key(c("id"))
    return ids.select("id", F.array_join(key.cast("array<string>"), ".").alias("sort_key")).orderBy(key)


ENTRIES = {
    "student_choices": (
        lambda t: t.fx_crops.select("crop_id", F.coalesce(answer_string(student_choices(c("txt"))), F.lit("")).alias("answer")),
        check("SELECT crop_id, coalesce(parsed, '') AS answer FROM parsed"),
    ),
    "key_answer": (
        lambda t: t.fx_questions.select(
            "question_id", F.coalesce(F.array_join(mask_to_array(key_answer(c("answer_key"))).cast("array<string>"), ","), F.lit("")).alias("answer")
        ),
        check("SELECT question_id, coalesce(key_text, '') AS answer FROM keyed"),
    ),
    "eligible_answer": (
        lambda t: t.fx_crops.select("crop_id", answer_string(eligible_answer(c("txt"), c("score"), c("route"))).alias("answer")).filter("answer IS NOT NULL"),
        check(f"""SELECT crop_id, array_to_string(list_sort(list_distinct(string_split({digits_of('txt')}, ''))), ',') AS answer
FROM fx_crops WHERE route = 'student_candidate' AND score IS NOT NULL AND NOT (score < CAST(0.8 AS DOUBLE))
AND regexp_full_match(txt, '[\\s①②③④⑤1-5,，().]+') AND {digits_of('txt')} <> ''"""),
    ),
    "to_digit": (
        lambda t: t.fx_crops.select("crop_id", to_digit(c("txt")).alias("digit")).filter("digit IS NOT NULL"),
        check(f"SELECT crop_id, CAST(translate(trim(txt), '①②③④⑤', '12345') AS INT) AS digit FROM fx_crops WHERE regexp_full_match(trim(txt), '{D}')"),
    ),
    "required_count": (
        lambda t: t.fx_questions.select("question_id", F.coalesce(required_answer_count(c("source_text")), F.lit(0)).alias("required")),
        check("SELECT question_id, coalesce(expected_count, 0) AS required FROM counted"),
    ),
    "should_reread": (
        lambda t: t.fx_crops.select("crop_id", should_reread(c("txt"), c("score")).alias("reread")),
        check("""SELECT crop_id, trim(txt) = '0' OR (coalesce(score < CAST(0.8 AS DOUBLE), false)
AND regexp_full_match(trim(txt), '[①②③④⑤○◯□■◇△▽@©OoDⓞ◎]+')) AS reread FROM fx_crops"""),
    ),
    "classify": (
        lambda t: classify_crops(t.fx_crops).select("crop_id", "stage", "reason", F.coalesce(answer_string(c("choice")), F.lit("")).alias("choice")),
        check("SELECT crop_id, stage, reason, coalesce(choice, '') AS choice FROM classified"),
    ),
    "route": (
        _stats,
        check("""SELECT crop_id, CASE WHEN page % 31 = 0 THEN 'alignment_review'
 WHEN shaded AND largest_residual <= 12 THEN CASE WHEN print_overlap >= CAST(0.2 AS DOUBLE) THEN 'reference_print_background' ELSE 'mixed_shade_background' END
 WHEN print_overlap >= CAST(0.2 AS DOUBLE) THEN CASE WHEN largest_residual <= 12 THEN 'reference_print' ELSE 'mixed_print_review' END ELSE 'student_candidate' END AS route,
 CASE WHEN page % 31 = 0 THEN 'alignment_review'
 WHEN print_overlap >= CAST(0.2 AS DOUBLE) THEN CASE WHEN largest_residual <= 12 THEN 'reference_print' ELSE 'mixed_print_review' END ELSE 'student_candidate' END AS print_route FROM fx_stats"""),
    ),
    "gate": (
        _gate,
        check("""SELECT crop_id, excluded, NOT is_empty AND NOT excluded AS executed,
 CASE WHEN protected_choice THEN 'choice_mark_review' WHEN excluded THEN 'excluded_after_extraction' ELSE 'student_candidate' END AS final_route FROM (
SELECT *, NOT protected_choice AND (is_empty OR (gray_area >= 150 AND gray_area / total_pixels::DOUBLE >= CAST(0.12 AS DOUBLE) AND gray_median BETWEEN 150 AND 235 AND dark_pixels = 0 AND largest_area >= 150)
 OR (shaded AND gray_interior >= 150 AND ink_fraction <= CAST(0.0566 AS DOUBLE)) OR (shaded AND largest_residual <= 12) OR (print_overlap >= CAST(0.2 AS DOUBLE) AND largest_residual <= 12)) AS excluded FROM fx_stats) q"""),
    ),
    "bg_flat": (
        lambda t: t.fx_stats.select("crop_id", *(
            gates.flat_background(c("gray_median"), c("dark_pixels"), c("total_pixels"), c("largest_area"), c("gray_area"), limit).alias(name)
            for name, limit in (("strict", 0.0), ("allowed", 0.01)))),
        check("""SELECT crop_id, base AND dark_pixels = 0 AS strict, base AND dark_pixels / total_pixels::DOUBLE <= CAST(0.01 AS DOUBLE) AS allowed FROM (
SELECT *, gray_area >= 150 AND gray_area / total_pixels::DOUBLE >= CAST(0.12 AS DOUBLE) AND gray_median BETWEEN 150 AND 235 AND largest_area >= 150 AS base FROM fx_stats) q"""),
    ),
    "bg_shade": (
        lambda t: t.fx_stats.select("crop_id", gates.shaded_low_ink(c("shaded"), c("gray_interior"), c("ink_fraction")).alias("ignored")),
        check("SELECT crop_id, shaded AND gray_interior >= 150 AND ink_fraction <= CAST(0.0566 AS DOUBLE) AS ignored FROM fx_stats"),
    ),
    "mixed_print": (
        lambda t: t.fx_stats.select("crop_id", gates.mixed_print(c("protected_choice"), c("answer_excluded"), c("print_overlap"), c("largest_residual")).alias("mixed")),
        check("SELECT crop_id, NOT protected_choice AND NOT answer_excluded AND print_overlap >= CAST(0.2 AS DOUBLE) AND largest_residual > 12 AS mixed FROM fx_stats"),
    ),
    "gray_residue": (
        lambda t: t.fx_stats.select("crop_id", gates.gray_residue(c("gray_pixels"), c("ink_pixels")).alias("residue")),
        check("SELECT crop_id, gray_pixels >= 100 AND gray_pixels >= CAST(0.2 AS DOUBLE) * greatest(1, ink_pixels) AS residue FROM fx_stats"),
    ),
    "aligned": (
        lambda t: t.fx_pages.select("page", gates.aligned(c("has_matrix"), c("inliers"), c("median_error")).alias("page_ok")),
        check("SELECT page, page_ok FROM page_gate"),
    ),
    "resolution": (
        lambda t: t.fx_pages.select("page", F.coalesce(resolution_reason(c("scan_short_side")), F.lit("")).alias("message")),
        check("SELECT page, coalesce(resolution, '') AS message FROM page_gate"),
    ),
    "box_algebra": (
        _box_algebra,
        check("""SELECT crop_id, z.question_id AS zone_id, w > 0 AND h > 0 AS touches, CAST(floor(greatest(w, 0) * greatest(h, 0) / ((xr - xl) * (yb - yt))::DOUBLE * 1000) AS BIGINT) AS share,
 zl <= xl AND zt <= yt AND zr >= xr AND zb >= yb AS inside, (xl + xr) / 2.0 BETWEEN zl AND zr AND (yt + yb) / 2.0 BETWEEN zt AND zb AS center_in, CAST((xr - xl) * (yb - yt) AS BIGINT) AS box_area
FROM (SELECT c.*, z.*, least(xr, zr) - greatest(xl, zl) AS w, least(yb, zb) - greatest(yt, zt) AS h FROM fx_crops c JOIN (SELECT question_id AS zone_id, page AS zone_page, zl, zt, zr, zb FROM fx_questions) z
 ON z.zone_page = c.page AND z.zone_id - c.question_id IN (0, 1)) z""".replace("z.question_id AS zone_id", "zone_id")),
    ),
    "project_box": (_project, check(PROJECT_SQL)),
    "page_boxes": (
        _page_boxes,
        check("""SELECT question_id, symbol_no, CAST(floor((xl + ox) / sx * 1000) AS BIGINT) AS l, CAST(floor((yt + oy) / sy * 1000) AS BIGINT) AS t,
 CAST(floor((xr + ox) / sx * 1000) AS BIGINT) AS r, CAST(floor((yb + oy) / sy * 1000) AS BIGINT) AS b FROM (
SELECT m.*, round_even(zl * (2480::DOUBLE / 1334), 0) AS ox, round_even(zt * (3507::DOUBLE / 1886), 0) AS oy, 2480::DOUBLE / 1334 AS sx, 3507::DOUBLE / 1886 AS sy
FROM fx_marks m JOIN fx_questions q ON q.question_id = m.question_id) x"""),
    ),
    "size_plan": (
        _size_plan,
        check("""SELECT crop_id, CAST(floor(h * 1000) AS BIGINT) AS ink_height, skip, CASE WHEN skip THEN -1 ELSE greatest(1, CAST(round_even(ink_width * 40 / ink_rows::DOUBLE, 0) AS INT)) END AS width FROM (
SELECT *, ink_rows <= 0 OR h <= 8 AS skip FROM (SELECT *, ink_rows * (40 + crop_id % 30) / 90::DOUBLE AS h FROM fx_stats) a) b"""),
    ),
    "messages": (
        lambda t: classify_crops(t.fx_crops).select("crop_id", reason_message(F.when(c("crop_id") % 97 == 0, F.lit("X-1")).otherwise(c("reason"))).alias("message")),
        check("""SELECT crop_id, coalesce(m.text, q.code) AS message FROM (SELECT crop_id, CASE WHEN crop_id % 97 = 0 THEN 'X-1' ELSE reason END AS code FROM classified) q
LEFT JOIN reason_text m ON m.code = q.code"""),
    ),
    "natural_sort": (
        _natural_sort,
        check("SELECT 'set' || page % 3 || '-p1-s0-q' || question_id AS id, page % 3 || '.1.0.' || question_id AS sort_key FROM fx_questions"),
    ),
    "answer_string": (
        lambda t: classify_crops(t.fx_crops).filter("stage = 0").groupBy("question_id").agg(F.min("choice").alias("low"), F.max("choice").alias("high")).select(
            "question_id", F.coalesce(answer_string(F.when(c("low") == c("high"), c("low"))), F.lit("null")).alias("answer")),
        check("SELECT question_id, CASE WHEN count(DISTINCT choice) = 1 THEN min(choice) ELSE 'null' END AS answer FROM classified WHERE stage = 0 GROUP BY question_id"),
    ),
}
