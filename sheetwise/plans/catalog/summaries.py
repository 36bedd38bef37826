"""Counts over recognition runs and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import rereads as rr
from sheetwise.operators import summaries as sm
from sheetwise.plans.catalog.rules import _gate
from sheetwise.plans.checks import check

c = F.col
LINES = "list_filter(list_transform(string_split({0}, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '')"


def _pairs(t):
    return t.documents.select(
        "doc_id", c("text").alias("expected_text"),
        F.concat(F.replace("text", F.lit("the "), F.lit("teh ")), F.when(c("doc_id") % 5 == 0, F.lit("\n extra line \n")).otherwise(F.lit(""))).alias("actual_text"),
    )


ENTRIES = {
    "timing": (
        lambda t: sm.timing_summary(_gate(t).withColumn("part", c("crop_id") % 10), ["part"]),
        check("""SELECT crop_id % 10 AS part, count(*) AS regions, count(*) FILTER (WHERE NOT is_empty AND NOT excluded) AS ocr_executed, count(*) FILTER (WHERE is_empty OR excluded) AS stage1_skipped, count(*) FILTER (WHERE excluded) AS answer_excluded FROM (
SELECT *, NOT protected_choice AND (is_empty OR (gray_area >= 150 AND gray_area / total_pixels::DOUBLE >= CAST(0.12 AS DOUBLE) AND gray_median BETWEEN 150 AND 235 AND dark_pixels = 0 AND largest_area >= 150)
 OR (shaded AND gray_interior >= 150 AND ink_fraction <= CAST(0.0566 AS DOUBLE)) OR (shaded AND largest_residual <= 12) OR (print_overlap >= CAST(0.2 AS DOUBLE) AND largest_residual <= 12)) AS excluded FROM fx_stats) q GROUP BY 1"""),
    ),
    "line_match": (
        lambda t: sm.line_match_summary(sm.line_match(_pairs(t), ["doc_id"]), ["doc_id"]),
        f"""WITH l AS (SELECT doc_id, {LINES.format('text')} AS e, {LINES.format("(replace(text, 'the ', 'teh ') || CASE WHEN doc_id % 5 = 0 THEN chr(10) || ' extra line ' || chr(10) ELSE '' END)")} AS a FROM documents)
SELECT doc_id, len(e) AS expected_lines, len(a) AS recognised_lines, CAST(len(list_filter(range(1, least(len(e), len(a)) + 1), lambda i: e[i] = a[i])) AS BIGINT) AS exact_lines, greatest(len(a) - len(e), 0) AS extra_lines FROM l WHERE len(e) > 0 OR len(a) > 0""",
    ),
    "best_reading": (
        lambda t: sm.best_reading(rr.all_readings(t.fx_crops, t.fx_readings), ["crop_id"]),
        check("""SELECT crop_id, txt, score, read_no FROM (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY score DESC NULLS LAST, read_no) AS rn FROM (
SELECT crop_id, 0 AS read_no, txt, CASE WHEN NOT isnan(score) THEN score END AS score FROM fx_crops UNION ALL SELECT crop_id, stage_no * 10 + variant_no, txt, score FROM fx_readings) u) q WHERE rn = 1"""),
    ),
}
