"""Small tables for golden cases."""

from __future__ import annotations

CROP = (
    "crop_id bigint, question_id bigint, page int, txt string, score double, route string, is_empty boolean, answer_excluded boolean, "
    "ocr_executed boolean, semantic_annotation string, ownership_review boolean, retry_ownership_review boolean, reread_conflict boolean, "
    "has_ring boolean, ring_only_answer boolean, xl int, yt int, xr int, yb int"
)
BASE = dict(
    question_id=1, page=1, txt="3", score=0.98, route="student_candidate", is_empty=False, answer_excluded=False, ocr_executed=True,
    semantic_annotation=None, ownership_review=False, retry_ownership_review=False, reread_conflict=False, has_ring=False,
    ring_only_answer=False, xl=0, yt=0, xr=10, yb=10,
)


def crops(spark, *rows):
    names = [part.split()[0] for part in CROP.split(", ")]
    filled = [{**BASE, "crop_id": i, **row} for i, row in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(row[n] for n in names) for row in filled], CROP)


def question(spark, key, text="다음 중 옳은 것은?"):
    return spark.createDataFrame([(1, 1, key, text)], "question_id bigint, page int, answer_key string, source_text string")


def page(spark, inliers=50, error=1.0, short=2480, matrix=True):
    return spark.createDataFrame([(1, matrix, inliers, error, short)], "page int, has_matrix boolean, inliers int, median_error double, scan_short_side int")
