"""Comparison with confirmed labels. Labels enter only here, after grading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.geometry import Box, center_inside
from sheetwise.operators.review import reason_array
from sheetwise.operators.spatial import with_cells

MATCH, MISMATCH, UNLABELLED, HELD = "전사 일치", "전사 불일치", "미확정 답 자동 확정 오류", "보류"


def compare_label(reviews: DataFrame, labels: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Reviews beside ``labels(question, expected)``; expected is a mask or null."""
    joined = reviews.join(labels.select(*scope, "question_id", "expected"), [*scope, "question_id"])
    chosen, expected, key = F.col("selection"), F.col("expected"), F.col("key")
    known = chosen.isNotNull() & expected.isNotNull() & key.isNotNull()
    status = (
        F.when(chosen.isNull(), F.lit(HELD))
        .when(expected.isNull(), F.lit(UNLABELLED))
        .when(chosen == expected, F.lit(MATCH))
        .otherwise(F.lit(MISMATCH))
    )
    return (
        joined.withColumn("comparison", status)
        .withColumn("false_correct", F.coalesce(known & (expected != key) & (chosen == key), F.lit(False)))
        .withColumn("false_incorrect", F.coalesce(known & (expected == key) & (chosen != key), F.lit(False)))
    )


def verdict_matrix(compared: DataFrame) -> DataFrame:
    """True right/wrong against confirmed right/wrong/held, per policy. The gate
    fails as soon as one wrong answer is confirmed right."""
    truth = F.when(F.col("expected") == F.col("key"), F.lit("right")).otherwise(F.lit("wrong"))
    return (
        compared.filter(F.col("expected").isNotNull() & F.col("key").isNotNull())
        .groupBy("policy", truth.alias("truth"))
        .agg(
            F.count_if(F.col("status") == "정답").alias("confirmed_right"),
            F.count_if(F.col("status") == "오답").alias("confirmed_wrong"),
            F.count_if(F.col("status") == "보류").alias("held"),
        )
        .withColumn("gate_ok", (F.col("truth") == "right") | (F.col("confirmed_right") == 0))
    )


def crops_in_rois(crops: DataFrame, rois: DataFrame, scope: Sequence[str] = (), size: int = 256) -> DataFrame:
    """(roi question, crop) pairs whose crop centre lies in the region. A centre
    has one cell, a region lists every cell it reaches, so a pair meets once."""
    on = [*scope, "page", "cell_x", "cell_y"]
    centred = crops.withColumn("cell_x", F.floor((F.col("xl") + F.col("xr")) / 2 / size)).withColumn(
        "cell_y", F.floor((F.col("yt") + F.col("yb")) / 2 / size)
    )
    region = Box(F.col("roi_l"), F.col("roi_t"), F.col("roi_r"), F.col("roi_b"))
    # The closed right and bottom edges may open one more cell.
    reach = Box(region.l, region.t, region.r + 1, region.b + 1)
    here = Box(F.col("xl"), F.col("yt"), F.col("xr"), F.col("yb"))
    regions = with_cells(
        rois.select(*scope, "page", F.col("question_id").alias("roi_question"), "roi_l", "roi_t", "roi_r", "roi_b"),
        size, reach,
    )
    return centred.join(regions, on).filter(center_inside(here, region)).drop("cell_x", "cell_y")


def roi_review(near: DataFrame, labels: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Union of the digits read at the labelled place, against the label.

    ``near`` has (roi_question, digits): a mask of strictly numeric readings."""
    keys = [*scope, "question_id"]
    union = near.groupBy(*scope, F.col("roi_question").alias("question_id")).agg(
        F.bit_or("digits").alias("numbers"), F.count(F.lit(1)).alias("n_crops")
    )
    numbers = F.coalesce("numbers", F.lit(0))
    return labels.join(union, keys, "left").select(
        *keys, numbers.alias("numbers"), F.coalesce("n_crops", F.lit(0)).alias("n_crops"),
        F.when(F.col("expected").isNull(), F.lit("special"))
        .when(numbers == 0, F.lit("no_numeric_read"))
        .when(numbers == F.col("expected"), F.lit("match"))
        .otherwise(F.lit("mismatch")).alias("status"),
    )


def roi_buckets(
    near: DataFrame, previous: DataFrame, labels: DataFrame, conflicts: DataFrame, has_rois: bool = True,
    scope: Sequence[str] = (),
) -> DataFrame:
    """One of nine diagnostic buckets per labelled question, first hit wins.

    ``near(roi_question, question_id, stage)`` are classified crops at the answer
    place, ``previous(question_id, old_status)`` the earlier comparison,
    ``labels(question_id, answer_status)``, ``conflicts(question_id)``.
    """
    keys = [*scope, "question_id"]
    at_place = near.groupBy(*scope, F.col("roi_question").alias("_q")).agg(
        F.count(F.lit(1)).alias("n_near"),
        F.count_if(F.col("stage") == 0).alias("n_passed"),
        F.count_if(F.col("question_id") != F.col("roi_question")).alias("n_cross"),
        F.min(F.when(F.col("stage") > 0, F.col("stage"))).alias("low_stage"),
        F.max(F.when(F.col("stage") > 0, F.col("stage"))).alias("high_stage"),
    ).withColumnRenamed("_q", "question_id")
    rows = (
        labels.join(previous, keys, "left")
        .join(conflicts.select(*keys).distinct().withColumn("conflict", F.lit(True)), keys, "left")
        .join(at_place, keys, "left")
    )
    special = F.col("answer_status").isin("conflicting_markings", "do_not_know", "partial_with_question_mark")
    bucket = (
        F.when(F.lit(not has_rois), F.lit("수동 답 위치 자료 없음 · 배정된 조각으로 분류"))
        .when(special, F.lit("사용자 확인 특수 표시"))
        .when(F.col("conflict"), F.lit("4단계 · 사유10 답 후보 충돌"))
        .when(F.col("old_status") == "일치", F.lit("기존 채택 · 전사 일치"))
        .when(F.col("old_status") == "불일치", F.lit("기존 채택 · 전사 불일치"))
        .when(F.coalesce("n_near", F.lit(0)) == 0, F.lit("답 위치의 조각 없음 · 추출 확인"))
        .when(F.col("n_passed") > 0, F.lit("답 위치 후보 있음 · 소속/통합 확인"))
        .when(
            F.col("low_stage") == F.col("high_stage"),
            F.format_string("%d단계에서 답 위치 조각 전부 중단", "low_stage"),
        )
        .otherwise(F.lit("답 위치 조각이 여러 단계에서 중단"))
    )
    return rows.select(*keys, bucket.alias("bucket"), F.coalesce("n_cross", F.lit(0)).alias("n_cross"))


def stage_summary(
    classified: DataFrame, compared: DataFrame, policy: str, buckets: DataFrame | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """Counts (scope, kind, name, n) over crops and questions, in one pass over each.

    ``classified`` needs ``mixed_print``; ``compared`` comes from compare_label and
    ``buckets``, whose cases are counted too, from roi_buckets.
    """
    keys = [*scope, "question_id"]
    count = F.count(F.lit(1)).alias("n")

    def tag_array(*pairs):
        return F.array_compact(F.array(*(
            F.when(cond, F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name")))
            for kind, name, cond in pairs
        )))

    def tagged(*pairs):
        return F.explode(tag_array(*pairs)).alias("tag")

    yes = F.lit(True)
    crops = classified.select(*scope, tagged(
        ("region", F.col("reason"), yes),
        ("region_stage", F.col("stage"), yes),
        ("total", F.lit("recognised_on_stage1"), (F.col("stage") == 1) & F.col("ocr_executed")),
    ))
    mixed = classified.filter((F.col("stage") == 0) & F.col("mixed_print")).select(*keys).distinct()
    rows = compared.filter(F.col("policy") == policy).join(
        mixed.withColumn("mixed", F.lit(True)), keys, "left"
    ).na.fill(False, ["mixed"])
    wrong = F.col("comparison").isin(MISMATCH, UNLABELLED)
    own = tag_array(
        ("review", F.col("status"), yes),
        ("review_stage", F.coalesce(F.col("stage").cast("string"), F.lit("None")), yes),
        ("comparison", F.col("comparison"), yes),
        ("total", F.lit("false_correct"), F.col("false_correct")),
        ("total", F.lit("false_incorrect"), F.col("false_incorrect")),
        ("total", F.lit("mixed_candidate_questions"), F.col("mixed")),
        ("total", F.lit("mixed_candidate_errors"), F.col("mixed") & wrong),
    )
    reasons = reason_array()
    named = [
        F.array_distinct(F.transform(reasons, lambda r: F.struct(F.lit(kind).alias("kind"), r[kind_field].alias("name"))))
        for kind, kind_field in (("reason", "code"), ("rule", "rule"))
    ]
    counted = crops.unionByName(rows.select(*scope, F.explode(F.concat(own, *named)).alias("tag")))
    if buckets is not None:
        counted = counted.unionByName(buckets.select(*scope, tagged(
            ("bucket", F.col("bucket"), yes), ("total", F.lit("crossed_question_cases"), F.col("n_cross") > 0),
        )))
    return counted.groupBy(*scope, "tag.kind", "tag.name").agg(count)
