"""Alignment settings as rows, and summaries of their runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.operators.ordered import exact_median

# Setting ranges and the baseline, run first.
FEATURES, RATIO_TENTHS, RANSAC = (5000, 6000, 7000), (6, 7, 8), (2, 3, 4)
EXTRA_RANSAC = 5
BASELINE = (6000, 7, 3)


def grid_settings(targets: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """Every setting for every target row, baseline first, the rest in an order the
    seed fixes. The list of settings is part of the plan, not a second table."""
    combos = [(f, r, e) for f in FEATURES for r in RATIO_TENTHS for e in RANSAC]
    rows = F.array(*(
        F.struct(F.lit(f).alias("features"), F.lit(r).alias("ratio_tenths"), F.lit(e).alias("ransac")) for f, r, e in combos
    ))
    is_base = lambda s: (s.features == BASELINE[0]) & (s.ratio_tenths == BASELINE[1]) & (s.ransac == BASELINE[2])
    keyed = F.transform(rows, lambda s: F.struct(
        (~is_base(s)).alias("later"),
        F.md5(F.concat_ws("-", F.lit(str(seed)), *(s[n].cast("string") for n in ("features", "ratio_tenths", "ransac")))).alias("rank"),
        s.alias("setting"),
    ))
    return targets.select(*keys, F.posexplode(F.array_sort(keyed)).alias("place", "row")).select(
        *keys, "place", "row.setting.features", "row.setting.ratio_tenths", "row.setting.ransac"
    )


def extra_settings(targets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The nine additional settings with the wider error limit, per target row."""
    rows = F.array(*(
        F.struct(F.lit(f).alias("features"), F.lit(r).alias("ratio_tenths"), F.lit(EXTRA_RANSAC).alias("ransac"))
        for f in FEATURES for r in RATIO_TENTHS
    ))
    return targets.select(*columns, F.inline(rows))


def grid_summary(crops: DataFrame, runs: DataFrame, setting: Sequence[str]) -> DataFrame:
    """Per completed setting: crops, recognised crops, median score over recognised
    and not excluded ones, seconds."""
    setting = list(setting)
    counts = crops.groupBy(*setting).agg(
        F.count(F.lit(1)).alias("crops"), F.count_if("ocr_executed").alias("ocr_calls")
    )
    scored = crops.filter("ocr_executed AND NOT answer_excluded AND score IS NOT NULL AND NOT isnan(score)")
    seconds = runs.groupBy(*setting).agg(F.sum("seconds").alias("seconds"), F.count_if("failed").alias("failed"))
    return counts.join(exact_median(scored, setting, "score"), setting, "left").join(seconds, setting)


def grading_groups(outcomes: DataFrame, setting: Sequence[str]) -> DataFrame:
    """Settings whose whole list of (question, outcome) is the same share a group,
    named by a digest of the list. Four 60-bit lanes of the row digests are summed,
    which needs no ordering and no collected list."""
    setting = list(setting)
    digest = F.sha2(F.concat_ws("\u0001", F.col("question_id").cast("string"), "outcome"), 256)
    lanes = [
        F.sum(F.conv(F.substr(digest, F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("decimal(38,0)")).alias(f"lane{i}") for i in range(4)
    ]
    prints = outcomes.groupBy(*setting).agg(F.count(F.lit(1)).alias("n"), *lanes)
    key = F.sha2(F.concat_ws("-", "n", *(f"lane{i}" for i in range(4))), 256)
    prints = prints.select(*setting, key.alias("digest"))
    sizes = prints.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(*setting)).alias("first"))
    return prints.join(sizes, "digest").drop("digest")
