"""Counts and reports over finished tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.answers import single_mask
from sheetwise.functions.gates import finite


def _evaluated(reviews: DataFrame, recommended: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reviews with ``given`` (has a recommendation), ``usable`` (its label is confirmed) and ``same``."""
    rows = reviews.join(recommended, ["policy", *keys], "left").join(
        labels.select(*keys, "expected", "confirmed_by_user", "needs_review"), list(keys), "left"
    )
    usable = F.coalesce(F.col("confirmed_by_user") & ~F.col("needs_review") & F.col("expected").isNotNull(), F.lit(False))
    same = single_mask(F.col("number")) == F.col("expected")
    return rows.withColumns({"given": F.col("number").isNotNull(), "usable": usable, "same": same})


def recommendation_audit(
    reviews: DataFrame, recommended: DataFrame, labels: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """Per policy: automatic, held, recommended, matched, wrong and unverified;
    recommendations are shown from 90 % matched on. Labels only evaluate."""
    rows = _evaluated(reviews, recommended, labels, [*scope, "question_id"])
    given, usable, same = F.col("given"), F.col("usable"), F.col("same")
    return rows.groupBy("policy").agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(F.col("status") != "보류").alias("automatic"),
        F.count_if(F.col("status") == "보류").alias("held"),
        F.count("number").alias("recommended"),
        F.count_if(given & usable & same).alias("matched"),
        F.count_if(given & usable & ~same).alias("wrong"),
        F.count_if(given & ~usable).alias("unverified"),
    ).withColumn("show", (F.col("recommended") > 0) & (F.col("matched") >= 0.9 * F.col("recommended")))


def recommendation_views(
    reviews: DataFrame, recommended: DataFrame, labels: DataFrame, decided: DataFrame, shown: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """Per policy and question, which filters of the recommendation report keep it:
    held, recommended, wrong (against a confirmed label), agreement (newly confirmed by
    two kinds of evidence). ``decided`` has the decision on held questions, ``shown`` a
    ``show`` per policy: policies not to be shown keep no recommendation. A question
    that was confirmed is no longer held and loses its recommendation."""
    keys = [*scope, "question_id"]
    confirmed = decided.filter(F.col("decision") == "confirmed").select("policy", *keys, F.col("mark").isNotNull().alias("agreement"))
    rows = _evaluated(reviews, recommended, labels, keys).join(confirmed, ["policy", *keys], "left").join(shown.select("policy", "show"), "policy", "left")
    held = (F.col("status") == "보류") & F.col("agreement").isNull()
    listed = F.col("given") & held & F.coalesce("show", F.lit(False))
    return rows.select(
        "policy", *keys, held.alias("held"), listed.alias("recommended"),
        F.coalesce(listed & F.col("usable") & ~F.col("same"), F.lit(False)).alias("wrong"), F.coalesce("agreement", F.lit(False)).alias("agreement"),
    )


def timing_summary(gated: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Regions, executed, skipped and excluded crops of a recognition run."""
    return gated.groupBy(*group).agg(
        F.count(F.lit(1)).alias("regions"), F.count_if("executed").alias("ocr_executed"),
        F.count_if(~F.col("executed")).alias("stage1_skipped"), F.count_if("excluded").alias("answer_excluded"),
    )


def _numbered_lines(df: DataFrame, key: Sequence[str], text: str, side: str) -> DataFrame:
    """Nonblank stripped lines with their place."""
    from sheetwise.functions.answers import blank, strip

    lines = F.filter(F.split(text, "\n"), lambda line: ~blank(line))
    return df.select(*key, F.posexplode(F.transform(lines, strip)).alias("place", side))


def line_match(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected and recognised lines by position: (key, place, expected, actual,
    exact). ``pairs`` carries the two whole texts."""
    key = list(key)
    expected = _numbered_lines(pairs, key, "expected_text", "expected")
    actual = _numbered_lines(pairs, key, "actual_text", "actual")
    return expected.join(actual, [*key, "place"], "full").withColumn(
        "exact", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))
    )


def line_match_summary(matched: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected, recognised, exact and extra lines per text."""
    return matched.groupBy(*key).agg(
        F.count("expected").alias("expected_lines"), F.count("actual").alias("recognised_lines"),
        F.count_if("exact").alias("exact_lines"), F.count_if(F.col("expected").isNull()).alias("extra_lines"),
    )


def best_reading(readings: DataFrame, key: Sequence[str]) -> DataFrame:
    """Highest finite score per key, the earliest reading on ties; by aggregation. A
    score that is null, NaN or infinite ranks below every number and is returned as null."""
    score = F.when(finite(F.col("score")), F.col("score"))
    return readings.groupBy(*key).agg(
        F.max(F.struct(score.alias("score"), (-F.col("read_no")).alias("order"), "txt")).alias("best")
    ).select(*key, F.col("best.txt").alias("txt"), F.col("best.score").alias("score"), (-F.col("best.order")).alias("read_no"))
