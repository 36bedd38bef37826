"""Confirmation policies side by side, and counts over reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from sheetwise.functions.messages import reason_message
from sheetwise.operators.review import BIT, BLOCK6, BLOCK7, RULES, reasons_long


def policy_summary(reviews: DataFrame) -> DataFrame:
    """Per policy: questions, automatic, held, right, wrong, stated counts and
    count mismatches."""
    return reviews.groupBy("policy").agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(F.col("selection").isNotNull()).alias("automatic"),
        F.count_if(F.col("selection").isNull()).alias("held"),
        F.count_if(F.col("status") == "정답").alias("right_answers"),
        F.count_if(F.col("status") == "오답").alias("wrong_answers"),
        F.count_if(F.col("expected_count").isNotNull()).alias("explicit_count"),
        F.count_if(F.col("fired").bitwiseAND(BIT["F12", "14"]) != 0).alias("count_mismatch"),
    )


def diff_policies(
    reviews: DataFrame, blockers: DataFrame, a: str, b: str, scope: Sequence[str] = ()
) -> DataFrame:
    """Questions whose selection or reasons differ between two policies. A reason
    also differs when it names other crops."""
    keys = [*scope, "question_id"]

    def side(policy: str):
        return F.max(F.when(F.col("policy") == policy, F.struct("selection", "fired", "status"))).alias(f"side_{policy}")

    def exempt(policy: str):
        return F.lit(False) if policy == "none" else F.col(f"exempt_{policy}")

    def live_only(here: str, there: str):
        bit = F.when(F.col("reason") == "6", BLOCK6).otherwise(BLOCK7)
        return F.bit_or(F.when(~exempt(here) & exempt(there), bit).otherwise(0))

    # Both sides of a question meet in one aggregation of the reviews. A crop let
    # pass by just one policy is named in a reason of the other.
    both = reviews.filter(F.col("policy").isin(a, b)).groupBy(*keys).agg(side(a), side(b))
    named = blockers.groupBy(*keys).agg(live_only(a, b).alias("named_a"), live_only(b, a).alias("named_b"))
    one, two = F.col(f"side_{a}"), F.col(f"side_{b}")
    selection_differs = ~one["selection"].eqNullSafe(two["selection"])
    other_crops = (
        one["fired"].bitwiseAND(F.coalesce("named_a", F.lit(0)))
        .bitwiseOR(two["fired"].bitwiseAND(F.coalesce("named_b", F.lit(0))))
    ) != 0
    return both.join(named, keys, "left").filter(
        selection_differs | (one["fired"] != two["fired"]) | other_crops
    ).select(
        *keys, one["selection"].alias("selection_a"), two["selection"].alias("selection_b"),
        one["status"].alias("status_a"), two["status"].alias("status_b"),
        selection_differs.alias("selection_differs"),
    )


def top_hold_reasons(reviews: DataFrame, n: int = 5, scope: Sequence[str] = ()) -> DataFrame:
    """The n most frequent reason codes per policy (and scope); a question counts once per code."""
    masks: dict[str, int] = {}
    for i, (_, code, _) in enumerate(RULES):
        masks[code] = masks.get(code, 0) | 1 << i
    keys = [*scope, "policy"]
    counted = reviews.groupBy(*keys).agg(
        *(F.count_if(F.col("fired").bitwiseAND(mask) != 0).alias(code) for code, mask in masks.items())
    )
    counts = counted.unpivot(keys, list(masks), "code", "questions").filter("questions > 0")
    order = Window.partitionBy(*keys).orderBy(F.desc("questions"), "code")
    return (
        counts.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= n)
        .withColumn("message", reason_message(F.col("code")))
    )


def status_by_page(reviews: DataFrame, baseline: str = "none", scope: Sequence[str] = ()) -> DataFrame:
    """Status counts per page and in total (page null), beside the baseline policy;
    with a scope, pages and totals of each of its values."""
    wide = (
        reviews.groupBy(*scope, "page", "policy")
        .pivot("status", ["정답", "오답", "보류"])
        .agg(F.count(F.lit(1)))
        .select(
            *scope, "page", "policy", F.coalesce("정답", F.lit(0)).alias("right_answers"),
            F.coalesce("오답", F.lit(0)).alias("wrong_answers"), F.coalesce("보류", F.lit(0)).alias("held"),
        )
    )
    sums = [F.sum(c).alias(c) for c in ("right_answers", "wrong_answers", "held")]
    # Pages are already counted, so the total rolls up counts, not questions.
    rolled = wide.rollup(*scope, "policy", "page").agg(*sums).filter("policy IS NOT NULL")
    keys = [*scope, "page"]
    base = rolled.filter(F.col("policy") == baseline).select(
        *(F.col(k).alias(f"base_{k}") for k in keys), F.col("right_answers").alias("base_right"), F.col("held").alias("base_held")
    )
    same = [F.col(k).eqNullSafe(F.col(f"base_{k}")) for k in keys]
    return rolled.join(base, same).drop(*(f"base_{k}" for k in keys))


def run_summary(reviews: DataFrame, recommended: DataFrame, seconds: float, scope: Sequence[str] = ()) -> DataFrame:
    """Per policy (and scope): automatic, held, recommended, seconds per page."""
    keys = [*scope, "policy"]
    marked = recommended.groupBy(*keys).agg(F.count(F.lit(1)).alias("recommendations"))
    counts = reviews.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(F.col("status") != "보류").alias("automatic"),
        F.count_if(F.col("status") == "보류").alias("held"),
        F.count_distinct("page").alias("pages"),
    )
    return counts.join(marked, keys, "left").select(
        *keys, "questions", "automatic", "held", "pages",
        F.coalesce("recommendations", F.lit(0)).alias("recommendations"),
        (F.lit(seconds) / F.col("pages")).alias("seconds_per_page"),
    )


def write_reviews(reviews: DataFrame, path: str) -> dict[str, int]:
    """Store reviews as Parquet and return their totals, which the writing action
    itself counts, so they cost no second scan: questions, right, wrong, held, reasons.

    Every question is right, wrong or held, and a held one has a reason; a table that
    breaks this is refused with an error that names the totals, after it was written.
    """
    status = lambda name: F.count_if(F.col("status") == name)
    reasoned = F.coalesce(F.col("fired"), F.lit(0)) != 0
    seen = Observation("reviews")
    reviews.observe(
        seen, F.count(F.lit(1)).alias("questions"), status("정답").alias("right"), status("오답").alias("wrong"), status("보류").alias("held"),
        F.count_if(reasoned).alias("with_reason"), F.count_if((F.col("status") == "보류") & ~reasoned).alias("held_without_reason"),
    ).write.parquet(path)
    totals = dict(seen.get)
    if totals["right"] + totals["wrong"] + totals["held"] != totals["questions"] or totals["held_without_reason"]:
        raise ValueError(f"Reviews in {path} do not add up: {totals}")
    return totals


def held_messages(reviews: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent reason texts per policy, shown only where nothing was confirmed."""
    automatic = reviews.groupBy("policy").agg(F.count_if(F.col("status") != "보류").alias("automatic"))
    counts = reasons_long(reviews).groupBy("policy", "message").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("policy").orderBy(F.desc("n"), "message")
    return (
        counts.join(automatic.filter("automatic = 0"), "policy", "left_semi")
        .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    )


def no_read_gallery(reviews: DataFrame, crops_of_reasons: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Crops without any reading, of held questions, per policy."""
    keys = [*scope, "question_id"]
    held = reviews.filter(F.col("status") == "보류").select("policy", *keys, "page")
    return crops_of_reasons.filter(F.col("code") == "5").select("policy", *keys, "crop_id").distinct().join(
        held, ["policy", *keys]
    )


def view_filter(reviews: DataFrame, baseline: DataFrame, view: str, scope: Sequence[str] = ()) -> DataFrame:
    """Reviews one screen filter keeps: held, all, changed or count."""
    if view == "all":
        return reviews
    if view == "held":
        return reviews.filter(F.col("status") == "보류")
    if view == "count":
        return reviews.filter(F.col("expected_count").isNotNull())
    if view == "changed":
        keys = [*scope, "question_id"]
        before = baseline.select(*keys, F.col("selection").alias("s0"), F.col("fired").alias("r0"))
        same = F.col("selection").eqNullSafe(F.col("s0")) & F.col("fired").eqNullSafe(F.col("r0"))
        return reviews.join(before, keys).filter(~same).drop("s0", "r0")
    raise ValueError(f"unknown view {view}")


def differences(
    computed: DataFrame, frozen: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Rows that a recomputed review and a stored one do not share, null-safe;
    no row means the stored result reproduces."""
    left = computed.select(*keys, F.struct(*values).alias("now"))
    right = frozen.select(*keys, F.struct(*values).alias("stored"))
    joined = left.join(right, list(keys), "full")
    return joined.filter(~F.col("now").eqNullSafe(F.col("stored"))).select(
        *keys,
        F.when(F.col("stored").isNull(), F.lit("added"))
        .when(F.col("now").isNull(), F.lit("missing"))
        .otherwise(F.lit("changed")).alias("change"),
    )
