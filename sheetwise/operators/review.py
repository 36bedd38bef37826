"""Question review: from classified crops to a confirmed or held answer.

Everything a question needs from its crops fits in a few integers (the lowest
and highest candidate mask and one bit per fact), so the review is a single
aggregation with map-side combine whatever the number of crops. The reason
list is bounded by the rules and is built afterwards, on question rows. Crop
ids stay in a long table (`reason_crops`) and are never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.answers import key_answer, mask_size, required_answer_count, student_choices
from sheetwise.functions.gates import aligned, classify
from sheetwise.functions.messages import key_count_message, reason_message, resolution_reason
from sheetwise.operators.spatial import BOX, overlap_counts

POLICIES = ("duplicate", "broad")

# The hold rules in reason order as (stage, code, rule). A review
# carries the rules that fired as one bit mask, bit seq-1 for the seq-th rule.
RULES = [
    (1, "2", "D12"),
    (3, "15", "page_ownership"),
    (3, "11", "F10"),
    (4, "10", "F06"),
    (4, "10", "F06(re-read)"),
    (4, "14", "F12"),
    (3, "6", "F08(b)"),
    (3, "7", "F08(b)"),
    (1, "2", "no_candidate"),
    (1, "9", "no_candidate"),
    (2, "5", "no_candidate"),
    (2, "6", "no_candidate"),
    (2, "not_executed", "no_candidate"),
    (2, "score_missing", "no_candidate"),
    (3, "11", "no_candidate"),
    (3, "15", "no_candidate"),
    (3, "7", "no_candidate"),
    (3, "8", "no_candidate"),
    (3, "route_unknown", "no_candidate"),
    (1, "2", "no_crop"),
    (None, "12", "G03"),
    (4, "16", "F12(key-count)"),
    (1, "17", "scan_resolution"),
]
BIT = {(rule, code): 1 << i for i, (_, code, rule) in enumerate(RULES)}
NO_CANDIDATE = sum(bit for (rule, _), bit in BIT.items() if rule == "no_candidate")
BLOCK6, BLOCK7 = BIT["F08(b)", "6"], BIT["F08(b)", "7"]
OWNERSHIP = BIT["page_ownership", "15"]
FROM_CROPS = OWNERSHIP | BIT["F10", "11"] | BIT["F06(re-read)", "10"]


def classify_crops(crops: DataFrame) -> DataFrame:
    """Crops with ``choice`` (mask, only where stage is 0), ``stage`` and ``reason``."""
    gate = classify(
        empty=F.col("is_empty"), excluded=F.col("answer_excluded"),
        executed=F.col("ocr_executed"), text=F.col("txt"), score=F.col("score"),
        annotation=F.col("semantic_annotation"), route=F.col("route"),
        choice=F.col("parsed"), ownership=F.col("ownership_review"),
    )
    parsed = crops.withColumn("parsed", student_choices(F.col("txt")))
    gated = parsed.withColumn("gate", gate)
    return (
        gated.withColumn("stage", F.col("gate.stage"))
        .withColumn("reason", F.col("gate.reason"))
        .withColumn("choice", F.when(F.col("stage") == 0, F.col("parsed")))
        .drop("gate")
    )


def f08_blockers(
    classified: DataFrame, duplicates: DataFrame | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """Crops of reason 6 or 7 that overlap a candidate of their question.

    ``duplicates(crop_id, candidate_id)`` lists the candidates a ring repeats.
    ``exempt_broad``: the crop is a ring. ``exempt_duplicate``: also every
    overlapping candidate is one the ring repeats.
    """
    keys = [*scope, "question_id"]
    candidates = classified.filter("stage = 0")
    held = classified.filter(F.col("reason").isin("6", "7")).select(
        *keys, "crop_id", "reason", "has_ring", "ring_only_answer", *BOX
    )
    touched = overlap_counts(held, candidates, keys)
    if duplicates is None:
        repeated = F.lit(0)
    else:
        # Rings are taken as they are: only overlapping candidates are counted, so the overlaps need not be found twice.
        rings = held.filter("has_ring").select(
            *keys, "crop_id", *(F.col(c).alias("r_" + c) for c in BOX)
        )
        listed = (
            rings.join(duplicates, [*scope, "crop_id"])
            .join(
                candidates.select(*keys, F.col("crop_id").alias("candidate_id"), *BOX),
                [*keys, "candidate_id"],
            )
            .filter("greatest(xl, r_xl) < least(xr, r_xr) AND greatest(yt, r_yt) < least(yb, r_yb)")
            .groupBy(*keys, "crop_id")
            .agg(F.count_distinct("candidate_id").alias("n_repeated"))
        )
        touched = touched.join(listed, [*keys, "crop_id"], "left")
        repeated = F.coalesce("n_repeated", F.lit(0))
    return touched.select(
        *keys, "crop_id", "reason", "n_overlaps", "ring_only_answer", *BOX,
        F.col("has_ring").alias("exempt_broad"),
        (F.col("has_ring") & (repeated == F.col("n_overlaps"))).alias("exempt_duplicate"),
    )


def exemptions(blockers: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(policy, question, crop) rows each policy lets pass."""
    listed = F.array_compact(
        F.array(*(F.when(F.col(f"exempt_{p}"), F.lit(p)) for p in POLICIES))
    )
    return blockers.select(
        F.explode(listed).alias("policy"), *scope, "question_id", "crop_id"
    )


def question_facts(
    classified: DataFrame,
    blockers: DataFrame,
    policies: Sequence[str],
    scope: Sequence[str] = (),
) -> DataFrame:
    """One row per question with crops: row count, lowest and highest candidate
    mask, rule bits its crops can raise, and per policy the F08(b) bits
    (``block_<policy>``) that remain ("none" exempts nothing)."""
    keys = [*scope, "question_id"]
    bits = (
        F.when(F.col("ownership_review") & (F.col("stage") != 1), OWNERSHIP).otherwise(0)
        .bitwiseOR(F.when(F.col("semantic_annotation").isNotNull(), BIT["F10", "11"]).otherwise(0))
        .bitwiseOR(F.when(F.col("reread_conflict"), BIT["F06(re-read)", "10"]).otherwise(0))
    )
    held = F.lit(0)
    for (rule, code), bit in BIT.items():
        if rule == "no_candidate":
            held = F.when(F.col("reason") == code, bit).otherwise(held)
    zero = F.lit(0)
    from_crops = classified.select(
        *keys, F.lit(1).alias("n"), "choice", bits.bitwiseOR(held).alias("bits"),
        *(zero.alias(f"block_{p}") for p in policies),
    )
    competes = F.when(F.col("reason") == "6", BLOCK6).otherwise(BLOCK7)
    from_blockers = blockers.select(
        *keys, zero.alias("n"), F.lit(None).cast("int").alias("choice"), zero.alias("bits"),
        *(
            (competes if p == "none" else F.when(~F.col(f"exempt_{p}"), competes).otherwise(0)).alias(f"block_{p}")
            for p in policies
        ),
    )
    return from_crops.unionByName(from_blockers).groupBy(*keys).agg(
        F.sum("n").alias("n_crops"), F.min("choice").alias("low"), F.max("choice").alias("high"),
        F.bit_or("bits").alias("bits"), *(F.bit_or(f"block_{p}").alias(f"block_{p}") for p in policies),
    )


def key_columns(questions: DataFrame) -> DataFrame:
    """Questions with the parsed key mask and the stated answer count."""
    return questions.withColumn(
        "key", key_answer(F.coalesce(F.col("answer_key"), F.lit("")))
    ).withColumn("expected_count", required_answer_count(F.col("source_text")))


def page_gates(pages: DataFrame) -> DataFrame:
    return pages.withColumn(
        "page_ok", aligned(F.col("has_matrix"), F.col("inliers"), F.col("median_error"))
    ).withColumn("resolution", resolution_reason(F.col("scan_short_side")))


def fired_rules(block: Column) -> Column:
    """Mask of the rules that hold a question row; ``block`` is its F08(b) bits."""
    bit = lambda rule, code: BIT[rule, code]
    return F.expr(f"""
        IF(page_ok,
           (bits & {FROM_CROPS})
           | IF(low <> high, {bit("F06", "10")}, 0)
           | IF(proposed IS NOT NULL AND expected_count IS NOT NULL AND bit_count(proposed) <> expected_count,
                {bit("F12", "14")}, 0)
           | IF(low IS NULL, bits & IF(bits & {OWNERSHIP} <> 0, {NO_CANDIDATE & ~bit("no_candidate", "15")}, {NO_CANDIDATE}), 0)
           | IF(n_crops = 0, {bit("no_crop", "2")}, 0)
           | IF(proposed IS NOT NULL AND bit_count(key) >= 2 AND bit_count(proposed) <> bit_count(key),
                {bit("F12(key-count)", "16")}, 0),
           {bit("D12", "2")})
        | IF(key IS NULL, {bit("G03", "12")}, 0)
        | IF(resolution IS NOT NULL, {bit("scan_resolution", "17")}, 0)
    """).bitwiseOR(F.when(F.expr("page_ok AND proposed IS NOT NULL"), block).otherwise(0))


def stage_of(fired: Column) -> Column:
    """Furthest stage among fired rules: 0 without any, null with stage-less ones only."""
    result = F.when(fired == 0, 0)
    for stage in (4, 3, 2, 1):
        mask = sum(1 << i for i, rule in enumerate(RULES) if rule[0] == stage)
        result = result.when(fired.bitwiseAND(mask) != 0, stage)
    return result


def settle(reviewed: DataFrame) -> DataFrame:
    """Selection, stage and status from the fired rules."""
    return (
        reviewed.withColumn("selection", F.expr("IF(fired = 0, proposed, NULL)"))
        .withColumn("stage", stage_of(F.col("fired")))
        .withColumn("status", F.expr("CASE WHEN fired <> 0 THEN '보류' WHEN proposed <=> key THEN '정답' ELSE '오답' END"))
    )


def join_question_facts(
    facts: DataFrame, questions: DataFrame, pages: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """Questions with their facts, page gates and proposed answer; questions
    without crops stay."""
    wanted = key_columns(questions).select(*scope, "question_id", "page", "key", "expected_count")
    gates = page_gates(pages).select(*scope, "page", "page_ok", "resolution")
    # Pages first, while rows are narrow: the result then lies by question, as the joins after it need it.
    return (
        wanted.join(gates, [*scope, "page"], "left")
        .join(facts, [*scope, "question_id"], "left")
        .na.fill(0, ["n_crops", "bits"]).na.fill(False, ["page_ok"])
        .withColumn("proposed", F.expr("IF(low = high, low, NULL)"))
    )


REVIEW_COLUMNS = (
    "question_id", "page", "proposed", "selection", "fired", "stage", "key", "status",
    "expected_count", "resolution",
)


def question_review(
    classified: DataFrame,
    questions: DataFrame,
    pages: DataFrame,
    *,
    blockers: DataFrame | None = None,
    policies: Sequence[str] = ("none",),
    scope: Sequence[str] = (),
) -> DataFrame:
    """Reviews per (policy, question): proposed and selected masks, fired rules,
    stage, key and status. All policies come from one aggregation."""
    if blockers is None:
        blockers = f08_blockers(classified, scope=scope)
    facts = question_facts(classified, blockers, policies, scope)
    under = ", ".join(f"'{p}', coalesce(block_{p}, 0)" for p in policies)
    rows = join_question_facts(facts, questions, pages, scope).selectExpr(
        *scope, "question_id", "page", "key", "expected_count", "n_crops", "low", "high", "bits",
        "page_ok", "resolution", "proposed", f"stack({len(policies)}, {under}) AS (policy, block)",
    )
    return settle(rows.withColumn("fired", fired_rules(F.col("block")))).select(
        "policy", *scope, *REVIEW_COLUMNS
    )


_RULE_ARRAY = "array({})".format(", ".join(
    f"named_struct('seq', {i}, 'stage', {'CAST(NULL AS INT)' if stage is None else stage}, "
    f"'code', '{code}', 'rule', '{rule}')"
    for i, (stage, code, rule) in enumerate(RULES, 1)
))


def reason_array(fired: str = "fired") -> Column:
    """Ordered array of (seq, stage, code, rule) structs behind a fired mask."""
    return F.expr(f"filter({_RULE_ARRAY}, r -> shiftright({fired}, r.seq - 1) & 1 = 1)")


def reasons_long(reviews: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per reason, with the text shown for it."""
    own = F.when(F.col("code") == "16", key_count_message(mask_size(F.col("key")))).when(
        F.col("code") == "17", F.col("resolution")
    )
    return (
        reviews.filter("fired <> 0")
        .select("policy", *scope, "question_id", "key", "resolution", F.inline(reason_array()))
        .withColumn("message", F.coalesce(own, reason_message(F.col("code"))))
        .drop("key", "resolution")
    )


def reason_crops(
    reviews: DataFrame,
    classified: DataFrame,
    blockers: DataFrame,
    scope: Sequence[str] = (),
) -> DataFrame:
    """(policy, question, seq, crop): the crops behind each reason, as rows."""
    keys = [*scope, "question_id"]
    reasons = reasons_long(reviews, scope).select("policy", *keys, "seq", "code", "rule")
    # Which rules a crop can stand behind is known from the crop alone, so the
    # join is on (question, rule, code) and no pair is dropped afterwards.
    candidate = F.col("stage") == 0
    rule = lambda condition, name, code: F.when(
        condition, F.struct(F.lit(name).alias("rule"), code.alias("code"))
    )
    roles = F.array_compact(
        F.array(
            rule(F.col("ownership_review") & (F.col("stage") != 1), "page_ownership", F.lit("15")),
            rule(F.col("semantic_annotation").isNotNull(), "F10", F.lit("11")),
            rule(candidate, "F06", F.lit("10")),
            rule(F.col("reread_conflict"), "F06(re-read)", F.lit("10")),
            rule(candidate, "F12", F.lit("14")),
            rule(candidate, "F12(key-count)", F.lit("16")),
            rule(~candidate, "no_candidate", F.col("reason")),
        )
    )
    behind = classified.select(*keys, "crop_id", F.explode(roles).alias("role")).select(
        *keys, "crop_id", "role.rule", "role.code"
    )
    general = reasons.filter("rule <> 'F08(b)'").join(behind, [*keys, "rule", "code"])
    competing = reasons.filter("rule = 'F08(b)'").join(
        blockers.withColumnRenamed("reason", "code").drop(*BOX), [*keys, "code"]
    )
    exempt = F.lit(False)
    for policy in POLICIES:
        exempt = exempt | ((F.col("policy") == policy) & F.col(f"exempt_{policy}"))
    columns = ["policy", *keys, "seq", "code", "rule", "crop_id"]
    return general.select(columns).unionByName(competing.filter(~exempt).select(columns))
