"""Choice marks, recommendations and confirmation by two kinds of evidence.

A held answer is confirmed only when independent handwriting and the printed
choice marks name the same number and every hold reason is proven to come from
that same answer. Reasons are bit masks, so "some cleared, some not" is plain
bit arithmetic on question rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.answers import single_mask
from sheetwise.functions.geometry import Box, box, overlaps, strictly_inside
from sheetwise.operators.review import (
    BIT, BLOCK6, f08_blockers, fired_rules, join_question_facts, question_facts, reason_crops, reasons_long,
    settle, stage_of,
)
from sheetwise.operators.spatial import BOX

# Measurement parameters a recommendation is valid for.
PARAMETERS = {"minimum_ink": 40, "cancel_width": 200, "nms": 18, "match_threshold": 0.72}
NOTE_ID = "choice-mark-recommendation"
_RETESTED = BIT["no_candidate", "5"] | BIT["no_candidate", "6"] | BIT["no_candidate", "9"] | BLOCK6


def mark_flags(marks: DataFrame) -> DataFrame:
    """Marks with ``cancelled`` and ``marked``."""
    cancelled = F.col("span") >= PARAMETERS["cancel_width"]
    return marks.withColumn("cancelled", cancelled).withColumn(
        "marked", (F.col("ink_pixels") >= PARAMETERS["minimum_ink"]) & ~cancelled
    )


def printed_numbers(marks: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per question: are the printed numbers exactly 1..5, the one marked number
    (null unless exactly one is marked), and the five boxes p1..p5."""
    flagged = mark_flags(marks)
    boxes = [
        F.max(F.when(F.col("symbol_no") == k, F.struct(*BOX))).alias(f"p{k}") for k in range(1, 6)
    ]
    return (
        flagged.groupBy(*scope, "question_id")
        .agg(
            F.count(F.lit(1)).alias("n_symbols"),
            F.bit_or(single_mask(F.col("symbol_no"))).alias("symbols"),
            F.count_if("marked").alias("n_marked"),
            F.max(F.when(F.col("marked"), F.col("symbol_no"))).alias("top_marked"),
            *boxes,
        )
        .withColumn("complete", (F.col("n_symbols") == 5) & (F.col("symbols") == 31))
        .withColumn("mark", F.when(F.col("complete") & (F.col("n_marked") == 1), F.col("top_marked")))
        .drop("n_symbols", "symbols", "n_marked", "top_marked")
    )


def recommend(reviews: DataFrame, marks: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(policy, question, number): held questions with a one-answer key, all five
    printed numbers and exactly one of them marked."""
    numbers = printed_numbers(marks, scope).filter("mark IS NOT NULL")
    held = reviews.filter((F.col("status") == "보류") & (F.bit_count("key") == 1))
    return held.join(numbers, [*scope, "question_id"]).select(
        "policy", *scope, "question_id", F.col("mark").alias("number")
    )


def attach_recommendations(evidence: DataFrame, recommended: DataFrame, parameters: dict, scope: Sequence[str] = ()) -> DataFrame:
    """Evidence rows (policy, question, evidence_id, label) with recommendation
    rows added; nothing else changes. Refuses other parameters and a second run."""
    if parameters != PARAMETERS:
        raise ValueError("Recommendation thresholds differ from the fixed version")
    if evidence.filter(F.col("evidence_id") == NOTE_ID).take(1):
        raise ValueError("Recommendation evidence already exists")
    symbol = F.element_at(F.split(F.lit("①,②,③,④,⑤"), ","), F.col("number"))
    added = recommended.select(
        "policy", *scope, "question_id", F.lit(NOTE_ID).alias("evidence_id"),
        F.format_string("추천 %s · 선택 표시 기반 · 확인 필요", symbol).alias("label"),
    )
    return evidence.unionByName(added)


def touched_symbols(crops: DataFrame, numbers: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Crops with ``touch``: a mask of the printed numbers they overlap."""
    bits = F.lit(0)
    for k in range(1, 6):
        printed = Box(*(F.col(f"p{k}.{name}") for name in BOX))
        bits = bits + F.when(overlaps(box(), printed), 1 << (k - 1)).otherwise(0)
    boxes = numbers.filter("complete").select(*scope, "question_id", *(f"p{k}" for k in range(1, 6)))
    return crops.join(boxes, [*scope, "question_id"]).withColumn("touch", bits).drop(
        *(f"p{k}" for k in range(1, 6))
    )


def gather_evidence(crops: DataFrame, numeric: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per question: candidate range, independent readings and the best of them.

    ``crops`` has touch bits; ``numeric`` are numeric readings (crop_id, read_no,
    mask, score). Ties go to the lowest crop, then the earliest reading.
    """
    crop = [*scope, "crop_id"]
    reads = numeric.groupBy(*crop).agg(
        F.count(F.lit(1)).alias("n_reads"), F.min("mask").alias("mask_low"), F.max("mask").alias("mask_high"),
        F.max(F.struct(F.col("score"), (-F.col("read_no")).alias("order"), F.col("mask"))).alias("top"),
    )
    independent = (
        (F.col("touch") == 0) & (F.col("stage") != 1) & ~F.col("ownership_review") & F.col("semantic_annotation").isNull()
    )
    # Readings count for independent crops only; the others need not meet them.
    apart = F.coalesce(independent, F.lit(False))
    rows = crops.filter(apart).join(reads, crop, "left").unionByName(crops.filter(~apart), allowMissingColumns=True)
    rows = rows.withColumn("used", independent & F.col("n_reads").isNotNull())
    used = lambda column: F.when(F.col("used"), column)
    candidate = F.col("stage") == 0
    place = [(-F.col("crop_id")).alias("order"), F.col("crop_id"), *(F.col(b) for b in BOX)]
    bit_and_of = lambda code: F.bit_and(F.when(F.col("reason") == code, F.col("touch")))
    return rows.groupBy(*scope, "question_id").agg(
        F.min("choice").alias("low"), F.max("choice").alias("high"),
        F.max(candidate & (F.col("score") >= 0.8) & (F.col("touch") == 0)).alias("accepted"),
        F.sum(used(F.col("n_reads"))).alias("n_reads"),
        F.min(used(F.col("mask_low"))).alias("mask_low"), F.max(used(F.col("mask_high"))).alias("mask_high"),
        F.max(used(F.struct(F.col("top.score").alias("score"), *place, F.col("top.mask").alias("mask")))).alias("best"),
        F.max(used(F.when(candidate, F.struct(F.col("score"), *place)))).alias("standing"),
        bit_and_of("2").alias("touch_2"), bit_and_of("8").alias("touch_8"),
    )


def first_decisions(reviews: DataFrame, numbers: DataFrame, gathered: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Reviews with ``decision`` where the case ends early, else null plus the
    agreed ``number``, the ``path`` and the candidate crop."""
    keys = [*scope, "question_id"]
    rows = reviews.join(numbers.select(*keys, "complete", "mark"), keys, "left").join(gathered, keys, "left")
    rows = rows.withColumn(
        "number",
        F.coalesce("mark", F.when(F.col("accepted") & (F.bit_count("proposed") == 1), F.expr("CAST(log2(proposed) AS INT) + 1"))),
    ).withColumn("wanted", single_mask(F.col("number")))
    strong = F.col("best.score") >= 0.8
    rows = rows.withColumn(
        "decision",
        F.when(F.col("selection").isNotNull(), F.lit("already_automatic"))
        .when(F.coalesce(F.bit_count("key") != 1, F.lit(True)), F.lit("no_single_mark_or_single_key"))
        .when(~F.coalesce("complete", F.lit(False)), F.lit("printed_numbers_incomplete"))
        .when(F.col("number").isNull(), F.lit("no_single_mark_or_single_key"))
        .when(F.coalesce("n_reads", F.lit(0)) == 0, F.lit("no_independent_digit"))
        .when((F.col("mask_low") != F.col("wanted")) | (F.col("mask_high") != F.col("wanted")), F.lit("independent_digits_disagree"))
        .when(~strong & F.col("mark").isNull(), F.lit("no_single_mark_or_single_key"))
        .when(
            strong & (F.col("standing").isNull() | ~F.col("proposed").eqNullSafe(F.col("wanted"))),
            F.lit("high_retry_not_adopted"),
        ),
    )
    open_case = F.col("decision").isNull()
    return (
        rows.withColumn("path", F.when(open_case, F.when(strong, F.lit("existing_candidate_mark_blocker")).otherwise(F.lit("low_confidence_agreement"))))
        .withColumn("promoted", F.when(open_case & ~strong, F.col("best.crop_id")))
        .withColumn("cand", F.when(open_case, F.when(strong, F.struct("standing.score", "standing.crop_id", *(f"standing.{b}" for b in BOX)))
                                   .otherwise(F.struct("best.score", "best.crop_id", *(f"best.{b}" for b in BOX)))))
        .withColumn("best_score", F.when(open_case, F.col("cand.score")))
    )


def open_cases(decided: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per question still open: number, promoted crop, candidate box. These
    do not depend on the policy."""
    return (
        decided.filter("decision IS NULL")
        .select(*scope, "question_id", "wanted", "promoted", F.col("cand.crop_id").alias("cand_id"),
                *(F.col(f"cand.{b}").alias("c_" + b) for b in BOX))
        .distinct()
    )


def promote(crops: DataFrame, cases: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Crops of open questions, with the agreed low-score crop as a candidate."""
    rows = crops.join(cases, [*scope, "question_id"])
    hit = F.coalesce(F.col("crop_id") == F.col("promoted"), F.lit(False))
    return (
        rows.withColumn("stage", F.when(hit, 0).otherwise(F.col("stage")))
        .withColumn("choice", F.when(hit, F.col("wanted")).otherwise(F.col("choice")))
        .withColumn("reason", F.when(hit, F.lit("candidate")).otherwise(F.col("reason")))
    )


def clear_method(code: Column, rule: Column) -> Column:
    """How a cause crop is explained by the agreed answer, else null. Needs touch,
    wanted, the crop box, the candidate (cand_id, c_box) and ring_only_answer."""
    may = ((rule == "F08(b)") & (code == "6")) | ((rule == "no_candidate") & code.isin("2", "8"))
    same_print = (F.col("touch").bitwiseAND(F.col("wanted")) != 0) & ((code != "2") | F.col("is_empty"))
    border = (
        (rule == "F08(b)") & F.col("ring_only_answer") & (F.col("crop_id") != F.col("cand_id"))
        & strictly_inside(box(), box("c_"))
    )
    return F.when(may & same_print, F.lit("same_printed_number")).when(
        may & border, F.lit("closed_border_only_answer")
    )


def _open_blocks(blockers: DataFrame, flags: DataFrame, policies: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """Per question and policy, whether a competing low-score crop stays unexplained."""
    rows = blockers.filter("reason = '6'").drop("ring_only_answer", *BOX).join(flags, [*scope, "question_id", "crop_id"])
    unexplained = clear_method(F.lit("6"), F.lit("F08(b)")).isNull()
    return rows.groupBy(*scope, "question_id").agg(
        *(F.max(unexplained & ~F.col(f"exempt_{p}")).alias(f"open_{p}") for p in policies)
    )


class Agreement:
    """Tables of one two-evidence run over a set of reviews.

    ``keep`` may store a step's table (see session.materialise); later steps read
    each of these tables several times.
    """

    def __init__(
        self, reviews: DataFrame, classified: DataFrame, blockers: DataFrame, numeric: DataFrame, marks: DataFrame,
        questions: DataFrame, pages: DataFrame, policies: Sequence[str] = ("duplicate", "broad"), scope: Sequence[str] = (),
        keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
    ):
        keys = [*scope, "question_id"]
        numbers = printed_numbers(marks, scope)
        # What no step below reads need not travel with the crops.
        crops = classified.select(
            *keys, "crop_id", "score", "stage", "reason", "choice", "ownership_review", "semantic_annotation", "reread_conflict",
            "is_empty", "has_ring", "ring_only_answer", *BOX,
        )
        touched = keep(touched_symbols(crops, numbers, scope), "touched")
        self.decided = keep(
            first_decisions(reviews, numbers, gather_evidence(touched, numeric, scope), scope), "decided"
        )
        cases = open_cases(self.decided, scope)
        self.updated = keep(promote(touched, cases, scope), "updated")
        flags = self.updated.select(
            *keys, "crop_id", "touch", "wanted", "cand_id", "is_empty", "ring_only_answer", *BOX, *(f"c_{b}" for b in BOX)
        )
        # Exemptions stay those of the first review; a crop that competes only
        # since the promotion has none.
        passes = [f"exempt_{p}" for p in policies]
        earlier = blockers.select(*keys, "crop_id", *passes)
        fresh = f08_blockers(self.updated, scope=scope).drop(*passes)
        self.trial_blockers = keep(
            fresh.join(earlier, [*keys, "crop_id"], "left").na.fill(False, passes), "trial-blockers"
        )
        facts = question_facts(self.updated, self.trial_blockers, policies, scope)
        per_policy = ", ".join(f"'{p}', coalesce(block_{p}, 0)" for p in policies)
        trial = join_question_facts(
            facts, questions.join(cases.select(*keys), keys, "left_semi"), pages, scope
        ).selectExpr(
            *keys, "key", "expected_count", "n_crops", "low", "high", "bits", "page_ok", "resolution", "proposed", "page",
            f"stack({len(policies)}, {per_policy}) AS (policy, block)",
        )
        self.trial = keep(settle(trial.withColumn("fired", fired_rules(F.col("block")))), "trial")

        def opened(table: DataFrame, name: str) -> DataFrame:
            pairs = ", ".join(f"'{p}', open_{p}" for p in policies)
            return _open_blocks(table, flags, policies, scope).selectExpr(*keys, f"stack({len(policies)}, {pairs}) AS (policy, {name})")

        both = ["policy", *keys]
        self.flags = flags
        rows = (
            self.decided.join(
                self.trial.select(*both, F.col("fired").alias("trial_fired"), F.col("proposed").alias("trial_proposed")), both, "left"
            )
            .join(opened(blockers, "open_before"), both, "left")
            .join(opened(self.trial_blockers, "open_after"), both, "left")
            .na.fill(False, ["open_before", "open_after"])
        )
        self.result = _conclude(rows, scope)
        self.policies, self.scope, self.blockers, self.classified = policies, scope, blockers, classified
        self.reviews = reviews

    def trace(self) -> DataFrame:
        """(policy, question, phase, seq, code, rule, crop, method, cleared) for every
        reason of the open cases, before and with the candidate: a row per crop behind
        it, or one row without crop, never cleared, for a reason that no crop causes."""
        both = ["policy", *self.scope, "question_id"]
        cases = self.decided.filter("decision IS NULL").select(*both)

        def phase(name: str, reviews: DataFrame, crops: DataFrame, blockers: DataFrame) -> DataFrame:
            own = reviews.join(cases, both, "left_semi")
            reasons = reasons_long(own, self.scope).select(*both, "seq", "code", "rule")
            behind = reason_crops(own, crops, blockers, self.scope).select(*both, "seq", "crop_id")
            return reasons.join(behind, [*both, "seq"], "left").withColumn("phase", F.lit(name))

        rows = phase("original", self.reviews, self.classified, self.blockers).unionByName(
            phase("candidate", self.trial, self.updated, self.trial_blockers)
        )
        method = clear_method(F.col("code"), F.col("rule"))
        return rows.join(self.flags, [*self.scope, "question_id", "crop_id"], "left").select(
            *both, "phase", "seq", "code", "rule", "crop_id", method.alias("method"), method.isNotNull().alias("cleared")
        )


def _conclude(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Confirmed, held with fewer reasons, or left as it was."""
    fired, trial = F.col("fired"), F.col("trial_fired")

    def cleared_bit(bit: int, clear: Column) -> Column:
        return F.when(F.coalesce(clear, F.lit(False)), fired.bitwiseAND(bit)).otherwise(0)

    cleared = (
        cleared_bit(BLOCK6, ~F.col("open_before"))
        .bitwiseOR(cleared_bit(BIT["no_candidate", "2"], F.col("touch_2").bitwiseAND(F.col("wanted")) != 0))
        .bitwiseOR(cleared_bit(BIT["no_candidate", "8"], F.col("touch_8").bitwiseAND(F.col("wanted")) != 0))
    )
    left = lambda mask, bits: mask.bitwiseAND(F.bitwise_not(bits))
    rows = (
        rows.withColumn("cleared", cleared)
        .withColumn("blocked", left(left(fired, F.col("cleared")), F.lit(_RETESTED)))
        .withColumn("final_fired", F.when(F.col("open_after"), trial).otherwise(left(trial, F.lit(BLOCK6))))
    )
    rows = rows.withColumn(
        "decision",
        F.coalesce(
            "decision",
            F.when(F.col("blocked") != 0, F.lit("protected_hold")).when(F.col("final_fired") != 0, F.lit("remaining_hold"))
            .when(F.col("trial_proposed").eqNullSafe(F.col("wanted")), F.lit("confirmed"))
            .otherwise(F.raise_error(F.lit("Same-answer candidate was not reproduced")).cast("string")),
        ),
    )
    confirmed = F.col("decision") == "confirmed"
    fewer = F.col("decision").isin("protected_hold", "remaining_hold") & (F.col("cleared") != 0) & (
        left(fired, F.col("cleared")) != 0
    )
    rows = rows.withColumn("reasons_changed", fewer).withColumn(
        "fired_after", F.when(confirmed, 0).when(fewer, left(fired, F.col("cleared"))).otherwise(fired)
    )
    return rows.withColumn("selection_after", F.when(confirmed, F.col("wanted")).otherwise(F.col("selection"))).withColumn(
        "stage_after", stage_of(F.col("fired_after"))
    ).withColumn(
        "status_after",
        F.when(confirmed, F.when(F.col("wanted") == F.col("key"), F.lit("정답")).otherwise(F.lit("오답"))).otherwise(F.col("status")),
    )


def agreement_export(result: DataFrame, trace: DataFrame, rules_version: Column, scope: Sequence[str] = ()) -> DataFrame:
    """New answer, judgement, label and version of the questions that changed."""
    both = ["policy", *scope, "question_id"]
    # A reason counts as cleared when all of its crops are explained.
    reasons = trace.groupBy(*both, "phase", "seq", "code").agg(
        F.bool_and("cleared").alias("cleared"), F.max(F.col("method") == "closed_border_only_answer").alias("border")
    )
    extra = reasons.groupBy(*both).agg(
        F.max(F.col("cleared") & (F.col("code").isin("2", "8") | F.coalesce("border", F.lit(False)))).alias("extra")
    )
    confirmed = F.col("decision") == "confirmed"
    same_answer = F.col("mark").isNull() | F.coalesce("extra", F.lit(False))
    version = (
        F.when(confirmed & same_answer, F.concat(rules_version, F.lit(" + two-evidence-v1 + same-answer-causes-v1")))
        .when(confirmed, F.concat(rules_version, F.lit(" + two-evidence-v1")))
        .otherwise(F.concat(rules_version, F.lit(" + same-answer-causes-v1")))
    )
    label = F.when(
        confirmed,
        F.when(
            F.col("mark").isNotNull(),
            F.format_string("두 증거 일치 · 손글씨 %d %.2f + 선택 표시 %d", "number", "best_score", "number"),
        ).otherwise(F.format_string("같은 답 표시 사유 해소 · 손글씨 %d %.2f", "number", "best_score")),
    )
    return (
        result.filter(confirmed | F.col("reasons_changed")).join(extra, both, "left")
        .select(
            *both, F.when(confirmed, F.col("number")).alias("read_answer"), F.col("status_after").alias("judgement"),
            label.alias("label"), version.alias("rules_version"),
        )
    )
