"""Whole grading plans built from the operators."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.answers import answer_string, single_mask
from sheetwise.operators import ownership as own
from sheetwise.operators.evidence import Agreement
from sheetwise.operators.rereads import all_readings, numeric_readings
from sheetwise.operators.review import (
    classify_crops, f08_blockers, question_review, reason_array,
)
from sheetwise.operators.spatial import BOX
from sheetwise.plans.fixtures import Tables
from sheetwise.session import materialise

ALL_POLICIES = ("none", "broad", "duplicate")


def ring_duplicates(crops: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Candidates a ring repeats: all neighbours for a ring around the answer
    only, else every second crop of the question. Where it is known which crops are
    candidates, only those are listed."""
    rings = crops.filter("has_ring").select("crop_id", "question_id", "ring_only_answer", "crop_no")
    others = (crops if candidates is None else candidates).select("question_id", F.col("crop_id").alias("candidate_id"), F.col("crop_no").alias("other_no"))
    return rings.join(others, "question_id").filter("ring_only_answer OR (crop_no + other_no) % 2 = 0").select("crop_id", "candidate_id")


class Graded:
    """Lazily built tables of one grading run over the recorded owners.

    The classified crops feed the fact, blocker and candidate branches of every
    review. They are stored once in the shared folder, when first asked for, so no
    branch aggregates and joins the crops anew; so are the blockers.
    """

    def __init__(self, t: Tables):
        self.t = t
        self.labels = t.fx_questions.select(
            "question_id", single_mask(F.col("label_answer")).alias("expected")
        )

    @cached_property
    def classified(self) -> DataFrame:
        return materialise(classify_crops(self.t.fx_crops), "classified")

    @cached_property
    def stored(self) -> Tables:
        """The tables with crops read from the classified ones, which have all their columns."""
        return self.t.holding("fx_crops", self.classified)

    @cached_property
    def blockers(self) -> DataFrame:
        # Blockers are crops of reason 6 or 7 and meet candidates only; no other pair is built.
        held, candidates = self.classified.filter(F.col("reason").isin("6", "7")), self.classified.filter("stage = 0")
        return materialise(f08_blockers(self.classified, ring_duplicates(held, candidates)), "blockers")

    def reviews(self, *policies: str) -> DataFrame:
        return question_review(
            self.classified, self.t.fx_questions, self.t.fx_pages,
            blockers=self.blockers, policies=policies or ALL_POLICIES,
        )


def review_view(reviews: DataFrame) -> DataFrame:
    """Flat form of reviews with texts instead of masks and arrays."""
    return reviews.select(
        "policy", "question_id", "page",
        F.coalesce(answer_string(F.col("proposed")), F.lit("")).alias("proposed"),
        F.coalesce(answer_string(F.col("selection")), F.lit("")).alias("selection"),
        F.array_join(reason_array().code, ",").alias("codes"),
        F.array_join(reason_array().rule, ",").alias("rules"),
        F.coalesce(F.col("stage").cast("string"), F.lit("")).alias("stage"), "status",
    )


def associations(t: Tables, minimum: float | None = 0.7) -> tuple[DataFrame, DataFrame]:
    """(zones, associations); only what ownership is decided by travels with a crop."""
    heights = t.fx_pages.select("page", (F.lit(1800) + F.col("page") % 3).alias("height"))
    zones = own.extend_column_bottoms(
        t.fx_questions.select("question_id", "page", "zl", "zt", "zr", "zb"), heights
    )
    crops = own.anchor_columns(t.fx_page_crops).select(
        "crop_id", "page", *BOX, "anchor_ok", "left_out", "retry_ownership_review"
    )
    return zones, own.associate(crops, zones, minimum)


def ownership_tables(t: Tables, minimum: float | None = 0.7):
    """(zones, associations, enclosed owners, assigned rows) from geometry. The
    associations feed anchors, targets and the assignment and are stored once."""
    zones, associated = associations(t, minimum)
    associated = materialise(associated, "associated")
    changed = own.enclosing_assignments(associated)
    return zones, associated, changed, own.assign(associated, changed)


def owned_reviews(t: Tables, policies=("duplicate",)) -> DataFrame:
    """Grade on the owner computed from geometry: associate, enclose, assign,
    classify, review. Ownership comes first because it sets ownership_review."""
    t = t.storing("fx_crops")
    _, _, _, assigned = ownership_tables(t)
    owners = assigned.filter("question_id IS NOT NULL").select("crop_id", "question_id", "ownership_review")
    classified = classify_crops(t.fx_page_crops.join(owners, "crop_id")).select(
        "crop_id", "question_id", "recorded_id", "crop_no", "stage", "reason", "choice", "ownership_review",
        "semantic_annotation", "reread_conflict", "has_ring", "ring_only_answer", *BOX,
    )
    classified = materialise(classified, "owned")
    # Only rings that hold and candidates count; both are listed under the question they were recorded for.
    recorded = classified.withColumn("question_id", F.col("recorded_id"))
    held, candidates = recorded.filter(F.col("reason").isin("6", "7")), recorded.filter("stage = 0")
    blockers = f08_blockers(classified, ring_duplicates(held, candidates).distinct())
    return question_review(
        classified, t.fx_questions, t.fx_pages, blockers=blockers, policies=policies
    )


def agreement_tables(t: Tables, policies=("duplicate", "broad")) -> Agreement:
    """Two-evidence run over the recorded owners."""
    g = Graded(t)
    reviews = materialise(g.reviews(*policies), "reviews")
    numeric = numeric_readings(all_readings(g.stored.fx_crops, g.stored.fx_readings))
    return Agreement(
        reviews, g.classified, g.blockers, numeric, t.fx_marks, t.fx_questions, t.fx_pages, policies,
        keep=materialise,
    )
