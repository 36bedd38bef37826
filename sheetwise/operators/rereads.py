"""Rereads of uncertain crops over one long table of readings.

``readings(crop_id, stage, variant_no, param, txt, score)`` holds every reread
variant; the chain of attempts of a crop is the order of its stages. Nothing
here looks at answer keys or labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.answers import CIRCLED, should_reread, student_choices, to_digit
from sheetwise.functions.gates import CIRCLED_LETTERS, classify, finite

# Stage -> (method, parameters every proof must show, parameter
# whose reading is the result).
STAGES = {
    "peel": ("enclosure", None, 0.0),
    "B": ("hull_stable", (2.0, 2.5, 3.0), 2.5),
    "C": ("size_stable_C", (16.0, 24.0), 24.0),
    "D1": ("circle_strip_D-1", (16.0, 24.0), 24.0),
    "D2": ("circle_strip_D-2", (16.0, 24.0), 24.0),
}
MINIMUM_SCORE = 0.5


def consensus(
    readings: DataFrame, params: Sequence[float], pick: float, keys: Sequence[str] = ("crop_id", "stage")
) -> DataFrame:
    """Per key: is the reread stable, its result and its last reading.

    Stable means exactly the expected parameters in order, one and the same
    digit in all of them, every score a real number of at least .8. The proof is
    counted, not collected: one aggregation with map-side combine.
    """
    wanted = F.array(*(F.lit(float(p)) for p in params))
    place = F.array_position(wanted, F.col("param"))
    digit = to_digit(F.col("txt"))
    good = finite(F.col("score")) & (F.col("score") >= 0.8) & digit.isNotNull()
    rows = readings.withColumn("digit", digit).withColumn("good", good).withColumn(
        "in_order", (place > 0) & (place == F.col("variant_no"))
    )
    return rows.groupBy(*keys).agg(
        (
            (F.count(F.lit(1)) == len(params)) & F.bool_and("in_order") & F.bool_and("good")
            & (F.min("digit") == F.max("digit")) & (F.min("variant_no") == 1)
            & (F.sum("variant_no") == sum(range(1, len(params) + 1)))
        ).alias("stable"),
        F.max(F.when(F.col("param") == pick, F.struct("txt", "score"))).alias("picked"),
        F.max_by(F.struct("txt", "score"), "variant_no").alias("last_read"),
    ).withColumn("stable", F.coalesce("stable", F.lit(False)))


def eligible_strip(crops: DataFrame) -> DataFrame:
    """Crops the reread cascade may look at. ``protected`` lists preserved printed
    symbols of the crop, null or empty for none."""
    kept = F.coalesce(F.col("protected"), F.lit(""))
    return crops.filter(
        (F.col("route") == "student_candidate") & ~F.col("is_empty") & ~F.col("answer_excluded")
        & ~kept.rlike(f"[{CIRCLED}{CIRCLED_LETTERS}]")
        & should_reread(F.col("txt"), F.coalesce(F.col("score"), F.lit(float("inf"))))
    )


def without_history(crops: DataFrame, traces: DataFrame, keys: Sequence[str] = ("crop_id",)) -> DataFrame:
    """Crops no search ever touched; a trace counts even with zero attempts."""
    return crops.join(traces.select(*keys), list(keys), "left_anti")


def eligible_inner(classified: DataFrame, traces: DataFrame, keys: Sequence[str] = ("crop_id",)) -> DataFrame:
    """Low-score student crops free of preserved choices, notes, conflicts and history."""
    held = classified.filter(
        (F.col("reason") == "6") & (F.col("route") == "student_candidate")
        & (F.coalesce(F.col("protected"), F.lit("")) == "")
        & F.col("semantic_annotation").isNull() & ~F.col("reread_conflict")
    )
    return without_history(held, traces, keys)


def needs_search(
    classified: DataFrame, questions: DataFrame, pages: DataFrame, traces: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """Questions whose stated answer count is not reached by their one candidate set.

    ``questions`` carries expected_count, ``pages`` carries page_ok."""
    crop, question = [*scope, "crop_id"], [*scope, "question_id"]
    touched = traces.select(*crop).distinct().withColumn("searched", F.lit(True))
    facts = (
        classified.join(touched, crop, "left").groupBy(*question)
        .agg(
            F.max(F.col("semantic_annotation").isNotNull() | F.coalesce("searched", F.lit(False))).alias("blocked"),
            F.min("choice").alias("low"), F.max("choice").alias("high"),
        )
    )
    rows = (
        questions.filter("expected_count IS NOT NULL")
        .join(pages.filter("page_ok").select(*scope, "page"), [*scope, "page"])
        .join(facts, question, "left")
    )
    one_set = F.col("low").isNull() | (F.col("low") == F.col("high"))
    size = F.coalesce(F.bit_count("low"), F.lit(0))
    return rows.filter(~F.coalesce("blocked", F.lit(False)) & one_set & (size < F.col("expected_count"))).select(
        *question, "expected_count"
    )


def count_search_targets(
    crops: DataFrame, wanted: DataFrame, zones: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """Ordinary student crops of the wanted questions; ``inside`` is false for a
    crop that leaves its zone, which callers refuse."""
    question = [*scope, "question_id"]
    rows = crops.filter(
        ~F.col("is_empty") & ~F.col("answer_excluded") & (F.col("route") == "student_candidate")
    ).join(wanted.select(*question), question, "left_semi")
    return rows.join(zones.select(*question, "zl", "zt", "zr", "zb"), question).withColumn(
        "inside",
        F.expr("zl <= xl AND xl < xr AND xr <= zr AND zt <= yt AND yt < yb AND yb <= zb"),
    ).drop("zl", "zt", "zr", "zb")


def retry_candidates(flags: DataFrame, keys: Sequence[str] = ("crop_id",)) -> DataFrame:
    """Crops either policy wants retried and that have no history, each once."""
    return (
        flags.filter(~F.col("any_history") & (F.col("broad_candidate") | F.col("duplicate_candidate")))
        .dropDuplicates(list(keys))
    )


def reread_plan(inputs: DataFrame, cache: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Inputs with ``reused``: same crop and image digest was read in this run, so
    its text and score are copied; the rest is to be read."""
    keys = [*scope, "crop_id", "input_sha256"]
    known = cache.groupBy(*keys).agg(F.max_by(F.struct("txt", "score"), "read_no").alias("known"))
    return inputs.join(known, keys, "left").select(
        *inputs.columns, F.col("known").isNotNull().alias("reused"),
        F.col("known.txt").alias("txt"), F.col("known.score").alias("score"),
    )


def reconcile_count(current: DataFrame, extra: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Extra readings of one count search. Two valid, different answers conflict;
    only a valid answer where none was is taken over."""
    keys = [*scope, "crop_id"]
    more = extra.select(*keys, F.col("txt").alias("new_txt"), F.col("score").alias("new_score"))
    rows = current.join(more, keys)
    old, new = F.col("old_choice"), F.col("new_choice")
    rows = rows.withColumn("old_choice", _accepted(F.col("txt"), F.col("score"))).withColumn(
        "new_choice", _accepted(F.col("new_txt"), F.col("new_score"))
    )
    conflict = old.isNotNull() & new.isNotNull() & (old != new)
    adopted = old.isNull() & new.isNotNull()
    return rows.select(
        *keys, conflict.alias("conflict"), adopted.alias("adopted"),
        F.when(adopted, F.col("new_txt")).otherwise(F.col("txt")).alias("txt"),
        F.when(adopted, F.col("new_score")).otherwise(F.col("score")).alias("score"),
        "old_choice", "new_choice",
    )


def _accepted(text: Column, score: Column) -> Column:
    """Answer mask of a reading that passes every gate of its crop, else null."""
    choice = student_choices(text)
    gate = classify(
        empty=F.col("is_empty"), excluded=F.col("answer_excluded"), executed=F.col("ocr_executed"),
        text=text, score=score, annotation=F.col("semantic_annotation"),
        route=F.col("route"), choice=choice, ownership=F.col("ownership_review"),
    )
    return F.when(gate.reason == "candidate", choice)


def reconcile_shape(rows: DataFrame, allow_consensus: bool) -> DataFrame:
    """Take over, refuse or hold one new reading per crop.

    ``rows`` carries the current reading (txt, score, conflict_old, conflict_new
    masks), the crop gates, the new reading (new_txt, new_score), ``method`` and
    ``proof_ok`` with ``proof_digit``: whether the proof readings are the expected
    parameters in order with one digit at or above .8.
    """
    rows = rows.withColumn("before", student_choices(F.col("txt"))).withColumn(
        "after", _accepted(F.col("new_txt"), F.col("new_score"))
    )
    digit = to_digit(F.col("new_txt"))
    differs = F.col("before").isNotNull() & (F.col("before") != F.col("after"))
    same_conflict = F.col("conflict_old").isNull() | (
        (F.col("conflict_old") == F.col("before")) & (F.col("conflict_new") == F.col("after"))
    )
    methods = [method for method, _, _ in STAGES.values()]
    agreed = F.lit(allow_consensus) & F.coalesce(
        to_digit(F.col("txt")).isNotNull() & finite(F.col("score")) & (F.col("score") < 0.8)
        & F.col("method").isin(methods) & same_conflict & digit.isNotNull()
        & F.col("proof_ok") & (F.col("proof_digit") == digit),
        F.lit(False),
    )
    status = (
        F.when(F.col("after").isNull(), F.lit("still_unreadable"))
        .when(differs & ~agreed, F.lit("answer_conflict"))
        .otherwise(F.lit("adopted"))
    )
    rows = rows.withColumn("status", status).withColumn(
        "by_consensus", (F.col("status") == "adopted") & differs
    )
    adopted, conflict = F.col("status") == "adopted", F.col("status") == "answer_conflict"
    keep_old = F.lit(allow_consensus) & F.col("conflict_old").isNotNull()

    def conflict_side(old: str, new: str) -> Column:
        return (
            F.when(F.col("by_consensus"), F.lit(None).cast("int"))
            .when(conflict & ~keep_old, F.col(new))
            .otherwise(F.col(old))
        )

    return (
        rows.withColumn("next_old", conflict_side("conflict_old", "before"))
        .withColumn("next_new", conflict_side("conflict_new", "after"))
        .withColumn("previous_txt", F.col("txt")).withColumn("previous_score", F.col("score"))
        .withColumn("txt", F.when(adopted, F.col("new_txt")).otherwise(F.col("txt")))
        .withColumn("score", F.when(adopted, F.col("new_score")).otherwise(F.col("score")))
        .withColumn("conflict_old", F.col("next_old")).withColumn("conflict_new", F.col("next_new"))
        .withColumn("adopted", adopted)
        .drop("next_old", "next_new", "before", "after")
    )


def stage_results(readings: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per crop with a struct per stage: stable, picked and last reading.

    All stages come from one aggregation over the readings; the cascade then only
    decides which of them were due, without any further join.
    """
    keys = [*scope, "crop_id"]
    parts = None
    for stage, (_, params, pick) in STAGES.items():
        rows = readings.filter(F.col("stage") == stage)
        found = consensus(rows, params or (pick,), pick, [*keys, "stage"])
        if params is None:
            found = found.withColumn("stable", F.lit(True))
        parts = found if parts is None else parts.unionByName(found)
    return parts.groupBy(*keys).agg(
        *(
            F.max(F.when(F.col("stage") == stage, F.struct("stable", "picked", "last_read"))).alias(f"s_{stage}")
            for stage in STAGES
        )
    )


def cascade(rows: DataFrame) -> DataFrame:
    """Which stages a crop goes through, as booleans due_<stage> plus confirm_D2.

    ``rows``: eligible crops with stage_results columns and ``peel_possible``.
    Peel if possible, else B; an unstable B leads to C, an unstable C to D1; a peel
    without a valid digit leads to D2, a low-score digit conflict asks D2 to confirm.
    A stage without readings (a null struct, as after a left join) has not run and
    leads to no other stage.
    """
    peel = F.col("peel_possible")
    unstable = lambda stage: _ran(stage) & ~F.coalesce(F.col(f"s_{stage}.stable"), F.lit(False))
    digit = to_digit(F.col("s_peel.picked.txt"))
    weak = _ran("peel") & (digit.isNull() | ~F.coalesce(F.col("s_peel.picked.score") >= 0.8, F.lit(False)))
    original = to_digit(F.col("txt"))
    conflict = F.coalesce(
        student_choices(F.col("txt")) != _accepted(F.col("s_peel.picked.txt"), F.col("s_peel.picked.score")),
        F.lit(False),
    )
    confirm = peel & ~weak & conflict & original.isNotNull() & F.coalesce(F.col("score") < 0.8, F.lit(False))
    return (
        rows.withColumn("due_peel", peel)
        .withColumn("due_B", ~peel)
        .withColumn("due_C", F.col("due_B") & unstable("B"))
        .withColumn("due_D1", F.col("due_C") & unstable("C"))
        .withColumn("confirm_D2", confirm)
        .withColumn("due_D2", (peel & weak) | confirm)
    )


def _ran(stage: str) -> Column:
    return F.col(f"s_{stage}").isNotNull()


def apply_stage(rows: DataFrame, due: dict[str, Column], *, confirmation: bool = False) -> DataFrame:
    """One step of the chain over the current readings. ``due`` gives stages that
    exclude each other once stable (a stable one ends the chain): the stable one is
    reconciled, the others are recorded as failed, other crops stay as they are.

    The state of a crop is (txt, score, conflict_old, conflict_new, trace).
    """
    stable = {s: F.coalesce(F.col(f"s_{s}.stable"), F.lit(False)) for s in due}
    if confirmation:
        # The peel result is looked at again, now with the confirming readings.
        (stage,) = due
        new, ready = F.col("s_peel.picked"), due[stage]
        method, proof_ok, digit = F.lit("enclosure"), stable[stage], to_digit(F.col(f"s_{stage}.picked.txt"))
        label = {stage: f"{stage}+"}
        stable[stage] = F.lit(True)
    else:
        ready = F.lit(False)
        for stage, wanted in due.items():
            ready = ready | (wanted & stable[stage])
        pick = lambda value: F.coalesce(*(F.when(due[s] & stable[s], value(s)) for s in due))
        new = pick(lambda s: F.col(f"s_{s}.picked"))
        method = pick(lambda s: F.lit(STAGES[s][0]))
        # Peel proves nothing by itself; the fixed-parameter stages do.
        proof_ok, digit = pick(lambda s: F.lit(STAGES[s][1] is not None)), to_digit(F.col("new.txt"))
        label = {s: s for s in due}
    state = ["txt", "score", "conflict_old", "conflict_new", "trace"]
    kept = [name for name in rows.columns if name not in state]
    prepared = (
        rows.withColumn("new", new).withColumn("ready", ready).withColumn("method", method)
        .withColumn("proof_ok", proof_ok)
        .withColumn("new_txt", F.col("new.txt")).withColumn("new_score", F.col("new.score"))
        .withColumn("proof_digit", digit)
        .withColumn("before_state", F.struct("txt", "score", "conflict_old", "conflict_new"))
    )
    done = reconcile_shape(prepared, allow_consensus=True)

    def now(name: str) -> Column:
        return F.when(F.col("ready"), F.col(name)).otherwise(F.col(f"before_state.{name}")).alias(name)

    steps = [
        F.when(
            wanted,
            F.concat(F.lit(f"{label[s]}:"), F.when(stable[s], F.col("status")).otherwise(F.lit("fixed_consensus_failed"))),
        )
        for s, wanted in due.items()
    ]
    trace = F.concat_ws(">", F.when(F.col("trace") != "", F.col("trace")), *steps)
    return done.select(*kept, *(now(name) for name in state[:-1]), trace.alias("trace"))


def run_cascade(rows: DataFrame) -> DataFrame:
    """All stages in their fixed order; rows from cascade(). Due stages without readings
    have not run: they leave a crop and its trace as they are."""
    state = (
        rows.withColumn("conflict_old", F.lit(None).cast("int"))
        .withColumn("conflict_new", F.lit(None).cast("int"))
        .withColumn("trace", F.lit(""))
        .withColumn("original_txt", F.col("txt")).withColumn("original_score", F.col("score"))
    )
    state = apply_stage(state, {"peel": F.col("due_peel") & _ran("peel")})
    fixed = {s: F.col(f"due_{s}") & _ran(s) for s in ("B", "C", "D1")}
    state = apply_stage(state, {**fixed, "D2": F.col("due_D2") & ~F.col("confirm_D2") & _ran("D2")})
    return apply_stage(state, {"D2": F.col("confirm_D2") & _ran("D2")}, confirmation=True)


def numeric_readings(all_readings: DataFrame) -> DataFrame:
    """Every stored digit reading with a real score of at least .5, with its mask."""
    return (
        all_readings.withColumn("mask", student_choices(F.col("txt")))
        .filter(F.col("mask").isNotNull() & finite(F.col("score")) & (F.col("score") >= MINIMUM_SCORE))
    )


def all_readings(crops: DataFrame, readings: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Current readings (read_no 0) and stored variants as one long table, in the
    order they were made."""
    current = crops.select(
        *scope, "crop_id", "question_id", F.lit("current").alias("stage"), F.lit(0).alias("read_no"), "txt", "score"
    )
    variants = readings.select(
        *scope, "crop_id", "question_id", "stage", (F.col("stage_no") * 10 + F.col("variant_no")).alias("read_no"), "txt", "score"
    )
    return current.unionByName(variants)


def current_input(crops: DataFrame, traces: DataFrame, keys: Sequence[str] = ("crop_id",)) -> DataFrame:
    """Image behind the current reading: that of the adopted trace with the same
    text and score (the latest search kind first), else the crop's own image.

    ``traces`` has (search_rank, adopted, txt, score, input); rank 1 is looked at first.
    """
    keys = list(keys)
    adopted = traces.filter("adopted").select(
        *keys, "search_rank", F.col("txt").alias("t_txt"), F.col("score").alias("t_score"), F.col("input").alias("t_input")
    )
    same = F.col("txt").eqNullSafe(F.col("t_txt")) & F.col("score").eqNullSafe(F.col("t_score"))
    matching = (
        crops.join(adopted, keys).filter(same).groupBy(*keys).agg(F.min_by("t_input", "search_rank").alias("t_input"))
    )
    return crops.join(matching, keys, "left").select(
        *keys, F.coalesce("t_input", "input").alias("current_input")
    )


def display_reads(readings: DataFrame, traces: DataFrame, keys: Sequence[str] = ("crop_id",)) -> DataFrame:
    """Readings to show: the one peel read that only repeats its trace is left out."""
    repeated = traces.filter(F.col("stage") == "peel").select(*keys, "stage", "input_sha256")
    return readings.join(repeated, [*keys, "stage", "input_sha256"], "left_anti")


def retry_method(flag_line: Column, zero_or_shape: Column, inside_found: Column, protected: Column, frames: Column) -> Column:
    """How a retried crop image is prepared."""
    return (
        F.when(flag_line & inside_found & ~protected, F.lit("line_inner_resize"))
        .when(flag_line, F.lit("line_resize_fallback"))
        .when(zero_or_shape & frames, F.lit("shape_inner_resize"))
        .otherwise(F.lit("resize"))
    )


def retry_ownership(supports: DataFrame, owners: DataFrame, previous: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Ownership check of expanded boxes: review unless the 70 % association of
    the support box names exactly the questions the crop had.

    ``owners`` are kept associations of the support boxes (crop_id, question_id,
    status), ``previous`` the stored links (crop_id, question_id). Both lists are
    compared by counting shared and unshared links, not by collecting them.
    """
    keys = [*scope, "crop_id"]
    links = (
        owners.filter("question_id IS NOT NULL").select(*keys, "question_id", F.lit(1).alias("side"))
        .unionByName(previous.select(*keys, "question_id", F.lit(2).alias("side")))
        .groupBy(*keys, "question_id").agg(F.bit_or("side").alias("sides"))
        .groupBy(*keys).agg(F.bool_and(F.col("sides") == 3).alias("same_owner"))
    )
    state = owners.groupBy(*keys).agg(F.max("status").alias("status"))
    return (
        supports.select(*keys).join(state, keys, "left").join(links, keys, "left")
        .select(
            *keys,
            (~(F.col("status").eqNullSafe("assigned") & F.coalesce("same_owner", F.lit(False)))).alias("ownership_review"),
        )
    )


def retry_summary(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("crop_id",)) -> DataFrame:
    """Counts by method: eligible, prepared, adopted, conflicts, recovered.

    ``before`` has old_reason; ``after`` has method, prepared, adopted, status, new_reason."""
    rows = before.join(after, list(keys))
    return rows.groupBy("method").agg(
        F.count(F.lit(1)).alias("eligible"),
        F.count_if("prepared").alias("prepared"),
        F.count_if("adopted").alias("adopted"),
        F.count_if(F.col("status") == "answer_conflict").alias("conflicts"),
        F.count_if((F.col("old_reason") != "candidate") & (F.col("new_reason") == "candidate")).alias("recovered"),
    )
