"""Rereads, consensus and eligibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.functions.answers import answer_string
from sheetwise.operators import ownership as own
from sheetwise.operators import rereads as rr
from sheetwise.operators.review import classify_crops, key_columns, page_gates
from sheetwise.plans.catalog.ownership import X as OWN
from sheetwise.plans.checks import check
from sheetwise.plans.grading import ownership_tables

c = F.col


def text(column):
    return F.coalesce(column, F.lit("")).alias


def protected(df):
    symbol = F.when(c("crop_id") % 17 == 0, F.lit("③")).when(c("crop_id") % 13 == 0, F.lit("x"))
    return df.withColumn("protected", symbol)


def traces(t):
    return t.fx_crops.filter("crop_id % 5 = 0").select("crop_id")


PROTECTED = "CASE WHEN crop_id % 17 = 0 THEN '③' WHEN crop_id % 13 = 0 THEN 'x' END"
STAGE = lambda stage, pick, n: f"""SELECT crop_id, count(*) = {n} AND min(score) >= CAST(0.8 AS DOUBLE) AND min(txt) = max(txt) AS stable, max(CASE WHEN param = {pick} THEN txt END) AS ptxt,
 max(CASE WHEN param = {pick} THEN score END) AS pscore FROM fx_readings WHERE stage = '{stage}' GROUP BY crop_id"""
X = {
    **OWN,
    "st_peel": STAGE("peel", 0, 1), "st_b": STAGE("B", 2.5, 3), "st_c": STAGE("C", 24, 2), "st_d1": STAGE("D1", 24, 2), "st_d2": STAGE("D2", 24, 2),
    "elig": f"""SELECT *, ocr_executed AND semantic_annotation IS NULL AND NOT ownership_review AS open, crop_id % 2 = 0 AS peel_possible, txt = '③' AND coalesce(score < CAST(0.8 AS DOUBLE), false) AS low_digit FROM classified
WHERE route = 'student_candidate' AND NOT is_empty AND NOT answer_excluded AND NOT regexp_matches(coalesce({PROTECTED}, ''), '[①②③④⑤ⓐ-ⓩ]')
 AND (trim(txt) = '0' OR (coalesce(score < CAST(0.8 AS DOUBLE), false) AND regexp_full_match(trim(txt), '[①②③④⑤○◯□■◇△▽@©OoDⓞ◎]+')))""",
    "old_valid": "SELECT crop_id, digits, CASE WHEN txt = '③' THEN '3' WHEN txt = '①④' THEN '1,4' END AS before FROM parsed",
    "path": """SELECT e.crop_id, e.txt, e.score, e.open, e.low_digit, e.peel_possible, o.before, p.ptxt AS peel_txt, p.pscore AS peel_score, b.stable AS b_ok, b.ptxt AS b_txt, b.pscore AS b_score,
 c.stable AS c_ok, c.ptxt AS c_txt, c.pscore AS c_score, d1.stable AS d1_ok, d1.ptxt AS d1_txt, d1.pscore AS d1_score, d2.stable AS d2_ok, d2.ptxt AS d2_txt, d2.pscore AS d2_score,
 coalesce(e.peel_possible AND p.pscore >= CAST(0.8 AS DOUBLE) AND e.open AND e.low_digit AND o.before IS NOT NULL AND o.before <> p.ptxt, false) AS confirm, p.crop_id IS NOT NULL AS has_reads
FROM elig e JOIN old_valid o ON o.crop_id = e.crop_id LEFT JOIN st_peel p ON p.crop_id = e.crop_id LEFT JOIN st_b b ON b.crop_id = e.crop_id LEFT JOIN st_c c ON c.crop_id = e.crop_id LEFT JOIN st_d1 d1 ON d1.crop_id = e.crop_id LEFT JOIN st_d2 d2 ON d2.crop_id = e.crop_id""",
    "due": """SELECT *, peel_possible AS due_peel, NOT peel_possible AS due_b, coalesce(NOT peel_possible AND NOT b_ok, false) AS due_c, coalesce(NOT peel_possible AND NOT b_ok AND NOT c_ok, false) AS due_d1,
 coalesce(peel_possible AND (confirm OR peel_score < CAST(0.8 AS DOUBLE)), false) AS due_d2 FROM path""",
    # A crop is reconciled at most once with a stable fixed-parameter result, plus the peel before it.
    "last_step": """SELECT *, CASE WHEN NOT has_reads THEN 'none' WHEN due_b AND b_ok THEN 'B' WHEN due_c AND c_ok THEN 'C' WHEN due_d1 AND d1_ok THEN 'D1' WHEN due_d2 AND NOT confirm AND d2_ok THEN 'D2' WHEN due_peel AND NOT due_d2 THEN 'peel' WHEN confirm THEN 'confirm' ELSE 'none' END AS step,
 CASE WHEN due_b AND b_ok THEN b_txt WHEN due_c AND c_ok THEN c_txt WHEN due_d1 AND d1_ok THEN d1_txt WHEN due_d2 AND NOT confirm AND d2_ok THEN d2_txt ELSE peel_txt END AS new_txt,
 CASE WHEN due_b AND b_ok THEN b_score WHEN due_c AND c_ok THEN c_score WHEN due_d1 AND d1_ok THEN d1_score WHEN due_d2 AND NOT confirm AND d2_ok THEN d2_score ELSE peel_score END AS new_score FROM due""",
    "outcome": """SELECT *, CASE WHEN step = 'none' THEN 'kept' WHEN NOT open THEN 'still_unreadable' WHEN before IS NULL OR before = new_txt THEN 'adopted' WHEN step = 'peel' THEN 'answer_conflict'
 WHEN step = 'confirm' THEN CASE WHEN d2_ok AND d2_txt = peel_txt THEN 'adopted' ELSE 'answer_conflict' END WHEN low_digit THEN 'adopted' ELSE 'answer_conflict' END AS status FROM last_step""",
}


def _consensus(stage):
    def query(t):
        _, params, pick = rr.STAGES[stage]
        rows = rr.consensus(t.fx_readings.filter(c("stage") == stage), params, pick)
        return rows.filter("stable").select("crop_id", "stage", c("picked.txt").alias("txt"), c("picked.score").alias("score"))
    return query


def _consensus_sizes(t):
    parts = [_consensus(stage)(t) for stage in ("C", "D1", "D2")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cascade_rows(t):
    eligible = rr.eligible_strip(protected(t.fx_crops)).withColumn("peel_possible", c("crop_id") % 2 == 0)
    return rr.cascade(eligible.join(rr.stage_results(t.fx_readings), "crop_id", "left"))


def _cascade(t):
    names = ["due_peel", "due_B", "due_C", "due_D1", "due_D2", "confirm_D2"]
    return cascade_rows(t).select("crop_id", *(c(n).alias(n.lower()) for n in names))


def _apply_stage(t):
    return rr.run_cascade(cascade_rows(t)).select(
        "crop_id", "txt", "score", F.coalesce(answer_string(c("conflict_old")), F.lit("")).alias("conflict_old"),
        F.coalesce(answer_string(c("conflict_new")), F.lit("")).alias("conflict_new"), "trace",
    )


def _reconcile_count(t):
    extra = t.fx_readings.filter("stage = 'C' AND param = 24").select("crop_id", "txt", "score")
    rows = rr.reconcile_count(t.fx_crops, extra.unionByName(
        t.fx_crops.filter("txt IN ('1', '2', '4')").select("crop_id", F.when(c("crop_id") % 2 == 0, c("txt")).otherwise(F.lit("5")).alias("txt"), F.lit(0.9).alias("score"))))
    return rows.select("crop_id", "conflict", "adopted", "txt", F.coalesce(answer_string(c("old_choice")), F.lit("")).alias("old_choice"),
                       F.coalesce(answer_string(c("new_choice")), F.lit("")).alias("new_choice"))


def _reconcile_shape(t):
    _, params, pick = rr.STAGES["B"]
    proof = rr.consensus(t.fx_readings.filter("stage = 'B'"), params, pick, ["crop_id"])
    rows = t.fx_crops.join(proof, "crop_id").selectExpr(
        "*", "picked.txt AS new_txt", "picked.score AS new_score", "CAST(NULL AS INT) AS conflict_old", "CAST(NULL AS INT) AS conflict_new",
        "'hull_stable' AS method", "stable AS proof_ok", "CAST(picked.txt AS INT) AS proof_digit",
    )
    strict = rr.reconcile_shape(rows, False).select("crop_id", c("status").alias("strict_status"))
    open_ = rr.reconcile_shape(rows, True).select("crop_id", "status", "by_consensus", "txt")
    return strict.join(open_, "crop_id")


def _current(t):
    readings = t.fx_readings.filter("variant_no = 1")
    made = readings.select(
        "crop_id", c("stage_no").alias("search_rank"), ((c("crop_id") + c("stage_no")) % 3 == 0).alias("adopted"), "txt", "score",
        F.concat(F.lit("trace-"), c("crop_id"), F.lit("-"), c("stage")).alias("input"),
    )
    now = readings.filter("stage = 'C'").select("crop_id", "txt", "score", F.concat(F.lit("crop-"), c("crop_id")).alias("input"))
    return rr.current_input(now, made)


def _display(t):
    digest = F.sha2(F.concat_ws("|", "crop_id", F.when(c("stage") == "peel", F.lit("p")).otherwise(c("variant_no").cast("string"))), 256)
    rows = t.fx_readings.withColumn("input_sha256", digest)
    kept = rows.filter("stage = 'peel' AND crop_id % 4 <> 0")
    return rr.display_reads(rows, kept).select("crop_id", "stage", "variant_no")


def _plan(t):
    inputs = t.fx_readings.filter("stage = 'C'").select("crop_id", "variant_no", F.concat_ws("|", "crop_id", F.when(
        (c("crop_id") % 3 == 0) & (c("variant_no") == 2), F.lit("w2.5")).otherwise(F.concat(F.lit("c"), c("variant_no")))).alias("input_sha256"))
    cache = t.fx_readings.filter("stage = 'B'").select("crop_id", F.concat(c("crop_id"), F.lit("|w"), c("param")).alias("input_sha256"), "txt", "score", c("variant_no").alias("read_no"))
    return rr.reread_plan(inputs, cache).select("crop_id", "variant_no", "reused", F.coalesce("txt", F.lit("")).alias("txt"), F.coalesce("score", F.lit(-1.0)).alias("score"))


def _needs(t):
    pages = page_gates(t.fx_pages)
    return rr.needs_search(classify_crops(t.fx_crops), key_columns(t.fx_questions), pages, traces(t))


def method_column():
    i = c("crop_id")
    return rr.retry_method(i % 4 == 0, i % 3 == 0, i % 8 == 0, i % 17 == 0, i % 5 != 0)


METHOD = "CASE WHEN crop_id % 4 = 0 AND crop_id % 8 = 0 AND crop_id % 17 <> 0 THEN 'line_inner_resize' WHEN crop_id % 4 = 0 THEN 'line_resize_fallback' WHEN crop_id % 3 = 0 AND crop_id % 5 <> 0 THEN 'shape_inner_resize' ELSE 'resize' END"


def _retry_method(t):
    zones, associated, _, _ = ownership_tables(t)
    line = t.fx_page_crops.filter("crop_id % 4 = 0")
    supports = line.selectExpr("crop_id", "page", "xl - 20 AS xl", "yt - 20 AS yt", "xr + 20 AS xr", "yb + 20 AS yb")
    owners = own.associate(supports, zones, 0.7)
    owners = owners.filter("kept OR n_hits = 0")
    review = rr.retry_ownership(supports, owners, associated.filter("kept").join(supports.select("crop_id"), "crop_id", "left_semi"))
    return t.fx_page_crops.select("crop_id", method_column().alias("method")).join(review, "crop_id", "left").withColumn(
        "ownership_review", F.coalesce("ownership_review", F.lit(False))
    )


def _retry_summary(t):
    before = classify_crops(t.fx_crops).select("crop_id", c("reason").alias("old_reason"))
    done = _reconcile_count(t)
    after = done.select(
        "crop_id", method_column().alias("method"), (c("crop_id") % 7 != 0).alias("prepared"), "adopted",
        F.when(c("conflict"), F.lit("answer_conflict")).otherwise(F.lit("")).alias("status"),
        F.when(c("adopted") | (c("old_choice") != ""), F.lit("candidate")).otherwise(F.lit("held")).alias("new_reason"),
    )
    return rr.retry_summary(before, after)


COUNT_ROWS = """SELECT c.crop_id, c.reason, c.txt, e.txt AS new_txt, CASE WHEN c.reason = 'candidate' THEN c.choice END AS old_choice,
 CASE WHEN c.ocr_executed AND NOT c.is_empty AND NOT c.answer_excluded AND c.semantic_annotation IS NULL AND c.route = 'student_candidate' AND NOT c.ownership_review AND e.score >= CAST(0.8 AS DOUBLE) THEN e.txt END AS new_choice
FROM classified c JOIN (SELECT crop_id, txt, score FROM fx_readings WHERE stage = 'C' AND param = 24 UNION ALL SELECT crop_id, CASE WHEN crop_id % 2 = 0 THEN txt ELSE '5' END, CAST(0.9 AS DOUBLE) FROM fx_crops WHERE txt IN ('1', '2', '4')) e ON e.crop_id = c.crop_id"""
X["count_rows"] = COUNT_ROWS
X["to_search"] = """SELECT k.question_id, e.expected_count FROM keyed k JOIN counted e ON e.question_id = k.question_id JOIN page_gate g ON g.page = k.page LEFT JOIN
 (SELECT question_id, bool_or(semantic_annotation IS NOT NULL OR crop_id % 5 = 0) AS blocked, count(DISTINCT choice) AS n_sets, min(choice) AS one FROM classified GROUP BY question_id) f ON f.question_id = k.question_id
WHERE e.expected_count IS NOT NULL AND g.page_ok AND NOT coalesce(f.blocked, false) AND coalesce(f.n_sets, 0) <= 1 AND coalesce((length(f.one) + 1) // 2, 0) < e.expected_count"""
X["s_hits"] = """SELECT c.crop_id, z.question_id, (least(xr + 20, zr) - greatest(xl - 20, zl)) * (least(yb + 20, zb) - greatest(yt - 20, zt)) / ((xr - xl + 40) * (yb - yt + 40))::DOUBLE AS share
FROM fx_page_crops c JOIN zoned z ON z.page = c.page WHERE c.crop_id % 4 = 0 AND greatest(xl - 20, zl) < least(xr + 20, zr) AND greatest(yt - 20, zt) < least(yb + 20, zb)"""
X["s_owner"] = """SELECT crop_id, CASE WHEN count(*) FILTER (WHERE share >= 0.7) = 1 THEN max(CASE WHEN share >= 0.7 THEN question_id END) WHEN count(*) = 1 AND max(share) = 1 THEN max(question_id) END AS owner FROM s_hits GROUP BY crop_id"""
X["kept_links"] = """SELECT h.crop_id, min(h.question_id) AS lo, max(h.question_id) AS hi FROM hits h JOIN crop_status s ON s.crop_id = h.crop_id WHERE s.n_enough <> 1 OR h.shared / h.whole::DOUBLE >= 0.7::DOUBLE GROUP BY h.crop_id"""

ENTRIES = {
    "no_history": (
        lambda t: rr.without_history(t.fx_crops, traces(t)).select("crop_id"),
        check("SELECT crop_id FROM fx_crops WHERE crop_id % 5 <> 0"),
    ),
    "eligible_inner": (
        lambda t: rr.eligible_inner(protected(classify_crops(t.fx_crops)), traces(t)).select("crop_id"),
        check(f"SELECT crop_id FROM classified WHERE reason = '6' AND route = 'student_candidate' AND {PROTECTED} IS NULL AND semantic_annotation IS NULL AND NOT reread_conflict AND crop_id % 5 <> 0"),
    ),
    "eligible_strip": (
        lambda t: rr.eligible_strip(protected(t.fx_crops)).select("crop_id"),
        check("SELECT crop_id FROM elig", X),
    ),
    "needs_search": (_needs, check("SELECT question_id, expected_count FROM to_search", X)),
    "count_targets": (
        lambda t: rr.count_search_targets(t.fx_crops, _needs(t), t.fx_questions).select("question_id", "crop_id", "inside"),
        check("""SELECT c.question_id, c.crop_id, zl <= xl AND xl < xr AND xr <= zr AND zt <= yt AND yt < yb AND yb <= zb AS inside FROM fx_crops c JOIN fx_questions q ON q.question_id = c.question_id
WHERE NOT is_empty AND NOT answer_excluded AND route = 'student_candidate' AND c.question_id IN (SELECT question_id FROM to_search)""", X),
    ),
    "retry_candidates": (
        lambda t: rr.retry_candidates(t.fx_readings.select("crop_id", (c("crop_id") % 5 == 0).alias("any_history"), (c("crop_id") % 2 == 0).alias("broad_candidate"), (c("crop_id") % 3 == 0).alias("duplicate_candidate"))).select("crop_id"),
        check("SELECT DISTINCT crop_id FROM fx_readings WHERE crop_id % 5 <> 0 AND (crop_id % 2 = 0 OR crop_id % 3 = 0)"),
    ),
    "reread_plan": (
        _plan,
        check("""SELECT r.crop_id, r.variant_no, b.crop_id IS NOT NULL AS reused, coalesce(b.txt, '') AS txt, coalesce(b.score, CAST(-1 AS DOUBLE)) AS score FROM fx_readings r LEFT JOIN fx_readings b
 ON b.crop_id = r.crop_id AND b.stage = 'B' AND b.param = 2.5 AND r.crop_id % 3 = 0 AND r.variant_no = 2 WHERE r.stage = 'C'"""),
    ),
    "consensus_widths": (_consensus("B"), check("SELECT crop_id, 'B' AS stage, ptxt AS txt, pscore AS score FROM st_b WHERE stable", X)),
    "consensus_sizes": (
        _consensus_sizes,
        check("""SELECT crop_id, 'C' AS stage, ptxt AS txt, pscore AS score FROM st_c WHERE stable UNION ALL SELECT crop_id, 'D1', ptxt, pscore FROM st_d1 WHERE stable
UNION ALL SELECT crop_id, 'D2', ptxt, pscore FROM st_d2 WHERE stable""", X),
    ),
    "cascade": (_cascade, check("SELECT crop_id, due_peel, due_b, due_c, due_d1, due_d2, confirm AS confirm_d2 FROM due", X)),
    "apply_stage": (
        _apply_stage,
        check("""SELECT crop_id, CASE WHEN status = 'adopted' THEN new_txt ELSE txt END AS txt, CASE WHEN status = 'adopted' THEN new_score ELSE score END AS score,
 CASE WHEN status = 'answer_conflict' THEN before ELSE '' END AS conflict_old, CASE WHEN status = 'answer_conflict' THEN new_txt ELSE '' END AS conflict_new,
 CASE WHEN NOT has_reads THEN '' WHEN due_b THEN CASE WHEN step = 'B' THEN 'B:' || status WHEN step = 'C' THEN 'B:fixed_consensus_failed>C:' || status WHEN step = 'D1' THEN 'B:fixed_consensus_failed>C:fixed_consensus_failed>D1:' || status
   ELSE 'B:fixed_consensus_failed>C:fixed_consensus_failed>D1:fixed_consensus_failed' END
  WHEN step = 'peel' THEN 'peel:' || status WHEN confirm THEN 'peel:answer_conflict>D2+:' || status WHEN d2_ok THEN 'peel:still_unreadable>D2:' || status ELSE 'peel:still_unreadable>D2:fixed_consensus_failed' END AS trace
FROM outcome""", X),
    ),
    "reconcile_count": (
        _reconcile_count,
        check("""SELECT crop_id, coalesce(old_choice <> new_choice, false) AS conflict, old_choice IS NULL AND new_choice IS NOT NULL AS adopted,
 CASE WHEN old_choice IS NULL AND new_choice IS NOT NULL THEN new_txt ELSE txt END AS txt, coalesce(old_choice, '') AS old_choice, coalesce(new_choice, '') AS new_choice FROM count_rows""", X),
    ),
    "reconcile_shape": (
        _reconcile_shape,
        check("""SELECT crop_id, CASE WHEN NOT ok THEN 'still_unreadable' WHEN before <> ptxt THEN 'answer_conflict' ELSE 'adopted' END AS strict_status,
 CASE WHEN NOT ok THEN 'still_unreadable' WHEN before <> ptxt AND NOT (txt = '③' AND stable) THEN 'answer_conflict' ELSE 'adopted' END AS status,
 ok AND coalesce(before <> ptxt, false) AND txt = '③' AND stable AS by_consensus, CASE WHEN ok AND (before IS NULL OR before = ptxt OR (txt = '③' AND stable)) THEN ptxt ELSE txt END AS txt FROM (
SELECT c.*, b.stable, b.ptxt, o.before, b.pscore >= CAST(0.8 AS DOUBLE) AND c.ocr_executed AND NOT c.is_empty AND NOT c.answer_excluded AND c.semantic_annotation IS NULL AND c.route = 'student_candidate' AND NOT c.ownership_review AS ok
FROM classified c JOIN st_b b ON b.crop_id = c.crop_id JOIN old_valid o ON o.crop_id = c.crop_id) q""", X),
    ),
    "numeric_readings": (
        lambda t: rr.numeric_readings(rr.all_readings(t.fx_crops, t.fx_readings)).select("crop_id", "read_no", answer_string(c("mask")).alias("answer"), "score"),
        check("""SELECT crop_id, 0 AS read_no, parsed AS answer, score FROM parsed WHERE parsed IS NOT NULL AND isfinite(score) AND score >= 0.5
UNION ALL SELECT crop_id, stage_no * 10 + variant_no, txt, score FROM fx_readings WHERE score >= 0.5"""),
    ),
    "current_input": (
        _current,
        check("""SELECT r.crop_id, coalesce((SELECT min_by('trace-' || a.crop_id || '-' || a.stage, a.stage_no) FROM fx_readings a WHERE a.crop_id = r.crop_id AND a.variant_no = 1 AND (a.crop_id + a.stage_no) % 3 = 0 AND a.txt = r.txt AND a.score = r.score),
 'crop-' || r.crop_id) AS current_input FROM fx_readings r WHERE r.stage = 'C' AND r.variant_no = 1"""),
    ),
    "display_reads": (_display, check("SELECT crop_id, stage, variant_no FROM fx_readings WHERE NOT (stage = 'peel' AND crop_id % 4 <> 0)")),
    "retry_method": (
        _retry_method,
        check(f"""SELECT c.crop_id, {METHOD.replace('crop_id', 'c.crop_id')} AS method, c.crop_id % 4 = 0 AND NOT coalesce(o.owner = k.lo AND o.owner = k.hi, false) AS ownership_review
FROM fx_page_crops c LEFT JOIN s_owner o ON o.crop_id = c.crop_id LEFT JOIN kept_links k ON k.crop_id = c.crop_id""", X),
    ),
    "retry_summary": (
        _retry_summary,
        check(f"""SELECT {METHOD} AS method, count(*) AS eligible, count(*) FILTER (WHERE crop_id % 7 <> 0) AS prepared, count(*) FILTER (WHERE old_choice IS NULL AND new_choice IS NOT NULL) AS adopted,
 count(*) FILTER (WHERE old_choice <> new_choice) AS conflicts, count(*) FILTER (WHERE reason <> 'candidate' AND old_choice IS NULL AND new_choice IS NOT NULL) AS recovered FROM count_rows GROUP BY 1""", X),
    ),
}
