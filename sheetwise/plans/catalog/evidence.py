"""Choice marks, recommendations and two-evidence confirmation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.functions.answers import answer_string
from sheetwise.operators import evidence as ev
from sheetwise.operators import policies as pol
from sheetwise.operators import rereads as rr
from sheetwise.operators import summaries as sm
from sheetwise.operators.review import reason_array
from sheetwise.plans.checks import check, overlap, review_ctes
from sheetwise.plans.grading import Graded, agreement_tables

c = F.col
POL = ("duplicate", "broad")

U_LIVE = f"""SELECT p.policy, b.question_id, b.crop_id, b.reason, b.touch_chosen, b.ring_only_answer AND b.crop_id <> b.cand_id AND b.xl < b.c_xl AND b.yt < b.c_yt AND b.xr > b.c_xr AND b.yb > b.c_yb AS border
FROM u_crops b CROSS JOIN policy_names p WHERE b.reason IN ('6', '7') AND EXISTS (SELECT 1 FROM u_crops c WHERE c.question_id = b.question_id AND c.stage = 0 AND {overlap('b', 'c')})
 AND NOT EXISTS (SELECT 1 FROM blockers o WHERE o.crop_id = b.crop_id AND ((p.policy = 'broad' AND o.exempt_broad) OR (p.policy = 'duplicate' AND o.exempt_duplicate)))"""
X = {
    "recs": """SELECT r.policy, r.question_id, m.number, r.label_ok FROM (SELECT *, length(key_text) = 1 AS label_ok FROM reviews) r JOIN printed m ON m.question_id = r.question_id
WHERE r.status = '보류' AND label_ok AND m.complete AND m.n_marked = 1 AND r.policy <> 'none'""",
    "printed": """SELECT question_id, count(*) = 5 AND count(DISTINCT symbol_no) = 5 AS complete, count(*) FILTER (WHERE ink_pixels >= 40 AND span < 200) AS n_marked,
 max(symbol_no) FILTER (WHERE ink_pixels >= 40 AND span < 200) AS number FROM fx_marks GROUP BY question_id""",
    "touches": f"SELECT c.question_id, c.crop_id, m.symbol_no FROM fx_crops c JOIN fx_marks m ON m.question_id = c.question_id WHERE {overlap('c', 'm')}",
    "accepted": "SELECT DISTINCT question_id FROM classified WHERE stage = 0 AND score >= CAST(0.8 AS DOUBLE) AND crop_id NOT IN (SELECT crop_id FROM touches)",
    "numbered": """SELECT q.question_id, q.proposed, coalesce(p.complete, false) AS complete, CASE WHEN p.n_marked = 1 AND p.complete THEN p.number END AS mark,
 coalesce(CASE WHEN p.n_marked = 1 AND p.complete THEN p.number END, CASE WHEN length(q.proposed) = 1 AND q.question_id IN (SELECT question_id FROM accepted) THEN CAST(q.proposed AS INT) END) AS number
FROM (SELECT question_id, proposed FROM reviews WHERE policy = 'none') q LEFT JOIN printed p ON p.question_id = q.question_id""",
    "proposals": "SELECT question_id, CASE WHEN count(DISTINCT choice) = 1 THEN min(choice) END AS sole FROM classified GROUP BY question_id",
    "stored_reads": """SELECT crop_id, 0 AS read_no, parsed AS answer, score FROM parsed WHERE parsed IS NOT NULL AND isfinite(score) AND score >= 0.5
UNION ALL SELECT crop_id, stage_no * 10 + variant_no, txt, score FROM fx_readings WHERE score >= 0.5""",
    "indep": """SELECT c.question_id, c.crop_id, c.stage, c.xl, c.yt, c.xr, c.yb, r.read_no, r.answer, r.score, c.score AS own_score FROM classified c JOIN stored_reads r ON r.crop_id = c.crop_id
WHERE c.stage <> 1 AND NOT c.ownership_review AND c.semantic_annotation IS NULL AND c.crop_id NOT IN (SELECT crop_id FROM touches)""",
    "best_read": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, crop_id, read_no) AS rn FROM indep) q WHERE rn = 1",
    "standing": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY own_score DESC, crop_id, read_no) AS rn FROM indep WHERE stage = 0) q WHERE rn = 1",
    "read_stats": "SELECT question_id, count(*) AS n_reads, min(answer) AS lo, max(answer) AS hi FROM indep GROUP BY question_id",
    "first_step": """SELECT r.policy, r.question_id, r.page, r.proposed, r.key_text, r.selection, r.status, r.stage, n.mark, n.number, b.score AS top_score, b.crop_id AS best_crop, s.crop_id AS stand_crop,
 CASE WHEN r.selection IS NOT NULL THEN 'already_automatic' WHEN r.key_text IS NULL OR length(r.key_text) <> 1 THEN 'no_single_mark_or_single_key' WHEN NOT n.complete THEN 'printed_numbers_incomplete'
  WHEN n.number IS NULL THEN 'no_single_mark_or_single_key' WHEN t.n_reads IS NULL THEN 'no_independent_digit' WHEN t.lo <> CAST(n.number AS VARCHAR) OR t.hi <> CAST(n.number AS VARCHAR) THEN 'independent_digits_disagree'
  WHEN b.score < CAST(0.8 AS DOUBLE) AND n.mark IS NULL THEN 'no_single_mark_or_single_key'
  WHEN b.score >= CAST(0.8 AS DOUBLE) AND (s.crop_id IS NULL OR r.proposed IS DISTINCT FROM CAST(n.number AS VARCHAR)) THEN 'high_retry_not_adopted' END AS early,
 CASE WHEN b.score >= CAST(0.8 AS DOUBLE) THEN s.crop_id ELSE b.crop_id END AS cand_id, CASE WHEN b.score >= CAST(0.8 AS DOUBLE) THEN s.own_score ELSE b.score END AS cand_score,
 b.score >= CAST(0.8 AS DOUBLE) AS strong
FROM reviews r JOIN numbered n ON n.question_id = r.question_id LEFT JOIN read_stats t ON t.question_id = r.question_id LEFT JOIN best_read b ON b.question_id = r.question_id LEFT JOIN standing s ON s.question_id = r.question_id WHERE r.policy <> 'none'""",
    "cases": "SELECT DISTINCT f.question_id, f.number, f.strong, f.cand_id, k.xl AS c_xl, k.yt AS c_yt, k.xr AS c_xr, k.yb AS c_yb FROM first_step f JOIN fx_crops k ON k.crop_id = f.cand_id WHERE f.early IS NULL",
    "u_crops": """SELECT c.* EXCLUDE (stage, reason, choice), CASE WHEN hit THEN 0 ELSE stage END AS stage, CASE WHEN hit THEN 'candidate' ELSE reason END AS reason, CASE WHEN hit THEN CAST(number AS VARCHAR) ELSE choice END AS choice
FROM (SELECT k.*, p.number, p.cand_id, p.c_xl, p.c_yt, p.c_xr, p.c_yb, NOT p.strong AND k.crop_id = p.cand_id AS hit, EXISTS (SELECT 1 FROM touches t WHERE t.crop_id = k.crop_id AND t.symbol_no = p.number) AS touch_chosen FROM classified k JOIN cases p ON p.question_id = k.question_id) c""",
    "u_live": U_LIVE,
    **review_ctes("u_crops", "u_live", "u_"),
    "causes": """SELECT 'original' AS phase, r.policy, r.question_id, r.seq, r.code, r.rule, u.crop_id, u.touch_chosen, u.is_empty, u.ring_only_answer AND u.crop_id <> u.cand_id AND u.xl < u.c_xl AND u.yt < u.c_yt AND u.xr > u.c_xr AND u.yb > u.c_yb AS border
 FROM reasons r JOIN first_step f ON f.policy = r.policy AND f.question_id = r.question_id AND f.early IS NULL JOIN u_crops u ON u.question_id = r.question_id JOIN classified c ON c.crop_id = u.crop_id
 WHERE (r.rule = 'page_ownership' AND c.ownership_review AND c.stage <> 1) OR (r.rule = 'F10' AND c.semantic_annotation IS NOT NULL) OR (r.rule IN ('F06', 'F12', 'F12(key-count)') AND c.stage = 0) OR (r.rule = 'F06(re-read)' AND c.reread_conflict)
  OR (r.rule = 'no_candidate' AND c.reason = r.code) OR (r.rule = 'F08(b)' AND EXISTS (SELECT 1 FROM live_blockers l WHERE l.policy = r.policy AND l.crop_id = c.crop_id AND l.reason = r.code))
UNION ALL SELECT 'candidate', r.policy, r.question_id, r.seq, r.code, r.rule, c.crop_id, c.touch_chosen, c.is_empty, c.ring_only_answer AND c.crop_id <> c.cand_id AND c.xl < c.c_xl AND c.yt < c.c_yt AND c.xr > c.c_xr AND c.yb > c.c_yb
 FROM u_reasons r JOIN first_step f ON f.policy = r.policy AND f.question_id = r.question_id AND f.early IS NULL JOIN u_crops c ON c.question_id = r.question_id
 WHERE (r.rule = 'page_ownership' AND c.ownership_review AND c.stage <> 1) OR (r.rule = 'F10' AND c.semantic_annotation IS NOT NULL) OR (r.rule IN ('F06', 'F12', 'F12(key-count)') AND c.stage = 0) OR (r.rule = 'F06(re-read)' AND c.reread_conflict)
  OR (r.rule = 'no_candidate' AND c.reason = r.code) OR (r.rule = 'F08(b)' AND EXISTS (SELECT 1 FROM u_live l WHERE l.policy = r.policy AND l.crop_id = c.crop_id AND l.reason = r.code))""",
    "traced": """SELECT *, CASE WHEN (rule = 'F08(b)' AND code = '6') OR (rule = 'no_candidate' AND code IN ('2', '8')) THEN CASE WHEN touch_chosen AND (code <> '2' OR is_empty) THEN 'same_printed_number' WHEN rule = 'F08(b)' AND border THEN 'closed_border_only_answer' END END AS method FROM causes""",
    "cleared": "SELECT phase, policy, question_id, seq, code, rule, bool_and(method IS NOT NULL) AS cleared, bool_or(coalesce(method = 'closed_border_only_answer', false)) AS border FROM traced GROUP BY phase, policy, question_id, seq, code, rule",
    "o_state": """SELECT r.policy, r.question_id, count(*) FILTER (WHERE NOT coalesce(k.cleared, false) AND NOT ((r.rule = 'no_candidate' AND r.code IN ('5', '6', '9')) OR (r.rule = 'F08(b)' AND r.code = '6'))) AS n_blocked,
 count(*) FILTER (WHERE coalesce(k.cleared, false)) AS n_cleared, count(*) FILTER (WHERE NOT coalesce(k.cleared, false)) AS n_left, string_agg(r.code, ',' ORDER BY r.seq) FILTER (WHERE NOT coalesce(k.cleared, false)) AS left_codes,
 max(r.stage) FILTER (WHERE NOT coalesce(k.cleared, false)) AS left_stage
FROM reasons r LEFT JOIN cleared k ON k.phase = 'original' AND k.policy = r.policy AND k.question_id = r.question_id AND k.seq = r.seq GROUP BY r.policy, r.question_id""",
    "n_state": """SELECT r.policy, r.question_id, count(*) AS n_final FROM u_reasons r LEFT JOIN cleared k ON k.phase = 'candidate' AND k.policy = r.policy AND k.question_id = r.question_id AND k.seq = r.seq
WHERE NOT (r.rule = 'F08(b)' AND coalesce(k.cleared, false)) GROUP BY r.policy, r.question_id""",
    "decided": """SELECT f.*, r.codes, o.left_codes, o.left_stage, coalesce(f.early, CASE WHEN o.n_blocked > 0 THEN 'protected_hold' WHEN coalesce(n.n_final, 0) > 0 THEN 'remaining_hold' ELSE 'confirmed' END) AS decision,
 f.early IS NULL AND (o.n_blocked > 0 OR coalesce(n.n_final, 0) > 0) AND o.n_cleared > 0 AND o.n_left > 0 AS fewer
FROM first_step f JOIN reviews r ON r.policy = f.policy AND r.question_id = f.question_id LEFT JOIN o_state o ON o.policy = f.policy AND o.question_id = f.question_id LEFT JOIN n_state n ON n.policy = f.policy AND n.question_id = f.question_id""",
}


def _decide(t):
    result = agreement_tables(t).result
    return result.select(
        "policy", "question_id", "decision", F.coalesce("path", F.lit("")).alias("path"),
        F.coalesce(F.when(c("path").isNotNull(), c("number")), F.lit(0)).alias("number"),
        F.coalesce("best_score", F.lit(-1.0)).alias("best_score"), "reasons_changed",
        F.array_join(reason_array("fired_after").code, ",").alias("codes_after"),
        F.coalesce(answer_string(c("selection_after")), F.lit("")).alias("selection_after"),
        F.coalesce(c("stage_after").cast("string"), F.lit("")).alias("stage_after"), "status_after",
    )


def _trace(t):
    return agreement_tables(t).trace().withColumn("method", F.coalesce("method", F.lit(""))).withColumn("crop_id", F.coalesce("crop_id", F.lit(-1)))


def _export(t):
    run = agreement_tables(t)
    rows = ev.agreement_export(run.result, run.trace(), F.lit("rules-1"))
    return rows.select("policy", "question_id", F.coalesce("read_answer", F.lit(0)).alias("read_answer"), "judgement", F.coalesce("label", F.lit("")).alias("label"), "rules_version")


def recommended(t):
    return ev.recommend(Graded(t).reviews(*POL), t.fx_marks)


def _attach(t):
    evidence = t.fx_questions.select(F.explode(F.array(*map(F.lit, POL))).alias("policy"), "question_id", F.lit("context").alias("evidence_id"), F.lit("학생 원래 문항").alias("label"))
    return ev.attach_recommendations(evidence, recommended(t), ev.PARAMETERS)


def _rec_audit(t):
    g = Graded(t)
    labels = g.labels.withColumn("confirmed_by_user", c("question_id") % 5 != 0).withColumn("needs_review", c("question_id") % 7 == 0)
    reviews = g.reviews(*POL)
    return sm.recommendation_audit(reviews, ev.recommend(reviews, t.fx_marks), labels).withColumn("show", F.coalesce("show", F.lit(False)))


def _rec_views(t):
    """Every policy is shown here, so that the filters have rows."""
    g = Graded(t)
    labels = g.labels.withColumn("confirmed_by_user", c("question_id") % 5 != 0).withColumn("needs_review", c("question_id") % 7 == 0)
    reviews = g.reviews(*POL)
    shown = reviews.select("policy").distinct().withColumn("show", F.lit(True))
    return sm.recommendation_views(reviews, ev.recommend(reviews, t.fx_marks), labels, agreement_tables(t).result, shown)


def _run_summary(t):
    reviews = Graded(t).reviews(*POL)
    return pol.run_summary(reviews, ev.recommend(reviews, t.fx_marks), 3600.0).withColumn(
        "seconds_per_page", F.floor(c("seconds_per_page") * 1000).cast("bigint")
    )


ENTRIES = {
    "mark_flags": (
        lambda t: ev.mark_flags(t.fx_marks).select("question_id", "symbol_no", "cancelled", "marked"),
        check("SELECT question_id, symbol_no, span >= 200 AS cancelled, ink_pixels >= 40 AND span < 200 AS marked FROM fx_marks"),
    ),
    "recommend": (recommended, check("SELECT policy, question_id, number FROM recs", X)),
    "attach_rec": (
        _attach,
        check("""SELECT p.policy, q.question_id, 'context' AS evidence_id, '학생 원래 문항' AS label FROM fx_questions q CROSS JOIN policy_names p WHERE p.policy <> 'none'
UNION ALL SELECT policy, question_id, 'choice-mark-recommendation', '추천 ' || substr('①②③④⑤', number, 1) || ' · 선택 표시 기반 · 확인 필요' FROM recs""", X),
    ),
    "decide": (
        _decide,
        check("""SELECT policy, question_id, decision, CASE WHEN early IS NOT NULL THEN '' WHEN strong THEN 'existing_candidate_mark_blocker' ELSE 'low_confidence_agreement' END AS path,
 CASE WHEN early IS NULL THEN number ELSE 0 END AS number, CASE WHEN early IS NULL THEN cand_score ELSE CAST(-1 AS DOUBLE) END AS best_score, fewer AS reasons_changed,
 CASE WHEN decision = 'confirmed' THEN '' WHEN fewer THEN left_codes ELSE codes END AS codes_after, CASE WHEN decision = 'confirmed' THEN CAST(number AS VARCHAR) ELSE coalesce(selection, '') END AS selection_after,
 CASE WHEN decision = 'confirmed' THEN '0' WHEN fewer THEN coalesce(CAST(left_stage AS VARCHAR), '') ELSE coalesce(CAST(stage AS VARCHAR), '') END AS stage_after,
 CASE WHEN decision = 'confirmed' THEN CASE WHEN CAST(number AS VARCHAR) = key_text THEN '정답' ELSE '오답' END ELSE status END AS status_after FROM decided""", X),
    ),
    "trace_reasons": (
        _trace,
        check("""SELECT policy, question_id, phase, seq, code, rule, crop_id, coalesce(method, '') AS method, method IS NOT NULL AS cleared FROM traced
UNION ALL SELECT r.policy, r.question_id, phase, r.seq, r.code, r.rule, -1, '', false FROM (SELECT 'original' AS phase, policy, question_id, seq, code, rule FROM reasons UNION ALL SELECT 'candidate', policy, question_id, seq, code, rule FROM u_reasons) r
 JOIN first_step f ON f.policy = r.policy AND f.question_id = r.question_id AND f.early IS NULL
 WHERE NOT EXISTS (SELECT 1 FROM causes k WHERE k.phase = r.phase AND k.policy = r.policy AND k.question_id = r.question_id AND k.seq = r.seq)""", X),
    ),
    "agreement_export": (
        _export,
        check("""SELECT d.policy, d.question_id, CASE WHEN decision = 'confirmed' THEN number ELSE 0 END AS read_answer, CASE WHEN decision = 'confirmed' THEN CASE WHEN CAST(number AS VARCHAR) = key_text THEN '정답' ELSE '오답' END ELSE status END AS judgement,
 CASE WHEN decision <> 'confirmed' THEN '' WHEN mark IS NOT NULL THEN printf('두 증거 일치 · 손글씨 %d %.2f + 선택 표시 %d', number, cand_score, number) ELSE printf('같은 답 표시 사유 해소 · 손글씨 %d %.2f', number, cand_score) END AS label,
 CASE WHEN decision <> 'confirmed' THEN 'rules-1 + same-answer-causes-v1' WHEN mark IS NULL OR EXISTS (SELECT 1 FROM cleared k WHERE k.policy = d.policy AND k.question_id = d.question_id AND k.cleared AND (k.code IN ('2', '8') OR k.border))
  THEN 'rules-1 + two-evidence-v1 + same-answer-causes-v1' ELSE 'rules-1 + two-evidence-v1' END AS rules_version FROM decided d WHERE decision = 'confirmed' OR fewer""", X),
    ),
    "rec_audit": (
        _rec_audit,
        check("""SELECT r.policy, count(*) AS questions, count(*) FILTER (WHERE status <> '보류') AS automatic, count(*) FILTER (WHERE status = '보류') AS held, count(m.number) AS recommended,
 count(*) FILTER (WHERE m.number IS NOT NULL AND ok AND m.number = label_answer) AS matched, count(*) FILTER (WHERE m.number IS NOT NULL AND ok AND m.number <> label_answer) AS wrong,
 count(*) FILTER (WHERE m.number IS NOT NULL AND NOT ok) AS unverified, coalesce(count(*) FILTER (WHERE m.number IS NOT NULL AND ok AND m.number = label_answer) >= 0.9 * nullif(count(m.number), 0), false) AS show
FROM reviews r JOIN (SELECT *, label_answer IS NOT NULL AND question_id % 5 <> 0 AND question_id % 7 <> 0 AS ok FROM fx_questions) q ON q.question_id = r.question_id
LEFT JOIN recs m ON m.policy = r.policy AND m.question_id = r.question_id WHERE r.policy <> 'none' GROUP BY r.policy""", X),
    ),
    "rec_views": (
        _rec_views,
        check("""SELECT r.policy, r.question_id, r.held, m.number IS NOT NULL AND r.held AS recommended, coalesce(m.number IS NOT NULL AND r.held AND ok AND m.number <> label_answer, false) AS wrong, agreement
FROM (SELECT r.policy, r.question_id, r.status = '보류' AND coalesce(d.decision, '') <> 'confirmed' AS held, coalesce(d.decision = 'confirmed' AND d.mark IS NOT NULL, false) AS agreement
 FROM reviews r LEFT JOIN decided d ON d.policy = r.policy AND d.question_id = r.question_id WHERE r.policy <> 'none') r
JOIN (SELECT *, label_answer IS NOT NULL AND question_id % 5 <> 0 AND question_id % 7 <> 0 AS ok FROM fx_questions) q ON q.question_id = r.question_id
LEFT JOIN recs m ON m.policy = r.policy AND m.question_id = r.question_id""", X),
    ),
    "run_summary": (
        _run_summary,
        check("""SELECT r.policy, count(*) AS questions, count(*) FILTER (WHERE status <> '보류') AS automatic, count(*) FILTER (WHERE status = '보류') AS held, count(DISTINCT page) AS pages,
 (SELECT count(*) FROM recs x WHERE x.policy = r.policy) AS recommendations, CAST(floor(3600::DOUBLE / count(DISTINCT page) * 1000) AS BIGINT) AS seconds_per_page FROM reviews r WHERE r.policy <> 'none' GROUP BY r.policy""", X),
    ),
}
