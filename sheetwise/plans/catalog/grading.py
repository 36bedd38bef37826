"""Question review, policies and label comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.functions.answers import answer_string, eligible_answer
from sheetwise.functions.gates import mixed_print
from sheetwise.operators import labels as lab
from sheetwise.operators import policies as pol
from sheetwise.operators import review as rev
from sheetwise.plans.checks import check
from sheetwise.plans.grading import Graded, review_view
from sheetwise.session import materialise

c = F.col
VIEW = "policy, question_id, page, coalesce(proposed, '') AS proposed, coalesce(selection, '') AS selection, codes, rules, coalesce(CAST(stage AS VARCHAR), '') AS stage, status"
COMPARED = """SELECT r.*, q.label_answer, CASE WHEN selection IS NULL THEN '보류' WHEN q.label_answer IS NULL THEN '미확정 답 자동 확정 오류'
 WHEN selection = CAST(q.label_answer AS VARCHAR) THEN '전사 일치' ELSE '전사 불일치' END AS comparison,
 coalesce(CAST(q.label_answer AS VARCHAR) <> key_text AND selection = key_text, false) AS false_correct,
 coalesce(CAST(q.label_answer AS VARCHAR) = key_text AND selection <> key_text, false) AS false_incorrect
FROM reviews r JOIN fx_questions q ON q.question_id = r.question_id"""
NEAR = """SELECT q.question_id AS roi_question, c.* FROM classified c JOIN fx_questions q ON q.page = c.page
 AND (c.xl + c.xr) / 2.0 BETWEEN zl + 20 AND zl + 220 AND (c.yt + c.yb) / 2.0 BETWEEN zt + 10 AND zt + 150"""
X = {"compared": COMPARED, "near": NEAR}


def _compared(t):
    g = Graded(t)
    return g, lab.compare_label(g.reviews(), g.labels)


def _rois(t):
    return t.fx_questions.select(
        "page", "question_id", (c("zl") + 20).alias("roi_l"), (c("zt") + 10).alias("roi_t"),
        (c("zl") + 220).alias("roi_r"), (c("zt") + 150).alias("roi_b"),
    )


def _compare_label(t):
    _, rows = _compared(t)
    return rows.select("policy", "question_id", "comparison", "false_correct", "false_incorrect")


def _policy_diff(t):
    g = Graded(t)
    rows = pol.diff_policies(g.reviews("broad", "duplicate"), g.blockers, "broad", "duplicate")
    return rows.select(
        "question_id", F.coalesce(answer_string(c("selection_a")), F.lit("")).alias("selection_a"),
        F.coalesce(answer_string(c("selection_b")), F.lit("")).alias("selection_b"), "selection_differs",
    )


def _stage_summary(t):
    g, rows = _compared(t)
    rows = materialise(rows, "compared")
    stats = t.fx_stats.select("crop_id", "print_overlap", "largest_residual", "protected_choice")
    classified = g.classified.join(stats, "crop_id").withColumn(
        "mixed_print", mixed_print(c("protected_choice"), c("answer_excluded"), c("print_overlap"), c("largest_residual"))
    )
    return lab.stage_summary(classified, rows, "duplicate", _roi_buckets(t, (g, rows)))


def _roi_review(t):
    near = lab.crops_in_rois(t.fx_crops, _rois(t)).withColumn(
        "digits", eligible_answer(c("txt"), F.lit(1.0), F.lit("student_candidate"))
    )
    rows = lab.roi_review(near, Graded(t).labels)
    return rows.withColumn("numbers", answer_string(c("numbers")))


def _roi_buckets(t, compared=None):
    g, rows = compared or _compared(t)
    near = lab.crops_in_rois(g.classified, _rois(t))
    previous = rows.filter("policy = 'duplicate'").select(
        "question_id", F.when(c("comparison") == lab.MATCH, F.lit("일치")).when(c("comparison") == lab.MISMATCH, F.lit("불일치")).alias("old_status")
    )
    labels = t.fx_questions.select(
        "question_id", F.when(c("question_id") % 37 == 0, F.lit("do_not_know")).otherwise(F.lit("answered")).alias("answer_status")
    )
    conflicts = rows.filter("policy = 'none'").filter(c("fired").bitwiseAND(rev.BIT["F06", "10"]) != 0)
    return lab.roi_buckets(near, previous, labels, conflicts)


def _reproduce(t):
    reviews = materialise(Graded(t).reviews("duplicate"), "reviews")
    stored = reviews.withColumn(
        "status", F.when(c("question_id") % 101 == 0, F.lit("정답")).otherwise(c("status"))
    ).filter("question_id % 211 <> 5")
    return pol.differences(
        reviews, stored, ["policy", "question_id"], ["proposed", "selection", "fired", "stage", "key", "status"]
    )


def _view_filters(t):
    g = Graded(t)
    reviews, base = g.reviews("broad"), g.reviews("none")
    parts = [
        pol.view_filter(reviews, base, view).select(F.lit(view).alias("view"), "question_id")
        for view in ("held", "changed", "count", "all")
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _no_read(t):
    g = Graded(t)
    reviews = g.reviews("broad", "duplicate")
    return pol.no_read_gallery(reviews, rev.reason_crops(reviews, g.classified, g.blockers))


def _scope(t):
    """Requested questions that exist, and requested ones that are missing."""
    from sheetwise.operators.selection import scope_rows

    wanted = t.fx_corrections.select("question_id").distinct()
    return scope_rows(t.fx_questions.select("question_id"), wanted, ["question_id"])


def _top(t):
    return pol.top_hold_reasons(Graded(t).reviews("broad", "duplicate"))


BUCKETS = """SELECT q.question_id, CAST(coalesce(n.n_cross, 0) AS BIGINT) AS n_cross, CASE WHEN q.question_id % 37 = 0 THEN '사용자 확인 특수 표시'
 WHEN EXISTS (SELECT 1 FROM reasons r WHERE r.question_id = q.question_id AND r.rule = 'F06') THEN '4단계 · 사유10 답 후보 충돌'
 WHEN p.comparison = '전사 일치' THEN '기존 채택 · 전사 일치' WHEN p.comparison = '전사 불일치' THEN '기존 채택 · 전사 불일치'
 WHEN n.roi_question IS NULL THEN '답 위치의 조각 없음 · 추출 확인' WHEN n.n_passed > 0 THEN '답 위치 후보 있음 · 소속/통합 확인'
 WHEN n.n_stages = 1 THEN n.one_stage || '단계에서 답 위치 조각 전부 중단' ELSE '답 위치 조각이 여러 단계에서 중단' END AS bucket
FROM fx_questions q JOIN compared p ON p.question_id = q.question_id AND p.policy = 'duplicate'
LEFT JOIN (SELECT roi_question, count(*) FILTER (WHERE question_id <> roi_question) AS n_cross, count(*) FILTER (WHERE stage = 0) AS n_passed,
 count(DISTINCT stage) FILTER (WHERE stage > 0) AS n_stages, min(stage) FILTER (WHERE stage > 0) AS one_stage FROM near GROUP BY roi_question) n ON n.roi_question = q.question_id"""


ENTRIES = {
    "question_review": (
        lambda t: review_view(Graded(t).reviews("none")),
        check(f"SELECT {VIEW} FROM reviews WHERE policy = 'none'"),
    ),
    "policies": (
        lambda t: pol.policy_summary(Graded(t).reviews()),
        check("""SELECT policy, count(*) AS questions, count(*) FILTER (WHERE selection IS NOT NULL) AS automatic, count(*) FILTER (WHERE selection IS NULL) AS held,
 count(*) FILTER (WHERE status = '정답') AS right_answers, count(*) FILTER (WHERE status = '오답') AS wrong_answers,
 count(*) FILTER (WHERE expected_count IS NOT NULL) AS explicit_count, count(*) FILTER (WHERE list_contains(string_split(codes, ','), '14')) AS count_mismatch
FROM reviews GROUP BY policy"""),
    ),
    "policy_reviews": (
        lambda t: review_view(Graded(t).reviews("broad", "duplicate")),
        check(f"SELECT {VIEW} FROM reviews WHERE policy <> 'none'"),
    ),
    "reason_crops": (
        lambda t: (lambda g: rev.reason_crops(g.reviews("none", "duplicate"), g.classified, g.blockers))(Graded(t)),
        check("""SELECT r.policy, r.question_id, r.seq, r.code, r.rule, c.crop_id FROM reasons r JOIN classified c ON c.question_id = r.question_id
 WHERE r.policy <> 'broad' AND ((r.rule = 'page_ownership' AND ownership_review AND c.stage <> 1) OR (r.rule = 'F10' AND semantic_annotation IS NOT NULL)
 OR (r.rule IN ('F06', 'F12', 'F12(key-count)') AND c.stage = 0) OR (r.rule = 'F06(re-read)' AND reread_conflict) OR (r.rule = 'no_candidate' AND c.reason = r.code))
UNION ALL SELECT r.policy, r.question_id, r.seq, r.code, r.rule, l.crop_id FROM reasons r JOIN live_blockers l ON l.policy = r.policy AND l.question_id = r.question_id AND l.reason = r.code
 WHERE r.policy <> 'broad' AND r.rule = 'F08(b)'"""),
    ),
    "conflict": (
        lambda t: rev.classify_crops(t.fx_crops).filter("stage = 0").groupBy("question_id").agg((F.min("choice") != F.max("choice")).alias("conflict")),
        check("SELECT question_id, count(DISTINCT choice) > 1 AS conflict FROM classified WHERE stage = 0 GROUP BY question_id"),
    ),
    "f08_pairs": (
        lambda t: Graded(t).blockers.select("question_id", "crop_id", "reason", "n_overlaps"),
        check("SELECT question_id, crop_id, reason, n_overlaps FROM blockers"),
    ),
    "exemptions": (
        lambda t: rev.exemptions(Graded(t).blockers),
        check("""SELECT 'broad' AS policy, question_id, crop_id FROM blockers WHERE exempt_broad
UNION ALL SELECT 'duplicate', question_id, crop_id FROM blockers WHERE exempt_duplicate"""),
    ),
    "policy_diff": (
        _policy_diff,
        check("""SELECT a.question_id, coalesce(a.selection, '') AS selection_a, coalesce(b.selection, '') AS selection_b, a.selection IS DISTINCT FROM b.selection AS selection_differs
FROM reviews a JOIN reviews b ON a.question_id = b.question_id AND a.policy = 'broad' AND b.policy = 'duplicate'
WHERE a.selection IS DISTINCT FROM b.selection OR a.codes <> b.codes OR EXISTS (SELECT 1 FROM blockers x JOIN reasons r ON r.question_id = x.question_id AND r.rule = 'F08(b)' AND r.code = x.reason
 AND r.policy = CASE WHEN x.exempt_broad THEN 'duplicate' ELSE 'broad' END WHERE x.question_id = a.question_id AND x.exempt_broad <> x.exempt_duplicate)"""),
    ),
    "compare_label": (
        _compare_label,
        check("SELECT policy, question_id, comparison, false_correct, false_incorrect FROM compared", X),
    ),
    "verdict_matrix": (
        lambda t: lab.verdict_matrix(_compared(t)[1]),
        check("""SELECT policy, truth, count(*) FILTER (WHERE status = '정답') AS confirmed_right, count(*) FILTER (WHERE status = '오답') AS confirmed_wrong,
 count(*) FILTER (WHERE status = '보류') AS held, truth = 'right' OR count(*) FILTER (WHERE status = '정답') = 0 AS gate_ok
FROM (SELECT *, CASE WHEN CAST(label_answer AS VARCHAR) = key_text THEN 'right' ELSE 'wrong' END AS truth FROM compared WHERE label_answer IS NOT NULL AND key_text IS NOT NULL) q GROUP BY policy, truth""", X),
    ),
    "stage_summary": (
        _stage_summary,
        check("""SELECT kind, name, count(*) AS n FROM (
SELECT 'bucket' AS kind, bucket AS name FROM buckets UNION ALL SELECT 'total', 'crossed_question_cases' FROM buckets WHERE n_cross > 0
UNION ALL SELECT 'region', reason FROM classified UNION ALL SELECT 'region_stage', CAST(stage AS VARCHAR) FROM classified
UNION ALL SELECT 'total', 'recognised_on_stage1' FROM classified WHERE stage = 1 AND ocr_executed
UNION ALL SELECT 'review', status FROM compared WHERE policy = 'duplicate'
UNION ALL SELECT 'review_stage', coalesce(CAST(stage AS VARCHAR), 'None') FROM compared WHERE policy = 'duplicate'
UNION ALL SELECT 'comparison', comparison FROM compared WHERE policy = 'duplicate'
UNION ALL SELECT 'total', 'false_correct' FROM compared WHERE policy = 'duplicate' AND false_correct
UNION ALL SELECT 'total', 'false_incorrect' FROM compared WHERE policy = 'duplicate' AND false_incorrect
UNION ALL SELECT 'reason', code FROM (SELECT DISTINCT question_id, code FROM reasons WHERE policy = 'duplicate') a
UNION ALL SELECT 'rule', rule FROM (SELECT DISTINCT question_id, rule FROM reasons WHERE policy = 'duplicate') b
UNION ALL SELECT 'total', 'mixed_candidate_questions' FROM mixed
UNION ALL SELECT 'total', 'mixed_candidate_errors' FROM mixed m JOIN compared r ON r.question_id = m.question_id WHERE r.policy = 'duplicate' AND r.comparison IN ('전사 불일치', '미확정 답 자동 확정 오류')) u
GROUP BY kind, name""", {**X, "mixed": """SELECT DISTINCT c.question_id FROM classified c JOIN fx_stats s ON s.crop_id = c.crop_id
 WHERE c.stage = 0 AND NOT s.protected_choice AND NOT s.answer_excluded AND s.print_overlap >= CAST(0.2 AS DOUBLE) AND s.largest_residual > 12""", "buckets": BUCKETS}),
    ),
    "by_page": (
        lambda t: pol.status_by_page(Graded(t).reviews()).withColumn("page", F.coalesce("page", F.lit(-1))),
        check("""SELECT a.*, b.right_answers AS base_right, b.held AS base_held FROM counts a JOIN counts b ON b.page = a.page AND b.policy = 'none'""", {"counts": """
SELECT policy, coalesce(page, -1) AS page, count(*) FILTER (WHERE status = '정답') AS right_answers, count(*) FILTER (WHERE status = '오답') AS wrong_answers,
 count(*) FILTER (WHERE status = '보류') AS held FROM reviews GROUP BY GROUPING SETS ((policy, page), (policy))"""}),
    ),
    "top_reasons": (
        _top,
        check("""SELECT q.policy, q.code, questions, place, t.text AS message FROM (SELECT policy, code, count(*) AS questions, CAST(row_number() OVER (PARTITION BY policy ORDER BY count(*) DESC, code) AS INT) AS place
 FROM (SELECT DISTINCT policy, question_id, code FROM reasons WHERE policy <> 'none') d GROUP BY policy, code) q JOIN reason_text t ON t.code = q.code WHERE place <= 5"""),
    ),
    "reproduce": (
        _reproduce,
        check("""SELECT policy, question_id, CASE WHEN question_id % 211 = 5 THEN 'added' ELSE 'changed' END AS change FROM reviews
WHERE policy = 'duplicate' AND (question_id % 211 = 5 OR (question_id % 101 = 0 AND status <> '정답'))"""),
    ),
    "view_filters": (
        _view_filters,
        check("""SELECT 'held' AS view, question_id FROM reviews WHERE policy = 'broad' AND status = '보류'
UNION ALL SELECT 'count', question_id FROM reviews WHERE policy = 'broad' AND expected_count IS NOT NULL
UNION ALL SELECT 'all', question_id FROM reviews WHERE policy = 'broad'
UNION ALL SELECT 'changed', a.question_id FROM reviews a JOIN reviews b ON a.question_id = b.question_id AND a.policy = 'broad' AND b.policy = 'none' WHERE a.codes <> b.codes"""),
    ),
    "no_read": (
        _no_read,
        check("""SELECT DISTINCT r.policy, r.question_id, r.page, c.crop_id FROM reviews r JOIN reasons s ON s.policy = r.policy AND s.question_id = r.question_id AND s.code = '5'
 JOIN classified c ON c.question_id = r.question_id AND c.reason = '5' WHERE r.policy <> 'none' AND r.status = '보류'"""),
    ),
    "scope": (
        _scope,
        check("""SELECT question_id, false AS missing FROM fx_questions WHERE question_id IN (SELECT question_id FROM fx_corrections)
UNION ALL SELECT DISTINCT question_id, true FROM fx_corrections WHERE question_id NOT IN (SELECT question_id FROM fx_questions)"""),
    ),
    "roi_review": (
        _roi_review,
        check("""SELECT q.question_id, coalesce(n.numbers, '') AS numbers, coalesce(n.n_crops, 0) AS n_crops, CASE WHEN label_answer IS NULL THEN 'special'
 WHEN coalesce(n.numbers, '') = '' THEN 'no_numeric_read' WHEN n.numbers = CAST(label_answer AS VARCHAR) THEN 'match' ELSE 'mismatch' END AS status
FROM fx_questions q LEFT JOIN (SELECT roi_question, count(DISTINCT crop_id) AS n_crops, coalesce(string_agg(DISTINCT d, ',' ORDER BY d) FILTER (WHERE d <> '' AND regexp_full_match(txt, '[\\s①②③④⑤1-5,，().]+')), '') AS numbers
 FROM (SELECT roi_question, crop_id, txt, unnest(list_concat([''], string_split(regexp_replace(translate(txt, '①②③④⑤', '12345'), '[^1-5]', '', 'g'), ''))) AS d FROM near) u GROUP BY roi_question) n ON n.roi_question = q.question_id""", X),
    ),
    "roi_buckets": (_roi_buckets, check(BUCKETS, X)),
}
