"""SQL building blocks of the result checks.

They follow the written rules with plain joins and unions on text answers, and
share nothing with the DataFrame operators except the fixture views.
"""

from __future__ import annotations

import re

from sheetwise.functions.messages import REASON_TEXT
from sheetwise.plans.fixtures import VIEWS

D = "[1-5①②③④⑤]"
FORM = rf"\s*({D}|\({D}\)|{D}\.|[①②③④⑤]{{2,}}|{D}((\s*[,，]\s*|\s+){D})+)\s*"
LEAD = rf"^[ \t]*({D}(\s*[,，]\s*{D})*)"


def overlap(a: str, b: str) -> str:
    return (
        f"greatest({a}.xl, {b}.xl) < least({a}.xr, {b}.xr) "
        f"AND greatest({a}.yt, {b}.yt) < least({a}.yb, {b}.yb)"
    )


def answer(digits: str) -> str:
    """Sorted answer text of a digit run without repeats, else NULL."""
    return (
        f"CASE WHEN length({digits}) > 0 AND len(list_distinct(string_split({digits}, ''))) = length({digits}) "
        f"THEN array_to_string(list_sort(string_split({digits}, '')), ',') END"
    )


def digits_of(text: str) -> str:
    return f"regexp_replace(translate({text}, '①②③④⑤', '12345'), '[^1-5]', '', 'g')"


def size_of(text: str) -> str:
    return f"CAST((length({text}) + 1) / 2 AS INT)"


COUNT_ONLY = r"\s*[（(]?\s*정답\s*(은|[:：])?\s*([1-5한두세네]|다섯)\s*개\s*[)）]?\s*"
COUNT_HEAD = r"^(.*?([?？]|(고르|선택하)(시오|세요)\.?))(\s*[（(]\s*정답[^)）]*[)）])?"

CTES = dict(VIEWS)
CTES["parsed"] = f"""
SELECT *, {answer('digits')} AS parsed FROM (
  SELECT *, CASE WHEN regexp_full_match(txt, '{FORM}') THEN {digits_of('txt')} END AS digits FROM fx_crops) d"""
CTES["classified"] = """
SELECT *, CASE WHEN stage = 0 THEN parsed END AS choice FROM (
 SELECT *, CASE WHEN reason IN ('2', '9') THEN 1 WHEN reason IN ('not_executed', '5', 'score_missing', '6') THEN 2
              WHEN reason = 'candidate' THEN 0 ELSE 3 END AS stage FROM (
  SELECT *, CASE WHEN is_empty THEN '2' WHEN answer_excluded THEN '9' WHEN NOT ocr_executed THEN 'not_executed'
              WHEN trim(txt) = '' THEN '5' WHEN score IS NULL OR NOT isfinite(score) THEN 'score_missing'
              WHEN score < CAST(0.8 AS DOUBLE) THEN '6' WHEN semantic_annotation IS NOT NULL THEN '11'
              WHEN route = 'choice_mark_review' THEN '8' WHEN route <> 'student_candidate' THEN 'route_unknown'
              WHEN parsed IS NULL THEN '7' WHEN ownership_review THEN '15' ELSE 'candidate' END AS reason
  FROM parsed) g) s"""
CTES["blockers"] = f"""
SELECT b.question_id, b.crop_id, b.reason, b.ring_only_answer, b.xl, b.yt, b.xr, b.yb, count(*) AS n_overlaps, b.has_ring AS exempt_broad,
       b.has_ring AND bool_and(b.ring_only_answer OR (b.crop_no + c.crop_no) % 2 = 0) AS exempt_duplicate
FROM classified b JOIN classified c ON c.question_id = b.question_id
WHERE b.reason IN ('6', '7') AND c.stage = 0 AND {overlap('b', 'c')}
GROUP BY b.question_id, b.crop_id, b.reason, b.ring_only_answer, b.has_ring, b.xl, b.yt, b.xr, b.yb"""
CTES["policy_names"] = "SELECT 'none' AS policy UNION ALL SELECT 'broad' UNION ALL SELECT 'duplicate'"
CTES["live_blockers"] = """
SELECT p.policy, b.* FROM blockers b CROSS JOIN policy_names p
WHERE NOT ((p.policy = 'broad' AND exempt_broad) OR (p.policy = 'duplicate' AND exempt_duplicate))"""
CTES["keyed"] = f"""
SELECT *, {answer('field')} AS key_text FROM (
  SELECT *, CASE WHEN regexp_matches(tail, '^[ \\t]*(:|\\r|\\n|$)') AND NOT regexp_matches(tail, '^\\s*[,，①②③④⑤]')
                 THEN {digits_of('lead')} END AS field FROM (
    SELECT *, regexp_extract(answer_key, '{LEAD}', 1) AS lead,
           substr(answer_key, length(regexp_extract(answer_key, '{LEAD}', 0)) + 1) AS tail FROM fx_questions) a) b"""
CTES["counted"] = f"""
SELECT question_id, CASE WHEN len(numbers) = 1 THEN numbers[1] END AS expected_count FROM (
 SELECT question_id, list_distinct(list_transform(list_concat(
    regexp_extract_all(header, '정답\\s*(?:은|[:：])?\\s*(다섯|[1-5한두세네])\\s*개', 1),
    regexp_extract_all(header, '(?:^|[^0-9])(다섯|[1-5한두세네])\\s*개(?:를|씩)?\\s*(?:모두\\s*)?(?:고르|고른|선택)', 1)),
    lambda w: CAST(translate(replace(w, '다섯', '5'), '한두세네', '1234') AS INT))) AS numbers FROM (
  SELECT question_id, CASE WHEN regexp_matches(before, '{COUNT_HEAD}') THEN regexp_extract(before, '{COUNT_HEAD}', 0)
                           WHEN regexp_full_match(before, '{COUNT_ONLY}') THEN before ELSE '' END AS header FROM (
   SELECT question_id, regexp_extract(regexp_replace(trim(source_text), '^\\s*\\d+\\.', ''), '^[^①②③④⑤•]*', 0) AS before
   FROM fx_questions) x) y) z"""
CTES["page_gate"] = """
SELECT page, has_matrix AND inliers > 30 AND isfinite(median_error) AND median_error <= 3 AS page_ok,
       CASE WHEN scan_short_side NOT BETWEEN 2400 AND 2560
            THEN '스캔 해상도 확인 필요: 300dpi로 스캔해 주세요 (현재 짧은 변 ' || scan_short_side || ' px)' END AS resolution
FROM fx_pages"""


def review_ctes(crops: str, blockers: str, prefix: str) -> dict[str, str]:
    """CTEs of one whole review over a classified crop table and a table of
    blockers that still compete per policy."""
    p = prefix
    return {
        f"{p}cand": f"""
SELECT question_id, count(*) AS n_crops, count(*) FILTER (WHERE stage = 0) AS n_cand, count(DISTINCT choice) AS n_sets, min(choice) AS one_set,
       coalesce(bool_or(ownership_review AND stage <> 1), false) AS own
FROM {crops} GROUP BY question_id""",
        f"{p}base": f"""
SELECT n.policy, k.question_id, k.page, k.key_text, e.expected_count, g.page_ok, g.resolution, coalesce(c.n_crops, 0) AS n_crops,
       coalesce(c.n_cand, 0) AS n_cand, coalesce(c.n_sets, 0) AS n_sets, coalesce(c.own, false) AS own,
       CASE WHEN c.n_sets = 1 THEN c.one_set END AS proposed
FROM keyed k CROSS JOIN policy_names n JOIN counted e ON e.question_id = k.question_id
JOIN page_gate g ON g.page = k.page LEFT JOIN {p}cand c ON c.question_id = k.question_id""",
        f"{p}reasons": f"""
SELECT policy, question_id, 1 AS seq, 1 AS stage, '2' AS code, 'D12' AS rule, CAST(NULL AS VARCHAR) AS own_message FROM {p}base WHERE NOT page_ok
UNION ALL SELECT policy, question_id, 2, 3, '15', 'page_ownership', NULL FROM {p}base WHERE page_ok AND own
UNION ALL SELECT DISTINCT policy, b.question_id, 3, 3, '11', 'F10', NULL FROM {p}base b JOIN {crops} r ON r.question_id = b.question_id WHERE page_ok AND r.semantic_annotation IS NOT NULL
UNION ALL SELECT policy, question_id, 4, 4, '10', 'F06', NULL FROM {p}base WHERE page_ok AND n_sets > 1
UNION ALL SELECT DISTINCT policy, b.question_id, 5, 4, '10', 'F06(re-read)', NULL FROM {p}base b JOIN {crops} r ON r.question_id = b.question_id WHERE page_ok AND r.reread_conflict
UNION ALL SELECT policy, question_id, 6, 4, '14', 'F12', NULL FROM {p}base WHERE page_ok AND proposed IS NOT NULL AND expected_count IS NOT NULL AND {size_of('proposed')} <> expected_count
UNION ALL SELECT DISTINCT b.policy, b.question_id, CASE WHEN l.reason = '6' THEN 7 ELSE 8 END, 3, l.reason, 'F08(b)', NULL
   FROM {p}base b JOIN {blockers} l ON l.question_id = b.question_id AND l.policy = b.policy WHERE page_ok AND proposed IS NOT NULL
UNION ALL SELECT DISTINCT policy, b.question_id, o.seq, o.stage, o.code, 'no_candidate', NULL FROM {p}base b JOIN {crops} r ON r.question_id = b.question_id
   JOIN outcome_order o ON o.code = r.reason WHERE page_ok AND n_cand = 0 AND NOT (o.code = '15' AND own)
UNION ALL SELECT policy, question_id, 20, 1, '2', 'no_crop', NULL FROM {p}base WHERE page_ok AND n_crops = 0
UNION ALL SELECT policy, question_id, 21, NULL, '12', 'G03', NULL FROM {p}base WHERE key_text IS NULL
UNION ALL SELECT policy, question_id, 22, 4, '16', 'F12(key-count)', '답 개수 확인 필요 · 답지 정답 ' || {size_of('key_text')} || '개' FROM {p}base
   WHERE page_ok AND proposed IS NOT NULL AND length(key_text) > 1 AND length(proposed) <> length(key_text)
UNION ALL SELECT policy, question_id, 23, 1, '17', 'scan_resolution', resolution FROM {p}base WHERE resolution IS NOT NULL""",
        f"{p}reason_sum": f"""
SELECT policy, question_id, string_agg(code, ',' ORDER BY seq) AS codes, string_agg(rule, ',' ORDER BY seq) AS rules, max(stage) AS stage, count(*) AS n_reasons
FROM {p}reasons GROUP BY policy, question_id""",
        f"{p}reviews": f"""
SELECT b.policy, b.question_id, b.page, b.proposed, b.key_text, b.expected_count, coalesce(s.codes, '') AS codes, coalesce(s.rules, '') AS rules,
       CASE WHEN s.n_reasons IS NULL THEN b.proposed END AS selection,
       CASE WHEN s.n_reasons IS NULL THEN 0 ELSE s.stage END AS stage, coalesce(s.n_reasons, 0) AS n_reasons,
       CASE WHEN s.n_reasons IS NOT NULL THEN '보류' WHEN b.proposed IS NOT DISTINCT FROM b.key_text THEN '정답' ELSE '오답' END AS status
FROM {p}base b LEFT JOIN {p}reason_sum s ON s.policy = b.policy AND s.question_id = b.question_id""",
    }


CTES["outcome_order"] = "SELECT * FROM (VALUES (9,1,'2'),(10,1,'9'),(11,2,'5'),(12,2,'6'),(13,2,'not_executed'),(14,2,'score_missing'),(15,3,'11'),(16,3,'15'),(17,3,'7'),(18,3,'8'),(19,3,'route_unknown')) v(seq, stage, code)"
CTES["reason_text"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in REASON_TEXT.items()) + ") v(code, text)"
CTES.update(review_ctes("classified", "live_blockers", ""))


def check(body: str, extra: dict[str, str] | None = None) -> str:
    """Full SQL: the body behind a WITH list of every block it uses."""
    blocks = {**CTES, **(extra or {})}
    order: list[str] = []
    open_blocks: set[str] = set()  # a recursive block names itself

    def need(text: str) -> None:
        for name in blocks:
            if name not in order and name not in open_blocks and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
                need_block(name)

    def need_block(name: str) -> None:
        open_blocks.add(name)
        need(blocks[name])
        order.append(name)

    need(body)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({blocks[n]})" for n in order) + "\n" + body
