"""Result contract, corrections, export and stored evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators.review import reason_array, reason_crops, reasons_long
from sheetwise.operators.selection import coverage
from sheetwise.functions.gates import safe_image_path
from sheetwise.functions.messages import reason_message
from sheetwise.plans.checks import check
from sheetwise.plans.grading import Graded
from sheetwise.session import materialise, scratch_path
from sheetwise.sources import documents
from sheetwise.sources import manifests as mf
from sheetwise.sources import results as rs

c = F.col

DOC_Q = r"""
SELECT question_id, page, CAST(CASE WHEN question_id % 61 = 7 THEN question_id - 1 ELSE question_id END AS VARCHAR(20)) AS id, CASE WHEN question_id % 53 = 0 THEN ' ' ELSE 'L' END AS label,
 CASE WHEN question_id % 47 = 0 THEN '???' WHEN question_id % 3 = 0 THEN '보류' WHEN question_id % 3 = 1 THEN '정답' ELSE '오답' END AS judgement,
 CASE WHEN question_id % 5 = 0 THEN NULL ELSE CAST(label_answer AS VARCHAR(2)) END AS read_answer, '3' AS answer_key,
 CASE WHEN question_id % 43 = 0 THEN 7 WHEN question_id % 3 = 0 THEN 4 ELSE NULL END AS review_stage, question_id % 3 = 0 AND question_id % 41 <> 0 AS has_reason,
 CASE WHEN question_id % 37 = 0 THEN '' ELSE 'm' END AS message, CASE WHEN question_id % 59 = 0 THEN 9 ELSE 4 END AS reason_stage,
 CASE question_id % 13 WHEN 0 THEN '../up.png' WHEN 1 THEN 'a/b.gif' WHEN 2 THEN 'a//b.png' ELSE 'evidence/x.png' END AS path, CASE WHEN question_id % 31 = 0 THEN 'e1' ELSE 'e2' END AS second_id FROM fx_questions"""
X = {
    "doc_q": DOC_Q,
    "latest_valid": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY updated_at DESC, edit_id DESC) AS rn FROM fx_corrections WHERE judgement <> '???') q WHERE rn = 1",
    "latest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY updated_at DESC, edit_id DESC) AS rn FROM fx_corrections) q WHERE rn = 1",
}


def doc_rows(t):
    """One result document per page, with violations of every kind."""
    q = t.sql(DOC_Q)
    reason = F.struct(F.lit("F").alias("code"), "message", c("reason_stage").alias("stage"))
    image = lambda ident, path: F.struct(ident.alias("id"), F.lit("x").alias("label"), path.alias("path"))
    item = F.struct(
        "id", "label", "judgement", "read_answer", "answer_key", "review_stage", F.lit("r1").alias("rules_version"),
        F.when(c("has_reason"), F.array(reason)).otherwise(F.array().cast("array<struct<code:string,message:string,stage:int>>")).alias("reasons"),
        F.array(image(F.lit("e1"), F.lit("evidence/y.jpg")), image(c("second_id"), c("path"))).alias("evidence_images"),
    )
    docs = q.groupBy("page").agg(F.sort_array(F.collect_list(item)).alias("questions"))
    head = F.struct(
        F.when(c("page") % 29 == 0, 2).otherwise(1).alias("schema_version"), F.concat(F.lit("A"), "page").alias("assessment_id"), F.lit("R1").alias("result_id"),
        F.when(c("page") % 23 == 0, F.lit("2026-09-27T10:00:00")).otherwise(F.lit("2026-09-27T10:00:00+09:00")).alias("generated_at"),
        F.when(c("page") % 19 == 0, F.lit("")).otherwise(F.lit("T")).alias("title"), "questions",
    )
    return docs.select(c("page").cast("string").alias("doc_id"), F.to_json(head, {"ignoreNullFields": "false"}).alias("raw"))


def _result_questions(t):
    """Documents written as JSON lines and read back."""
    path = scratch_path(t.spark, "documents")
    doc_rows(t).select("raw").write.text(path)
    docs = t.spark.read.text(path).select(F.get_json_object("value", "$.assessment_id").alias("doc_id"), c("value").alias("raw"))
    questions = rs.result_questions(rs.parse_results(docs))
    return questions.select(
        "doc_id", c("q.id").alias("id"), "q.judgement", F.coalesce("q.read_answer", F.lit("null")).alias("read_answer"),
        F.coalesce("q.review_stage", F.lit(0)).alias("review_stage"), F.size("q.reasons").alias("n_reasons"), F.size("q.evidence_images").alias("n_images"),
    )


def _dup_keys(t):
    raw = F.when(c("question_id") % 5 == 0, F.concat(F.lit('{"a":{"id":'), "question_id", F.lit(',"id":2}}'))).when(
        c("question_id") % 7 == 0, F.lit('{"a":')).otherwise(F.concat(F.lit('{"a":{"id":'), "question_id", F.lit("}}")))
    return rs.reject_duplicate_keys(t.fx_questions.select("question_id", raw.alias("raw"))).select("question_id", "valid")


def correction_docs(t):
    last = rs.latest_correction(t.fx_corrections)
    stamp = F.concat(F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(c("edit_id") % 11 == 0, F.lit("")).otherwise(F.lit("+09:00")))
    edit = F.struct(
        "read_answer", "judgement", F.when(c("edit_id") % 7 != 0, F.lit("n")).alias("note"), stamp.alias("updated_at"),
        F.lit("R1").alias("based_on_result_id"), F.when(c("edit_id") % 13 == 0, F.lit(" ")).otherwise(F.lit("r1")).alias("based_on_rules_version"),
    )
    page = F.floor(c("question_id") / 8)
    docs = last.groupBy(page.alias("page")).agg(F.map_from_entries(F.collect_list(F.struct(c("question_id").cast("string"), edit))).alias("corrections"))
    doc = F.struct(F.when(c("page") % 17 == 0, 2).otherwise(1).alias("schema_version"), F.concat(F.lit("A"), F.when(c("page") % 21 == 0, F.lit(-1)).otherwise(c("page"))).alias("assessment_id"), "corrections")
    return docs.select(c("page").cast("string").alias("doc_id"), F.concat(F.lit("A"), "page").alias("assessment_id"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("raw"))


PATHS = ["a/b.png", "a/b.JPG", "../b.png", "a/./b.png", "/a.png", "a//b.png", "c:/b.png", "a\\\\b.png", "a/b .png", "a /b.png", "a/b.gif", "a/.png", "x.jpeg", "a/b.png "]


def _safe_paths(t):
    paths = F.array(*(F.lit(p.replace("\\\\", "\\")) for p in PATHS))
    return t.fx_crops.select("crop_id", safe_image_path(F.element_at(paths, (c("crop_id") % len(PATHS) + 1).cast("int"))).alias("safe"))


def _overlay(t):
    reviews = Graded(t).reviews("duplicate")
    from sheetwise.functions.answers import answer_string

    results = reviews.select("question_id", answer_string(c("proposed")).alias("read_answer"), c("status").alias("judgement"))
    edits = rs.latest_correction(t.fx_corrections.filter(c("judgement").isin(*rs.JUDGEMENTS)))
    return rs.overlay_corrections(results, edits).withColumn("effective_answer", F.coalesce("effective_answer", F.lit("null")))


def _write_guard(t):
    pages = t.fx_pages
    stored = pages.filter("page % 3 <> 0").select(c("page").alias("target"), F.concat(F.lit("A"), F.when(c("page") % 11 == 0, 0).otherwise(c("page"))).alias("assessment_id"), F.lit("R1").alias("result_id"))
    new = pages.select(c("page").alias("target"), F.concat(F.lit("A"), "page").alias("assessment_id"), F.when(c("page") % 7 == 0, F.lit("R1")).otherwise(F.lit("R2")).alias("result_id"))
    return rs.write_conflicts(new, stored)


def _written(t):
    """Two runs written over each other: the second replaces only its assessments."""
    path = scratch_path(t.spark, "results")
    rows = t.fx_questions.select("question_id", c("page").alias("target"), (c("page") % 40).cast("string").alias("assessment_id"))
    first = rows.withColumn("target", c("assessment_id")).withColumn("result_id", F.lit("R1"))
    rs.write_results(first, path)
    rs.write_results(first.filter("CAST(assessment_id AS INT) % 4 = 1").withColumn("result_id", F.lit("R2")), path)
    return t.spark.read.parquet(path).groupBy(c("assessment_id").cast("int").alias("assessment"), "result_id").agg(F.count(F.lit(1)).alias("n"))


def _manifest(t):
    rows = t.fx_crops.select(c("crop_id").cast("string").alias("path"), F.sha2("txt", 256).alias("sha256"), "crop_id", "txt")
    after = rows.filter("crop_id % 19 <> 0").select("path", F.when(c("crop_id") % 23 == 0, F.sha2(F.concat("txt", F.lit("!")), 256)).otherwise(c("sha256")).alias("sha256"))
    return mf.manifest_diff(rows.filter("crop_id % 29 <> 0").select("path", "sha256"), after)


def _scan_range(t):
    number = F.lpad((c("page") % 40 + 1).cast("string"), 4, "0")
    files = t.fx_pages.filter("page % 77 <> 5").select(
        F.floor(c("page") / 40).alias("folder"), F.explode(F.when(c("page") % 91 == 3, F.array(F.lit(""), F.lit("-b"))).otherwise(F.array(F.lit("")))).alias("tag"), number.alias("number")
    ).select("folder", F.concat(F.when(c("folder") == 3, F.lit("book")).otherwise(F.lit("scan")), "tag", "number", F.lit(".jpg")).alias("name"))
    mappings = t.spark.sql("""SELECT * FROM VALUES ('A', 'scan', 1, 40, CAST(NULL AS BIGINT)), ('B', 'old', 1, 20, NULL), ('C', 'book', 1, 20, 3), ('D', 'zzz', 5, 9, 4), ('E', 'zzz', 1, 2, 4)
        AS m(mapping_id, prefix, first, last, known_folder)""")
    return mf.select_scan_range(files, mappings).select("folder", F.coalesce("mapping_id", F.lit("")).alias("mapping_id"), F.coalesce("problem", F.lit("")).alias("problem"))


def _content(t):
    rows = t.fx_crops.select("crop_id", F.concat("txt", F.lit("|"), c("crop_id") % 50).alias("image"))
    store, references = mf.content_store(rows, "image", ["crop_id"])
    return references.join(store, "digest").groupBy("image", "uses").agg(F.count(F.lit(1)).alias("n"), F.min("crop_id").alias("first_crop"))


def export_tables(t):
    g = Graded(t)
    reviews = materialise(g.reviews("duplicate"), "reviews")
    readings = g.stored.fx_readings.withColumn("path", F.concat(F.lit("evidence/"), "crop_id", F.lit("-"), F.when(c("stage_no") > 3, F.lit("D")).otherwise(c("stage")), F.lit("-"), "variant_no", F.lit(".png")))
    crops = g.stored.fx_crops.select("crop_id", F.concat(F.lit("evidence/"), "crop_id", F.lit(".png")).alias("path"), c("txt").alias("shown_text"), c("score").alias("shown_score"))
    candidates = g.classified.filter("stage = 0").select(F.lit("duplicate").alias("policy"), "question_id", "crop_id")
    return reviews, rs.evidence_rows(reviews, candidates, reason_crops(reviews, g.classified, g.blockers), crops, rs.retry_evidence(readings))


def _export(t):
    reviews = Graded(t).reviews("duplicate")
    shown = F.array_join(F.transform(reason_array(), lambda r: F.concat(r.code, F.lit("="), reason_message(r.code))), ";")
    return rs.result_rows(reviews, shown, "rules-1").select(
        "question_id", "label", "judgement", F.coalesce("read_answer", F.lit("null")).alias("read_answer"), F.coalesce("answer_key", F.lit("null")).alias("answer_key"),
        F.coalesce("review_stage", F.lit(0)).alias("review_stage"), "reasons", "rules_version",
    )


def _documents(t):
    """Exported documents parsed again: questions per assessment."""
    rows = _export(t).withColumn("assessment_id", F.concat(F.lit("A"), F.floor(c("question_id") / 800)))
    docs = rs.assemble_documents(rows, ["assessment_id"])
    return docs.select(
        F.get_json_object("raw", "$.assessment_id").alias("assessment_id"), F.get_json_object("raw", "$.schema_version").alias("version"),
        F.size(F.from_json(F.get_json_object("raw", "$.questions"), "array<struct<question_id:bigint>>")).alias("n"),
    ).groupBy("assessment_id", "version").agg(F.sum("n").cast("bigint").alias("questions"))


def _written_documents(t):
    """Documents in the file contract, written, read back and judged."""
    reviews, evidence = export_tables(t)
    named = lambda df: df.withColumn("assessment_id", F.concat(F.lit("A"), F.floor(c("question_id") / 800)))
    questions = named(rs.result_rows(reviews, reason_array(), "rules-1").drop("reasons"))
    results = questions.select("assessment_id").distinct().select(
        "assessment_id", F.concat(F.lit("R-"), "assessment_id").alias("result_id"), F.lit("2026-09-27T10:00:00+09:00").alias("generated_at"), F.lit("T").alias("title"))
    path = scratch_path(t.spark, "documents")
    documents.write_documents(results, questions, named(reasons_long(reviews)), named(evidence), path, compression="gzip")
    parsed = rs.parse_results(rs.read_documents(t.spark, f"{path}/*/*.txt.gz"))
    bad = rs.validate_result(parsed).groupBy("doc_id").agg(F.count(F.lit(1)).alias("violations"))
    rows = rs.result_questions(parsed).select("doc_id", "assessment_id", "result_id", "q.*")
    return rows.groupBy("doc_id", "assessment_id", "result_id").agg(
        F.count(F.lit(1)).alias("questions"), F.count("read_answer").alias("answers"), F.sum(F.size("reasons")).alias("reasons"),
        F.min(F.size("evidence_images")).alias("least_images"), F.count(F.when(c("judgement") == "보류", 1)).alias("held"),
    ).join(bad, "doc_id", "left").select(
        "assessment_id", "result_id", "questions", "answers", "reasons", (c("least_images") > 0).alias("has_images"), "held", F.coalesce("violations", F.lit(0)).alias("violations"))


ENTRIES = {
    "written_documents": (
        _written_documents,
        check("""SELECT 'A' || r.question_id // 800 AS assessment_id, 'R-A' || r.question_id // 800 AS result_id, count(*) AS questions, count(r.proposed) AS answers,
 CAST(sum(coalesce(s.n, 0)) AS BIGINT) AS reasons, true AS has_images, count(*) FILTER (WHERE r.status = '보류') AS held, CAST(0 AS BIGINT) AS violations
FROM reviews r LEFT JOIN (SELECT question_id, count(*) AS n FROM reasons WHERE policy = 'duplicate' GROUP BY 1) s ON s.question_id = r.question_id WHERE r.policy = 'duplicate' GROUP BY 1, 2""", X),
    ),
    "result_questions": (
        _result_questions,
        check("""SELECT 'A' || page AS doc_id, id, judgement, coalesce(read_answer, 'null') AS read_answer, coalesce(review_stage, 0) AS review_stage, CASE WHEN has_reason THEN 1 ELSE 0 END AS n_reasons, 2 AS n_images FROM doc_q""", X),
    ),
    "dup_keys": (_dup_keys, check("SELECT question_id, question_id % 5 <> 0 AND question_id % 7 <> 0 AS valid FROM fx_questions")),
    "validate_result": (
        lambda t: rs.validate_result(rs.parse_results(doc_rows(t))),
        check("""SELECT DISTINCT CAST(page AS VARCHAR) AS doc_id, '' AS question_id, 'version' AS rule FROM doc_q WHERE page % 29 = 0
UNION ALL SELECT DISTINCT CAST(page AS VARCHAR), '', 'generated_at' FROM doc_q WHERE page % 23 = 0 UNION ALL SELECT DISTINCT CAST(page AS VARCHAR), '', 'title' FROM doc_q WHERE page % 19 = 0
UNION ALL SELECT CAST(page AS VARCHAR), id, 'label' FROM doc_q WHERE label = ' ' UNION ALL SELECT CAST(page AS VARCHAR), id, 'judgement' FROM doc_q WHERE judgement = '???'
UNION ALL SELECT CAST(page AS VARCHAR), id, 'review_stage' FROM doc_q WHERE review_stage = 7 UNION ALL SELECT CAST(page AS VARCHAR), id, 'held_without_reason' FROM doc_q WHERE judgement = '보류' AND NOT has_reason
UNION ALL SELECT CAST(page AS VARCHAR), id, 'duplicate_question' FROM doc_q GROUP BY page, id HAVING count(*) > 1
UNION ALL SELECT CAST(page AS VARCHAR), id, 'reason_text' FROM doc_q WHERE has_reason AND message = '' UNION ALL SELECT CAST(page AS VARCHAR), id, 'reason_stage' FROM doc_q WHERE has_reason AND reason_stage = 9
UNION ALL SELECT CAST(page AS VARCHAR), id, 'image_path' FROM doc_q WHERE question_id % 13 < 3
UNION ALL SELECT CAST(page AS VARCHAR), id, 'duplicate_evidence' FROM (SELECT page, id, 'e1' AS e FROM doc_q UNION ALL SELECT page, id, second_id FROM doc_q) u GROUP BY page, id, e HAVING count(*) > 1""", X),
    ),
    "validate_corrections": (
        lambda t: rs.validate_corrections(correction_docs(t)),
        check("""SELECT DISTINCT CAST(question_id // 8 AS VARCHAR) AS doc_id, '' AS question_id, 'version' AS rule FROM latest WHERE (question_id // 8) % 17 = 0
UNION ALL SELECT DISTINCT CAST(question_id // 8 AS VARCHAR), '', 'assessment_id' FROM latest WHERE (question_id // 8) % 21 = 0
UNION ALL SELECT CAST(question_id // 8 AS VARCHAR), CAST(question_id AS VARCHAR), 'judgement' FROM latest WHERE judgement = '???' UNION ALL SELECT CAST(question_id // 8 AS VARCHAR), CAST(question_id AS VARCHAR), 'note' FROM latest WHERE edit_id % 7 = 0
UNION ALL SELECT CAST(question_id // 8 AS VARCHAR), CAST(question_id AS VARCHAR), 'updated_at' FROM latest WHERE edit_id % 11 = 0 UNION ALL SELECT CAST(question_id // 8 AS VARCHAR), CAST(question_id AS VARCHAR), 'based_on' FROM latest WHERE edit_id % 13 = 0""", X),
    ),
    "safe_paths": (_safe_paths, check("SELECT crop_id, crop_id % 14 IN (0, 1, 8, 12) AS safe FROM fx_crops")),
    "latest_correction": (
        lambda t: rs.latest_correction(t.fx_corrections).select("question_id", "edit_id", "judgement", F.coalesce("read_answer", F.lit("")).alias("read_answer")),
        check("SELECT question_id, edit_id, judgement, coalesce(read_answer, '') AS read_answer FROM latest", X),
    ),
    "overlay": (
        _overlay,
        check("""SELECT coalesce(r.question_id, e.question_id) AS question_id, coalesce(CASE WHEN e.question_id IS NOT NULL THEN e.read_answer ELSE r.proposed END, 'null') AS effective_answer, coalesce(e.judgement, r.status) AS effective_judgement,
 r.question_id IS NOT NULL AND e.question_id IS NOT NULL AND (e.read_answer IS DISTINCT FROM r.proposed OR e.judgement <> r.status) AS differs, r.question_id IS NULL AS orphan
FROM (SELECT * FROM reviews WHERE policy = 'duplicate') r FULL JOIN latest_valid e ON e.question_id = r.question_id""", X),
    ),
    "write_guard": (
        _write_guard,
        check("""SELECT page AS target, 'A' || page AS assessment_id, CASE WHEN page % 7 = 0 THEN 'R1' ELSE 'R2' END AS result_id, CASE WHEN page % 11 = 0 AND page <> 0 THEN 'other_assessment' ELSE 'result_id_reused' END AS problem
FROM fx_pages WHERE page % 3 <> 0 AND (page % 11 = 0 OR page % 7 = 0)"""),
    ),
    "written_results": (
        _written,
        check("SELECT CAST(page % 40 AS INT) AS assessment, CASE WHEN page % 40 % 4 = 1 THEN 'R2' ELSE 'R1' END AS result_id, count(*) AS n FROM fx_questions GROUP BY 1, 2"),
    ),
    "manifest_diff": (
        _manifest,
        check("""SELECT CAST(crop_id AS VARCHAR) AS path, CASE WHEN crop_id % 19 = 0 THEN 'missing' WHEN crop_id % 29 = 0 THEN 'added' ELSE 'changed' END AS change FROM fx_crops
WHERE NOT (crop_id % 19 = 0 AND crop_id % 29 = 0) AND (crop_id % 19 = 0 OR crop_id % 29 = 0 OR crop_id % 23 = 0)"""),
    ),
    "scan_range": (
        _scan_range,
        check("""SELECT CAST(k.folder AS BIGINT) AS folder, CASE WHEN problem = '' THEN CASE WHEN k.folder = 3 THEN 'C' ELSE 'A' END ELSE '' END AS mapping_id, problem FROM (
SELECT folder, CASE WHEN folder = 4 THEN 'two_known_mappings' WHEN count(*) FILTER (WHERE n > lim_lo AND n <= lim AND twice) > 0 THEN 'repeated_number' WHEN count(*) FILTER (WHERE n <= lim) <> max(lim) THEN 'no_single_fit' ELSE '' END AS problem FROM (
 SELECT page // 40 AS folder, page % 40 + 1 AS n, page % 91 = 3 AS twice, CASE WHEN page // 40 = 3 THEN 20 ELSE 40 END AS lim, 0 AS lim_lo FROM fx_pages WHERE page % 77 <> 5) f GROUP BY folder) k"""),
    ),
    "content_dedup": (
        _content,
        check("SELECT txt || '|' || crop_id % 50 AS image, count(*) AS uses, count(*) AS n, min(crop_id) AS first_crop FROM fx_crops GROUP BY 1"),
    ),
    "coverage": (
        lambda t: coverage(t.fx_questions, t.fx_corrections, ["question_id"]),
        check("""SELECT coalesce(a.question_id, b.question_id) AS question_id, CASE WHEN a.n IS NULL THEN 'missing_left' WHEN b.n IS NULL THEN 'missing_right' ELSE 'duplicate' END AS problem, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right
FROM (SELECT question_id, count(*) AS n FROM fx_questions GROUP BY 1) a FULL JOIN (SELECT question_id, count(*) AS n FROM fx_corrections GROUP BY 1) b ON a.question_id = b.question_id WHERE a.n IS NULL OR b.n IS NULL OR a.n > 1 OR b.n > 1"""),
    ),
    "export_result": (
        _export,
        check("""SELECT r.question_id, r.page || '쪽 · ' || r.question_id AS label, r.status AS judgement, coalesce(r.proposed, 'null') AS read_answer, coalesce(r.key_text, 'null') AS answer_key, coalesce(r.stage, 0) AS review_stage,
 coalesce((SELECT string_agg(s.code || '=' || m.text, ';' ORDER BY s.seq) FROM reasons s JOIN reason_text m ON m.code = s.code WHERE s.policy = 'duplicate' AND s.question_id = r.question_id), '') AS reasons, 'rules-1' AS rules_version
FROM reviews r WHERE r.policy = 'duplicate'"""),
    ),
    "export_evidence": (
        lambda t: export_tables(t)[1],
        check("""SELECT 'duplicate' AS policy, question_id, arg_min(crop_id, (crop_id, retry_no)) AS crop_id, CAST(arg_min(retry_no, (crop_id, retry_no)) AS INT) AS retry_no, arg_min(image_id, (crop_id, retry_no, image_id)) AS image_id, path, string_agg(label, ' · ' ORDER BY crop_id, retry_no, label) AS label FROM (
SELECT question_id, CAST(-1 AS BIGINT) AS crop_id, 0 AS retry_no, 'context' AS image_id, 'contexts/' || question_id || '.jpg' AS path, '학생 원래 문항' AS label FROM fx_questions
UNION ALL SELECT n.question_id, c.crop_id, 0, CAST(c.crop_id AS VARCHAR), 'evidence/' || c.crop_id || '.png', 'OCR 조각 ' || c.crop_id || ' · 읽은 내용 ' || CASE WHEN txt = '' THEN '없음' ELSE txt END || ' · ' || CASE WHEN score IS NULL THEN '미실행' WHEN isnan(score) THEN '점수 nan' ELSE printf('점수 %.3f', score) END FROM named n JOIN fx_crops c ON c.crop_id = n.crop_id
UNION ALL SELECT n.question_id, r.crop_id, stage_no * 10 + variant_no, r.crop_id || '-retry-' || stage || '-' || variant_no, 'evidence/' || r.crop_id || '-' || CASE WHEN stage_no > 3 THEN 'D' ELSE stage END || '-' || variant_no || '.png',
 CASE stage WHEN 'peel' THEN '테두리 제거' WHEN 'B' THEN printf('테두리 제거 폭 %.1f', param) WHEN 'C' THEN '네모 제거 · 위아래 여백 ' || CAST(param AS INT) || 'px' ELSE '동그라미까지 제거 · 위아래 여백 ' || CAST(param AS INT) || 'px' END || ' · 읽은 내용 ' || txt || printf(' · 점수 %.3f', score)
 FROM named n JOIN fx_readings r ON r.crop_id = n.crop_id) u GROUP BY question_id, path""", {**X, "named": """SELECT question_id, crop_id FROM classified WHERE stage = 0
UNION SELECT c.question_id, c.crop_id FROM reasons r JOIN classified c ON c.question_id = r.question_id WHERE r.policy = 'duplicate' AND ((r.rule = 'page_ownership' AND ownership_review AND c.stage <> 1) OR (r.rule = 'F10' AND semantic_annotation IS NOT NULL)
 OR (r.rule = 'F06(re-read)' AND reread_conflict) OR (r.rule = 'no_candidate' AND c.reason = r.code))
UNION SELECT r.question_id, l.crop_id FROM reasons r JOIN live_blockers l ON l.policy = r.policy AND l.question_id = r.question_id AND l.reason = r.code WHERE r.policy = 'duplicate' AND r.rule = 'F08(b)'"""}),
    ),
    "export_documents": (
        _documents,
        check("SELECT 'A' || question_id // 800 AS assessment_id, '1' AS version, count(*) AS questions FROM fx_questions GROUP BY 1"),
    ),
}
