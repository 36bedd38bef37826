"""Ownership from geometry, and the grade on the computed owner."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import ownership as own
from sheetwise.plans.checks import check, overlap, review_ctes
from sheetwise.plans.grading import associations, owned_reviews, ownership_tables, review_view
from sheetwise.plans.catalog.grading import VIEW

c = F.col

ZONED = """SELECT question_id, page, zl, zt, zr, CASE WHEN zt = max(zt) OVER (PARTITION BY page, zl, zr) THEN 1800 + page % 3 ELSE zb END AS zb FROM fx_questions"""
HITS = """SELECT c.crop_id, z.question_id, (least(xr, zr) - greatest(xl, zl)) * (least(yb, zb) - greatest(yt, zt)) AS shared, (xr - xl) * (yb - yt) AS whole
FROM fx_page_crops c JOIN zoned z ON z.page = c.page WHERE greatest(xl, zl) < least(xr, zr) AND greatest(yt, zt) < least(yb, zb)"""


def status_sql(minimum: str | None) -> str:
    enough = f"count(h.question_id) FILTER (WHERE h.shared / h.whole::DOUBLE >= {minimum}::DOUBLE)" if minimum else "0"
    return f"""SELECT c.crop_id, CASE WHEN {enough} = 1 THEN 'assigned' WHEN count(h.question_id) = 1 AND max(h.shared) = max(h.whole) THEN 'assigned'
 WHEN count(h.question_id) > 1 THEN 'ambiguous' WHEN count(h.question_id) = 1 THEN 'outside_zone' ELSE 'unassigned' END AS status, {enough} AS n_enough, count(h.question_id) AS n_hits
FROM fx_page_crops c LEFT JOIN hits h ON h.crop_id = c.crop_id GROUP BY c.crop_id"""


X = {
    "zoned": ZONED,
    "hits": HITS,
    "crop_status": status_sql("0.7"),
    "plain_status": status_sql(None),
    "anchors": """SELECT c.page, h.question_id, c.xl, c.yt, c.xr, c.yb FROM fx_page_crops c JOIN classified k ON k.crop_id = c.crop_id JOIN crop_status s ON s.crop_id = c.crop_id AND s.status = 'assigned'
 JOIN hits h ON h.crop_id = c.crop_id AND (s.n_enough <> 1 OR h.shared / h.whole::DOUBLE >= 0.7::DOUBLE)
WHERE k.reason IN ('candidate', '15') AND NOT c.reread_conflict AND NOT c.retry_ownership_review""",
    "enclosed": f"""SELECT t.crop_id, min(a.question_id) AS owner, count(*) AS anchors FROM fx_page_crops t JOIN crop_status s ON s.crop_id = t.crop_id AND s.status <> 'assigned' JOIN anchors a ON a.page = t.page
WHERE NOT t.is_empty AND NOT t.answer_excluded AND {overlap('t', 'a')}
 AND (least(t.xr, a.xr) - greatest(t.xl, a.xl)) * (least(t.yb, a.yb) - greatest(t.yt, a.yt)) / ((a.xr - a.xl) * (a.yb - a.yt))::DOUBLE >= 0.8::DOUBLE
GROUP BY t.crop_id HAVING count(DISTINCT a.question_id) = 1""",
    "owned": """SELECT s.crop_id, h.question_id, s.status, false AS enclosed, s.status <> 'assigned' OR c.retry_ownership_review AS ownership_review
FROM crop_status s JOIN fx_page_crops c ON c.crop_id = s.crop_id LEFT JOIN hits h ON h.crop_id = s.crop_id WHERE s.crop_id NOT IN (SELECT crop_id FROM enclosed) AND (h.crop_id IS NULL OR s.n_enough <> 1 OR h.shared / h.whole::DOUBLE >= 0.7::DOUBLE)
UNION ALL SELECT e.crop_id, e.owner, 'assigned', true, c.retry_ownership_review FROM enclosed e JOIN fx_page_crops c ON c.crop_id = e.crop_id""",
    "o_crops": """SELECT *, CASE WHEN stage = 0 THEN parsed END AS choice FROM (SELECT *, CASE WHEN reason IN ('2', '9') THEN 1 WHEN reason IN ('not_executed', '5', 'score_missing', '6') THEN 2
 WHEN reason = 'candidate' THEN 0 ELSE 3 END AS stage FROM (SELECT o.question_id, o.ownership_review, k.* EXCLUDE (question_id, ownership_review, reason, stage, choice, xl, xr), c.xl, c.xr,
 CASE WHEN k.reason IN ('candidate', '15') THEN CASE WHEN o.ownership_review THEN '15' ELSE 'candidate' END ELSE k.reason END AS reason
 FROM owned o JOIN classified k ON k.crop_id = o.crop_id JOIN fx_page_crops c ON c.crop_id = o.crop_id WHERE o.question_id IS NOT NULL) a) b""",
    "o_live": f"""SELECT 'duplicate' AS policy, b.question_id, b.reason FROM o_crops b JOIN o_crops c ON c.question_id = b.question_id
WHERE b.reason IN ('6', '7') AND c.stage = 0 AND {overlap('b', 'c')} GROUP BY b.question_id, b.crop_id, b.reason, b.has_ring
HAVING NOT (b.has_ring AND bool_and(c.crop_id // 10 = b.crop_id // 10 AND (b.ring_only_answer OR (b.crop_no + c.crop_no) % 2 = 0)))""",
    **{k: v for k, v in review_ctes("o_crops", "o_live", "o_").items()},
}


def _associate(minimum):
    def query(t):
        _, associated = associations(t, minimum)
        return associated.filter("first_row").select("crop_id", "status", "n_hits")
    return query


def _links(t):
    _, associated = associations(t)
    return associated.filter("kept").select("crop_id", "question_id", F.floor(c("fraction") * 1000).cast("bigint").alias("share"))


def _assign(t):
    return ownership_tables(t)[3].select(
        "crop_id", F.coalesce(c("question_id"), F.lit(-1)).alias("question_id"), "status", "enclosed", "ownership_review"
    )


def _summary(t):
    _, associated, _, assigned = ownership_tables(t)
    return own.association_summary(associated, assigned)


def _annotate(t):
    crops = t.fx_crops.withColumn("source_hash", F.sha2(c("crop_id").cast("string"), 256))
    notes = crops.filter("semantic_annotation IS NOT NULL").select(
        "page", "xl", "yt", "xr", "yb", c("crop_id").alias("note_seq"), "source_hash", c("semantic_annotation").alias("note")
    )
    return own.attach_annotations(crops, notes)


ENTRIES = {
    "associate": (_associate(0.7), check("SELECT crop_id, status, n_hits FROM crop_status", X)),
    "associate_plain": (_associate(None), check("SELECT crop_id, status, n_hits FROM plain_status", X)),
    "association_links": (
        _links,
        check("""SELECT h.crop_id, h.question_id, CAST(floor(h.shared / h.whole::DOUBLE * 1000) AS BIGINT) AS share FROM hits h JOIN crop_status s ON s.crop_id = h.crop_id
WHERE s.n_enough <> 1 OR h.shared / h.whole::DOUBLE >= 0.7::DOUBLE""", X),
    ),
    "enclosing": (
        lambda t: ownership_tables(t)[2].select("crop_id", "owner", "anchors"),
        check("SELECT crop_id, owner, anchors FROM enclosed", X),
    ),
    "assign": (_assign, check("SELECT crop_id, coalesce(question_id, -1) AS question_id, status, enclosed, ownership_review FROM owned", X)),
    "assoc_summary": (
        _summary,
        check("""SELECT status, count(*) AS n FROM crop_status GROUP BY status
UNION ALL SELECT CASE WHEN question_id IS NULL THEN 'final:unassigned' ELSE 'final:' || status END, count(*) FROM owned GROUP BY 1""", X),
    ),
    "owned_review": (
        lambda t: review_view(owned_reviews(t)),
        check(f"SELECT {VIEW} FROM o_reviews WHERE policy = 'duplicate'", X),
    ),
    "annotate": (
        _annotate,
        check(f"""SELECT crop_id, CASE WHEN note_id = crop_id THEN note ELSE 'previous_annotation_overlap_requires_review' END AS annotation FROM (
SELECT c.crop_id, n.crop_id AS note_id, n.semantic_annotation AS note, row_number() OVER (PARTITION BY c.crop_id ORDER BY n.crop_id DESC) AS rn
FROM fx_crops c JOIN fx_crops n ON n.page = c.page AND n.semantic_annotation IS NOT NULL WHERE {overlap('c', 'n')}) q WHERE rn = 1"""),
    ),
    "printed_overlap": (
        lambda t: own.printed_overlap(t.fx_crops, t.fx_marks).select("question_id", "crop_id", "n_overlaps"),
        check(f"SELECT c.question_id, c.crop_id, count(*) AS n_overlaps FROM fx_crops c JOIN fx_marks m ON m.question_id = c.question_id WHERE {overlap('c', 'm')} GROUP BY c.question_id, c.crop_id"),
    ),
    "column_bottoms": (
        lambda t: own.extend_column_bottoms(
            t.fx_questions.select("question_id", "page", "zl", "zt", "zr", "zb"),
            t.fx_pages.select("page", (F.lit(1700) + c("page") % 3 * 100).alias("height")),
        ).select("question_id", "zb", "zb_before", F.coalesce("problem", F.lit("")).alias("problem")),
        check("""SELECT question_id, CASE WHEN zt = last THEN height ELSE zb END AS zb, zb AS zb_before,
 CASE WHEN zb > height THEN 'outside_page' WHEN zt = last AND ties > 1 THEN 'no_unique_last' ELSE '' END AS problem FROM (
SELECT *, 1700 + page % 3 * 100 AS height, max(zt) OVER (PARTITION BY page, zl, zr) AS last, count(*) OVER (PARTITION BY page, zl, zr, zt) AS ties FROM fx_questions) q"""),
    ),
}
