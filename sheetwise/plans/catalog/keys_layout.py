"""Answer keys, page layout, settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.functions.answers import answer_string
from sheetwise.operators import keys as ks
from sheetwise.operators import layout as lo
from sheetwise.operators import settings as st
from sheetwise.plans.checks import check

c = F.col

X = {
    "entry": """SELECT q.*, 'S' || CAST(floor(page / 50) AS INT) AS set_id, CAST(floor((page % 50) / 5) AS INT) AS part_no,
 CAST((page % 5) * 8 + slot + 1 AS INT) AS n, answer_key || CASE WHEN question_id % 4 = 0 THEN ' ' || chr(10) || ' 풀이' ELSE '' END AS body FROM fx_questions q""",
    "copies": "SELECT e.*, k.copy, row_number() OVER (PARTITION BY page ORDER BY slot DESC, k.copy DESC) = 1 AS last_on_page FROM entry e JOIN (SELECT 1 AS copy UNION ALL SELECT 2) k ON k.copy = 1 OR question_id % 89 = 0 WHERE question_id % 97 <> 0",
    "key_rows": """SELECT c.set_id, 'p' || (1 + part_no % 2) || '-s' || part_no AS section, set_id || '-p' || (1 + part_no % 2) || '-s' || part_no || '-q' || n AS id, c.page, c.slot, copy, n AS number,
 trim(body) || CASE WHEN last_on_page AND (c.page + 1) % 5 <> 0 AND (c.page + 1) % 3 = 1 AND c.page < (SELECT max(page) FROM fx_questions) THEN chr(10) || '(이어짐) 앞 쪽 해설' ELSE '' END AS raw, k.key_text
FROM copies c JOIN keyed k ON k.question_id = c.question_id""",
    "merge_cases": "SELECT page, question_id, crop_id AS component, crop_id FROM fx_crops UNION ALL SELECT page, question_id, crop_id, crop_id + 1 FROM fx_crops WHERE crop_no % 3 <> 0",
    "reach": """SELECT DISTINCT page, component, component AS other FROM merge_cases UNION SELECT r.page, r.component, b.component FROM reach r JOIN merge_cases a ON a.page = r.page AND a.component = r.other
 JOIN merge_cases b ON b.page = a.page AND b.crop_id = a.crop_id""",
    "bound": """SELECT DISTINCT e.page, e.axis, e.edge, s.crop_id AS component, e.crop_id, e.question_id FROM (
 SELECT c.*, u.axis, u.edge FROM fx_crops c JOIN fx_questions q ON q.question_id = c.question_id CROSS JOIN LATERAL (SELECT 0 AS axis, zl AS edge, xl = zl AS hit UNION ALL SELECT 0, zr, xr = zr UNION ALL SELECT 1, zt, yt = zt UNION ALL SELECT 1, zb, yb = zb) u WHERE u.hit) e
JOIN (SELECT page, crop_id, xl - 10 AS xl, yt - 10 AS yt, xr - 10 AS xr, yb - 10 AS yb FROM fx_crops) s ON s.page = e.page
WHERE greatest(e.xl, s.xl) < least(e.xr, s.xr) AND greatest(e.yt, s.yt) < least(e.yb, s.yb) AND (s.xr - s.xl) * (s.yb - s.yt) / 4 >= 35
 AND CASE WHEN e.axis = 0 THEN s.xl ELSE s.yt END <= e.edge - 3 AND CASE WHEN e.axis = 0 THEN s.xr ELSE s.yb END >= e.edge + 3""",
    "seq_heads": "SELECT set_id || '-' || part_no AS grp, page * 8 + slot AS pos, CASE WHEN question_id % 13 = 0 THEN n + 1 WHEN question_id % 17 = 0 THEN 1 ELSE n END AS number FROM entry",
    "chain": """SELECT grp, 1 AS k, min(pos) AS pos FROM seq_heads WHERE number = 1 GROUP BY grp
UNION ALL SELECT s.grp, s.k + 1, s.nxt FROM (SELECT c.grp, c.k, (SELECT min(h.pos) FROM seq_heads h WHERE h.grp = c.grp AND h.number = c.k + 1 AND h.pos > c.pos) AS nxt FROM chain c) s WHERE s.nxt IS NOT NULL""",
    "pts": """SELECT question_id, crop_no AS label, xl AS x, yt AS y, (crop_id * 7) % 10 AS score, row_number() OVER (PARTITION BY question_id ORDER BY (crop_id * 7) % 10 DESC, crop_no DESC, xl DESC, yt DESC) AS rn FROM fx_crops""",
    "greedy": """SELECT DISTINCT question_id, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(label INT, x INT, y INT)[]) AS kept FROM pts
UNION ALL SELECT g.question_id, p.rn, CASE WHEN len(list_filter(g.kept, lambda k: abs(k.x - p.x) <= 18 AND abs(k.y - p.y) <= 18)) > 0 THEN g.kept ELSE list_append(g.kept, {'label': p.label, 'x': p.x, 'y': p.y}) END
 FROM greedy g JOIN pts p ON p.question_id = g.question_id AND p.rn = g.r + 1""",
    "heads": "SELECT question_id, page, slot % 2 AS column_no, 180 + 400 * CAST(floor(slot / 2) AS INT) + CAST((question_id * 7) % 11 AS DOUBLE) / 2 AS y FROM fx_questions UNION ALL SELECT question_id, page, slot % 2, 183 + 400 * CAST(floor(slot / 2) AS INT) + CAST((question_id * 5) % 13 AS DOUBLE) / 2 FROM fx_questions WHERE question_id % 3 = 0",
    "inked": "SELECT question_id, yt + 4 * u.k AS y, 4 + crop_no AS pixels FROM fx_crops CROSS JOIN (SELECT unnest(range(0, 9)) AS k) u",
    "islands": "SELECT *, sum(CASE WHEN y - prev > 5 OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY y) AS run FROM (SELECT *, lag(y) OVER (PARTITION BY question_id ORDER BY y) AS prev FROM (SELECT question_id, y, sum(pixels) AS pixels FROM inked GROUP BY question_id, y) a) b",
    "xs": "SELECT question_id, u.k AS x FROM fx_questions CROSS JOIN (SELECT unnest(range(0, 40)) AS k) u WHERE u.k <= question_id % 40 AND u.k % (7 + question_id % 30) <> 6",
    "nine": "SELECT * FROM (VALUES (5000,6),(5000,7),(5000,8),(6000,6),(6000,7),(6000,8),(7000,6),(7000,7),(7000,8)) v(features, ratio_tenths)",
    "all27": "SELECT features, ratio_tenths, ransac FROM nine CROSS JOIN (SELECT 2 AS ransac UNION ALL SELECT 3 UNION ALL SELECT 4) r",
    "run_crops": "SELECT n.*, c.* FROM fx_crops c CROSS JOIN nine n WHERE (c.crop_id + n.ratio_tenths + n.features // 1000) % 3 <> 0",
}


def entry_rows(t):
    return t.fx_questions.select(
        "*", F.concat(F.lit("S"), F.floor(c("page") / 50)).alias("set_id"), F.floor(c("page") % 50 / 5).cast("int").alias("part_no"),
        (c("page") % 5 * 8 + c("slot") + 1).alias("n"),
        F.concat("answer_key", F.when(c("question_id") % 4 == 0, F.lit(" \n 풀이")).otherwise(F.lit(""))).alias("body"),
    )


def entries(t):
    """Lines of the key, with a few numbers missing and a few written twice."""
    rows = entry_rows(t)
    return rows.filter("question_id % 97 <> 0").select(
        "*", F.explode(F.when(c("question_id") % 89 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    )


def key_pages(t, headings=True, line=None):
    line = line if line is not None else F.concat(c("n").cast("string"), F.lit(") "), c("body"))
    lines = entries(t).groupBy("set_id", "page", "part_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "copy", line.alias("line")))), lambda x: x.line), "\n").alias("lines")
    )
    if not headings:
        return lines.select("set_id", "page", F.concat("lines", F.lit("\nFOOTER-7")).alias("text"))
    top = F.when(c("page") % 5 == 0, F.concat(F.lit("Pattern "), 1 + c("part_no") % 2, F.when(c("part_no") > 0, F.concat(F.lit(" Part "), "part_no")).otherwise(F.lit("")))).when(
        c("page") % 3 == 1, F.lit("(이어짐) 앞 쪽 해설"))
    return lines.select("set_id", "page", F.concat_ws("\n", top, "lines").alias("text"))


def _sections(t):
    return ks.key_sections(key_pages(t)).select("id", "page", "raw", F.coalesce(answer_string(c("answer")), F.lit("")).alias("answer"))


def _audit(t):
    part = F.concat(F.lit("-p"), 1 + c("part_no") % 2, F.lit("-s"), "part_no", F.lit("-q"), "n")
    expected = entry_rows(t).filter("question_id % 83 <> 0").select("set_id", F.concat("set_id", part).alias("id"))
    # Beside each key, the same one without its headings and a scan without text.
    pages, plain = key_pages(t), key_pages(t, headings=False)
    pages = pages.union(plain.withColumn("set_id", F.concat("set_id", F.lit("-plain")))).union(plain.select(F.concat("set_id", F.lit("-scan")), "page", F.lit(" \n")))
    return ks.key_audit(ks.key_sections(pages), expected, pages=pages).withColumn("id", F.coalesce("id", F.lit("")))


EXPLAINED = "CASE question_id % 6 WHEN 0 THEN '② 설명' WHEN 1 THEN '①, ③ 해설' WHEN 2 THEN '①, ?' WHEN 3 THEN '2,5 해설' WHEN 4 THEN '④' ELSE '② → ③' END"


NUMBERED = f"""SELECT 'compact' AS layout, set_id, c.page, n AS question, CASE WHEN k.key_text IS NULL OR c.question_id % 4 = 0 THEN 'text_review' ELSE 'numeric' END AS kind, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS display,
 CASE WHEN c.question_id % 4 = 0 THEN CASE WHEN c.answer_key LIKE '%:%' THEN k.key_text ELSE '' END ELSE coalesce(k.key_text, '') END AS answer FROM copies c JOIN keyed k ON k.question_id = c.question_id
UNION ALL SELECT 'explained', set_id, page, n, CASE WHEN question_id % 6 IN (0, 1, 4) THEN 'numeric' ELSE 'review' END, CASE question_id % 6 WHEN 0 THEN '②' WHEN 1 THEN '①, ③' WHEN 4 THEN '④' ELSE {EXPLAINED} END,
 CASE question_id % 6 WHEN 0 THEN '2' WHEN 1 THEN '1,3' WHEN 4 THEN '4' ELSE '' END FROM copies""".replace("CASE WHEN k.key_text IS NULL OR c.question_id % 4 = 0 THEN", "CASE WHEN k.key_text IS NULL OR (c.question_id % 4 = 0 AND c.answer_key NOT LIKE '%:%') THEN")


def _numbered_rows(t):
    compact = ks.numbered_key(key_pages(t, False), "compact", "FOOTER-7").withColumn("layout", F.lit("compact"))
    line = F.concat(c("n").cast("string"), F.lit(" 번 - "), F.expr(EXPLAINED))
    explained = ks.numbered_key(key_pages(t, False, line), "explained", "FOOTER-7").withColumn("layout", F.lit("explained"))
    return compact.unionByName(explained)


def _numbered_summary(t):
    return ks.numbered_key_summary(_numbered_rows(t), ("layout", "set_id"))


def _numbered(t):
    return _numbered_rows(t).select("layout", "set_id", "page", "question", "kind", "display", F.coalesce(answer_string(c("answer")), F.lit("")).alias("answer"))


def _accept(t):
    rows = entry_rows(t).select(
        F.concat_ws("-", "set_id", "part_no").alias("grp"), (c("page") * 8 + c("slot")).cast("bigint").alias("pos"),
        F.when(c("question_id") % 13 == 0, c("n") + 1).when(c("question_id") % 17 == 0, 1).otherwise(c("n")).alias("number"),
    )
    return ks.accept_sequence(rows, ["grp"]).filter("accepted").select("grp", "pos", "number")


def _carry(t):
    rows = t.fx_questions.select(
        F.floor(c("page") / 50).alias("grp"), "page", "slot", "question_id", F.when((c("slot") == 3) & (c("page") % 3 == 0), c("page") % 7).alias("own_part")
    )
    return lo.carry_part(rows, ["grp"], c("page"), ["page", "slot"]).select("question_id", "part")


def _heads(t):
    y = lambda base, k, m: F.lit(base) + 400 * F.floor(c("slot") / 2) + (c("question_id") * k % m).cast("double") / 2
    cols = lambda v: ["question_id", "page", (c("slot") % 2).alias("column_no"), v.alias("y")]
    q = t.fx_questions
    return q.select(*cols(y(180, 7, 11))).unionByName(q.filter("question_id % 3 = 0").select(*cols(y(183, 5, 13))))


def boundary_rows(t):
    crops = t.fx_crops.join(t.fx_questions.select("question_id", "zl", "zt", "zr", "zb"), "question_id")
    strokes = t.fx_crops.selectExpr("page", "crop_id AS component", "xl - 10 AS xl", "yt - 10 AS yt", "xr - 10 AS xr", "yb - 10 AS yb", "(xr - xl) * (yb - yt) / 4 AS stroke_area")
    return lo.diagnose_boundary(crops, strokes)


def _merge(t):
    base = t.fx_crops.select("page", c("crop_id").alias("component"), "crop_id", "crop_no")
    cases = base.drop("crop_no").unionByName(base.filter("crop_no % 3 <> 0").select("page", "component", (c("crop_id") + 1).alias("crop_id")))
    return lo.merge_groups(cases, ["page"]).select("page", "component", "crop_id", "group_id")


def _run_crops(t):
    return st.extra_settings(t.fx_crops, ["crop_id", "ocr_executed", "answer_excluded", "score"]).filter(
        (c("crop_id") + c("ratio_tenths") + c("features") / 1000) % 3 != 0
    )


def _grid_summary(t):
    runs = st.extra_settings(t.fx_pages, ["page"]).select(
        "features", "ratio_tenths", (c("page") % 13 + c("ratio_tenths")).cast("bigint").alias("seconds"), (c("page") % 29 == 3).alias("failed")
    )
    out = st.grid_summary(_run_crops(t), runs, ["features", "ratio_tenths"])
    return out.withColumn("median", F.round(c("median") * 1000).cast("bigint"))


def _grading_groups(t):
    rows = st.extra_settings(t.fx_questions, ["question_id"]).select(
        "features", "ratio_tenths", "question_id",
        F.when((c("features") == 7000) & (c("question_id") % 50 == 0), F.lit("x")).when((c("ratio_tenths") == 8) & (c("question_id") % 70 == 1), F.lit("y")).otherwise((c("question_id") % 3).cast("string")).alias("outcome"),
    )
    return st.grading_groups(rows, ["features", "ratio_tenths"]).select("features", "ratio_tenths", "group_size", c("first.features").alias("first_features"), c("first.ratio_tenths").alias("first_ratio"))


ENTRIES = {
    "key_sections": (_sections, check("SELECT id, page, raw, coalesce(key_text, '') AS answer FROM key_rows", X)),
    "key_audit": (
        _audit,
        check("""SELECT e.set_id, 'missing' AS kind, e.id FROM wanted e WHERE e.id NOT IN (SELECT id FROM key_rows)
UNION ALL SELECT DISTINCT set_id, 'extra', id FROM key_rows WHERE id NOT IN (SELECT id FROM wanted)
UNION ALL SELECT set_id, 'duplicate', id FROM key_rows GROUP BY set_id, id HAVING count(*) > 1
UNION ALL SELECT DISTINCT set_id, 'invalid', id FROM key_rows WHERE key_text IS NULL
UNION ALL SELECT DISTINCT set_id, 'sequence', section FROM (SELECT *, row_number() OVER (PARTITION BY set_id, section ORDER BY page, slot, copy) AS place FROM key_rows) p WHERE place <> number
UNION ALL SELECT DISTINCT set_id || '-plain', 'no_heading', '' FROM copies UNION ALL SELECT DISTINCT set_id || '-scan', 'no_text', '' FROM copies""",
              {**X, "wanted": "SELECT set_id, set_id || '-p' || (1 + part_no % 2) || '-s' || part_no || '-q' || n AS id FROM entry WHERE question_id % 83 <> 0"}),
    ),
    "numbered_key": (_numbered, check(NUMBERED, X)),
    "numbered_summary": (
        _numbered_summary,
        check("""SELECT r.layout, r.set_id, s.sequential, count(*) FILTER (WHERE kind = 'numeric') AS numeric, count(*) FILTER (WHERE kind <> 'numeric') AS to_review, d.duplicates
FROM numbered_rows r JOIN (SELECT set_id, bool_and(n = place) AS sequential FROM (SELECT set_id, n, row_number() OVER (PARTITION BY set_id ORDER BY page, slot, copy) AS place FROM copies) p GROUP BY set_id) s ON s.set_id = r.set_id
JOIN (SELECT set_id, count(*) FILTER (WHERE k > 1) AS duplicates FROM (SELECT set_id, n, count(*) AS k FROM copies GROUP BY set_id, n) g GROUP BY set_id) d ON d.set_id = r.set_id GROUP BY r.layout, r.set_id, s.sequential, d.duplicates""", {**X, "numbered_rows": NUMBERED}),
    ),
    "carry_part": (
        _carry,
        check("""SELECT question_id, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY floor(page / 50) ORDER BY page, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
FROM (SELECT *, CASE WHEN slot = 3 AND page % 3 = 0 THEN page % 7 END AS own FROM fx_questions) q"""),
    ),
    "accept_seq": (_accept, check("SELECT c.grp, CAST(c.pos AS BIGINT) AS pos, c.k AS number FROM chain c", X)),
    "zone_bottoms": (
        lambda t: lo.zone_bottoms(_heads(t), 1980).select("question_id", "y", "bottom"),
        check("SELECT h.question_id, h.y, coalesce(CAST(floor((SELECT min(o.y) FROM heads o WHERE o.page = h.page AND o.column_no = h.column_no AND o.y > h.y + 5)) AS INT) - 18, 1830) AS bottom FROM heads h", X),
    ),
    "row_groups": (
        lambda t: lo.row_groups(t.fx_crops.select("question_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: c("yt") + 4 * k)).alias("y"), (4 + c("crop_no")).alias("pixels")), ["question_id"]),
        check("SELECT question_id, CAST(min(y) AS INT) AS top, CAST(max(y) AS INT) AS bottom, CAST(sum(pixels) AS BIGINT) AS pixels FROM islands GROUP BY question_id, run HAVING max(y) - min(y) >= 7 AND sum(pixels) >= 60", X),
    ),
    "longest_run": (
        lambda t: lo.longest_run(t.fx_questions.select("question_id", F.explode(F.sequence(F.lit(0), (c("question_id") % 40).cast("int"))).alias("x")).filter("x % (7 + question_id % 30) <> 6"), ["question_id"], 20),
        check("SELECT question_id, max(n) AS span, max(n) >= 20 AS cancelled FROM (SELECT question_id, count(*) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY question_id ORDER BY x) AS run FROM xs) a GROUP BY question_id, run) b GROUP BY question_id", X),
    ),
    "suppress": (
        lambda t: lo.suppress_near(t.fx_crops.select("question_id", c("crop_no").alias("label"), c("xl").alias("x"), c("yt").alias("y"), (c("crop_id") * 7 % 10).alias("score")), ["question_id"]).select("question_id", "label", "x", "y"),
        check("SELECT question_id, u.label, u.x, u.y FROM (SELECT question_id, unnest(kept) AS u FROM (SELECT *, max(r) OVER (PARTITION BY question_id) AS top FROM greedy) g WHERE r = top) q", X),
    ),
    "number_regions": (
        lambda t: lo.number_regions(t.fx_crops.select("crop_id", "page", "xl", "yt", "xr", "yb")).select("crop_id", "page", "number", "region_id"),
        check("SELECT crop_id, page, n AS number, page || '-ink' || lpad(CAST(n AS VARCHAR), 4, '0') AS region_id FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY yt, xl, yb, xr, crop_id) AS n FROM fx_crops) q"),
    ),
    "boundary": (boundary_rows, check("SELECT * FROM bound", X)),
    "merge_groups": (_merge, check("SELECT m.page, m.component, m.crop_id, g.group_id FROM merge_cases m JOIN (SELECT page, component, min(other) AS group_id FROM reach GROUP BY page, component) g ON g.page = m.page AND g.component = m.component", X)),
    "diag_summary": (
        lambda t: lo.diagnosis_summary(
            boundary_rows(t).select(F.lit("boundary").alias("category"), F.concat_ws("-", "page", "axis", "edge", "component").alias("case_id"), "question_id")
            .unionByName(t.fx_stats.filter("gray_pixels >= 100 AND gray_pixels >= 0.2 * ink_pixels").select(F.lit("gray").alias("category"), c("crop_id").cast("string").alias("case_id"), "question_id"))),
        check("""SELECT 'boundary' AS category, count(DISTINCT (page, axis, edge, component)) AS cases, count(DISTINCT question_id) AS questions FROM bound
UNION ALL SELECT 'gray', count(*), count(DISTINCT question_id) FROM fx_stats WHERE gray_pixels >= 100 AND gray_pixels >= CAST(0.2 AS DOUBLE) * ink_pixels""", X),
    ),
    "grid_settings": (
        lambda t: st.grid_settings(t.fx_pages, 20260926, ["page"]),
        check("""SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY NOT (features = 6000 AND ratio_tenths = 7 AND ransac = 3), md5('20260926-' || features || '-' || ratio_tenths || '-' || ransac)) - 1 AS INT) AS place, features, ratio_tenths, ransac
FROM fx_pages CROSS JOIN all27""", X),
    ),
    "grid_summary": (
        _grid_summary,
        check("""SELECT a.features, a.ratio_tenths, a.crops, a.ocr_calls, a.median, b.seconds, b.failed FROM (SELECT features, ratio_tenths, count(*) AS crops, count(*) FILTER (WHERE ocr_executed) AS ocr_calls,
 CAST(round(median(score) FILTER (WHERE ocr_executed AND NOT answer_excluded AND score IS NOT NULL AND NOT isnan(score)) * 1000) AS BIGINT) AS median FROM run_crops GROUP BY features, ratio_tenths) a
JOIN (SELECT features, ratio_tenths, CAST(sum(page % 13 + ratio_tenths) AS BIGINT) AS seconds, count(*) FILTER (WHERE page % 29 = 3) AS failed FROM fx_pages CROSS JOIN nine GROUP BY features, ratio_tenths) b ON b.features = a.features AND b.ratio_tenths = a.ratio_tenths""", X),
    ),
    "grading_groups": (
        _grading_groups,
        check("""SELECT s.features, s.ratio_tenths, g.group_size, g.first_features, g.first_ratio FROM sig s JOIN (SELECT sig, count(*) AS group_size, min(features) AS first_features, min_by(ratio_tenths, features * 10 + ratio_tenths) AS first_ratio FROM sig GROUP BY sig) g ON g.sig = s.sig""",
              {**X, "sig": """SELECT features, ratio_tenths, string_agg(question_id || ':' || CASE WHEN features = 7000 AND question_id % 50 = 0 THEN 'x' WHEN ratio_tenths = 8 AND question_id % 70 = 1 THEN 'y' ELSE CAST(question_id % 3 AS VARCHAR) END, ',' ORDER BY question_id) AS sig
FROM fx_questions CROSS JOIN nine GROUP BY features, ratio_tenths"""}),
    ),
}
