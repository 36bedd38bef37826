"""Answer-sheet tables derived from the order tables.

The same SELECT text builds DataFrames here and serves the SQL checks as common
table expressions, so both sides start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetwise.session import materialise, tune

VIEWS = {
    "fx_questions": """
SELECT CAST(o_orderkey AS BIGINT) AS question_id,
       CAST(floor(o_orderkey / 8) AS INT) AS page,
       CAST(o_orderkey % 8 AS INT) AS slot,
       CASE WHEN o_orderkey % 2 = 0 THEN 50 ELSE 667 END AS zl,
       180 + 400 * CAST(floor((o_orderkey % 8) / 2) AS INT) AS zt,
       CASE WHEN o_orderkey % 2 = 0 THEN 667 ELSE 1284 END AS zr,
       580 + 400 * CAST(floor((o_orderkey % 8) / 2) AS INT) AS zb,
       CASE o_custkey % 9 WHEN 0 THEN '①' WHEN 1 THEN '②: 해설' WHEN 2 THEN '3' WHEN 3 THEN '④' WHEN 4 THEN '⑤'
            WHEN 5 THEN '①, ③' WHEN 6 THEN '2,5: 해설' WHEN 7 THEN '①②' ELSE '?' END AS answer_key,
       CASE o_orderkey % 11 WHEN 0 THEN '1. 알맞은 것은? (정답 2개) ① 설명' WHEN 1 THEN '두 개를 고르시오. ① 하나'
            WHEN 2 THEN '정답은 세 개를 고르세요.' WHEN 3 THEN '12개를 고르시오.' WHEN 4 THEN '정답 2개 또는 정답 3개를 고르시오.'
            WHEN 5 THEN '정답 2개' ELSE '다음 중 옳은 것은? 지문에는 정답 2개라는 말이 있다.' END AS source_text,
       CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE CAST(o_custkey % 5 + 1 AS INT) END AS label_answer
FROM orders""",
    "fx_pages": """
SELECT page, page % 31 <> 0 AS has_matrix, 25 + (page * 7) % 60 AS inliers,
       CAST((page * 13) % 33 AS DOUBLE) / 10 AS median_error,
       CASE WHEN page % 11 = 0 THEN 1654 WHEN page % 11 = 1 THEN NULL ELSE 2480 END AS scan_short_side
FROM (SELECT DISTINCT CAST(floor(o_orderkey / 8) AS INT) AS page FROM orders) p""",
    "fx_crops": """
SELECT b.crop_id, b.question_id, q.page, b.crop_no,
       CASE b.qty % 12 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '③' WHEN 3 THEN '1,3' WHEN 4 THEN '(2)' WHEN 5 THEN '5.'
            WHEN 6 THEN '①④' WHEN 7 THEN 'X' WHEN 8 THEN '0' WHEN 9 THEN '2' WHEN 10 THEN '4' ELSE '1,1' END AS txt,
       CASE WHEN b.disc = 0 THEN NULL WHEN b.disc = 1 AND b.pk % 7 = 0 THEN CAST('NaN' AS DOUBLE)
            ELSE CAST(b.disc AS DOUBLE) / 10 END AS score,
       CASE WHEN b.pk % 11 = 0 THEN 'choice_mark_review' WHEN b.pk % 53 = 1 THEN 'mixed_print_review' ELSE 'student_candidate' END AS route,
       b.sk % 19 = 0 AS is_empty, b.pk % 23 = 0 AS answer_excluded,
       (b.sk % 19 <> 0 AND b.pk % 23 <> 0 AND b.pk % 41 <> 0) AS ocr_executed,
       CASE WHEN b.pk % 71 = 0 THEN 'do_not_know' ELSE NULL END AS semantic_annotation,
       b.sk % 29 = 0 AS ownership_review, b.pk % 89 = 0 AS reread_conflict,
       q.zl + CASE WHEN b.pk % 6 = 0 THEN 540 ELSE b.pk % 90 END AS xl,
       q.zt + CASE WHEN b.sk % 8 = 0 THEN 350 ELSE b.sk % 60 END AS yt,
       q.zl + CASE WHEN b.pk % 6 = 0 THEN 540 ELSE b.pk % 90 END + 20 + 3 * b.qty AS xr,
       q.zt + CASE WHEN b.sk % 8 = 0 THEN 350 ELSE b.sk % 60 END + 16 + 2 * b.qty AS yb,
       b.rf = 'A' AS has_ring, b.ls = 'F' AS ring_only_answer
FROM (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS crop_id, CAST(l_orderkey AS BIGINT) AS question_id,
             CAST(l_linenumber AS INT) AS crop_no, CAST(floor(min(l_quantity)) AS INT) AS qty,
             CAST(round(max(l_discount) * 100) AS INT) AS disc, CAST(min(l_partkey) AS INT) AS pk, CAST(min(l_suppkey) AS INT) AS sk,
             min(l_returnflag) AS rf, min(l_linestatus) AS ls
      FROM lineitem GROUP BY l_orderkey, l_linenumber) b
JOIN fx_questions q ON q.question_id = b.question_id""",
    "fx_marks": """
SELECT q.question_id, q.page, n.n AS symbol_no, q.zl + 10 AS xl, q.zt + 40 + 50 * n.n AS yt, q.zl + 42 AS xr, q.zt + 72 + 50 * n.n AS yb,
       CAST((q.question_id * 7 + n.n * 29) % 53 AS INT) AS ink_pixels, CAST((q.question_id * 3 + n.n * 37) % 230 AS INT) AS span
FROM fx_questions q CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) n
WHERE NOT (q.question_id % 13 = 0 AND n.n = 3)""",
    "fx_readings": """
SELECT c.crop_id, c.question_id, v.stage, v.stage_no, v.variant_no, v.param,
       CASE WHEN (c.crop_id + v.stage_no) % 3 = 0 THEN CAST(c.crop_id % 5 + 1 AS VARCHAR(2)) ELSE CAST((c.crop_id + v.variant_no) % 5 + 1 AS VARCHAR(2)) END AS txt,
       CASE WHEN (c.crop_id * 3 + v.stage_no + v.variant_no) % 7 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS score
FROM fx_crops c CROSS JOIN (
  SELECT 'peel' AS stage, 1 AS stage_no, 1 AS variant_no, CAST(0 AS DOUBLE) AS param UNION ALL
  SELECT 'B', 2, 1, 2.0 UNION ALL SELECT 'B', 2, 2, 2.5 UNION ALL SELECT 'B', 2, 3, 3.0 UNION ALL
  SELECT 'C', 3, 1, 16 UNION ALL SELECT 'C', 3, 2, 24 UNION ALL SELECT 'D1', 4, 1, 16 UNION ALL SELECT 'D1', 4, 2, 24 UNION ALL
  SELECT 'D2', 5, 1, 16 UNION ALL SELECT 'D2', 5, 2, 24) v
WHERE c.txt IN ('0', '③', '①④') AND c.score < 0.8 AND NOT isnan(c.score)""",
    "fx_page_crops": """
SELECT c.crop_id, c.page, c.txt, c.score, c.route, c.is_empty, c.answer_excluded, c.ocr_executed, c.semantic_annotation, c.reread_conflict,
       c.ownership_review AS retry_ownership_review, c.has_ring, c.ring_only_answer, c.crop_no,
       c.xl - CASE WHEN c.crop_id % 97 = 0 THEN 2000 ELSE 0 END AS xl, c.yt, c.xr - CASE WHEN c.crop_id % 97 = 0 THEN 2000 ELSE 0 END AS xr, c.yb
FROM fx_crops c""",
    "fx_stats": """
SELECT c.crop_id, c.question_id, c.page, c.is_empty, c.answer_excluded,
       CAST(c.crop_id % 50 AS DOUBLE) / 100 AS print_overlap, CAST((c.crop_id * 7) % 30 AS INT) AS largest_residual,
       c.crop_id % 3 = 0 AS shaded, c.crop_id % 17 = 0 AS protected_choice,
       CAST(120 + (c.crop_id * 11) % 140 AS DOUBLE) AS gray_median, CAST((c.crop_id * 5) % 40 AS INT) AS dark_pixels,
       CAST(900 + c.crop_id % 700 AS INT) AS total_pixels, CAST(100 + (c.crop_id * 3) % 400 AS INT) AS largest_area,
       CAST(90 + (c.crop_id * 13) % 600 AS INT) AS gray_area, CAST(60 + (c.crop_id * 19) % 300 AS INT) AS gray_interior,
       CAST((c.crop_id * 23) % 120 AS DOUBLE) / 1000 AS ink_fraction, CAST((c.crop_id * 29) % 240 AS INT) AS gray_pixels,
       CAST((c.crop_id * 31) % 900 AS INT) AS ink_pixels, CAST((c.crop_id * 37) % 90 AS INT) AS ink_rows,
       CAST(1 + (c.crop_id * 41) % 130 AS INT) AS ink_width
FROM fx_crops c""",
    "fx_corrections": """
SELECT CAST(event_id AS BIGINT) AS edit_id, CAST(user_id * 97 + event_id % 7 AS BIGINT) AS question_id, ts AS updated_at,
       CASE event_type WHEN 'view' THEN '정답' WHEN 'click' THEN '오답' WHEN 'error' THEN '???' ELSE '보류' END AS judgement,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(CAST(floor(value) AS INT) % 5 + 1 AS VARCHAR(2)) END AS read_answer
FROM events""",
}

# Spark lists the literal rows beside each row instead of joining them.
_STAGES = """
  SELECT 'peel' AS stage, 1 AS stage_no, 1 AS variant_no, CAST(0 AS DOUBLE) AS param UNION ALL
  SELECT 'B', 2, 1, 2.0 UNION ALL SELECT 'B', 2, 2, 2.5 UNION ALL SELECT 'B', 2, 3, 3.0 UNION ALL
  SELECT 'C', 3, 1, 16 UNION ALL SELECT 'C', 3, 2, 24 UNION ALL SELECT 'D1', 4, 1, 16 UNION ALL SELECT 'D1', 4, 2, 24 UNION ALL
  SELECT 'D2', 5, 1, 16 UNION ALL SELECT 'D2', 5, 2, 24"""
_SYMBOLS = "SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5"
# Lines travel once, by question: the aggregation, the join with the questions and whatever
# else works by question afterwards need no further exchange.
SPARK_VIEWS = {
    **VIEWS,
    "fx_crops": VIEWS["fx_crops"].replace(
        "FROM lineitem GROUP BY",
        "FROM (SELECT /*+ REPARTITION(l_orderkey) */ l_orderkey, l_linenumber, l_quantity, l_discount, l_partkey, l_suppkey, "
        "l_returnflag, l_linestatus FROM lineitem) l GROUP BY",
    ),
    # Which question a crop was recorded under: rings repeat crops of that question, whoever owns them.
    "fx_page_crops": VIEWS["fx_page_crops"].replace("SELECT c.crop_id,", "SELECT c.crop_id, c.question_id AS recorded_id,"),
    "fx_marks": VIEWS["fx_marks"].replace(
        f"CROSS JOIN ({_SYMBOLS}) n", "LATERAL VIEW explode(array(1, 2, 3, 4, 5)) n AS n"
    ),
    "fx_readings": VIEWS["fx_readings"].replace(
        f"CROSS JOIN ({_STAGES}) v",
        "LATERAL VIEW inline(array(struct('peel', 1, 1, 0D), struct('B', 2, 1, 2D), struct('B', 2, 2, 2.5D), struct('B', 2, 3, 3D), "
        "struct('C', 3, 1, 16D), struct('C', 3, 2, 24D), struct('D1', 4, 1, 16D), struct('D1', 4, 2, 24D), "
        "struct('D2', 5, 1, 16D), struct('D2', 5, 2, 24D))) v AS stage, stage_no, variant_no, param",
    ),
}

BASE_TABLES = ["orders", "lineitem", "events", "documents", "conversations", "pages", "labels"]


class Tables:
    """Base tables and fixture views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        tune(spark)
        self.spark = spark
        self._loaded: dict[str, DataFrame] = {}
        self._dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        # Operators over texts share the session and set pieces of their own.
        tune(self.spark)
        if name not in self._loaded:
            if name in VIEWS:
                self._loaded[name] = self.sql(SPARK_VIEWS[name])
            else:
                self._loaded[name] = self.spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._loaded[name]

    def holding(self, name: str, rows: DataFrame) -> Tables:
        """The same tables with one of them read from ``rows``, by the views over it too."""
        kept = Tables(self.spark, self._dir)
        kept._loaded[name] = rows.select(*getattr(self, name).columns)
        return kept

    def storing(self, name: str) -> Tables:
        """The same tables with one of them stored once."""
        return self.holding(name, materialise(getattr(self, name), name))

    def sql(self, text: str) -> DataFrame:
        """SQL over the tables, bound as parameters rather than global views."""
        names = [n for n in [*VIEWS, *BASE_TABLES] if f" {n}" in text or f"\n{n}" in text]
        used = {n: getattr(self, n) for n in names}
        for n in sorted(used, key=len, reverse=True):
            text = _bind(text, n)
        return self.spark.sql(text, **used)


def _bind(text: str, name: str) -> str:
    for lead in ("FROM ", "JOIN "):
        text = text.replace(f"{lead}{name} ", f"{lead}{{{name}}} ")
        text = text.replace(f"{lead}{name}\n", f"{lead}{{{name}}}\n")
        text = text.replace(f"{lead}{name})", f"{lead}{{{name}}})")
        if text.endswith(f"{lead}{name}"):
            text = text[: -len(name)] + f"{{{name}}}"
    return text


_OPEN: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Tables(spark, sf_dir)
    return _OPEN[key]
