"""Two assessments with the same question, crop and page numbers: reports with a
scope equal those of each assessment alone. Totals that a write counts itself."""

import random

import pytest
from pyspark.sql import functions as F

from rows import crops
from sheetwise.operators import labels as lab
from sheetwise.operators import policies as pol
from sheetwise.operators import rereads as rr
from sheetwise.operators.review import classify_crops, f08_blockers, question_review

SCOPE = ("assessment_id",)


def assessment(spark, seed):
    rng = random.Random(seed)
    rows = [dict(question_id=1 + rng.randrange(9), score=rng.choice([0.2, 0.9]), txt=rng.choice(["1", "2", "X", ""]), is_empty=rng.random() < 0.1,
                 xl=rng.randrange(60), yt=rng.randrange(60), xr=90, yb=90) for _ in range(40)]
    classified = classify_crops(crops(spark, *rows)).withColumn("mixed_print", F.col("crop_id") % 5 == seed % 5)
    questions = spark.createDataFrame([(q, 1 + q % (1 + seed), "1", "?") for q in range(1, 10)], "question_id bigint, page int, answer_key string, source_text string")
    pages = spark.createDataFrame([(p, True, 50, 1.0, 2480) for p in range(1, 4)], "page int, has_matrix boolean, inliers int, median_error double, scan_short_side int")
    reviews = question_review(classified, questions, pages, blockers=f08_blockers(classified), policies=("none", "broad"))
    labels = questions.select("question_id", F.when(F.col("question_id") % 4 > 0, F.col("question_id") % 3).cast("int").alias("expected"))
    compared = lab.compare_label(reviews, labels)
    buckets = questions.select("question_id", (F.col("question_id") % 2).alias("n_cross"), F.format_string("b%d", F.col("question_id") % 3).alias("bucket"))
    readings = classified.select("crop_id", "question_id", F.lit("B").alias("stage"), F.lit(2).alias("stage_no"), F.lit(1).alias("variant_no"), "txt", "score")
    recommended = reviews.filter(F.col("status") == "보류").filter("question_id % 2 = 0").select("policy", "question_id")
    return dict(classified=classified, reviews=reviews, compared=compared, buckets=buckets, readings=readings, recommended=recommended)


REPORTS = {
    "top_hold_reasons": lambda t, scope: pol.top_hold_reasons(t["reviews"], scope=scope),
    "status_by_page": lambda t, scope: pol.status_by_page(t["reviews"], scope=scope),
    "run_summary": lambda t, scope: pol.run_summary(t["reviews"], t["recommended"], 60.0, scope=scope),
    "stage_summary": lambda t, scope: lab.stage_summary(t["classified"], t["compared"], "broad", t["buckets"], scope=scope),
    "all_readings": lambda t, scope: rr.numeric_readings(rr.all_readings(t["classified"], t["readings"], scope=scope)),
}


def test_reports_keep_assessments_apart(spark):
    alone = {name: assessment(spark, seed) for name, seed in (("A", 1), ("B", 2))}
    both = {
        table: alone["A"][table].withColumn("assessment_id", F.lit("A")).unionByName(alone["B"][table].withColumn("assessment_id", F.lit("B")))
        for table in alone["A"]
    }
    for name, report in REPORTS.items():
        want = []
        for key, tables in alone.items():
            df = report(tables, ())
            columns = sorted(df.columns)
            want += [(key, *row) for row in df.select(*columns).collect()]
        got = report(both, SCOPE).select("assessment_id", *columns).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and want, name
    kinds = {(r.kind, r.name): r.n for r in REPORTS["stage_summary"](alone["A"], ()).collect()}
    assert [kinds["bucket", f"b{i}"] for i in range(3)] == [3, 3, 3] and kinds["total", "crossed_question_cases"] == 5


def test_totals_come_with_the_write(spark, tmp_path):
    reviews = assessment(spark, 3)["reviews"]
    totals = pol.write_reviews(reviews, str(tmp_path / "reviews"))
    stored = spark.read.parquet(str(tmp_path / "reviews"))
    counts = {r.status: r["count"] for r in stored.groupBy("status").count().collect()}
    assert totals["questions"] == stored.count() == 18
    assert (totals["right"], totals["wrong"], totals["held"]) == tuple(counts.get(s, 0) for s in ("정답", "오답", "보류"))
    assert pol.write_reviews(reviews.limit(0), str(tmp_path / "empty"))["questions"] == 0
    broken = reviews.withColumn("status", F.when(F.col("question_id") == 2, F.lit("?")).otherwise(F.col("status")))
    with pytest.raises(ValueError, match="do not add up"):
        pol.write_reviews(broken, str(tmp_path / "broken"))
