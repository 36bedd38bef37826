"""Archive records, recognition hook and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.functions.answers import answer_string
from sheetwise.plans.checks import check
from sheetwise.session import scratch_path
from sheetwise.sources import archive as ar
from sheetwise.sources.images import recognise
from sheetwise.streaming import flows

c = F.col

# Every crop with a real score becomes one stored JSON artifact of three levels.
ARTIFACT = "score IS NOT NULL AND NOT isnan(score)"
NAME = "CASE WHEN crop_id % 4 = 0 THEN 'results.json' WHEN crop_id % 4 = 1 THEN 'repeat-1.json' ELSE 'other.json' END"
X = {
    "arts": f"SELECT *, 'exp' || crop_id % 7 AS experiment, 'exp' || crop_id % 7 || '/' || crop_id || '/' || ({NAME}) AS path FROM fx_crops WHERE {ARTIFACT}",
    "score_rows": """SELECT path, experiment, crop_id, '/rec_score' AS pointer, 'rec_score' AS field, txt AS text, score FROM arts
UNION ALL SELECT path, experiment, crop_id, '/trace/a~1b/score', 'score', 't' || txt, score / 2 FROM arts
UNION ALL SELECT path, experiment, crop_id, '/Scores/0', 'Scores', txt, score FROM arts UNION ALL SELECT path, experiment, crop_id, '/Scores/1', 'Scores', NULL, CAST(0.25 AS DOUBLE) FROM arts""",
}


def artifacts(t):
    rows = t.fx_crops.filter(ARTIFACT)
    body = F.struct(
        c("crop_id").alias("id"), c("txt").alias("rec_text"), c("score").alias("rec_score"), F.concat(F.lit("img/"), "crop_id", F.lit(".png")).alias("input"),
        F.struct(F.struct((c("score") / 2).alias("score"), F.concat(F.lit("t"), "txt").alias("text")).alias("a/b")).alias("trace"),
        F.array(c("score"), F.lit(0.25)).alias("Scores"), F.array("txt").alias("texts"), F.when(c("crop_id") % 3 == 0, F.lit("match")).alias("status"),
    )
    experiment = F.concat(F.lit("exp"), c("crop_id") % 7)
    return rows.select(
        experiment.alias("experiment"), F.concat_ws("/", experiment, "crop_id", F.expr(NAME)).alias("path"), "crop_id",
        F.when(c("crop_id") % 50 == 3, F.lit("{broken")).otherwise(F.to_json(body)).alias("content"),
    )


def score_table(t):
    """Score records with experiment, image and a stable record number."""
    scores = ar.flatten_scores(ar.flatten_json(artifacts(t)))
    return scores.withColumn("experiment", F.element_at(F.split("path", "/"), 1)).withColumn(
        "image", F.get_json_object("context", "$.input")
    ).withColumn("record_id", F.concat_ws("#", "path", "pointer"))


def _conf(t):
    lines = F.array_join(F.array(F.lit("level\tconf\ttext"), F.concat_ws("\t", F.lit("5"), (c("crop_id") % 101).cast("string"), "txt"), F.lit("5\t-1\t"), F.lit("")), "\n")
    rows = t.fx_crops.select(c("crop_id").cast("string").alias("path"), F.when(c("crop_id") % 9 == 0, F.lit("a\tb\n1\t2")).otherwise(lines).alias("content"))
    return ar.read_conf_tsv(rows).select("path", "line", F.coalesce("text", F.lit("")).alias("text"), "conf")


def _recognise(t):
    def make_predict():
        return lambda batch: [(content.decode("utf-8")[::-1], 0.5 + len(content) / 100) for content in batch]

    images = t.fx_crops.select("crop_id", c("txt").cast("binary").alias("content"), c("ocr_executed").alias("executed"))
    rows = recognise(images, make_predict)
    return rows.select("crop_id", "txt", F.coalesce(F.floor(c("score") * 1000).cast("bigint"), F.lit(-1)).alias("score"), "input_sha256")


def _stream_readings(t):
    source, out = scratch_path(t.spark, "readings"), scratch_path(t.spark, "classified")
    t.fx_crops.write.json(source)
    stream = flows.stream_classify(t.spark.readStream.schema(t.fx_crops.schema).option("allowNonNumericNumbers", "true").json(source))
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(t.spark, "offsets"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return t.spark.read.parquet(out).select("crop_id", "stage", "reason", F.coalesce(answer_string(c("choice")), F.lit("")).alias("choice"))


def _stream_progress(t):
    source, out = scratch_path(t.spark, "progress"), scratch_path(t.spark, "latest")
    body = F.to_json(F.struct(
        F.when(c("event_type") != "error", c("event_type")).alias("stage"), F.when(c("event_type") == "error", F.lit("error")).alias("event"),
        F.floor("value").cast("bigint").alias("done"), (c("user_id") + 100).alias("total"), F.concat(F.lit("m"), "event_id").alias("message"),
    ))
    line = F.when(c("event_id") % 10 == 0, F.lit("EVENT {bad")).when(c("event_id") % 10 == 1, F.lit("plain output")).otherwise(F.concat(F.lit("EVENT "), body))
    t.events.select(c("user_id").alias("run_id"), c("event_id").alias("seq"), line.alias("line")).write.parquet(source)
    lines = t.spark.readStream.schema("run_id bigint, seq bigint, line string").option("maxFilesPerTrigger", "4").parquet(source)
    flows.write_progress(flows.stream_progress(lines, "EVENT "), out, scratch_path(t.spark, "offsets")).awaitTermination()
    return flows.read_progress(t.spark, out)


def _stream_corrections(t):
    source, out, offsets = (scratch_path(t.spark, name) for name in ("edits", "saved", "offsets"))
    edits = t.fx_corrections.withColumn("result_id", F.when(c("edit_id") % 17 == 0, F.lit("R0")).otherwise(F.lit("R1"))).withColumn(
        "seen_revision", F.when(c("edit_id") % 5 < 3, 0).otherwise((c("edit_id") % 2).cast("int"))
    )
    results = t.fx_questions.select("question_id", F.lit("R1").alias("result_id"))
    for part in ("edit_id % 5 < 3", "edit_id % 5 >= 3"):
        edits.filter(part).write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(edits.schema).parquet(source)
        flows.stream_corrections(stream, results, out, offsets).awaitTermination()
    rows = t.spark.read.schema(flows.SAVED).option("recursiveFileLookup", "true").parquet(out)
    return rows.select("question_id", "edit_id", "revision", "accepted", F.coalesce("problem", F.lit("")).alias("problem"))


# Saves see revision 0 or 1, so a chain is the first good save that sees 0 and the first later one that sees 1.
SAVED_SQL = """SELECT *, CASE WHEN judgement = '???' THEN 'judgement' WHEN question_id NOT IN (SELECT question_id FROM fx_questions) THEN 'question_gone' WHEN edit_id % 17 = 0 THEN 'stale_result' ELSE '' END AS basic FROM (
SELECT *, CASE WHEN edit_id % 5 < 3 THEN 0 ELSE edit_id % 2 END AS seen, row_number() OVER (PARTITION BY question_id ORDER BY edit_id % 5 >= 3, updated_at, edit_id) AS n FROM fx_corrections) q"""

ENTRIES = {
    "score_archive": (
        lambda t: ar.flatten_scores(ar.flatten_json(artifacts(t))).select("path", "pointer", "field", F.coalesce("text", F.lit("null")).alias("text"), "score", "score_scale", "representation"),
        check("SELECT path, pointer, field, coalesce(text, 'null') AS text, score, 'model-native; not calibrated probability' AS score_scale, CASE WHEN path LIKE '%/results.json' THEN 'derived-or-aggregate' ELSE 'source-or-metadata' END AS representation FROM score_rows WHERE crop_id % 50 <> 3", X),
    ),
    "assessment_archive": (
        lambda t: ar.flatten_assessments(ar.flatten_json(artifacts(t), assessments_only=True)).select("path", "pointer", F.get_json_object("payload", "$.status").alias("status")),
        check("SELECT path, '' AS pointer, 'match' AS status FROM arts WHERE crop_id % 3 = 0 AND crop_id % 50 <> 3", X),
    ),
    "conf_tsv": (
        _conf,
        check("""SELECT CAST(crop_id AS VARCHAR) AS path, 2 AS line, txt AS text, CAST(crop_id % 101 AS DOUBLE) AS conf FROM fx_crops WHERE crop_id % 9 <> 0
UNION ALL SELECT CAST(crop_id AS VARCHAR), 3, '', CAST(-1 AS DOUBLE) FROM fx_crops WHERE crop_id % 9 <> 0"""),
    ),
    "archive_page": (
        lambda t: ar.page_of(ar.archive_search(score_table(t).select("experiment", "path", "pointer", "field", "text", "score"), "exp3", "results", 0.3), [F.desc("score"), "path", "pointer"], 1).select("path", "pointer", "score"),
        check("SELECT path, pointer, score FROM score_rows WHERE crop_id % 50 <> 3 AND experiment = 'exp3' AND path LIKE '%results%' AND score >= CAST(0.3 AS DOUBLE) ORDER BY score DESC, path, pointer LIMIT 100 OFFSET 100", X),
    ),
    "active_scores": (
        lambda t: ar.active_view(score_table(t)),
        check("SELECT experiment, 'img/' || crop_id || '.png' AS image, text, score, path || '#' || pointer AS record_id FROM score_rows WHERE crop_id % 50 <> 3 AND field = 'rec_score'", X),
    ),
    "archive_summary": (
        lambda t: ar.archive_summary(artifacts(t), ar.flatten_json(artifacts(t))),
        check("""SELECT 'artifacts' AS name, count(*) AS n FROM arts UNION ALL SELECT 'texts', count(*) FROM arts UNION ALL SELECT 'experiments', count(DISTINCT experiment) FROM arts UNION ALL SELECT 'error', count(*) FROM arts WHERE crop_id % 50 = 3
UNION ALL SELECT 'score', count(*) FROM score_rows WHERE crop_id % 50 <> 3 UNION ALL SELECT 'assessment', count(*) FROM arts WHERE crop_id % 3 = 0 AND crop_id % 50 <> 3""", X),
    ),
    "recognise": (
        _recognise,
        check("""SELECT crop_id, CASE WHEN ocr_executed THEN reverse(txt) ELSE '' END AS txt, CASE WHEN ocr_executed THEN CAST(floor((0.5::DOUBLE + strlen(txt) / 100::DOUBLE) * 1000) AS BIGINT) ELSE -1 END AS score, sha256(txt) AS input_sha256 FROM fx_crops"""),
    ),
    "stream_readings": (
        _stream_readings,
        check("SELECT crop_id, stage, reason, coalesce(choice, '') AS choice FROM classified"),
    ),
    "stream_progress": (
        _stream_progress,
        """SELECT user_id AS run_id, event_type AS stage, event_id AS seq, CAST(floor(value) AS BIGINT) AS done, user_id + 100 AS total, 'm' || event_id AS message, event_type = 'error' AS ends_run FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 10 > 1) q WHERE rn = 1""",
    ),
    "stream_corrections": (
        _stream_corrections,
        check("""SELECT s.question_id, s.edit_id, CAST(coalesce(s.n >= f.n, false) AS INT) + CAST(coalesce(s.n >= g.n, false) AS INT) AS revision, coalesce(s.n = f.n OR s.n = g.n, false) AS accepted,
 CASE WHEN s.basic <> '' THEN s.basic WHEN NOT coalesce(s.n = f.n OR s.n = g.n, false) THEN 'stale_revision' ELSE '' END AS problem
FROM saved s LEFT JOIN (SELECT question_id, min(n) AS n FROM saved WHERE basic = '' AND seen = 0 GROUP BY question_id) f ON f.question_id = s.question_id
 LEFT JOIN (SELECT a.question_id, min(a.n) AS n FROM saved a JOIN saved b ON b.question_id = a.question_id AND b.basic = '' AND b.seen = 0 AND b.n < a.n WHERE a.basic = '' AND a.seen = 1 GROUP BY a.question_id) g ON g.question_id = s.question_id""", {"saved": SAVED_SQL}),
    ),
}
