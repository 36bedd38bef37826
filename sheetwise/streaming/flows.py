"""Readings, progress and corrections as streams.

Results go to tables in a shared folder. A batch that is run again after a failure
replaces its own output (saves) or changes nothing (progress).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.operators.review import classify_crops
from sheetwise.sources.results import JUDGEMENTS
from sheetwise.streaming.store import current_rows, last_number, merge_rows

PROGRESS_TYPE = "struct<stage:string,event:string,done:bigint,total:bigint,message:string>"


def stream_classify(readings: DataFrame) -> DataFrame:
    """Stage and reason of readings as they arrive; no state."""
    return classify_crops(readings)


def stream_progress(lines: DataFrame, prefix: str) -> DataFrame:
    """Latest done/total/message per run and stage of progress lines
    (run_id, seq, line); other output and broken JSON are skipped."""
    body = F.substr("line", F.lit(len(prefix) + 1))
    events = (
        lines.filter(F.startswith("line", F.lit(prefix))).withColumn("e", F.from_json(body, PROGRESS_TYPE))
        .filter("e IS NOT NULL AND (e.stage IS NOT NULL OR e.event IS NOT NULL)")
    )
    return events.groupBy("run_id", F.coalesce("e.event", "e.stage").alias("stage")).agg(
        F.max("seq").alias("seq"), F.max_by(F.struct("e.done", "e.total", "e.message"), "seq").alias("last"),
        F.max(F.col("e.event").isin("complete", "error")).alias("ends_run"),
    ).select("run_id", "stage", "seq", "last.*", F.coalesce("ends_run", F.lit(False)).alias("ends_run"))


PROGRESS_KEYS = ("run_id", "stage")


def write_progress(updates: DataFrame, path: str, checkpoint: str):
    """Merge every batch of stream_progress into the table at ``path``, which
    read_progress reads. The line number decides, so redelivered lines, batches that run
    again and a lost checkpoint change nothing."""

    def save(batch: DataFrame, batch_id: int) -> None:
        merge_rows(batch, path, PROGRESS_KEYS, "seq")

    return (
        updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(save).trigger(availableNow=True).start()
    )


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return current_rows(spark, path, PROGRESS_KEYS, "seq")


SAVED = (
    "question_id bigint, edit_id bigint, read_answer string, judgement string, note string, updated_at timestamp, "
    "based_on_result_id string, based_on_rules_version string, extra string, revision int, accepted boolean, problem string"
)
STATE = "question_id bigint, revision int, extra string, batch string, before_revision int, before_extra string"
STATE_OF_STORED = (
    "question_id", "revision", "extra", "CAST(NULL AS STRING) AS batch", "CAST(NULL AS INT) AS before_revision", "CAST(NULL AS STRING) AS before_extra",
    "CAST(0 AS BIGINT) AS seq",
)

def saved_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Current correction per question: the accepted save with the highest revision."""
    rows = spark.read.schema(SAVED).option("recursiveFileLookup", "true").parquet(path).filter("accepted")
    values = [f.split()[0] for f in SAVED.split(", ") if f.split()[0] not in ("question_id", "accepted", "problem")]
    return rows.groupBy("question_id").agg(F.max_by(F.struct(*values), "revision").alias("v")).select("question_id", "v.*")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Saves in order of question and time, each judged against the state that the saves
    before it left. State: revision, and the unknown members of the last accepted save,
    which a later save without such members keeps."""
    question, revision, extra, started = None, 0, None, False
    for batch in batches:
        judged = []
        columns = (batch.column(name).to_pylist() for name in ("question_id", "seen_revision", "problem", "extra", "held_revision", "held_extra"))
        for ident, seen, problem, more, held, kept in zip(*columns):
            if not started or ident != question:
                started, question, revision, extra = True, ident, held or 0, kept
            if problem is None and seen != revision:
                problem = "stale_revision"
            if problem is None:
                revision += 1
                extra = more if more is not None else extra
            judged.append((revision, problem is None, problem, extra if problem is None else more))
        if judged:
            found = dict(zip(("revision", "accepted", "problem", "extra"), zip(*judged)))
            kinds = {"revision": pa.int32(), "accepted": pa.bool_(), "problem": pa.string(), "extra": pa.string()}
            names = [f.split()[0] for f in SAVED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(found[n], kinds[n]) if n in found else batch.column(n) for n in names], names)


def judge_saves(saves: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of prepare_saves judged one after the other per question, from ``state``
    (question_id, revision, extra) on. A sorted stream of rows: no question's saves are gathered."""
    held = state.select("question_id", F.col("revision").alias("held_revision"), F.col("extra").alias("held_extra"))
    time = [F.asc_nulls_last("updated_at"), F.asc_nulls_last("edit_id")]
    rows = saves.join(held, "question_id", "left").repartition("question_id").sortWithinPartitions("question_id", *time)
    return rows.mapInArrow(_judge, SAVED)


def prepare_saves(edits: DataFrame, results: DataFrame) -> DataFrame:
    """Saves with what can be said about them without their question's history.

    ``edits``: question_id, edit_id, updated_at, read_answer, judgement, result_id,
    seen_revision, and where known note, rules_version and extra (the text of unknown
    members); ``results``: question_id, result_id of the current results, one row each.
    """
    optional = {"note": "string", "rules_version": "string", "extra": "string"}
    known = edits.select(*edits.columns, *(F.lit(None).cast(kind).alias(name) for name, kind in optional.items() if name not in edits.columns))
    current = results.select("question_id", F.col("result_id").alias("current_result"))
    problem = (
        F.when(F.col("question_id").isNull() | F.col("seen_revision").isNull() | ~F.coalesce(F.col("judgement").isin(*JUDGEMENTS), F.lit(False)),
               F.when(F.coalesce(F.col("judgement").isin(*JUDGEMENTS), F.lit(False)), F.lit("incomplete")).otherwise(F.lit("judgement")))
        .when(F.col("current_result").isNull(), F.lit("question_gone"))
        .when(~F.col("current_result").eqNullSafe(F.col("result_id")), F.lit("stale_result"))
    )
    return known.join(current, "question_id", "left").select(
        "question_id", F.col("edit_id").cast("bigint").alias("edit_id"), F.trim("read_answer").alias("read_answer"), "judgement", "note",
        F.col("updated_at").cast("timestamp").alias("updated_at"), F.col("result_id").alias("based_on_result_id"),
        F.col("rules_version").alias("based_on_rules_version"), "extra", F.coalesce("seen_revision", F.lit(-1)).cast("int").alias("seen_revision"), problem.alias("problem"),
    )


def _revisions(path: str) -> str:
    """Where the state behind the saves at ``path`` stands; beside it, so that reading the saves meets no other rows."""
    return f"{path.rstrip('/')}-revisions"


def _held(spark: SparkSession, path: str) -> DataFrame:
    """State per question: revision and extra, the batch that left it and what it was before."""
    place = _revisions(path)
    if not last_number(spark, place):
        try:
            stored = saved_corrections(spark, path).select("question_id", "revision", "extra")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], STATE)
        first = stored.selectExpr(*STATE_OF_STORED)
        merge_rows(first, place, ["question_id"], "seq")
    return current_rows(spark, place, ["question_id"], "seq").select(*(f.split()[0] for f in STATE.split(", ")))


def save_batch(batch: DataFrame, name: str, path: str) -> None:
    """Judge the saves of one batch and keep them under its name.

    A state row says which batch left it and what it was before, so a batch that is run
    again, after its rows or its state were written, starts where it started first.
    """
    spark = batch.sparkSession
    held = _held(spark, path)
    own = F.coalesce(F.col("batch") == name, F.lit(False))
    before = lambda column: F.when(own, F.col(f"before_{column}")).otherwise(F.col(column)).alias(column)
    state = held.select("question_id", before("revision"), before("extra"))
    judge_saves(batch, state).write.mode("overwrite").parquet(f"{path}/{name}")

    accepted = spark.read.schema(SAVED).parquet(f"{path}/{name}").filter("accepted")
    last = accepted.groupBy("question_id").agg(F.max_by(F.struct("revision", "extra"), "revision").alias("v")).select("question_id", "v.*")
    again = held.filter(own)
    if not again.isEmpty():  # what an earlier run of this batch left and this one does not
        undone = again.select("question_id", F.col("before_revision").alias("revision"), F.col("before_extra").alias("extra"))
        last = last.unionByName(undone.join(last, "question_id", "left_anti"))
    number = last_number(spark, _revisions(path)) + 1
    was = state.select("question_id", F.col("revision").alias("before_revision"), F.col("extra").alias("before_extra"))
    rows = last.join(was, "question_id", "left").select(
        "question_id", "revision", "extra", F.lit(name).alias("batch"), F.coalesce("before_revision", F.lit(0)).alias("before_revision"), "before_extra",
        F.lit(number).cast("bigint").alias("seq"))
    merge_rows(rows, _revisions(path), ["question_id"], "seq")


def stream_corrections(edits: DataFrame, results: DataFrame, path: str, checkpoint: str):
    """Optimistic saves from a stream of edits into the table at ``path``: a row per save,
    accepted or refused with its problem.

    Saves of a question are judged one after the other, in the order of their time within
    a batch, so it does not matter where batches end. The revisions reached are kept beside
    ``path`` as a merged table, so every run, with or without its checkpoint, starts from
    what ``path`` holds; each query writes to folders of its own. The saves of one question
    in one batch pass through one task, as a stream.
    """
    run: list[str] = []

    def save(batch: DataFrame, batch_id: int) -> None:
        # The id of a query lives in its checkpoint: a batch that is run again replaces
        # its own rows, another checkpoint never those of an earlier one.
        save_batch(batch, f"{run_of(batch)}-{batch_id}", path)

    def run_of(batch: DataFrame) -> str:
        if not run:
            run.append(batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"))
        return run[0]

    saves = prepare_saves(edits, results)
    return saves.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
