"""Streams with state: saves judged one after the other, whatever the batches."""

import pytest

from sheetwise.session import scratch_path
from sheetwise.streaming import flows

EDITS = "question_id bigint, edit_id bigint, updated_at timestamp, read_answer string, judgement string, result_id string, seen_revision int, note string, extra string"


def edits(spark):
    from datetime import datetime

    def row(question, edit, answer, seen, judgement="정답", result="R1", note="n", extra=None):
        return question, edit, datetime(2026, 1, 1, 0, 0, edit), answer, judgement, result, seen, note, extra

    rows = [
        row(1, 1, " 2 ", 0, extra='{"by":"x"}'), row(1, 2, "3", 0), row(1, 3, "4", 1), row(1, 4, "5", 2, judgement="?"), row(1, 5, None, 2, note="last"),
        row(2, 6, "1", 0, result="R0"), row(2, 7, "2", 0), row(3, 8, "1", 0), row(4, 9, "1", 1), row(4, 10, "1", 0), row(None, 11, "1", 0), row(5, 12, "1", None),
    ]
    return spark.createDataFrame(rows, EDITS)


def run(spark, parts, restart):
    source, out = scratch_path(spark, "edits"), scratch_path(spark, "saved")
    results = spark.createDataFrame([(i, "R1") for i in (1, 2, 4, 5)], "question_id bigint, result_id string")
    offsets = scratch_path(spark, "offsets")
    for part in parts:
        if restart:  # neither the checkpoint nor the source of the runs before is left
            source, offsets = scratch_path(spark, "edits"), scratch_path(spark, "offsets")
        edits(spark).filter(part).write.mode("append").parquet(source)
        flows.stream_corrections(spark.readStream.schema(EDITS).parquet(source), results, out, offsets).awaitTermination()
    judged = {r.edit_id: (r.accepted, r.problem, r.revision) for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect()}
    saved = {r.question_id: (r.read_answer, r.revision, r.note, r.extra, r.edit_id) for r in flows.saved_corrections(spark, out).collect()}
    return judged, saved


@pytest.mark.parametrize("parts,restart", [(["true"], False), (["edit_id <= 2", "edit_id > 2"], False), (["edit_id <= 4", "edit_id > 4"], True), (["edit_id > 5", "edit_id <= 5"], True)])
def test_every_save_is_judged_in_turn(spark, parts, restart):
    judged, saved = run(spark, parts, restart)
    assert judged == {
        1: (True, None, 1), 2: (False, "stale_revision", 1), 3: (True, None, 2), 4: (False, "judgement", 2), 5: (True, None, 3),
        6: (False, "stale_result", 0), 7: (True, None, 1), 8: (False, "question_gone", 0), 9: (False, "stale_revision", 0), 10: (True, None, 1),
        11: (False, "incomplete", 0), 12: (False, "incomplete", 0),
    }
    assert saved == {1: (None, 3, "last", '{"by":"x"}', 5), 2: ("2", 1, "n", None, 7), 4: ("1", 1, "n", None, 10)}


def test_a_batch_that_runs_again_starts_where_it_started(spark):
    out = scratch_path(spark, "saved")
    results = spark.createDataFrame([(i, "R1") for i in (1, 2, 4, 5)], "question_id bigint, result_id string")
    saves = flows.prepare_saves(edits(spark), results)
    read = lambda: sorted((r.edit_id, r.accepted, r.revision) for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect())
    flows.save_batch(saves.filter("edit_id <= 2"), "q-0", out)
    flows.save_batch(saves.filter("edit_id > 2"), "q-1", out)
    once = read()
    flows.save_batch(saves.filter("edit_id > 2"), "q-1", out)
    assert read() == once
    flows.save_batch(saves.filter("edit_id > 2 AND edit_id < 5"), "q-1", out)  # what only the earlier run left is undone
    flows.save_batch(saves.filter("edit_id = 5"), "q-2", out)
    assert (5, True, 3) in read()


def test_many_saves_of_one_question_pass_as_a_stream(spark):
    rows = spark.range(60000).selectExpr("1L AS question_id", "id AS edit_id", "timestamp_seconds(id) AS updated_at", "'1' AS read_answer", "'정답' AS judgement", "'R1' AS result_id", "CAST(id % 2 AS INT) AS seen_revision")
    saves = flows.prepare_saves(rows, spark.createDataFrame([(1, "R1")], "question_id bigint, result_id string"))
    judged = flows.judge_saves(saves, spark.createDataFrame([(1, 1, None)], "question_id bigint, revision int, extra string"))
    assert [(r.edit_id, r.revision) for r in judged.filter("accepted").collect()] == [(1, 2)]
    assert judged.count() == 60000


def progress(spark, lines):
    rows = [(run, seq, f'EVENT {{"stage": "{stage}", "done": {done}, "total": 9}}') for run, seq, stage, done in lines]
    return spark.createDataFrame([*rows, (1, 0, "plain"), (1, 0, "EVENT {bad")], "run_id bigint, seq bigint, line string")


def test_progress_survives_lost_checkpoints(spark):
    out = scratch_path(spark, "latest")
    runs = [[(1, 1, "a", 1), (1, 2, "a", 2), (2, 1, "a", 5)], [(1, 3, "b", 1), (1, 1, "a", 1)], [(2, 7, "a", 9)]]
    for lines in runs:  # every run has a checkpoint and a source of its own
        source = scratch_path(spark, "progress")
        progress(spark, lines).write.parquet(source)
        stream = spark.readStream.schema("run_id bigint, seq bigint, line string").parquet(source)
        flows.write_progress(flows.stream_progress(stream, "EVENT "), out, scratch_path(spark, "offsets")).awaitTermination()
    got = {(r.run_id, r.stage): (r.seq, r.done) for r in flows.read_progress(spark, out).collect()}
    assert got == {(1, "a"): (2, 2), (1, "b"): (3, 1), (2, "a"): (7, 9)}


def test_store_reads_two_folders_and_refuses_a_second_writer(spark):
    from sheetwise.streaming import store

    path = scratch_path(spark, "store")
    store.merge_rows(spark.range(100).selectExpr("id AS k", "0 AS seq", "'first' AS v"), path, ["k"], "seq")
    for i in range(1, 13):
        store.merge_rows(spark.range(3 * i, 3 * i + 3).selectExpr("id AS k", f"{i} AS seq", f"'later {i}' AS v"), path, ["k"], "seq")
        store.merge_rows(spark.range(5).selectExpr("id AS k", "-1 AS seq", "'stale' AS v"), path, ["k"], "seq")
    rows = store.current_rows(spark, path, ["k"], "seq")
    assert {r.k: r.v for r in rows.collect()} == {k: f"later {k // 3}" if 3 <= k < 39 else "first" for k in range(100)}
    assert len({f.rsplit("/", 2)[1] for f in rows.inputFiles()}) <= 2
    number, content = store._last_commit(spark, path)
    with pytest.raises(store.CommitRefused):
        store._commit(spark, path, number, content)
