"""How often rows travel: the shared steps of the reviews and of ownership."""

from __future__ import annotations

import re

import pytest

from sheetwise.operators.labels import compare_label
from sheetwise.operators.review import f08_blockers
from sheetwise.plans.grading import Graded, associations, ring_duplicates


@pytest.fixture
def unhinted(spark):
    """Without broadcasts, as on large tables."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", plan))


def test_lines_travel_once_by_question(unhinted, sheets):
    assert sorted(exchanges(sheets.fx_crops.groupBy("question_id").count())) == ["l_orderkey", "question_id"]  # the other are the questions


def test_reviews_read_stored_crops_and_meet_labels_where_they_lie(unhinted, sheets):
    g = Graded(sheets)
    rows = compare_label(g.reviews(), g.labels)
    assert "l_orderkey" not in rows._jdf.queryExecution().executedPlan().toString()
    assert exchanges(rows).count("question_id") == 3  # questions, facts and labels, never the reviews


def test_associations_carry_what_ownership_needs(unhinted, sheets):
    _, associated = associations(sheets)
    assert not {"txt", "score", "route"} & set(associated.columns)


def test_inked_rows_are_grouped_where_their_lines_lie(unhinted, sheets):
    from sheetwise.operators.layout import row_groups

    rows = sheets.fx_crops.selectExpr("question_id", "explode(sequence(yt, yt + 8, 4)) AS y", "crop_no AS pixels")
    assert sorted(exchanges(row_groups(rows, ["question_id"]))) == ["l_orderkey", "question_id"]


def test_pieces_of_an_exchange_do_not_depend_on_the_session(unhinted, sheets):
    """A task holds a few MB of an exchange, however many partitions the session asks for."""
    plan = sheets.fx_crops._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\)", plan)) == {"1000"}
    assert unhinted.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "4m"


def test_overlaps_are_found_once(unhinted, sheets):
    g = Graded(sheets)
    held, candidates = g.classified.filter("reason IN ('6', '7')"), g.classified.filter("stage = 0")
    blockers = f08_blockers(g.classified, ring_duplicates(held, candidates))
    assert exchanges(blockers).count("question_id, cell_x, cell_y") == 2  # held crops and candidates


def test_a_stage_summary_has_one_run_of_reviews(sheets):
    from sheetwise.plans.catalog.grading import _stage_summary

    files = " ".join(_stage_summary(sheets).inputFiles())
    assert len(set(re.findall(r"classified-[0-9a-f]+", files))) == 1
    assert len(set(re.findall(r"compared-[0-9a-f]+", files))) == 1


def test_crops_meet_zones_once(unhinted, sheets):
    """No second run of the crops beside their hits."""
    plan = associations(sheets)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[[^\]]*l_orderkey", plan)) == 1


def test_cells_of_a_crop_travel_without_its_hash(unhinted, sheets):
    from sheetwise.plans.catalog.ownership import _annotate

    plan = _annotate(sheets)._jdf.queryExecution().executedPlan().toString()
    listed = [line for line in plan.splitlines() if "Generate" in line]
    assert listed and not [line for line in listed if "source_hash" in line]


def test_annotations_of_repeated_and_nameless_crops(spark):
    from sheetwise.operators.ownership import attach_annotations

    crops = spark.createDataFrame(
        [(1, 1, "a", 0, 0, 10, 10), (1, 1, "a", 0, 0, 10, 10), (1, 2, "z", 0, 0, 9, 9), (None, 1, "b", 5, 5, 90, 90), (2, 1, None, 200, 200, 210, 210), (3, 1, "c", 900, 900, 910, 910)],
        "crop_id bigint, page int, source_hash string, xl int, yt int, xr int, yb int",
    )
    notes = spark.createDataFrame(
        [(1, 1, "a", "first", 2, 2, 8, 8), (1, 2, "b", "last", 6, 6, 80, 80), (1, 3, None, "bare", 190, 190, 300, 300)],
        "page int, note_seq int, source_hash string, note string, xl int, yt int, xr int, yb int",
    )
    other = "previous_annotation_overlap_requires_review"
    assert {tuple(r) for r in attach_annotations(crops, notes).collect()} == {(1, other), (None, "last"), (2, other)}


def test_regions_meet_counts_of_ranges_only(unhinted, sheets):
    from sheetwise.operators.layout import number_regions

    assert sorted(exchanges(number_regions(sheets.fx_crops.select("crop_id", "page", "xl", "yt", "xr", "yb")))) == ["page"] + ["page, _range"] * 3


def test_numbers_run_over_ranges_of_one_page(spark):
    """One page in many ranges: copies of one box, other pages beside it, rows without a whole place counted first and left out."""
    from pyspark.sql import functions as F

    from sheetwise.operators.ordered import range_ordinal

    old = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "20")
    try:
        rows = [(1 if i % 4 else 2, i % 3, i * 7919 % 5003) for i in range(3000)] + [(None, 1, 1), (1, None, 1), (1, 1, None)]
        df = spark.createDataFrame(rows, "page int, yt int, crop_id int")
        got = {tuple(r) for r in range_ordinal(df, ["page"], ["yt", "crop_id"], "n").collect()}
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    want = set()
    for page in (1, 2):
        placed = sorted((r for r in rows if r[0] == page), key=lambda r: [(v is not None, v or 0) for v in r])
        want |= {(p, y, c, n) for n, (p, y, c) in enumerate(placed, 1) if None not in (y, c)}
    assert got == want


def test_few_points_of_a_group_are_not_spread_over_cells(spark, monkeypatch):
    from sheetwise.operators import layout as lo

    def refuse(*_):
        raise AssertionError("listed in nine cells")

    monkeypatch.setattr(lo, "_around", refuse)
    rows = [(q, n, 10 * n, 0, float(n % 3)) for q in range(5) for n in range(lo.FEW_POINTS)]
    kept = []
    for _, label, x, y, score in sorted(rows[: lo.FEW_POINTS], key=lambda r: (r[4], r[1]), reverse=True):
        if all(abs(x - a) > 18 for _, a, _ in kept):
            kept.append((label, x, y))
    got = lo.suppress_near(spark.createDataFrame(rows, "q int, label int, x int, y int, score double"), ["q"])
    assert sorted(map(tuple, got.select("q", "label", "x", "y").collect())) == sorted((q, *one) for q in range(5) for one in kept)


def test_tables_bring_their_pieces_back_after_a_text_operator(spark, sheets):
    from sheetwise.llm.common import prepare

    prepare(spark)
    sheets.fx_crops
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "1000"
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "4m"


def test_boxes_of_a_key_meet_without_a_grid_where_they_are_few(unhinted):
    from sheetwise.operators.spatial import FEW_BOXES, overlap_counts

    # Key 1 holds one box more than few, key 2 few with copies, key None no pair.
    build = [(1, 7 * i, 7 * i, 7 * i + 60, 7 * i + 60) for i in range(FEW_BOXES + 1)] + [(2, 5 * i % 90, 0, 5 * i % 90 + 200, 300) for i in range(90)] + [(None, 0, 0, 9, 9)]
    probe = [(q, i, 11 * i, 11 * i, 11 * i + 150, 11 * i + 20) for q in (1, 2, None) for i in range(40)] + [(3, 0, 0, 0, 9, 9), (2, 99, 0, 0, None, 9)]
    build += [(2, 0, 0, None, 300)]
    box = "xl int, yt int, xr int, yb int"
    counted = overlap_counts(unhinted.createDataFrame(probe, f"q int, n int, {box}"), unhinted.createDataFrame(build, f"q int, {box}"), ["q"])
    meet = lambda a, b: None not in (*a, *b) and max(a[0], b[0]) < min(a[2], b[2]) and max(a[1], b[1]) < min(a[3], b[3])
    want = {(p[0], p[1], n) for p in probe if p[0] is not None and (n := sum(p[0] == b[0] and meet(p[2:], b[1:]) for b in build))}
    assert {(r.q, r.n, r.n_overlaps) for r in counted.collect()} == want and {q for q, _, _ in want} == {1, 2}
    assert "q" in exchanges(counted)


def test_owned_reviews_make_crops_once(sheets):
    from sheetwise.plans.grading import owned_reviews

    files = " ".join(owned_reviews(sheets).inputFiles())
    assert "lineitem" not in files and "owned-" in files


def test_two_evidence_runs_read_stored_crops(sheets, monkeypatch):
    from sheetwise.plans import grading

    stored, kept = {}, grading.materialise
    monkeypatch.setattr(grading, "materialise", lambda df, name: stored.setdefault(name, df) and kept(df, name))
    grading.agreement_tables(sheets)
    assert not {"txt", "route", "crop_no"} & set(stored["touched"].columns)
    assert not [f for f in stored["decided"].inputFiles() if "lineitem" in f]


def test_documents_may_be_compressed_and_read_evidence_once(spark, tmp_path, monkeypatch):
    import json

    from sheetwise.sources import documents
    from sheetwise.sources.results import read_documents

    names, kept = [], documents.materialise
    monkeypatch.setattr(documents, "materialise", lambda df, name: (names.append(name), kept(df, name))[1])
    results = spark.createDataFrame([("A1", "R", "2026-01-01T00:00:00+09:00", "T")], "assessment_id string, result_id string, generated_at string, title string")
    questions = spark.createDataFrame(
        [("A1", q, f"L{q}", "보류", None, "1", None, "r") for q in (1, 2)],
        "assessment_id string, question_id bigint, label string, judgement string, read_answer string, answer_key string, review_stage int, rules_version string",
    )
    reasons = spark.createDataFrame([("A1", 1, 1, "2", "m", 1)], "assessment_id string, question_id bigint, seq int, code string, message string, stage int")
    evidence = spark.createDataFrame(
        [("A1", 1, c, n, f"i{c}-{n}", f"p{c}-{n}.png", "e") for c in (None, -1, 5) for n in (0, 11)],
        "assessment_id string, question_id bigint, crop_id bigint, retry_no int, image_id string, path string, label string",
    )
    documents.write_documents(results, questions, reasons, evidence, str(tmp_path / "out"), compression="gzip")
    (raw,) = [r.raw for r in read_documents(spark, f"{tmp_path}/out/*/*.txt.gz").collect()]
    listed = json.loads(raw)["questions"]
    assert [i["id"] for i in listed[0]["evidence_images"]] == ["iNone-0", "iNone-11", "i-1-0", "i-1-11", "i5-0", "i5-11"] and not listed[1]["evidence_images"]
    assert names == ["questions"]
