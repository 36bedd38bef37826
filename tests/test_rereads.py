import pytest

from rows import crops
from sheetwise.operators import rereads as rr


def readings(spark, rows):
    return spark.createDataFrame([(1, "S", i, float(p), t, s) for i, (p, t, s) in enumerate(rows, 1)],
                                 "crop_id bigint, stage string, variant_no int, param double, txt string, score double")


@pytest.mark.parametrize("rows,stable", [
    ([(2, "2", 0.8), (2.5, "②", 0.9), (3, "2", 0.8)], True), ([(2, "2", 0.8), (2.5, "3", 0.9), (3, "2", 0.8)], False),
    ([(2, "2", 0.8), (2.5, "2", 0.79), (3, "2", 0.8)], False), ([(2, "6", 0.8), (2.5, "6", 0.9), (3, "6", 0.8)], False),
    ([(2, "2", 0.8), (3, "2", 0.9), (2.5, "2", 0.8)], False), ([(2, "2", 0.8), (2.5, "2", 0.9)], False),
    ([(2, "2", 0.8), (2.5, "2", float("nan")), (3, "2", 0.8)], False), ([(2, "2", 0.8), (2.5, "2", None), (3, "2", 0.8)], False),
])
def test_consensus(spark, rows, stable):
    row = rr.consensus(readings(spark, rows), (2.0, 2.5, 3.0), 2.5).first()
    assert row.stable == stable
    if stable:
        assert (row.picked.txt, row.picked.score) == ("②", 0.9)


def shape(spark, old, new=("2", 0.95), method="hull_stable", proof=2, conflict=None, allow=True):
    rows = crops(spark, dict(txt=old[0], score=old[1]))
    extra = spark.createDataFrame([(1, *new, method, proof is not None, proof, *(conflict or (None, None)))],
                                  "crop_id bigint, new_txt string, new_score double, method string, proof_ok boolean, proof_digit int, conflict_old int, conflict_new int")
    row = rr.reconcile_shape(rows.join(extra, "crop_id"), allow).select(
        "status", "txt", "conflict_old", "conflict_new").first()
    return row.status, row.txt, (row.conflict_old, row.conflict_new)


def mask(*numbers):
    return sum(1 << n - 1 for n in numbers)


def test_reread_is_not_forced(spark):
    none = (None, None)
    assert shape(spark, ("0", 0.2), ("1", 0.95), allow=False) == ("adopted", "1", none)
    assert shape(spark, ("0", 0.2), ("1", 0.8), allow=False) == ("adopted", "1", none)
    assert shape(spark, ("0", 0.2), ("1", 0.79), allow=False) == ("still_unreadable", "0", none)
    assert shape(spark, ("0", 0.2), ("@", 0.99), allow=False) == ("still_unreadable", "0", none)
    assert shape(spark, ("③", 0.2), ("1", 0.95), allow=False) == ("answer_conflict", "③", (mask(3), mask(1)))


def test_consensus_replaces_only_a_low_single_digit(spark):
    for method in ("hull_stable", "size_stable_C", "circle_strip_D-1", "circle_strip_D-2", "enclosure"):
        assert shape(spark, ("③", 0.4), method=method) == ("adopted", "2", (None, None))
    held = ("answer_conflict", "③", (mask(3), mask(2)))
    assert shape(spark, ("③", 0.4), allow=False) == held
    assert shape(spark, ("③", 0.4), method="unknown") == held
    assert shape(spark, ("③", 0.4), proof=None) == held
    assert shape(spark, ("③", 0.4), proof=3) == held
    for score in (0.8, 0.99, None, float("nan"), float("inf")):
        assert shape(spark, ("③", score)) == held
    assert shape(spark, ("③", 0.4), conflict=(mask(3), mask(2)))[0] == "adopted"
    assert shape(spark, ("③", 0.4), conflict=(mask(3), mask(1))) == ("answer_conflict", "③", (mask(3), mask(1)))
    for text in ("①④", "①②③", "1,4", "1 4", "(1)", "1."):
        assert shape(spark, (text, 0.633), ("4", 0.984), proof=4)[:2] == ("answer_conflict", text)


def test_history_counts_even_without_attempts(spark):
    rows = crops(spark, {}, {})
    traces = spark.createDataFrame([(2, 0)], "crop_id bigint, attempts int")
    assert [r.crop_id for r in rr.without_history(rows, traces).collect()] == [1]


def test_crops_without_readings_pass_the_cascade_unchanged(spark):
    rows = crops(spark, dict(txt="③", score=0.4), dict(txt="③", score=0.4), dict(txt="③", score=0.4), dict(txt="③", score=0.4))
    read = [(1, "B", i, p, "2", 0.9) for i, p in enumerate((2.0, 2.5, 3.0), 1)] + [(4, "peel", 1, 0.0, "2", 0.9)]
    read = spark.createDataFrame(read, "crop_id bigint, stage string, variant_no int, param double, txt string, score double")
    due = rr.cascade(rows.selectExpr("*", "crop_id % 2 = 0 AS peel_possible").join(rr.stage_results(read), "crop_id", "left"))
    assert sorted((r.crop_id, r.due_peel, r.due_B, r.due_C, r.due_D1, r.due_D2, r.confirm_D2) for r in due.collect()) == [
        (1, False, True, False, False, False, False), (2, True, False, False, False, False, False),
        (3, False, True, False, False, False, False), (4, True, False, False, False, True, True)]
    done = {r.crop_id: (r.txt, r.score, r.conflict_old, r.conflict_new, r.trace) for r in rr.run_cascade(due).collect()}
    assert done[2] == done[3] == ("③", 0.4, None, None, "")
    assert done[1][4] == "B:adopted" and done[4] == ("③", 0.4, mask(3), mask(2), "peel:answer_conflict")
