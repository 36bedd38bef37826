import pytest

from rows import crops
from sheetwise.operators import ownership as own


def zones(spark, *rows):
    return spark.createDataFrame([(1, i, *z) for i, z in enumerate(rows, 1)], "page int, question_id bigint, zl int, zt int, zr int, zb int")


def associate(spark, box, layout, minimum=None):
    crop = crops(spark, dict(zip(("xl", "yt", "xr", "yb"), box))).drop("question_id")
    rows = own.associate(crop, zones(spark, *layout), minimum).collect()
    return rows[0].status, sorted(r.question_id for r in rows if r.kept)


UPPER_LOWER = ([0, 0, 100, 60], [0, 60, 100, 100])


@pytest.mark.parametrize("box,minimum,status,kept", [
    ((0, 0, 100, 100), 0.5, "assigned", [1]), ((0, 0, 100, 100), 0.6, "assigned", [1]), ((0, 0, 100, 100), 0.7, "ambiguous", [1, 2]),
    ((0, 20, 100, 100), 0.5, "ambiguous", [1, 2]), ((110, 0, 120, 20), 0.5, "unassigned", []), ((-10, 0, 10, 20), 0.5, "assigned", [1]),
    ((-10, 0, 10, 20), 0.6, "outside_zone", [1]), ((20, 20, 30, 30), None, "assigned", [1]), ((90, 40, 95, 80), None, "ambiguous", [1, 2]),
])
def test_associate(spark, box, minimum, status, kept):
    assert associate(spark, box, UPPER_LOWER, minimum) == (status, kept)


@pytest.mark.parametrize("minimum", [0, 0.49, 1.1, float("nan")])
def test_bad_minimum(spark, minimum):
    with pytest.raises(ValueError):
        associate(spark, (0, 0, 10, 10), UPPER_LOWER, minimum)


def test_bad_box_stops(spark):
    with pytest.raises(Exception, match="Invalid ink box"):
        associate(spark, (10, 0, 10, 5), UPPER_LOWER)


def enclosing(spark, layout, *rows):
    crop = own.anchor_columns(crops(spark, *rows).drop("question_id"))
    return [(r.crop_id, r.owner) for r in own.enclosing_assignments(own.associate(crop, zones(spark, *layout))).collect()]


WIDE = ([0, 0, 100, 200], [100, 0, 200, 200])


def at(l, t, r, b, **kw):
    return dict(xl=l, yt=t, xr=r, yb=b, **kw)


def test_enclosing_takes_one_owner_only(spark):
    outer = at(50, 0, 150, 100, txt="O", score=0.2, route="choice_mark_review")
    assert enclosing(spark, WIDE, outer, at(60, 10, 70, 20)) == [(1, 1)]
    assert enclosing(spark, WIDE, outer, at(60, 10, 70, 20), at(110, 10, 120, 20)) == []
    assert enclosing(spark, WIDE, outer, at(60, 10, 70, 20), at(70, 30, 80, 40)) == [(1, 1)]
    assert enclosing(spark, WIDE, {**outer, "is_empty": True}, at(60, 10, 70, 20)) == []
    for bad in (dict(score=0.79), dict(semantic_annotation="x"), dict(reread_conflict=True), dict(retry_ownership_review=True), dict(txt="word3")):
        assert enclosing(spark, WIDE, outer, at(60, 10, 70, 20, **bad)) == []


def test_enclosing_share_and_no_chain(spark):
    # The outer crop crosses the zone edge; it covers 80 or 79 of 100 columns of the answer.
    layout = ([0, 0, 100, 200], [0, 200, 300, 400])
    assert enclosing(spark, layout, at(-20, 50, 80, 260), at(0, 60, 100, 70)) == [(1, 1)]
    assert enclosing(spark, layout, at(-20, 50, 79, 260), at(0, 60, 100, 70)) == []
    chain = [at(50, 0, 150, 100), at(50, 0, 60, 10), at(60, 0, 170, 100)]
    assert enclosing(spark, WIDE, *chain) == [(1, 1)]


def test_column_bottoms(spark):
    rows = spark.createDataFrame([(1, 2, 5, 50, 50, 80), (2, 2, 50, 30, 95, 80), (3, 2, 5, 10, 50, 50), (4, 3, 5, 10, 50, 80)],
                                 "question_id bigint, page int, zl int, zt int, zr int, zb int")
    heights = spark.createDataFrame([(2, 100), (3, 120)], "page int, height int")
    out = {r.question_id: (r.zb, r.problem) for r in own.extend_column_bottoms(rows, heights).collect()}
    assert out == {1: (100, None), 2: (100, None), 3: (50, None), 4: (120, None)}
    low = spark.createDataFrame([(2, 70), (3, 120)], "page int, height int")
    assert {r.problem for r in own.extend_column_bottoms(rows, low).collect()} == {None, "outside_page"}


def test_one_row_per_hit_and_one_for_a_crop_without(spark):
    """No crop travels beside its hits: the rows are the hits, over all cells of a crop."""
    layout = ([0, 0, 100, 600], [0, 600, 100, 1200], [0, 560, 100, 1200])
    rows = own.associate(
        crops(spark, at(10, 10, 20, 20), at(10, 500, 20, 700), at(300, 500, 1400, 1100), at(-10, 10, 10, 1500)).drop("question_id"), zones(spark, *layout)
    ).collect()
    found = sorted((r.crop_id, r.question_id or 0, r.n_hits, r.status) for r in rows)
    assert found == [
        (1, 1, 1, "assigned"), (2, 1, 3, "ambiguous"), (2, 2, 3, "ambiguous"), (2, 3, 3, "ambiguous"),
        (3, 0, 0, "unassigned"), (4, 1, 3, "ambiguous"), (4, 2, 3, "ambiguous"), (4, 3, 3, "ambiguous"),
    ]
    assert sorted(r.crop_id for r in rows if r.first_row) == [1, 2, 3, 4]
