import pytest
from pyspark.sql import functions as F

from sheetwise.functions import answers as an
from sheetwise.functions.gates import aligned, flat_background, route_candidate, timestamp_with_offset
from sheetwise.functions.messages import reason_message, resolution_reason


def values(spark, items, column, schema="x string"):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(items)], "i int, " + schema)
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_student_choices(spark):
    cases = {
        "3": "3", "③": "3", "(2)": "2", "5.": "5", "①④": "1,4", "1,3": "1,3", "3，1": "1,3", "1 4": "1,4", "　２": None, "　2\n": "2",
        "1,1": None, "6": None, "12": None, "(1,2)": None, "word3": None, "": None, "X": None, "1,": None,
    }
    got = values(spark, list(cases), an.answer_string(an.student_choices(F.col("x"))))
    assert dict(zip(cases, got)) == cases


def test_key_answer(spark):
    cases = {"①, ③\n : 해설": "1,3", "2,5: 해설": "2,5", "④": "4"} | dict.fromkeys(
        ["", "①, ?", "①, ⑥", "①②", "①,①", "① ②", "①,\n?", "6", "①abc"]
    )
    assert dict(zip(cases, values(spark, list(cases), an.answer_string(an.key_answer(F.col("x")))))) == cases


def test_required_answer_count(spark):
    cases = {
        "1. 알맞은 것은? (정답 2\n개)1) ① 설명": 2, "정답 2개": 2, "12개를 고르시오.": None, "두 개를 고르시오. ① 하나": 2,
        "정답은 세 개를 고르세요.": 3, "옳은 것을 모두 고르면? ① 정답 2개": None, "다음 두 문장을 연결한 것은? ① 답": None,
        "옳은 것은? 지문에는 정답 2개라는 말이 있다.": None, "정답 2개 또는 정답 3개를 고르시오.": None, "정답 2개 또는 두 개를 고르시오.": 2,
    }
    assert dict(zip(cases, values(spark, list(cases), an.required_answer_count(F.col("x"))))) == cases


def test_eligible_answer(spark):
    cases = [("③", 0.8, "student_candidate"), ("abc2", 0.9, "student_candidate"), ("100", 0.9, "student_candidate"),
             ("③", 0.799, "student_candidate"), ("③", 0.9, "choice_mark_review"), ("1,1", 0.9, "student_candidate")]
    column = an.answer_string(an.eligible_answer(F.col("x"), F.col("s"), F.col("r")))
    assert values(spark, cases, column, "x string, s double, r string") == ["3", None, None, None, None, "1"]


def test_should_reread_and_digit(spark):
    cases = [("0", 0.99), ("O", 0.79), ("O", 0.8), ("③", None), ("", 0.1), ("O3", 0.1), (" 0 ", None)]
    assert values(spark, cases, an.should_reread(F.col("x"), F.col("s")), "x string, s double") == [True, True, False, False, False, False, True]
    assert values(spark, ["③", " 4 ", "①④", "6", "(1)", None], an.to_digit(F.col("x"))) == [3, 4, None, None, None, None]


@pytest.mark.parametrize("short,held", [(1654, True), (2399, True), (2561, True), (2400, False), (2480, False), (2560, False), (None, False)])
def test_scan_resolution(spark, short, held):
    (message,) = values(spark, [short], resolution_reason(F.col("x")), "x int")
    assert (message is not None) == held
    if held:
        assert f"{short} px" in message


def test_gates_with_nan(spark):
    nan, inf = float("nan"), float("inf")
    column = aligned(F.lit(True), F.lit(31), F.col("x"))
    assert values(spark, [3.0, 3.1, nan, inf, None], column, "x double") == [True, False, False, False, False]
    with pytest.raises(ValueError):
        flat_background(F.lit(1), F.lit(1), F.lit(1), F.lit(1), F.lit(1), 1.5)
    with pytest.raises(ValueError):
        route_candidate(F.lit(1), F.lit(1), F.lit(True), F.lit(True), "other")


def test_unknown_reason_and_timestamps(spark):
    assert values(spark, ["FAKE-999", "12"], reason_message(F.col("x"))) == ["FAKE-999", "답지 해석 실패"]
    stamps = ["2026-09-27T10:00:00+09:00", "2026-09-27T10:00:00Z", "2026-09-27T10:00:00", "2026-13-27T10:00:00Z", "x", None]
    assert values(spark, stamps, timestamp_with_offset(F.col("x"))) == [True, True, False, False, False, False]
