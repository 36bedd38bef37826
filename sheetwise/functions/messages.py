"""Reason texts shown to the teacher."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reason code -> text.
REASON_TEXT = {
    "2": "답 존재 확인 필요 · 추출 후 흰 조각",
    "9": "원본·배경 필터로 제외됨",
    "5": "OCR 실행 후 인식 결과 없음",
    "6": "신뢰도 부족 · 0.8 미만",
    "score_missing": "점수 미산출 · 기록 확인 필요",
    "not_executed": "OCR 미실행 · 기록 확인 필요",
    "7": "답 형식 해석 불가 · 기호 의미는 미확인",
    "8": "선택 표시 미해석",
    "11": "확인된 특수 의미 주석",
    "route_unknown": "처리 경로 확인 필요",
    "candidate": "숫자 후보 · 문항 소속과 최종 의미 확인 필요",
    "10": "답 후보 충돌",
    "12": "답지 해석 실패",
    "13": "인쇄·필기 혼합 · 조건부 적용 대기",
    "14": "선택 개수 불일치",
    "15": "문항 소속 확인 필요 · 경계 또는 범위 밖 필기",
    "16": "답 개수 확인 필요 · 답지 정답 개수 불일치",
    "17": "스캔 해상도 확인 필요: 300dpi로 스캔해 주세요",
}


def reason_message(code: Column) -> Column:
    """Text of a code; a code nobody knows is shown as it is."""
    pairs = [F.lit(part) for item in REASON_TEXT.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def key_count_message(count: Column) -> Column:
    return F.format_string("답 개수 확인 필요 · 답지 정답 %d개", count)


def resolution_reason(short_side: Column) -> Column:
    """Message for a scan outside 2400..2560 px on its short side, else null."""
    text = F.format_string(
        REASON_TEXT["17"].replace("%", "%%") + " (현재 짧은 변 %d px)", short_side
    )
    return F.when(~short_side.between(2400, 2560), text)
