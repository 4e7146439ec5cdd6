"""Reasons of a decision as people read them: code, what it added to the score, and a sentence with its numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralis.config import RULES, Rules

#: Sentences by code, ``%s`` for each number, in the order of the rules (fixed values).
SENTENCES = {
    "PHOTO_REUSED_ELSEWHERE": "거의 같은 사진이 %s건, %sm 넘게 떨어진 다른 위치로 이미 접수됨",
    "CALIBRATION_MISSING": "기준 카드를 찾지 못해 폭(mm)과 색을 믿을 수 없다",
    "CALIBRATION_POOR": "보정 후에도 색차가 커서 색 판정을 보류한다",
    "GPS_IMPRECISE": "위치 정확도 %sm",
    "IMAGE_BLURRY": "흔들림이 심해 폭 추정 오차가 커진다",
    "NO_DETECTION": "검출된 균열이 없다 — 검출기가 놓쳤을 수도 있어 사람이 확인한다",
    "IMPLAUSIBLE_WIDTH": "폭이 %smm를 넘는다 — 균열이 아니라 줄눈·틈일 가능성",
    "FUTURE_TIMESTAMP": "촬영 시각이 현재보다 %s분 뒤",
    "STALE_PHOTO": "%s일 전 사진 — 현재 상태와 다를 수 있다",
    "FLOODING": "같은 기기에서 한 시간에 %s건",
    "FLOODING_RETRO": "같은 기기의 도배가 감지되어 이 신고도 소급 보류",
}


def whole(x: Column) -> Column:
    """A number without its fraction, halves to the even neighbour."""
    return F.bround(x.cast("double"), 0).cast("long").cast("string")


def numbers(r: Rules = RULES) -> dict[str, list[Column]]:
    """What the sentences tell, from the columns of ``verify.with_codes``."""
    late = F.col("received_us") - F.col("captured_us")
    return {
        "PHOTO_REUSED_ELSEWHERE": [F.col("n_far").cast("string"), whole(F.lit(r.limits("PHOTO_REUSED_ELSEWHERE")[1]))],
        "GPS_IMPRECISE": [whole(F.col("accuracy_m"))], "IMPLAUSIBLE_WIDTH": [whole(F.lit(r.limits("IMPLAUSIBLE_WIDTH")[0]))],
        "FUTURE_TIMESTAMP": [whole(-late / F.lit(6e7))], "STALE_PHOTO": [whole(late / F.lit(8.64e10))], "FLOODING": [F.col("prior").cast("string")],
    }


def reasons(coded: DataFrame, r: Rules = RULES) -> Column:
    """Array of ``(code, delta, detail)`` in the order of ``codes``; a code without sentence has a null detail."""
    told = numbers(r)
    deltas = {c.code: c.delta for c in r.checks}
    entries = [F.lit(x) for c, text in SENTENCES.items() for x in (c, F.format_string(text, *told.get(c, [])) if c in told else F.lit(text))]
    details = F.create_map(*entries)
    delta = F.create_map(*[F.lit(x) for c in deltas for x in (c, deltas[c])])
    return F.transform(coded["codes"], lambda c: F.struct(c.alias("code"), F.coalesce(F.try_element_at(delta, c), F.lit(0.0)).alias("delta"), F.try_element_at(details, c).alias("detail")))
