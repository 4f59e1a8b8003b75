"""Column functions of programme search: audiences, concepts, series and re-ranking adjustments."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The audience that a query asks for (the first pattern that occurs).
QUERY_AUDIENCES = (
    ("elementary_lower", r"초등\s*(?:저학년|1\s*[~～\-]\s*3학년)"),
    ("elementary_upper", r"초등\s*(?:고학년|4\s*[~～\-]\s*6학년)"),
    ("elementary", r"초등"),
    ("preschool", r"유아|미취학|6\s*[~～\-]\s*7세|5\s*[~～\-]\s*7세"),
    ("youth", r"청소년|중학생|고등학생"),
    ("child", r"어린이|아동|아이(?:와|가|를|에게|들이)?"),
    ("adult", r"성인|어른|직장인|대학생"),
    ("general", r"누구나|전연령|전 연령|지역주민"),
)
# The audiences that a document's target names (all patterns that occur, blanks left out).
DOCUMENT_AUDIENCES = (
    ("general", r"누구나|연령제한없음|아이부터어른|지역주민"),
    ("adult", r"성인|어른|대학생|직장인"),
    ("elementary", r"초등|[1-6][~～\-][1-6]학년|[1-6]학년"),
    ("elementary_lower", r"1[~～\-][23]학년"),
    ("elementary_upper", r"[34][~～\-]6학년"),
    ("preschool", r"유아|미취학|[5-7][~～\-][5-7]세|19~20년생|20,21년생"),
    ("youth", r"청소년|중학생|고등학생"),
)
# Audiences that satisfy a request, and those that a chosen filter keeps beside "general".
COMPATIBLE = {
    "elementary_lower": ("elementary_lower", "elementary"),
    "elementary_upper": ("elementary_upper", "elementary"),
    "elementary": ("elementary", "elementary_lower"),
    "preschool": ("preschool",),
    "youth": ("youth",),
    "child": ("preschool", "elementary", "elementary_lower"),
}
AUDIENCE_FILTERS = {
    "preschool": ("preschool",),
    "elementary-lower": ("elementary_lower", "elementary"),
    "elementary-upper": ("elementary_upper", "elementary"),
    "adult": ("adult",),
    "everyone": ("general",),
}
# Adjustments and their reasons.
NO_REQUEST = (0.0, "질의에 대상 조건 없음")
NO_TARGET = (-0.02, "프로그램 대상 정보 없음")
GENERAL_MATCH = (0.08, "누구나·지역주민 대상 일치")
GENERAL_MISS = (-0.04, "특정 연령 대상")
ADULT_MATCH = (0.10, "요청 대상과 일치")
ADULT_GENERAL = (0.08, "누구나·지역주민으로 요청 대상 포함")
EXACT_MATCH = (0.14, "요청 대상과 일치")
COMPATIBLE_MATCH = (0.10, "요청 대상과 일치")
INCLUDED = (0.06, "누구나·지역주민으로 요청 대상 포함")
MISMATCH = (-0.25, "요청 대상과 호환되지 않음")
GRADE_MISMATCH = (-0.25, "요청 학년과 호환되지 않음")
# Terms of each concept, by group, and the weight of a concept of the group.
CONCEPTS = {
    "topics": {
        "environment": ("환경", "기후", "생태", "탄소", "지구", "에너지"),
        "english": ("영어", "english", "파닉스", "main sentence"),
        "reading": ("독서", "책읽기", "책 읽기", "선정도서", "독서회"),
        "picturebook": ("그림책", "동화책", "동화나라", "동화구연"),
        "humanities": ("인문학", "시민인문", "지역경제"),
        "christmas": ("크리스마스", "산타", "호두까기"),
        "science": ("과학", "실험", "탐구", "행성", "별자리", "물리", "화석"),
        "art": ("미술", "그림", "표현력", "조형", "클레이"),
        "japanese": ("일본어", "일어", "히라가나", "가타카나"),
        "writing": ("글쓰기", "일기", "감상문", "논술"),
        "boardgame": ("보드게임", "보드 게임"),
    },
    "activities": {
        "craft": ("만들기", "클레이", "조형", "공예", "리스", "종이접기", "체험"),
        "discussion": ("토론", "토의", "이야기를 나누", "의견 나누", "독서 모임", "독서모임", "독서회"),
        "performance": ("인형극", "공연", "관람", "샌드아트"),
        "language": ("영어 수업", "영어수업", "영어동화", "파닉스", "문장", "sentence", "quiz", "game"),
        "lecture": ("강연", "아카데미"),
        "experiment": ("실험", "탐구", "관찰", "발굴"),
        "writing": ("글쓰기", "일기", "감상문", "논술", "써보는"),
        "boardgame": ("보드게임", "보드 게임", "게임 실습"),
    },
}
CONCEPT_WEIGHT = {"topics": 0.12, "activities": 0.08}


def _java(pattern: str) -> str:
    """A pattern whose blanks and digits are those of any script, as Python reads them."""
    return pattern.replace(r"\s", r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").replace(r"\d", r"\p{Nd}")


def query_audience(query: Column) -> Column:
    """The first audience whose pattern occurs in a query; null without one."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(QUERY_AUDIENCES):
        out = F.when(query.rlike(_java(pattern)), F.lit(name)).otherwise(out)
    return out


def query_audience_of(query: str) -> str | None:
    """The same for a query that is known before any row is read."""
    return next((name for name, pattern in QUERY_AUDIENCES if re.search(pattern, query)), None)


def document_audiences(target: Column) -> Column:
    """Every audience that a target names, in the order of the rules; empty for a null target."""
    value = F.replace(F.coalesce(target, F.lit("")), F.lit(" "), F.lit(""))
    return F.array_compact(F.array(*[F.when(value.rlike(_java(p)), F.lit(name)) for name, p in DOCUMENT_AUDIENCES]))


def audience_adjustment(requested: str | None, audiences: Column) -> Column:
    """A struct of adjustment and reason for a document's audiences under a requested one."""
    pair = lambda x: F.struct(F.lit(x[0]).cast("double").alias("adjustment"), F.lit(x[1]).alias("reason"))
    has = lambda *names: F.arrays_overlap(audiences, F.array(*map(F.lit, names)))
    if requested is None:
        return pair(NO_REQUEST)
    if requested == "general":
        known = F.when(has("general"), pair(GENERAL_MATCH)).otherwise(pair(GENERAL_MISS))
    elif requested == "adult":
        known = F.when(has("adult"), pair(ADULT_MATCH)).when(has("general"), pair(ADULT_GENERAL)).otherwise(pair(MISMATCH))
    else:
        known = F.when(has(requested), pair(EXACT_MATCH)).when(has(*COMPATIBLE[requested]), pair(COMPATIBLE_MATCH)).when(has("general"), pair(INCLUDED)).otherwise(pair(MISMATCH))
        for mine, other in (("elementary_lower", "elementary_upper"), ("elementary_upper", "elementary_lower")):
            if requested == mine:
                known = F.when(has(other) & ~has(mine), pair(GRADE_MISMATCH)).otherwise(known)
    return F.when(F.size(audiences) == 0, pair(NO_TARGET)).otherwise(known)


def concepts(text: Column, group: str) -> Column:
    """The group's concepts any of whose terms occurs in a text, sorted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = []
    for name, words in sorted(CONCEPTS[group].items()):
        found.append(F.when(low.rlike("|".join(w.lower() for w in words)), F.lit(name)))  # plain terms, no pattern signs
    return F.array_compact(F.array(*found))


def concepts_of(text: str) -> dict[str, list[str]]:
    """The same for a query that is known before any row is read."""
    low = text.lower()
    return {group: sorted(name for name, words in known.items() if any(w.lower() in low for w in words)) for group, known in CONCEPTS.items()}


def concept_adjustment(requested: dict[str, Sequence[str]], found: dict[str, Column]) -> Column:
    """A struct of adjustment, coverage, matched and missing for a document's concepts under the requested ones."""
    n = sum(map(len, requested.values()))
    if not n:
        none = F.array().cast("array<string>")
        return F.struct(F.lit(0.0).alias("adjustment"), F.lit(1.0).alias("coverage"), none.alias("matched"), none.alias("missing"))
    score, matched, missing = F.lit(0.0), [], []
    for group, names in requested.items():
        asked = F.array(*map(F.lit, names)).cast("array<string>")
        same, lacking = F.array_intersect(asked, found[group]), F.array_except(asked, found[group])
        score = score + CONCEPT_WEIGHT[group] * (F.size(same) - F.size(lacking))
        matched.append(same)
        missing.append(lacking)
    both = F.concat(*matched)
    return F.struct(F.round(score, 8).alias("adjustment"), (F.size(both) / n).alias("coverage"), F.array_sort(both).alias("matched"), F.array_sort(F.concat(*missing)).alias("missing"))


def series_key(title: Column, audiences: Column) -> Column:
    """A title without bracketed parts, round numbers, years and signs, and the audiences."""
    name = F.regexp_replace(title, r"\(.*?\)|\[.*?\]", "")
    name = F.regexp_replace(name, _java(r"\d+\s*(?:기|차|회|타임|반)"), "")
    name = F.regexp_replace(name, _java(r"\d{4}년|상반기|하반기"), "")
    name = F.regexp_replace(name, r"[^\p{L}\p{N}_]", "")
    who = F.array_join(F.array_sort(audiences), "")
    return F.concat(name, F.lit("|"), F.when(who == "", F.lit("-")).otherwise(who))
