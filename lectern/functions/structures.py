"""Dates, arrays, maps and JSON as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_calendar_date(text: Column) -> Column:
    """Whether a string is a real day in the form yyyy-MM-dd."""
    return F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd") == text, F.lit(False))


def date_range(text: Column) -> Column:
    """start and end of ``start ~ end``."""
    day = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
    return F.struct(F.nullif(F.regexp_extract(text, rf"^\s*{day}\s*~", 1), F.lit("")).alias("start"), F.nullif(F.regexp_extract(text, rf"~\s*{day}\s*$", 1), F.lit("")).alias("end"))


def weekly_dates(start: Column, end: Column, count: Column) -> Column:
    """Every seventh day from start to end if there are exactly ``count`` of them, else null."""
    days = F.when(start <= end, F.sequence(start, end, F.expr("interval 7 day")))
    return F.when(F.size(days) == count, days)


def week_start(day: Column) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def age_hours(now: Column, then: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / 3_600_000_000.0


def clean_list(items: Column) -> Column:
    """Trimmed, non-empty, distinct strings in their order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def canonical_json(columns: Sequence[str]) -> Column:
    """JSON with keys in alphabetical order and nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def content_hash(columns: Sequence[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def entry_value(entries: Column, label: str, key: str = "label", value: str = "value") -> Column:
    """The value of the first entry with a label, null without one."""
    return F.get(F.transform(F.filter(entries, lambda e: e[key] == label), lambda e: e[value]), F.lit(0))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)
