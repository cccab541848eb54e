"""Cron schedules: the next time after a moment, and the firing of those that are due.

Specs have five fields (minute, hour, day of month, month, day of week) in UTC,
a descriptor such as ``@daily``, or ``@every`` with a duration. Where both day
fields are restricted, either may match. Times are nanoseconds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the schedule language.
DESCRIPTORS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
UNITS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
#: Days that are searched for a match; a spec without one in them never fires.
HORIZON = 5 * 366


def duration_ns(text: str) -> int:
    """A duration such as ``1h30m`` or ``1.5s`` in nanoseconds; must be positive."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h)", text)
    total = sum(round(float(n) * UNITS[u]) for n, u in parts)
    if "".join(n + u for n, u in parts) != text or total <= 0:
        raise ValueError(f"not a positive duration: {text!r}")
    return total


def _number(text: str, field: int) -> int:
    for names, of, base in ((MONTHS, 3, 1), (DAYS, 4, 0)):
        if field == of and text.lower() in names:
            return names.index(text.lower()) + base
    return int(text)


def _field(text: str, field: int) -> tuple[frozenset[int], bool]:
    """The values that a field allows, and whether it is unrestricted."""
    low, high = BOUNDS[field]
    allowed: set[int] = set()
    free = False
    for part in text.split(","):
        span, _, step = part.partition("/")
        width = int(step) if step else 1
        if span in ("*", "?"):
            first, last = low, high
            free = free or width == 1
        else:
            a, dash, b = span.partition("-")
            first = _number(a, field)
            last = _number(b, field) if dash else high if step else first
        if not (low <= first <= last <= high) or width < 1:
            raise ValueError(f"out of range: {text!r}")
        allowed.update(range(first, last + 1, width))
    return frozenset(allowed), free


@lru_cache(maxsize=4096)
def parsed(spec: str):
    """An interval in nanoseconds, or the five fields."""
    spec = spec.strip()
    if spec.startswith("@every "):
        return duration_ns(spec[7:].strip())
    fields = DESCRIPTORS.get(spec, spec).split()
    if len(fields) != 5:
        raise ValueError(f"not a schedule: {spec!r}")
    return tuple(_field(f, k) for k, f in enumerate(fields))


def next_fire(spec: str, after_ns: int) -> int:
    """The first time strictly after ``after_ns``; 0 where there is none."""
    plan = parsed(spec)
    if isinstance(plan, int):
        return after_ns + plan
    (minutes, _), (hours, _), (dates, any_date), (months, _), (weekdays, any_weekday) = plan
    start = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(minutes=after_ns // UNITS["m"] + 1)
    for ahead in range(HORIZON):
        day = start + timedelta(days=ahead)
        on_date, on_weekday = day.day in dates, day.isoweekday() % 7 in weekdays
        matches = (on_date and on_weekday) if any_date or any_weekday else (on_date or on_weekday)
        if day.month not in months or not matches:
            continue
        least = (day.hour, day.minute) if not ahead else (0, 0)
        at = min(((h, m) for h in hours for m in minutes if (h, m) >= least), default=None)
        if at:
            moment = day.replace(hour=at[0], minute=at[1], second=0, microsecond=0)
            return int((moment - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(minutes=1)) * UNITS["m"]
    return 0


def next_fires(spec: Column | str, after: Column | str) -> Column:
    """``next_fire`` of columns, in Arrow batches; null where either is null."""

    @F.pandas_udf("long")
    def compute(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for specs, times in batches:
            yield pd.Series([None if s is None or pd.isna(t) else next_fire(s, int(t)) for s, t in zip(specs, times, strict=True)], dtype="Int64")

    return compute(spec, after)


def fire(crons: DataFrame, now: int) -> DataFrame:
    """(name, occurrence, next_at) of the schedules due at ``now``, one row each: missed times are skipped.

    (name, occurrence) is the key by which a firing happens once: advance next_at only where it still is
    ``occurrence``, and insert the run with it.
    """
    due = crons.filter((F.col("next_at") > 0) & (F.col("next_at") <= now))
    return due.select("name", F.col("next_at").alias("occurrence"), next_fires(F.col("spec"), F.lit(now)).alias("next_at"))
