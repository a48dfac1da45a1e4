"""Checks that come before any work: windows, fields, parameters, the calendar."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW = re.compile(r"([1-9]\d*)([DMY])")


def parse_window(text: str) -> tuple[int, str]:
    """A look-back like ``252D``, ``6M`` or ``1Y``: its number and unit."""
    found = WINDOW.fullmatch(text) if isinstance(text, str) else None
    if not found:
        raise ValueError(f"{text!r} is not a number from 1 followed by D, M or Y")
    return int(found[1]), found[2]


def window_starts(calendar: DataFrame, window: str, day: str = "trade_date") -> DataFrame:
    """``day, start`` of each open day: the open day N before it, or its date N months or years back (a month's last day where that has no such day). Null where the calendar does not reach."""
    n, unit = parse_window(window)
    days = calendar.select(day).distinct()
    w = Window.partitionBy(F.lit(1)).orderBy(day)  # the calendar
    if unit == "D":
        return days.withColumn("start", F.lag(day, n).over(w))
    start = F.add_months(day, -n * (12 if unit == "Y" else 1))
    # add_months keeps the day of the month unless the month is shorter.
    first = F.min(day).over(Window.partitionBy(F.lit(1)))
    return days.withColumn("start", F.when(start >= first, start))


def window_start(calendar: DataFrame, at: datetime.date, window: str, day: str = "trade_date") -> datetime.date:
    """``window_starts`` of one day; an error if it is no open day or the history is too short."""
    row = window_starts(calendar, window, day).where(F.col(day) == F.lit(at)).first()
    if row is None:
        raise ValueError(f"{at} is not an open day of the calendar")
    if row["start"] is None:
        raise ValueError(f"the calendar does not reach {window} before {at}")
    return row["start"]


def forward_days(calendar: DataFrame, last: datetime.date, days: int, wait: int = 1, day: str = "trade_date") -> list[datetime.date]:
    """The open days after ``last`` that a forward return needs; an error if the calendar ends before."""
    after = [r[0] for r in calendar.where(F.col(day) > F.lit(last)).select(day).distinct().orderBy(day).limit(days + wait).collect()]
    if len(after) < days + wait:
        raise ValueError(f"the calendar has {len(after)} of the {days + wait} open days needed after {last}")
    return after


def check_range(calendar: DataFrame, start: datetime.date, end: datetime.date, day: str = "trade_date") -> None:
    """An error unless start <= end and both are within the calendar."""
    low, high = calendar.agg(F.min(day), F.max(day)).first()
    if low is None or start > end or start < low or end > high:
        raise ValueError(f"{start} to {end} is not within the calendar ({low} to {high})")


def check_fields(wanted: Iterable[str], *tables: DataFrame | Iterable[str]) -> None:
    """An error that names all of ``wanted`` that no table has."""
    known = {c for t in tables for c in (t.columns if isinstance(t, DataFrame) else t)}
    missing = [c for c in dict.fromkeys(wanted) if c not in known]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")


def check_positive(**numbers: int) -> None:
    for name, n in numbers.items():
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise ValueError(f"{name} is a whole number from 1, not {n!r}")


def factor_params(text: str | None) -> dict:
    """Parameters of a factor from a JSON object."""
    params = json.loads(text) if text else {}
    if not isinstance(params, dict):
        raise ValueError("parameters are a JSON object")
    return params
