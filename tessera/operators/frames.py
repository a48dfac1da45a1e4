"""Frames over snapshots and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.joins import latest


def latest_revisions(revisions: DataFrame, days: DataFrame, by: list[str], at: str = "effective", day: str = "day", until: Column | None = None) -> DataFrame:
    """For each of the first days of months ``days`` the revision of each key that was known before it; ``until``: the last day on which a key is looked at.

    ``revisions`` has one row for each key and day. Revisions become intervals first, so each day meets one revision of a key, not all of them.
    """
    spans = revisions.withColumn("_until", F.lead(at).over(Window.partitionBy(*by).orderBy(at)))
    far = F.lit("9999-01-01").cast("date")
    first, last = F.trunc(F.add_months(at, 1), "month"), F.least(F.coalesce(F.trunc("_until", "month"), far), far if until is None else until)
    each = spans.where(first <= last).withColumn(day, F.explode(F.sequence(first, last, F.expr("interval 1 month"))))
    known = (F.col(at) < F.col(day)) & (F.col("_until").isNull() | (F.col("_until") >= F.col(day)))
    return each.where(known).join(F.broadcast(days.select(day).distinct()), day, "left_semi").drop("_until")  # as many rows as months


def snapshot_members(days: DataFrame, snapshots: DataFrame, day: str = "trade_date", snap: str = "snap") -> DataFrame:
    """Days with the members of the last snapshot of that day or before."""
    dates = snapshots.select(snap).distinct().withColumn("_next", F.lead(snap).over(Window.partitionBy(F.lit(1)).orderBy(snap)))  # as many rows as snapshots
    of = days.join(F.broadcast(dates), (F.col(day) >= F.col(snap)) & (F.col("_next").isNull() | (F.col(day) < F.col("_next")))).drop("_next")
    return of.join(snapshots, snap)


def previous_month_close(panel: DataFrame, close: str = "close") -> DataFrame:
    """``panel`` with ``month_close``: the stock's price on the last open day of the month before, null if it had none on that day."""
    m = F.trunc("trade_date", "month")
    ends = panel.groupBy(m.alias("_m")).agg(F.max("pos").alias("_end"))  # a row a month
    month = panel.withColumn("_m", m).join(F.broadcast(ends), "_m")
    at_end = F.max(F.when(F.col("pos") == F.col("_end"), F.col(close)))
    w = Window.partitionBy("ts_code").orderBy(F.months_between("_m", F.lit("1970-01-01").cast("date")).cast("int")).rangeBetween(-1, -1)
    return month.withColumn("month_close", at_end.over(w)).drop("_m", "_end")


def week_closes(trades: DataFrame, code: str, at: str, price: str, order: list[str]) -> DataFrame:
    """The last price of each stock and week, weeks ending on Fridays: ``code, week, close``."""
    week = F.next_day(F.date_sub(F.to_date(at), 1), "FRI").alias("week")
    return trades.groupBy(F.col(code).alias("ts_code"), week).agg(F.max_by(price, F.struct(at, *order)).alias("close"))


def bars(ticks: DataFrame, by: list[str], at: str, price: str, order: list[str], unit: str = "yyyy-MM-dd HH") -> DataFrame:
    """Open, high, low, close and count of each key and period (a pattern of its time)."""
    o = F.struct(at, *order)
    return ticks.groupBy(*by, F.date_format(at, unit).alias("bar")).agg(F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, o).alias("close"), F.count(F.lit(1)).alias("vol"))


def statuses(panel: DataFrame, rules: list[tuple[str, Column]], keys: list[str]) -> DataFrame:
    """Keys with at least one status: the names of the rules that hold, in their order, joined by pipes."""
    return panel.withColumn("value", F.concat_ws("|", *[F.when(c, F.lit(s)) for s, c in rules])).where("value <> ''").select(*keys, "value")


def collapse(sources: list[DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """Sparse sources of one key as one row: the largest value of each column; a source may lack columns."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])


def annual_values(snapshots: DataFrame, at: object, value: str, period: str = "period", day: str = "trade_date", code: str = "ts_code", count: int = 5) -> DataFrame:
    """``code, period, value``: of the snapshots up to the day ``at`` the last known value of each year-end report (``YYYY1231``), for the last ``count`` years that any stock has.

    The years are those of all stocks together, so a stock without one of them has a null row there.
    """
    seen = snapshots.where((F.col(day) <= F.lit(at)) & (F.col(period) % 10000 == 1231) & F.col(value).isNotNull())
    known = seen.groupBy(code, period).agg(F.max_by(value, day).alias(value))
    mine = known.withColumn("_n", F.row_number().over(Window.partitionBy(code).orderBy(F.col(period).desc()))).where(F.col("_n") <= count).drop("_n")
    years = mine.select(period).distinct().orderBy(F.col(period).desc()).limit(count)
    return mine.select(code).distinct().crossJoin(F.broadcast(years)).join(mine, [code, period], "left")  # years: at most ``count`` rows


def year_end_values(snapshots: DataFrame, year: int, value: str, day: str = "trade_date", code: str = "ts_code") -> DataFrame:
    """``code, year, value``: the last known value of each calendar year before ``year``."""
    known = snapshots.where(F.col(value).isNotNull() & (F.year(day) < year))
    return known.groupBy(code, F.year(day).alias("year")).agg(F.max_by(value, day).alias(value))


def fiscal_quarters(first: int, last: int) -> list[int]:
    """The ends of all quarters from year ``first`` to ``last``, as ``YYYYMMDD``."""
    return [y * 10000 + d for y in range(first, last + 1) for d in (331, 630, 930, 1231)]


def year_before(period: int | Column) -> int | Column:
    return period - 10000


def new_columns(old: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str], legacy: list[str]) -> DataFrame:
    """A migration: ``old``, whose columns must be exactly ``legacy``, with new ``columns`` of ``fresh``; rows and old values stay as they are."""
    if old.columns != list(legacy):
        raise ValueError(f"not the legacy table: {old.columns}")
    return old.join(fresh.select(*keys, *columns), keys, "left").select(*legacy, *columns)


def top(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    if n == 1:
        return latest(df, by, order)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
