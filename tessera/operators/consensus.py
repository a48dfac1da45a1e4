"""Analysts' consensus on each open day.

A report is one publication of an organisation with forecasts for fiscal years. An organisation's state for a year is its last
forecast, missing values included. On a day the state of the running year and that of the next are blended by the share of the year that is left, and the
consensus is taken over organisations. States are validity intervals, so days meet intervals by an equi-join on the year, not a loop over days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = ("np", "eps", "rd")


def year_left(day: str | Column) -> Column:
    """The share of its year that is left on a day, the day included."""
    end = F.make_date(F.year(day), F.lit(12), F.lit(31))
    return (F.datediff(end, day) + 1) / F.dayofyear(end)


def normalise_reports(reports: DataFrame) -> DataFrame:
    """Rows ``ts_code, org, report_date, seq, year, np, eps, rd``: annual targets (``quarter`` is ``YYYYQ4``) of named organisations, one for each report and year.

    ``seq`` orders the reports: day, time of entry (unknown first), title, author.
    """
    good = reports.where(F.col("quarter").rlike("^[0-9]{4}Q4$") & (F.coalesce("org_name", F.lit("")) != ""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    seq = F.struct("report_date", F.coalesce("create_time", F.lit("0001-01-01").cast("timestamp")).alias("at"), text("report_title").alias("title"), text("author_name").alias("author"))
    rows = good.select("ts_code", F.col("org_name").alias("org"), "report_date", seq.alias("seq"), F.substring("quarter", 1, 4).cast("int").alias("year"), *[F.expr(f"try_cast({f} AS DOUBLE)").alias(f) for f in FIELDS])
    values = F.max(F.struct(*[F.col(f) for f in FIELDS])).alias("v")  # of a year that a report gives twice
    return rows.groupBy("ts_code", "org", "report_date", "seq", "year").agg(values).select("ts_code", "org", "report_date", "seq", "year", "v.*")


def _spans(states: DataFrame, by: list[str]) -> DataFrame:
    """States of increasing ``seq`` as intervals of days: the last one of a day holds until the next."""
    last = F.lead("report_date").over(Window.partitionBy(*by).orderBy("seq"))
    return states.withColumn("until", last).where(F.col("until").isNull() | (F.col("until") > F.col("report_date")))


def _on_days(spans: DataFrame, days: DataFrame, year: Column) -> DataFrame:
    """Days of the calendar with the spans that hold on them; ``year`` is the days' year in which a span counts."""
    known = days.withColumn("_y", F.year("trade_date"))
    on = (F.col("_y") == F.col("_of")) & (F.col("trade_date") >= F.col("report_date")) & (F.col("until").isNull() | (F.col("trade_date") < F.col("until")))
    return spans.withColumn("_of", year).join(F.broadcast(known), on)  # a row for each open day: the calendar's size


def blended(reports: DataFrame, days: DataFrame) -> DataFrame:
    """``ts_code, trade_date, org`` with blended ``np, eps, rd``; ``reports`` are normalised."""
    value = F.struct(*FIELDS)
    use = F.array(F.struct(F.col("year").alias("of"), F.lit(0).alias("next")), F.struct((F.col("year") - 1).alias("of"), F.lit(1).alias("next")))
    both = reports.select("ts_code", "org", "report_date", "seq", value.alias("v"), F.explode(use).alias("u")).select("*", "u.of", "u.next")
    w = Window.partitionBy("ts_code", "org", "of").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    state = both.withColumns({k: F.last(F.when(F.col("next") == i, F.col("v")), ignorenulls=True).over(w) for i, k in enumerate(("now", "then"))})
    spans = _spans(state.select("ts_code", "org", "of", "report_date", "seq", "now", "then").distinct(), ["ts_code", "org", "of"]).where("now IS NOT NULL AND then IS NOT NULL")
    left = year_left("trade_date")
    mix = [(left * F.col(f"now.{f}") + (1 - left) * F.col(f"then.{f}")).alias(f) for f in FIELDS]
    return _on_days(spans, days, F.col("of")).select("ts_code", "trade_date", "org", *mix)


def growth(reports: DataFrame, days: DataFrame) -> DataFrame:
    """``ts_code, trade_date, org, cagr``: yearly growth from a report's first forward year to two years later, of each organisation's last report that has it."""
    forward = reports.where(F.col("year") >= F.year("report_date"))
    w = Window.partitionBy("ts_code", "org", "seq")
    first = forward.withColumn("first", F.min("year").over(w)).groupBy("ts_code", "org", "report_date", "seq", "first").agg(
        F.max(F.when(F.col("year") == F.col("first"), F.col("eps"))).alias("a"), F.max(F.when(F.col("year") == F.col("first") + 2, F.col("eps"))).alias("b")
    )
    good = first.where("a > 0 AND b > 0").withColumn("cagr", F.sqrt(F.col("b") / F.col("a")) - 1)
    spans = _spans(good, ["ts_code", "org"]).withColumn("of", F.explode(F.array("first", F.col("first") - 1)))
    return _on_days(spans, days, F.col("of")).select("ts_code", "trade_date", "org", "cagr")


def revisions(reports: DataFrame, days: DataFrame) -> DataFrame:
    """``ts_code, trade_date, up, down, total``: reports since the open day before whose blended eps is known, and whether it rose or fell against the organisation's state before."""
    target = F.explode(F.array(F.lit(0), F.lit(1)))
    ids = reports.select("ts_code", "org", "report_date", "seq").distinct().withColumn("next", target)
    probes = ids.select("ts_code", "org", "report_date", "seq", (F.year("report_date") + F.col("next")).alias("year"), "next")
    forward = reports.where(F.col("year") >= F.year("report_date")).select("ts_code", "org", "seq", "year", F.struct("eps").alias("v"))
    rows = probes.join(forward, ["ts_code", "org", "seq", "year"], "full")
    w = Window.partitionBy("ts_code", "org", "year").orderBy("seq")
    known = rows.withColumns({"after": F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "before": F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    pick = lambda c, i: F.max(F.when(F.col("next") == i, F.col(f"{c}.eps")))
    each = known.where("next IS NOT NULL").groupBy("ts_code", "org", "report_date", "seq").agg(*[pick(c, i).alias(f"{c}{i}") for c in ("before", "after") for i in (0, 1)])
    left = year_left("report_date")
    each = each.withColumns({c: left * F.col(f"{c}0") + (1 - left) * F.col(f"{c}1") for c in ("before", "after")}).where("after IS NOT NULL")
    spans = days.withColumn("_from", F.lag("trade_date").over(Window.partitionBy(F.lit(1)).orderBy("trade_date")))  # the calendar
    on = (F.col("report_date") <= F.col("trade_date")) & (F.col("report_date") > F.coalesce("_from", F.date_sub("trade_date", 1)))
    counted = each.join(F.broadcast(spans), on)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return counted.groupBy("ts_code", "trade_date").agg(count(F.col("after") > F.col("before")).alias("up"), count(F.col("after") < F.col("before")).alias("down"), F.count(F.lit(1)).alias("total"))


def consensus(raw: DataFrame, days: DataFrame) -> DataFrame:
    """Consensus of every code of ``raw`` on every open day ``trade_date`` of ``days``.

    ``np, eps, rd``: medians of blended forecasts; ``eps_std`` (two organisations or more); ``cagr``: median growth;
    ``up, down, total``: revisions. Reports before the first day make the states it starts from, and are no revisions.
    """
    reports = normalise_reports(raw)
    days = days.select("trade_date").distinct()
    keys = ["ts_code", "trade_date"]
    mixed = blended(reports, days).groupBy(*keys).agg(*[F.median(f).alias(f) for f in FIELDS], F.when(F.count("eps") >= 2, F.stddev_samp("eps")).alias("eps_std"))
    grown = growth(reports, days).groupBy(*keys).agg(F.median("cagr").alias("cagr"))
    grid = reports.select("ts_code").distinct().crossJoin(F.broadcast(days))  # codes by days is the size of the result
    out = grid.join(mixed, keys, "left").join(grown, keys, "left").join(revisions(reports, days), keys, "left")
    return out.select(*keys, *FIELDS, "eps_std", "cagr", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("up", "down", "total")])
