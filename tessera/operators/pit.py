"""Point-in-time statement operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.joins import asof_join, latest


def normalise(raw: DataFrame) -> DataFrame:
    """Consolidated reports with a valid announcement day; one row for each code, period and day, the updated one first."""
    day = F.coalesce(F.nullif(F.col("f_ann_date"), F.lit("")), F.col("ann_date"))
    good = raw.where("report_type = '1'").withColumn("effective_date", day).where(F.col("effective_date").rlike(r"^\d{8}$") & F.try_to_date("effective_date", "yyyyMMdd").isNotNull())
    return latest(good, ["ts_code", "end_date", "effective_date"], [F.when(F.col("update_flag") == "1", 0).otherwise(1), F.col("seq").desc()])


def trailing_year(events: DataFrame, code: str = "ts_code", fy: str = "fy", quarter: str = "quarter", at: str = "effective", value: str = "value") -> DataFrame:
    """Trailing-year values of cumulative statements, as known at every revision.

    For quarters 1 to 3: this report + the last full year - the same quarter of last year, each in its latest revision at that time;
    a part that is not known makes it NULL. Candidate times are the revisions of the report and of both parts, from its first one on.
    Returns ``code, fy, quarter, effective, ttm``.
    """
    e = events.select(F.col(code).alias("c"), F.col(fy).alias("y"), F.col(quarter).alias("k"), F.col(at).alias("t"), F.col(value).alias("v"))
    part = F.array(F.struct(F.col("y").alias("y"), F.col("k").alias("k"), F.lit("cur").alias("part")), F.struct((F.col("y") + 1).alias("y"), F.col("k").alias("k"), F.lit("same").alias("part")))
    one = e.select("c", "t", "v", F.explode(part).alias("p")).select("c", "p.y", "p.k", "t", "v", "p.part")
    full = e.where("k = 4").select("c", (F.col("y") + 1).alias("y"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"), "t", "v", F.lit("full").alias("part"))
    stream = one.unionByName(full)
    w = Window.partitionBy("c", "y", "k").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    last = {p: F.max_by(F.when(F.col("part") == p, F.struct("v")), F.when(F.col("part") == p, F.col("t"))).over(w)["v"] for p in ("cur", "same", "full")}
    first = F.min(F.when(F.col("part") == "cur", F.col("t"))).over(Window.partitionBy("c", "y", "k"))
    known = stream.withColumns({**last, "first": first}).where(F.col("t") >= F.col("first"))
    ttm = F.when(F.col("k") == 4, F.col("cur")).otherwise(F.col("cur") + F.col("full") - F.col("same"))
    only = (F.col("k") < 4) | (F.col("part") == "cur")
    return known.where(only).select(F.col("c").alias(code), F.col("y").alias(fy), F.col("k").alias(quarter), F.col("t").alias(at), ttm.alias("ttm")).distinct()


def merge_streams(a: DataFrame, b: DataFrame, by: list[str], at: str, values_a: list[str], values_b: list[str]) -> DataFrame:
    """Two revision streams as one: at each time of either, the latest values of both."""
    times = a.select(*by, at).unionByName(b.select(*by, at)).distinct()
    x = asof_join(times, a.withColumnRenamed(at, "_at"), by, at, "_at", values_a, strict=False).drop("_at")
    return asof_join(x, b.withColumnRenamed(at, "_at"), by, at, "_at", values_b, strict=False).drop("_at")


def first_preferred(events: DataFrame, by: list[str], period: str, priority: str, value: str) -> DataFrame:
    """Of the non-null values of a key, the one of the newest period, then of the source that comes first."""
    return latest(events.where(F.col(value).isNotNull()), by, [F.col(period).desc(), F.col(priority)])


def trailing_dividends(paid: DataFrame, calendar: DataFrame, code: str = "ts_code") -> DataFrame:
    """Dividends a share of the last twelve months on each open day: visible from the later of effective and ex-date, until twelve
    months after the ex-date. A payment is a step up and a step down on the calendar; a running sum adds them."""
    from_day = F.greatest("effective_date", "ex_date")
    to_day = F.add_months("ex_date", 12)
    steps = paid.where("cash IS NOT NULL AND ex_date IS NOT NULL").withColumns({"_f": from_day, "_u": to_day}).where("_f < _u")
    up = steps.select(code, F.col("_f").alias("day"), F.col("cash").alias("step"))
    down = steps.select(code, F.col("_u").alias("day"), (-F.col("cash")).alias("step"))
    codes = paid.select(code).distinct()
    grid = codes.crossJoin(calendar.select(F.col("day"))).withColumn("step", F.lit(None).cast("double"))
    all_rows = up.unionByName(down).withColumn("_probe", F.lit(0)).unionByName(grid.withColumn("_probe", F.lit(1)))
    w = Window.partitionBy(code).orderBy("day", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    return all_rows.withColumn("dps", F.coalesce(F.sum("step").over(w), F.lit(0.0))).where("_probe = 1").select(code, "day", "dps")


def daily_table(market: DataFrame, activation: DataFrame, sources: dict[str, DataFrame], free: dict[str, DataFrame] | None = None, coalesced: dict[str, list[str]] | None = None) -> DataFrame:
    """The daily point-in-time table: each day of ``market (ts_code, trade_date)`` with the report that was active before it and every source's last revision of that report before it.

    ``activation``: ``ts_code, effective, period``. ``sources``: tables ``ts_code, period, effective, <values>``, looked up under the active period; ``free``: the same without a
    period. Values of source ``s`` come as ``<s>_effective`` and their names; ``coalesced`` names columns that several sources give (``comp_type``): the first source that has it.
    All joins are strict: what became known on a day counts from the next. Each is a union, one exchange and one sort; those of the period share theirs.
    """
    coalesced = coalesced or {}
    out = asof_join(market, activation, ["ts_code"], "trade_date", "effective", ["period"]).drop("effective")
    for name, table in sources.items():
        values = [c for c in table.columns if c not in ("ts_code", "period", "effective")]
        sent = table.select("ts_code", "period", "effective", *[F.col(c).alias(f"{name}__{c}" if c in coalesced else c) for c in values])
        out = asof_join(out, sent, ["ts_code", "period"], "trade_date", "effective", [c for c in sent.columns if c not in ("ts_code", "period", "effective")])
        none = F.col("period").isNull()  # without an active report no period is looked up
        out = out.withColumns({c: F.when(none, F.lit(None)).otherwise(F.col(c)) for c in sent.columns if c not in ("ts_code", "period")}).withColumnRenamed("effective", f"{name}_effective")
    for name, table in (free or {}).items():
        values = [c for c in table.columns if c not in ("ts_code", "effective")]
        out = asof_join(out, table, ["ts_code"], "trade_date", "effective", values).drop("effective")
    for c, order in coalesced.items():
        out = out.withColumn(c, F.coalesce(*[f"{s}__{c}" for s in order])).drop(*[f"{s}__{c}" for s in order])
    return out


def extend_daily(old: DataFrame, new: DataFrame, cutoff: str, carried: list[str], kept: list[str] = ()) -> DataFrame:
    """An incremental build: ``old`` up to the day ``cutoff``, and ``new`` after it. Where a new row has no active period, the ``carried`` columns come from the
    stock's last old row of that day or before; ``kept`` columns fall back to it wherever they are null."""
    values = [*carried, *kept]
    new = new.where(F.col("trade_date") > F.lit(cutoff))
    before = old.select("ts_code", F.col("trade_date").alias("_day"), *[F.col(c).alias(f"_{c}") for c in values])
    rows = asof_join(new, before, ["ts_code"], "trade_date", "_day", [f"_{c}" for c in values], strict=False)
    none = F.col("period").isNull()
    # ``period`` itself may be carried: it is replaced with the others, in one step.
    rows = rows.withColumns({c: F.when(none, F.col(f"_{c}")).otherwise(F.col(c)) for c in carried} | {c: F.coalesce(c, f"_{c}") for c in kept})
    return old.where(F.col("trade_date") <= F.lit(cutoff)).unionByName(rows.select(*old.columns))


def key_state(table: DataFrame, market: DataFrame) -> str:
    """The last day of ``table``; an error if it is empty, or if its keys up to that day are not those of ``market``."""
    keys = ["trade_date", "ts_code"]
    end = table.agg(F.max("trade_date")).first()[0]
    if end is None:
        raise ValueError("the table is empty; it has to be built in full")
    extra = table.select(*keys).join(market.select(*keys), keys, "left_anti").count()
    missing = market.where(F.col("trade_date") <= F.lit(end)).select(*keys).join(table.select(*keys), keys, "left_anti").count()
    if extra or missing:
        raise ValueError(f"keys differ from the market's: {extra} more, {missing} missing up to {end}; the table has to be built in full")
    return end


def backfill_exact(table: DataFrame, sources: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """New columns for a table that was built before they existed: of each source the revision with exactly the row's period and ``<source>_effective`` day."""
    out = table
    for name, values in columns.items():
        sent = sources[name].select("ts_code", "period", F.col("effective").alias(f"{name}_effective"), *values)
        out = out.drop(*values).join(sent, ["ts_code", "period", f"{name}_effective"], "left")
    return out


def exactly_revised(events: DataFrame, keys: list[str], at: str, hash_col: str) -> DataFrame:
    """Of events with one key the last announced one (ties: the largest hash)."""
    return latest(events, keys, [F.col(at).desc_nulls_last(), F.col(hash_col).desc()])
