"""Queries of the point-in-time, cross-section, evaluation and storage operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.factors import price, statement  # noqa: F401
from tessera.factors.spec import CUT, compute, twin
from tessera.operators import crosssec, evaluate, frames, joins, pit, quality
from tessera.session import ship
from tessera.sources import panel as source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, text: str = "", numbers: str = ""):
    """Registers a query; columns in ``text`` are returned as strings and those in ``numbers`` as doubles, on both sides."""
    casts = {c: "string" for c in text.split()} | {c: "double" for c in numbers.split()}

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast(k) for c, k in casts.items()}) if casts else df

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            replace = ", ".join(f"CAST({c} AS {'VARCHAR' if k == 'string' else 'DOUBLE'}) AS {c}" for c, k in casts.items())
            SQL[name] = f"SELECT * REPLACE ({replace}) FROM ({sql})" if casts else sql
        return f

    return add


def cut(x: str) -> str:
    return CUT.replace("value", f"({x})")


def cut_col(x: str):
    return F.expr(cut(x)).alias(x)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Orders as statement revisions: a code, a quarter, the day a value became known, and the value in whole cents.
REVISIONS = """SELECT o_custkey % 100 AS ts_code, CAST(year(o_orderdate) AS INT) AS fy, CAST(quarter(o_orderdate) AS INT) AS quarter,
 CAST(o_orderdate AS DATE) AS effective, CAST(round(o_totalprice * 100) AS BIGINT) AS value, o_orderkey AS seq FROM {orders}"""
# One revision a code, quarter and day: the last.
DAILY = f"SELECT ts_code, fy, quarter, effective, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, fy, quarter, effective ORDER BY seq DESC) AS rn FROM ({REVISIONS})) WHERE rn = 1"
LATEST = f"SELECT ts_code, effective, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, effective ORDER BY seq DESC) AS rn FROM ({REVISIONS})) WHERE rn = 1"
PROBES = "SELECT DISTINCT l_suppkey AS ts_code, CAST(l_shipdate AS DATE) AS trade_date FROM {lineitem}"


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    ship(spark)
    return source.run_sql(spark, sf_dir, text)


D = source.duck_sql
WEEKLY = D(source.weekly_sql())


def asof_sql(op: str) -> str:
    return D(f"SELECT p.ts_code, p.trade_date, e.effective, e.value FROM ({PROBES}) p ASOF LEFT JOIN ({LATEST}) e ON p.ts_code = e.ts_code AND p.trade_date {op} e.effective")


@query("j4_asof_strict", asof_sql(">"), text="trade_date effective", numbers="value")
def j4(spark, sf_dir):
    return joins.asof_join(sql(spark, sf_dir, PROBES), sql(spark, sf_dir, REVISIONS), ["ts_code"], "trade_date", "effective", ["value"], strict=True, order=["seq"])


@query("j5_asof_inclusive", asof_sql(">="), text="trade_date effective", numbers="value")
def j5(spark, sf_dir):
    return joins.asof_join(sql(spark, sf_dir, PROBES), sql(spark, sf_dir, REVISIONS), ["ts_code"], "trade_date", "effective", ["value"], strict=False, order=["seq"])


MONTHS = "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS day FROM {orders}"


@query("j6_range_latest_revision", D(f"""
SELECT day, ts_code, fy, quarter, value FROM (
  SELECT m.day, r.ts_code, r.fy, r.quarter, r.value, row_number() OVER (PARTITION BY m.day, r.ts_code, r.fy, r.quarter ORDER BY r.effective DESC, r.seq DESC) AS rn
  FROM ({MONTHS}) m JOIN ({REVISIONS}) r ON r.effective < m.day AND r.fy >= year(m.day) - 1) WHERE rn = 1"""), text="day")  # fmt: skip
def j6(spark, sf_dir):
    until = F.make_date(F.col("fy") + 1, F.lit(12), F.lit(1))
    return frames.latest_revisions(sql(spark, sf_dir, DAILY), sql(spark, sf_dir, MONTHS), ["ts_code", "fy", "quarter"], until=until).select("day", "ts_code", "fy", "quarter", "value")


MEMBER = "SELECT DISTINCT o_custkey % 100 AS ts_code, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS day, (o_custkey % 100 + CAST(quarter(o_orderdate) AS INT)) % 7 AS industry FROM {orders}"


@query("j7_interval_join", D(f"""
SELECT p.ts_code, p.trade_date, s.industry FROM ({PROBES}) p LEFT JOIN (SELECT *, lead(day) OVER (PARTITION BY ts_code ORDER BY day) - INTERVAL 1 DAY AS out_date FROM ({MEMBER})) s
 ON p.ts_code = s.ts_code AND p.trade_date >= s.day AND (s.out_date IS NULL OR p.trade_date <= s.out_date)"""), text="trade_date", numbers="industry")  # fmt: skip
def j7(spark, sf_dir):
    spans = joins.intervals(sql(spark, sf_dir, MEMBER), ["ts_code"], "day")
    return joins.interval_join(sql(spark, sf_dir, PROBES), spans, ["ts_code"], "trade_date").select("ts_code", "trade_date", "industry")


@query("j12_universe_snapshot", D(f"""
WITH s AS (SELECT DISTINCT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS snap, l_suppkey AS ts_code FROM lineitem WHERE l_suppkey % 3 <> CAST(quarter(l_shipdate) AS INT) % 3),
d AS (SELECT snap, lead(snap) OVER (ORDER BY snap) AS nxt FROM (SELECT DISTINCT snap FROM s)),
c AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM lineitem)
SELECT c.trade_date, s.ts_code FROM c JOIN d ON c.trade_date >= d.snap AND (d.nxt IS NULL OR c.trade_date < d.nxt) JOIN s ON s.snap = d.snap
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id % 100 = s.ts_code AND month(e.ts) = month(c.trade_date) AND day(e.ts) = day(c.trade_date))"""), text="trade_date")  # fmt: skip
def j12(spark, sf_dir):
    """Members of the latest snapshot of each day without the excluded ones."""
    l = t(spark, sf_dir, "lineitem")
    snap = l.where("l_suppkey % 3 <> quarter(l_shipdate) % 3").select(F.trunc("l_shipdate", "quarter").alias("snap"), F.col("l_suppkey").alias("ts_code")).distinct()
    days = l.select(F.to_date("l_shipdate").alias("trade_date")).distinct()
    out = t(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("user_id") % 100).alias("ts_code"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d")).distinct()
    members = frames.snapshot_members(days, snap).withColumns({"m": F.month("trade_date"), "d": F.dayofmonth("trade_date")})
    return members.join(out, ["ts_code", "m", "d"], "left_anti").select("trade_date", "ts_code")


@query("d5_trailing_year", D(f"""
WITH e AS ({DAILY}),
cand AS (
  SELECT c.ts_code, c.fy, c.quarter, c.effective FROM e c
  UNION SELECT c.ts_code, c.fy, c.quarter, f.effective FROM (SELECT DISTINCT ts_code, fy, quarter FROM e WHERE quarter < 4) c JOIN e f ON f.ts_code = c.ts_code AND f.fy = c.fy - 1 AND f.quarter IN (4, c.quarter)
), first AS (SELECT ts_code, fy, quarter, min(effective) AS first FROM e GROUP BY ALL),
k AS (SELECT cand.* FROM cand JOIN first USING (ts_code, fy, quarter) WHERE effective >= first),
v AS (
  SELECT k.*, a.value AS cur, b.value AS fully, s.value AS same FROM k
  ASOF LEFT JOIN e a ON a.ts_code = k.ts_code AND a.fy = k.fy AND a.quarter = k.quarter AND a.effective <= k.effective
  ASOF LEFT JOIN (SELECT ts_code, fy + 1 AS fy, effective, value FROM e WHERE quarter = 4) b ON b.ts_code = k.ts_code AND b.fy = k.fy AND b.effective <= k.effective
  ASOF LEFT JOIN (SELECT ts_code, fy + 1 AS fy, quarter, effective, value FROM e) s ON s.ts_code = k.ts_code AND s.fy = k.fy AND s.quarter = k.quarter AND s.effective <= k.effective
)
SELECT ts_code, fy, quarter, effective, CASE WHEN quarter = 4 THEN cur ELSE cur + fully - same END AS ttm FROM v"""), text="effective", numbers="ttm")  # fmt: skip
def d5(spark, sf_dir):
    return pit.trailing_year(sql(spark, sf_dir, DAILY))


@query("d7_merge_streams", D(f"""
WITH a AS (SELECT ts_code, effective, value FROM ({LATEST}) WHERE ts_code % 2 = 0 OR value % 3 = 0), b AS (SELECT ts_code, effective, value AS other FROM ({LATEST}) WHERE value % 2 = 0),
k AS (SELECT ts_code, effective FROM a UNION SELECT ts_code, effective FROM b)
SELECT k.ts_code, k.effective, a.value, b.other FROM k ASOF LEFT JOIN a ON a.ts_code = k.ts_code AND a.effective <= k.effective ASOF LEFT JOIN b ON b.ts_code = k.ts_code AND b.effective <= k.effective"""), text="effective", numbers="value other")  # fmt: skip
def d7(spark, sf_dir):
    e = sql(spark, sf_dir, LATEST)
    a = e.where("ts_code % 2 = 0 OR value % 3 = 0").select("ts_code", "effective", "value")
    b = e.where("value % 2 = 0").select("ts_code", "effective", F.col("value").alias("other"))
    return pit.merge_streams(a, b, ["ts_code"], "effective", ["value"], ["other"])


@query("d8_first_preferred", D(f"""
SELECT ts_code, effective, fy, quarter, value FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, effective ORDER BY fy * 4 + quarter DESC, seq % 3, seq) AS rn FROM ({REVISIONS}) WHERE value % 5 <> 0) WHERE rn = 1"""), text="effective")
def d8(spark, sf_dir):
    r = sql(spark, sf_dir, REVISIONS).withColumns({"period": F.col("fy") * 4 + F.col("quarter"), "priority": F.struct(F.col("seq") % 3, "seq"), "value": F.when(F.col("value") % 5 != 0, F.col("value"))})
    return pit.first_preferred(r, ["ts_code", "effective"], "period", "priority", "value").select("ts_code", "effective", "fy", "quarter", "value")


@query("d9_activation", D(f"SELECT ts_code, fy, quarter, min(effective) AS effective FROM ({REVISIONS}) GROUP BY ALL"), text="effective")
def d9(spark, sf_dir):
    return sql(spark, sf_dir, REVISIONS).groupBy("ts_code", "fy", "quarter").agg(F.min("effective").alias("effective"))


@query("d11_normalise", """
SELECT ts_code, end_date, effective_date, value FROM (
  SELECT *, row_number() OVER (PARTITION BY ts_code, end_date, effective_date ORDER BY CASE WHEN update_flag = '1' THEN 0 ELSE 1 END, seq DESC) AS rn FROM (
    SELECT o_custkey % 100 AS ts_code, strftime(last_day(CAST(o_orderdate AS DATE)), '%Y%m%d') AS end_date, CASE WHEN o_orderkey % 4 = 0 OR nullif(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(o_orderdate, '%Y%m%d') END, '') IS NULL THEN strftime(o_orderdate + INTERVAL 3 DAY, '%Y%m%d') ELSE strftime(o_orderdate, '%Y%m%d') END AS effective_date,
           o_orderkey % 3 AS rt, CAST(o_orderkey % 2 AS VARCHAR) AS update_flag, o_orderkey AS seq, o_totalprice AS value FROM orders) WHERE rt <> 0) WHERE rn = 1""")
def d11(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    day = lambda n: F.date_format(F.date_add(F.to_date("o_orderdate"), n), "yyyyMMdd")
    raw = o.select(
        (F.col("o_custkey") % 100).alias("ts_code"), F.date_format(F.last_day("o_orderdate"), "yyyyMMdd").alias("end_date"),
        F.when(F.col("o_orderkey") % 4 == 0, None).when(F.col("o_orderkey") % 5 == 0, "").otherwise(day(0)).alias("f_ann_date"), day(3).alias("ann_date"),
        F.when(F.col("o_orderkey") % 3 == 0, "2").otherwise("1").alias("report_type"), (F.col("o_orderkey") % 2).cast("string").alias("update_flag"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"),
    )
    return pit.normalise(raw).select("ts_code", "end_date", "effective_date", "value")


@query("d13_anomalies", f"""
SELECT ts_code, pos, concat_ws('|', CASE WHEN ts_code % 13 = pos % 13 THEN 'ST' END, CASE WHEN vol IS NULL THEN 'SUSPENDED' END, CASE WHEN abs(close - high) <= 1e-6 THEN 'LIMIT_UP' END, CASE WHEN abs(close - low) <= 1e-6 THEN 'LIMIT_DOWN' END) AS value
FROM ({WEEKLY}) WHERE ts_code % 13 = pos % 13 OR vol IS NULL OR abs(close - high) <= 1e-6 OR abs(close - low) <= 1e-6""")
def d13(spark, sf_dir):
    """The statuses of a day in their order, joined by pipes."""
    p = source.panel(spark, sf_dir)
    status = [("ST", F.col("ts_code") % 13 == F.col("pos") % 13), ("SUSPENDED", F.col("vol").isNull()), ("LIMIT_UP", F.abs(F.col("close") - F.col("high")) <= 1e-6), ("LIMIT_DOWN", F.abs(F.col("close") - F.col("low")) <= 1e-6)]
    return frames.statuses(p, status, ["ts_code", "pos"])


PAID = "SELECT o_custkey % 100 AS ts_code, CAST(o_orderdate AS DATE) AS ex_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS effective_date, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 50 AS DOUBLE) END AS cash FROM {orders}"


@query("d16_trailing_dividends", D(f"""
WITH p AS ({PAID}), c AS ({MONTHS}), k AS (SELECT DISTINCT ts_code FROM p)
SELECT k.ts_code, c.day, coalesce((SELECT sum(cash) FROM p WHERE p.ts_code = k.ts_code AND greatest(effective_date, ex_date) <= c.day AND c.day < CAST(ex_date + INTERVAL 12 MONTH AS DATE)), 0) AS dps FROM k, c"""), text="day")
def d16(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    paid = o.select((F.col("o_custkey") % 100).alias("ts_code"), F.to_date("o_orderdate").alias("ex_date"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int")).alias("effective_date"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 50).cast("double")).alias("cash"))
    return pit.trailing_dividends(paid, sql(spark, sf_dir, MONTHS))


SIGNAL = twin(WEEKLY, "ROC", n=4)
SIGNALS = f"(SELECT s.ts_code, s.pos, s.value AS signal, r.ret FROM ({SIGNAL}) s JOIN (SELECT ts_code, pos, lead6.close / nullif(lead1.close, 0) - 1 AS ret FROM ({WEEKLY}) p LEFT JOIN (SELECT ts_code AS c1, pos - 1 AS p1, close FROM ({WEEKLY})) lead1 ON c1 = ts_code AND p1 = pos LEFT JOIN (SELECT ts_code AS c6, pos - 6 AS p6, close FROM ({WEEKLY})) lead6 ON c6 = ts_code AND p6 = pos) r USING (ts_code, pos))"


def signals(spark, sf_dir, n: int = 4) -> DataFrame:
    ship(spark)
    p = source.panel(spark, sf_dir)
    df = evaluate.forward_return(p)
    return compute(df, "ROC", keep=("ret", "total_mv", "close", "vol"), n=n).withColumnRenamed("value", "signal")


@query("d20_forward_return", f"SELECT ts_code, pos, {cut('ret')} AS ret FROM {SIGNALS}")
def d20(spark, sf_dir):
    return evaluate.forward_return(source.panel(spark, sf_dir)).select("ts_code", "pos", cut_col("ret"))


def bucket_sql(groups: int) -> str:
    import numpy as np

    edges = ", ".join(repr(float(x * 100 / 100)) + "e0" for x in np.linspace(0, 1, groups + 1)[1:-1])
    return f"""(
  SELECT *, CASE WHEN n < {groups} THEN NULL ELSE 1 + len(list_filter([{edges}], lambda q: r > CASE WHEN q * (n - 1) - floor(q * (n - 1)) < 0.5
     THEN (floor(q * (n - 1)) + 1) + (least(floor(q * (n - 1)) + 1, n - 1) - floor(q * (n - 1))) * (q * (n - 1) - floor(q * (n - 1)))
     ELSE (least(floor(q * (n - 1)) + 1, n - 1) + 1) - (least(floor(q * (n - 1)) + 1, n - 1) - floor(q * (n - 1))) * (1 - (q * (n - 1) - floor(q * (n - 1)))) END)) END AS bucket
  FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY signal, ts_code) AS r, count(*) OVER (PARTITION BY pos) AS n FROM {SIGNALS} WHERE signal IS NOT NULL))"""


@query("x9_buckets", f"SELECT ts_code, pos, CAST(bucket AS INT) AS bucket FROM {bucket_sql(10)}")
def x9(spark, sf_dir):
    return crosssec.buckets(signals(spark, sf_dir).where("signal IS NOT NULL"), 10).select("ts_code", "pos", F.col("bucket").cast("int").alias("bucket"))


@query("e2_group_returns", f"SELECT pos, CAST(bucket AS INT) AS bucket, {cut('avg(ret)')} AS ret, count(*) AS n FROM {bucket_sql(5)} WHERE bucket IS NOT NULL GROUP BY pos, bucket")
def e2(spark, sf_dir):
    return evaluate.group_returns(signals(spark, sf_dir), 5).select("pos", F.col("bucket").cast("int").alias("bucket"), cut_col("ret"), "n")


IC = f"""(SELECT pos, CASE WHEN sa > 1e-12 AND sb > 1e-12 THEN c / (sa * sb) END AS ic, n FROM (
  SELECT pos, covar_samp(a, b) AS c, stddev_samp(a) AS sa, stddev_samp(b) AS sb, count(*) AS n FROM (
    SELECT pos, rank() OVER (PARTITION BY pos ORDER BY signal) + (count(*) OVER (PARTITION BY pos, signal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY pos ORDER BY ret) + (count(*) OVER (PARTITION BY pos, ret) - 1) / 2.0 AS b
    FROM {SIGNALS} WHERE signal IS NOT NULL AND ret IS NOT NULL) GROUP BY pos) WHERE n >= 2)"""


@query("x10_rank_ic", f"SELECT pos, {cut('ic')} AS ic, n FROM {IC}")
def x10(spark, sf_dir):
    return evaluate.ic_series(signals(spark, sf_dir)).select("pos", cut_col("ic"), "n")


@query("e4_ic_statistics", f"""
WITH e AS (SELECT pos, ic - avg(ic) OVER () AS e, avg(ic) OVER () AS m, stddev_samp(ic) OVER () AS s, count(*) OVER () AS n FROM {IC} WHERE ic IS NOT NULL),
l AS (SELECT *, lag(e, 1) OVER (ORDER BY pos) AS l1, lag(e, 2) OVER (ORDER BY pos) AS l2, lag(e, 3) OVER (ORDER BY pos) AS l3, lag(e, 4) OVER (ORDER BY pos) AS l4 FROM e),
g AS (SELECT any_value(m) AS m, any_value(s) AS s, any_value(n) AS n, sum(e * e) + 2 * (0.8 * sum(e * l1) + 0.6 * sum(e * l2) + 0.4 * sum(e * l3) + 0.2 * sum(e * l4)) AS t FROM l)
SELECT {cut('m')} AS mean_ic, {cut('s')} AS std_ic, n, {cut('m / s * sqrt(252 / 5.0)')} AS icir, {cut('m / sqrt(t / (n * n) * n / (n - 1))')} AS t_hac FROM g""")
def e4(spark, sf_dir):
    s = evaluate.ic_statistics(evaluate.ic_series(signals(spark, sf_dir)), 5)
    return s.select(cut_col("mean_ic"), cut_col("std_ic"), "n", cut_col("icir"), cut_col("t_hac"))


@query("e10_style_correlation", f"""
SELECT pos, {cut('CASE WHEN sa > 1e-12 AND sb > 1e-12 THEN c / (sa * sb) END')} AS corr, n FROM (
  SELECT pos, covar_samp(signal, total_mv) AS c, stddev_samp(signal) AS sa, stddev_samp(total_mv) AS sb, count(*) AS n FROM {SIGNALS} JOIN (SELECT ts_code, pos, total_mv FROM ({WEEKLY})) USING (ts_code, pos)
  WHERE signal IS NOT NULL AND total_mv IS NOT NULL GROUP BY pos) WHERE n >= 3""")
def e10(spark, sf_dir):
    return crosssec.daily_correlation(signals(spark, sf_dir), "signal", "total_mv").select("pos", cut_col("corr"), "n")


NAV = "(SELECT ts_code, pos, close AS nav FROM ({0}) WHERE close IS NOT NULL)".format(WEEKLY)
RET = f"(SELECT *, nav / lag(nav) OVER (PARTITION BY ts_code ORDER BY pos) - 1 AS r, max(nav) OVER (PARTITION BY ts_code ORDER BY pos) AS top FROM {NAV})"


@query("e5_performance", f"""
SELECT ts_code, {cut('ann')} AS annual_return, {cut('vol')} AS volatility, {cut('m / nullif(vol, 0)')} AS sharpe, {cut('dd')} AS max_drawdown, {cut('ann / nullif(abs(dd), 0)')} AS calmar, {cut('win')} AS win_rate FROM (
  SELECT ts_code, power(arg_max(nav, pos) / arg_min(nav, pos), 252.0 / count(r)) - 1 AS ann, stddev_samp(r) * sqrt(252) AS vol, avg(r) * 252 AS m, min(nav / top - 1) AS dd, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) AS win FROM {RET} GROUP BY ts_code)""")
def e5(spark, sf_dir):
    nav = source.panel(spark, sf_dir).where("close IS NOT NULL").select("ts_code", "pos", F.col("close").alias("nav"))
    p = evaluate.performance(nav, ["ts_code"])
    return p.select("ts_code", *[cut_col(c) for c in ("annual_return", "volatility", "sharpe", "max_drawdown", "calmar", "win_rate")])


@query("e7_rolling_performance", f"""
SELECT ts_code, pos, CASE WHEN k = 26 THEN {cut('a / nullif(s, 0) * sqrt(252)')} END AS sharpe, CASE WHEN k = 26 THEN {cut('w')} END AS win_rate FROM (
  SELECT ts_code, pos, count(r) OVER f AS k, avg(r) OVER f AS a, stddev_samp(r) OVER f AS s, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) OVER f AS w FROM {RET} WINDOW f AS (PARTITION BY ts_code ORDER BY pos ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))""")
def e7(spark, sf_dir):
    nav = source.panel(spark, sf_dir).where("close IS NOT NULL").select("ts_code", "pos", F.col("close").alias("nav"))
    return evaluate.rolling_performance(nav, ["ts_code"], 26).select("ts_code", "pos", cut_col("sharpe"), cut_col("win_rate"))


OLD = "SELECT o_orderkey AS k, o_totalprice AS v, o_custkey AS c FROM orders WHERE o_orderkey % 3 <> 0"
NEW = "SELECT o_orderkey AS k, o_totalprice + 1 AS v, o_custkey AS c FROM orders WHERE o_orderkey % 2 = 0"


def old_new(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return tuple(o.where(f).select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + a).alias("v"), F.col("o_custkey").alias("c")) for f, a in (("o_orderkey % 3 <> 0", 0), ("o_orderkey % 2 = 0", 1)))


@query("s16_insert_missing", f"SELECT * FROM ({OLD}) UNION ALL SELECT * FROM ({NEW}) n WHERE k NOT IN (SELECT k FROM ({OLD}))")
def s16(spark, sf_dir):
    return joins.insert_missing(*old_new(spark, sf_dir), ["k"])


@query("s17_upsert", f"SELECT * FROM ({NEW}) UNION ALL SELECT * FROM ({OLD}) n WHERE k NOT IN (SELECT k FROM ({NEW}))")
def s17(spark, sf_dir):
    return joins.upsert(*old_new(spark, sf_dir), ["k"])


@query("s19_fill_from", f"SELECT o.k, coalesce(CASE WHEN o.k % 5 <> 0 THEN o.v END, n.v) AS v, o.c FROM ({OLD}) o LEFT JOIN ({NEW}) n USING (k)")
def s19(spark, sf_dir):
    old, new = old_new(spark, sf_dir)
    return joins.fill_from(old.withColumn("v", F.when(F.col("k") % 5 != 0, F.col("v"))), new, ["k"], ["v"])


@query("p11_key_difference", f"SELECT k, 'left' AS side FROM (SELECT k FROM ({OLD}) EXCEPT SELECT k FROM ({NEW})) UNION ALL SELECT k, 'right' FROM (SELECT k FROM ({NEW}) EXCEPT SELECT k FROM ({OLD}))")
def p11(spark, sf_dir):
    return quality.key_difference(*old_new(spark, sf_dir), ["k"])


@query("p13_bar_violations", f"SELECT count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS missing, count(*) FILTER (vol < 0 OR amount < 0 OR low <= 0) AS negative, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS high_low FROM ({WEEKLY})")
def p13(spark, sf_dir):
    return quality.bar_violations(source.panel(spark, sf_dir))


@query("p11_duplicate_keys", "SELECT l_orderkey, l_partkey, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def p11b(spark, sf_dir):
    return quality.duplicate_keys(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("p4_pattern_exclusion", "SELECT s_suppkey, s_name FROM supplier WHERE s_name LIKE 'S%' AND NOT regexp_full_match(s_name, '.*[13579]')")
def p4(spark, sf_dir):
    return t(spark, sf_dir, "supplier").where(F.col("s_name").like("S%") & ~F.col("s_name").rlike("^.*[13579]$")).select("s_suppkey", "s_name")


@query("a2_filtered_aggregates", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, max(l_quantity) FILTER (l_linestatus = 'O') AS most, CAST(CAST(min(l_shipdate) FILTER (l_tax > 0.04) AS DATE) AS VARCHAR) AS first FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (l_returnflag = 'R') > 2")
def a2(spark, sf_dir):
    g = t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.max(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("most"), F.to_date(F.min(F.when(F.col("l_tax") > 0.04, F.col("l_shipdate")))).cast("string").alias("first"))
    return g.where("returned > 2")


@query("a7_ordered_list", "SELECT l_shipdate::DATE AS day, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS codes FROM lineitem GROUP BY day", text="day")
def a7(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").cast("string").alias("c"))
    return l.groupBy("day").agg(F.concat_ws(",", F.array_sort(F.collect_set("c"))).alias("codes"))


@query("a8_median_deviation", f"SELECT l_suppkey, {cut('median(l_extendedprice)')} AS mid, {cut('stddev_samp(l_extendedprice)')} AS sd FROM lineitem GROUP BY l_suppkey")
def a8(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.median("l_extendedprice").alias("mid"), F.stddev_samp("l_extendedprice").alias("sd")).select("l_suppkey", cut_col("mid"), cut_col("sd"))


@query("a11_weighted_mean", f"SELECT l_partkey, {cut('sum(l_extendedprice * l_quantity) / sum(l_quantity)')} AS wm FROM lineitem GROUP BY l_partkey")
def a11(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.try_divide(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), F.sum("l_quantity")).alias("wm")).select("l_partkey", cut_col("wm"))


@query("a19_interior_gaps", D(f"SELECT ts_code, max(fy * 4 + quarter) - min(fy * 4 + quarter) + 1 - count(DISTINCT fy * 4 + quarter) AS gaps FROM ({REVISIONS}) GROUP BY ts_code HAVING gaps > 0"))
def a19(spark, sf_dir):
    q = F.col("fy") * 4 + F.col("quarter")
    return sql(spark, sf_dir, REVISIONS).groupBy("ts_code").agg((F.max(q) - F.min(q) + 1 - F.count_distinct(q)).alias("gaps")).where("gaps > 0")


@query("w16_drawdown", f"SELECT ts_code, pos, {cut('nav / top - 1')} AS drawdown FROM {RET}")
def w16(spark, sf_dir):
    w = Window.partitionBy("ts_code").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    nav = source.panel(spark, sf_dir).where("close IS NOT NULL")
    return nav.withColumn("drawdown", F.col("close") / F.max("close").over(w) - 1).select("ts_code", "pos", cut_col("drawdown"))


@query("w20_week_end_closes", "SELECT l_suppkey AS ts_code, CAST(l_shipdate AS DATE) + CAST((5 - dayofweek(CAST(l_shipdate AS DATE)) + 7) % 7 AS INT) AS week, arg_max(l_extendedprice, l_shipdate::VARCHAR || lpad(l_orderkey::VARCHAR, 12, '0') || l_linenumber) AS close FROM lineitem GROUP BY ALL", text="week")
def w20(spark, sf_dir):
    return frames.week_closes(t(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate", "l_extendedprice", ["l_orderkey", "l_linenumber"])


@query("s9_minute_bars", "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS bar, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS vol FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY ALL")
def s9(spark, sf_dir):
    e = t(spark, sf_dir, "events").where("ts >= timestamp'2024-01-05' AND ts < timestamp'2024-01-12'")
    return frames.bars(e, ["user_id"], "ts", "value", ["event_id"])


@query("d15_event_key", r"SELECT o_orderkey, sha256(concat_ws(chr(31), CAST(o_custkey AS VARCHAR), strftime(o_orderdate, '%Y%m%d'), coalesce(o_orderstatus, ''))) AS event_key FROM orders")
def d15(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.sha2(F.concat_ws("\x1f", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyyMMdd"), F.coalesce("o_orderstatus", F.lit(""))), 256).alias("event_key"))
