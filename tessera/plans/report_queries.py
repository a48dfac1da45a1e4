"""Queries of the point-in-time table, the consensus, the sorted portfolios and the reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import consensus, contract, crosssec, evaluate, pit, portfolios, quality
from tessera.plans.operator_queries import IC, LATEST, PROBES, REVISIONS, SIGNALS, WEEKLY, D, bucket_sql, cut, cut_col, query, signals, sql, t
from tessera.session import ship
from tessera.sources import panel as source

# -- the daily point-in-time table ------------------------------------------------------------------

KINDS = {"income": 0, "balance": 1, "cashflow": 2}
ACTIVE = f"SELECT ts_code, effective, max(max(fy * 10 + quarter)) OVER (PARTITION BY ts_code ORDER BY effective) AS period FROM ({REVISIONS}) GROUP BY ts_code, effective"


def statement_sql(kind: str) -> str:
    """Revisions of one kind of statement: the last of a code, period and day; income and balance name a company type."""
    comp = "" if kind == "cashflow" else ", CASE WHEN seq % 5 <> 0 THEN CAST(seq % 4 AS STRING) END AS comp_type"
    return f"""SELECT ts_code, period, effective, value AS {kind}_value{comp} FROM (SELECT ts_code, fy * 10 + quarter AS period, effective, value, seq,
 row_number() OVER (PARTITION BY ts_code, fy, quarter, effective ORDER BY seq DESC) AS rn FROM ({REVISIONS}) WHERE seq % 3 = {KINDS[kind]}) WHERE rn = 1"""


DEPRECIATION = f"SELECT ts_code, effective, value AS depreciation FROM ({LATEST}) WHERE value % 4 = 0"
DAILY_SQL = D(f"""
SELECT p.ts_code, p.trade_date, a.period, i.effective AS income_effective, i.income_value, b.effective AS balance_effective, b.balance_value, c.effective AS cashflow_effective, c.cashflow_value, d.depreciation, coalesce(i.comp_type, b.comp_type) AS comp_type
FROM ({PROBES}) p ASOF LEFT JOIN ({ACTIVE}) a ON p.ts_code = a.ts_code AND p.trade_date > a.effective
ASOF LEFT JOIN ({statement_sql('income')}) i ON p.ts_code = i.ts_code AND a.period = i.period AND p.trade_date > i.effective
ASOF LEFT JOIN ({statement_sql('balance')}) b ON p.ts_code = b.ts_code AND a.period = b.period AND p.trade_date > b.effective
ASOF LEFT JOIN ({statement_sql('cashflow')}) c ON p.ts_code = c.ts_code AND a.period = c.period AND p.trade_date > c.effective
ASOF LEFT JOIN ({DEPRECIATION}) d ON p.ts_code = d.ts_code AND p.trade_date > d.effective""")
DATES, NUMBERS = "trade_date income_effective balance_effective cashflow_effective comp_type", "period income_value balance_value cashflow_value depreciation"


def daily(spark, sf_dir, market: str = PROBES) -> DataFrame:
    sources = {k: sql(spark, sf_dir, statement_sql(k)) for k in KINDS}
    return pit.daily_table(sql(spark, sf_dir, market), sql(spark, sf_dir, ACTIVE), sources, {"depreciation": sql(spark, sf_dir, DEPRECIATION)}, {"comp_type": ["income", "balance"]})


@query("d10_daily_pit", DAILY_SQL, text=DATES, numbers=NUMBERS)
def d10(spark, sf_dir):
    """Each trading day with the active report and the last revisions of its statements."""
    return daily(spark, sf_dir)


CUTOFF = "DATE '1998-06-30'"


@query("d10_incremental", f"""
WITH f AS ({DAILY_SQL}), old AS (SELECT * FROM f WHERE trade_date <= DATE '1998-12-31'), n AS (SELECT * REPLACE (CASE WHEN ts_code % 7 <> 0 THEN period END AS period, CASE WHEN ts_code % 2 = 0 THEN depreciation END AS depreciation) FROM f WHERE trade_date > {CUTOFF})
SELECT * FROM old WHERE trade_date <= {CUTOFF} UNION ALL
SELECT n.ts_code, n.trade_date, CASE WHEN n.period IS NULL THEN o.period ELSE n.period END, n.income_effective, CASE WHEN n.period IS NULL THEN o.income_value ELSE n.income_value END, n.balance_effective, n.balance_value, n.cashflow_effective, n.cashflow_value, coalesce(n.depreciation, o.depreciation), n.comp_type
FROM n ASOF LEFT JOIN old o ON n.ts_code = o.ts_code AND n.trade_date >= o.trade_date""", text=DATES, numbers=NUMBERS)  # fmt: skip
def d10_incremental(spark, sf_dir):
    """An old table continued after a cutoff; rows without an active report fall back to the last old row."""
    full = daily(spark, sf_dir)
    new = full.withColumns({"period": F.when(F.col("ts_code") % 7 != 0, F.col("period")), "depreciation": F.when(F.col("ts_code") % 2 == 0, F.col("depreciation"))})
    return pit.extend_daily(full.where("trade_date <= DATE '1998-12-31'"), new, "1998-06-30", ["period", "income_value"], ["depreciation"])


@query("j13_exact_backfill", f"SELECT f.ts_code, f.trade_date, f.income_effective, i.income_value AS filled FROM ({DAILY_SQL}) f LEFT JOIN ({D(statement_sql('income'))}) i ON f.ts_code = i.ts_code AND f.period = i.period AND f.income_effective = i.effective", text="trade_date income_effective", numbers="filled")
def j13(spark, sf_dir):
    """A new column of an old table, from the revision that each row names."""
    income = sql(spark, sf_dir, statement_sql("income")).withColumnRenamed("income_value", "filled")
    return pit.backfill_exact(daily(spark, sf_dir), {"income": income}, {"income": ["filled"]}).select("ts_code", "trade_date", "income_effective", "filled")


@query("d15_latest_revision", D(f"SELECT ts_code, fy, quarter, value FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, fy, quarter ORDER BY effective DESC, md5(CAST(seq AS STRING)) DESC) AS rn FROM ({REVISIONS})) WHERE rn = 1"))
def d15(spark, sf_dir):
    """Of the announcements of one event the last one, ties by the row's hash."""
    r = sql(spark, sf_dir, REVISIONS).withColumn("hash", F.md5(F.col("seq").cast("string")))
    return pit.exactly_revised(r, ["ts_code", "fy", "quarter"], "effective", "hash").select("ts_code", "fy", "quarter", "value")


# -- consensus --------------------------------------------------------------------------------------

# Each event is a report of three or fewer fiscal years; now and then a forecast is missing, a year comes late, or the target is no year's end.
FORECASTS = """
SELECT user_id % 100 AS ts_code, event_type AS org_name, CAST(ts AS DATE) AS report_date, ts AS create_time, lpad(CAST(event_id AS STRING), 12, '0') AS report_title, CAST(user_id AS STRING) AS author_name, event_id, k,
 concat(CAST(2023 + k + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS STRING), CASE WHEN (event_id + k) % 31 = 0 THEN 'Q2' ELSE 'Q4' END) AS quarter,
 CASE WHEN (event_id + k) % 13 <> 0 THEN CAST((event_id * 37 + k * 11) % 400 - 30 AS DOUBLE) / 100 END AS eps, CAST((event_id * 17 + k * 5) % 900 AS DOUBLE) AS np, CASE WHEN event_id % 3 <> 0 THEN CAST((event_id + k) % 60 AS DOUBLE) / 10 END AS rd
FROM {events} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) WHERE (event_id + k) % 7 <> 0 AND event_id % 97 <> 1"""
OPEN_DAYS = "SELECT DISTINCT CAST(ts AS DATE) AS trade_date FROM {events} WHERE day(ts) % 3 <> 0 AND day(ts) > 8"
LEFT = "(date_diff('day', {0}, make_date(year({0}), 12, 31)) + 1) / (CASE WHEN year({0}) % 4 = 0 THEN 366e0 ELSE 365e0 END)"


@query("d18_consensus", D(f"""
WITH r AS (SELECT ts_code, org_name AS org, report_date, struct_pack(a := create_time, b := event_id) AS seq, CAST(substr(quarter, 1, 4) AS INT) AS y, np, eps, rd FROM ({FORECASTS}) WHERE quarter LIKE '%Q4'),
c AS ({OPEN_DAYS}), days AS (SELECT trade_date, {LEFT.format('trade_date')} AS l, lag(trade_date) OVER (ORDER BY trade_date) AS prev FROM c),
s AS (SELECT d.trade_date, d.l, r.ts_code, r.org, r.y - year(d.trade_date) AS nxt, arg_max(struct_pack(np := np, eps := eps, rd := rd), seq) AS v FROM days d JOIN r ON r.report_date <= d.trade_date AND r.y - year(d.trade_date) IN (0, 1) GROUP BY ALL),
m AS (SELECT a.trade_date, a.ts_code, a.l * a.v.np + (1 - a.l) * b.v.np AS np, a.l * a.v.eps + (1 - a.l) * b.v.eps AS eps, a.l * a.v.rd + (1 - a.l) * b.v.rd AS rd FROM s a JOIN s b USING (trade_date, ts_code, org) WHERE a.nxt = 0 AND b.nxt = 1),
med AS (SELECT ts_code, trade_date, median(np) AS np, median(eps) AS eps, median(rd) AS rd, CASE WHEN count(eps) >= 2 THEN stddev_samp(eps) END AS eps_std FROM m GROUP BY ALL),
f AS (SELECT *, min(y) OVER (PARTITION BY ts_code, org, report_date, seq) AS fy FROM r WHERE y >= year(report_date)),
g AS (SELECT ts_code, org, report_date, seq, fy, sqrt(max(eps) FILTER (y = fy + 2) / max(eps) FILTER (y = fy)) - 1 AS cagr FROM f GROUP BY ALL HAVING max(eps) FILTER (y = fy) > 0 AND max(eps) FILTER (y = fy + 2) > 0),
gs AS (SELECT d.trade_date, g.ts_code, g.org, arg_max(struct_pack(fy := fy, cagr := cagr), seq) AS v FROM days d JOIN g ON g.report_date <= d.trade_date GROUP BY ALL),
gm AS (SELECT ts_code, trade_date, median(v.cagr) AS cagr FROM gs WHERE v.fy - year(trade_date) IN (0, 1) GROUP BY ALL),
ids AS (SELECT DISTINCT ts_code, org, report_date, seq FROM r),
st AS (SELECT i.ts_code, i.org, i.report_date, i.seq, arg_max(struct_pack(e := f.eps), f.seq) FILTER (f.y = year(i.report_date) AND f.seq < i.seq) AS b0, arg_max(struct_pack(e := f.eps), f.seq) FILTER (f.y = year(i.report_date) + 1 AND f.seq < i.seq) AS b1,
  arg_max(struct_pack(e := f.eps), f.seq) FILTER (f.y = year(i.report_date)) AS a0, arg_max(struct_pack(e := f.eps), f.seq) FILTER (f.y = year(i.report_date) + 1) AS a1
  FROM ids i JOIN f ON f.ts_code = i.ts_code AND f.org = i.org AND f.seq <= i.seq GROUP BY ALL),
rev AS (SELECT ts_code, report_date, {LEFT.format('report_date')} AS l, l * b0.e + (1 - l) * b1.e AS before, l * a0.e + (1 - l) * a1.e AS after FROM st),
rv AS (SELECT ts_code, trade_date, count(*) FILTER (after > before) AS up, count(*) FILTER (after < before) AS down, count(*) AS total FROM rev JOIN days ON report_date <= trade_date AND report_date > coalesce(prev, trade_date - 1) WHERE after IS NOT NULL GROUP BY ALL)
SELECT k.ts_code, c.trade_date, {cut('np')} AS np, {cut('eps')} AS eps, {cut('rd')} AS rd, {cut('eps_std')} AS eps_std, {cut('cagr')} AS cagr, coalesce(up, 0) AS up, coalesce(down, 0) AS down, coalesce(total, 0) AS total
FROM (SELECT DISTINCT ts_code FROM r) k CROSS JOIN c LEFT JOIN med USING (ts_code, trade_date) LEFT JOIN gm USING (ts_code, trade_date) LEFT JOIN rv USING (ts_code, trade_date)"""), text="trade_date")  # fmt: skip
def d18(spark, sf_dir):
    """Consensus of blended forecasts, growth and revisions on every open day."""
    out = consensus.consensus(sql(spark, sf_dir, FORECASTS), sql(spark, sf_dir, OPEN_DAYS))
    return out.select("ts_code", "trade_date", *[cut_col(c) for c in ("np", "eps", "rd", "eps_std", "cagr")], "up", "down", "total")


# -- sorted portfolios ------------------------------------------------------------------------------

FF3_SQL = f"""
WITH b AS (SELECT *, total_hldr_eqy_exc_min_int_mrq / nullif(total_mv, 0) AS bm FROM ({WEEKLY})),
cal AS (SELECT pos, max(trade_date) AS d, max(index_close) AS ic, max(gc001_weight) / 100 / 365 AS rf FROM b GROUP BY pos),
ends AS (SELECT max(pos) AS pos FROM cal WHERE month(d) = 6 GROUP BY year(d) HAVING max(pos) < (SELECT max(pos) FROM cal) OR month((SELECT max(d) FROM cal) + 1) <> 6),
q AS (SELECT pos, quantile_cont(total_mv, 0.5) AS mid, quantile_cont(bm, 0.3) AS lo, quantile_cont(bm, 0.7) AS hi FROM b JOIN ends USING (pos) WHERE total_mv > 0 AND bm IS NOT NULL GROUP BY pos),
f AS (SELECT ts_code, b.pos, CASE WHEN total_mv <= mid THEN 'S' ELSE 'B' END || CASE WHEN bm <= lo THEN 'L' WHEN bm > hi THEN 'H' ELSE 'M' END AS leg FROM b JOIN q USING (pos) WHERE total_mv > 0 AND bm IS NOT NULL),
c AS (SELECT b.ts_code, b.pos, b.close / p.close - 1 AS r, p.total_mv AS w, (SELECT max(e.pos) FROM ends e WHERE e.pos < b.pos) AS formed FROM b JOIN b p ON p.ts_code = b.ts_code AND p.pos = b.pos - 1 WHERE b.close > 0 AND p.close > 0 AND p.total_mv > 0),
v AS (SELECT c.pos, f.leg, sum(r * w) / sum(w) AS r FROM c JOIN f ON f.ts_code = c.ts_code AND f.pos = c.formed GROUP BY c.pos, f.leg),
g AS (SELECT pos, max(r) FILTER (leg = 'SL') AS sl, max(r) FILTER (leg = 'SM') AS sm, max(r) FILTER (leg = 'SH') AS sh, max(r) FILTER (leg = 'BL') AS bl, max(r) FILTER (leg = 'BM') AS bm, max(r) FILTER (leg = 'BH') AS bh FROM v GROUP BY pos)
SELECT pos, ic / lag(ic) OVER (ORDER BY pos) - 1 - rf AS mkt, (sl + sm + sh) / 3 - (bl + bm + bh) / 3 AS smb, (sh + bh) / 2 - (sl + bl) / 2 AS hml, rf FROM cal LEFT JOIN g USING (pos)"""


def factor_days(panel: DataFrame) -> DataFrame:
    return portfolios.three_factors(panel.withColumns({"book": F.col("total_hldr_eqy_exc_min_int_mrq"), "rate": F.col("gc001_weight")}))


@query("d19_three_factors", f"SELECT pos, {cut('mkt')} AS mkt, {cut('smb')} AS smb, {cut('hml')} AS hml, {cut('rf')} AS rf FROM ({FF3_SQL})")
def d19(spark, sf_dir):
    """Market, size and value returns of each week, from legs formed at the end of June."""
    ship(spark)
    return factor_days(source.panel(spark, sf_dir)).select("pos", *[cut_col(c) for c in ("mkt", "smb", "hml", "rf")])


@query("e3_simulated_groups")
def e3(spark, sf_dir):
    """Net values of five groups; the sequence of trades is no SQL, tests compare it with a plain replay."""
    b = crosssec.buckets(signals(spark, sf_dir).where("signal IS NOT NULL"), 5).select("ts_code", "pos", F.col("bucket").cast("int").alias("bucket"))
    p = source.panel(spark, sf_dir).select("ts_code", "pos", "close", F.col("vol").isNull().alias("suspended"))
    return portfolios.simulate(p.join(b, ["ts_code", "pos"], "left"), 5, 4)


@query("factor_TrendScore")
def trend_score(spark, sf_dir):
    """The trend score with windows that the weekly panel can fill (its stocks trade in four weeks of five); a least squares fit a day is no SQL, tests compare it with numpy."""
    ship(spark)
    return crosssec.trend_scores(source.panel(spark, sf_dir), (3, 5, 10), least=10)


# -- evaluation and reports -------------------------------------------------------------------------

RETS = ", ".join(f"max(CASE WHEN bucket = {k} THEN r END) AS ret_{k}" for k in range(1, 6))
MEANS = ", ".join(f"avg(CASE WHEN bucket = {k} THEN ret END) AS ret_{k}" for k in range(1, 6))


@query("e1_evaluation", f"""
SELECT b.pos, {cut('ic')} AS ic, coalesce(i.n, b.n) AS n, {', '.join(f'{cut(f"ret_{k}")} AS ret_{k}' for k in range(1, 6))}
FROM (SELECT pos, count(ret) AS n, {MEANS} FROM {bucket_sql(5)} GROUP BY pos) b LEFT JOIN {IC} i ON i.pos = b.pos""")
def e1(spark, sf_dir):
    """Rank correlation and group returns of each week, in one pass."""
    return evaluate.evaluation(signals(spark, sf_dir), 5).select("pos", cut_col("ic"), "n", *[cut_col(f"ret_{k}") for k in range(1, 6)])


GROUP_NAV = f"(SELECT bucket, pos, {cut('exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY bucket ORDER BY pos))')} AS nav FROM (SELECT bucket, pos, avg(ret) / 500 AS r FROM {bucket_sql(5)} WHERE bucket IS NOT NULL GROUP BY bucket, pos))"


def group_nav(spark, sf_dir) -> DataFrame:
    r = evaluate.group_returns(signals(spark, sf_dir), 5).select(F.col("bucket").cast("int").alias("bucket"), "pos", (F.col("ret") / 500).alias("r"))
    w = Window.partitionBy("bucket").orderBy("pos")
    return r.select("bucket", "pos", F.exp(F.sum(F.log1p(F.coalesce("r", F.lit(0.0)))).over(w)).alias("nav")).select("bucket", "pos", cut_col("nav"))


def calendar(spark, sf_dir) -> DataFrame:
    return source.panel(spark, sf_dir).groupBy("pos").agg(F.max("trade_date").alias("trade_date"), F.max("index_close").alias("index_close"))


YEAR_ROWS = f"""(SELECT bucket, pos, nav, year(trade_date) AS y, lead(year(trade_date)) OVER (PARTITION BY bucket ORDER BY pos) AS ny FROM {GROUP_NAV} JOIN (SELECT DISTINCT pos, trade_date FROM ({WEEKLY})) USING (pos))"""


@query("e6_yearly_performance", f"""
WITH e AS (SELECT bucket, pos, nav, y FROM {YEAR_ROWS} UNION ALL SELECT bucket, pos, nav, ny FROM {YEAR_ROWS} WHERE ny > y),
r AS (SELECT *, nav / lag(nav) OVER (PARTITION BY bucket, y ORDER BY pos) - 1 AS r, max(nav) OVER (PARTITION BY bucket, y ORDER BY pos) AS top FROM e),
a AS (SELECT bucket, y, arg_max(nav, pos) / arg_min(nav, pos) AS g, count(r) AS k, stddev_samp(r) * sqrt(252) AS vol, avg(r) * 252 AS m, min(nav / top - 1) AS dd, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) AS win FROM r GROUP BY bucket, y HAVING count(*) > 1)
SELECT CAST(bucket AS INT) AS bucket, CAST(y AS INT) AS year, {cut('g - 1')} AS "return", {cut('power(g, 252.0 / k) - 1')} AS annual_return, {cut('vol')} AS volatility, {cut('m / nullif(vol, 0)')} AS sharpe, {cut('dd')} AS max_drawdown, {cut('win')} AS win_rate FROM a""")
def e6(spark, sf_dir):
    """Performance of each group in each calendar year; a year starts from the last value of the year before."""
    nav = group_nav(spark, sf_dir).join(F.broadcast(calendar(spark, sf_dir).select("pos", "trade_date")), "pos")  # a row a day
    out = evaluate.yearly_performance(nav, ["bucket"])
    return out.select("bucket", "year", *[cut_col(c) for c in ("return", "annual_return", "volatility", "sharpe", "max_drawdown", "win_rate")])


BENCH = f"(SELECT pos, index_close / first_value(index_close) OVER (ORDER BY pos) AS benchmark FROM (SELECT DISTINCT pos, index_close FROM ({WEEKLY})) WHERE pos IN (SELECT pos FROM {GROUP_NAV}))"
REPORT = f"""(
  SELECT pos, strategy AS "Strategy", benchmark AS "Benchmark", strategy / benchmark AS "Excess", exp(sum(ln(1 + coalesce(d, 0))) OVER (ORDER BY pos)) AS "Spread" FROM (
    SELECT pos, max(nav) FILTER (bucket = 5) AS strategy, arg_max(coalesce(r, 0), bucket) - arg_min(coalesce(r, 0), bucket) AS d FROM (SELECT *, nav / lag(nav) OVER (PARTITION BY bucket ORDER BY pos) - 1 AS r FROM {GROUP_NAV}) GROUP BY pos) JOIN {BENCH} USING (pos))"""


@query("e8_benchmark_nav", f"SELECT pos, {cut('benchmark')} AS benchmark FROM {BENCH}")
def e8(spark, sf_dir):
    return evaluate.benchmark_nav(group_nav(spark, sf_dir), calendar(spark, sf_dir)).select("pos", cut_col("benchmark"))


@query("e9_report_nav", f"SELECT series, pos, {cut('nav')} AS nav FROM (UNPIVOT {REPORT} ON \"Strategy\", \"Benchmark\", \"Excess\", \"Spread\" INTO NAME series VALUE nav)")
def e9(spark, sf_dir):
    """Strategy, benchmark, excess and spread."""
    groups = group_nav(spark, sf_dir)
    return evaluate.report_nav(groups, evaluate.benchmark_nav(groups, calendar(spark, sf_dir)), 5).select("series", "pos", cut_col("nav"))


@query("e10_correlation_summary", f"""
SELECT {cut('avg(c)')} AS mean, {cut('avg(abs(c))')} AS mean_abs, {cut('stddev_samp(c)')} AS std, {cut('avg(CASE WHEN c > 0 THEN 1.0 WHEN c IS NOT NULL THEN 0.0 END)')} AS positive, count(c) AS days FROM (
  SELECT pos, CASE WHEN stddev_samp(signal) > 1e-12 AND stddev_samp(total_mv) > 1e-12 THEN covar_samp(signal, total_mv) / (stddev_samp(signal) * stddev_samp(total_mv)) END AS c, count(*) AS n
  FROM {SIGNALS} JOIN (SELECT ts_code, pos, total_mv FROM ({WEEKLY})) USING (ts_code, pos) WHERE signal IS NOT NULL AND total_mv IS NOT NULL GROUP BY pos) WHERE n >= 3""")
def e10_summary(spark, sf_dir):
    s = evaluate.correlation_summary(crosssec.daily_correlation(signals(spark, sf_dir), "signal", "total_mv"))
    return s.select(*[cut_col(c) for c in ("mean", "mean_abs", "std", "positive")], "days")


@query("w19_rolling_ic", f"SELECT pos, CASE WHEN count(ic) OVER w >= 20 THEN {cut('avg(ic) OVER w')} END AS mean FROM {IC} WINDOW w AS (ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def w19(spark, sf_dir):
    return evaluate.rolling_mean(evaluate.ic_series(signals(spark, sf_dir)), 20).select("pos", cut_col("mean"))


CALENDAR = "SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM {lineitem}"


@query("w3_window_starts", D(f"""
WITH c AS ({CALENDAR}), l AS (SELECT min(trade_date) AS low FROM c)
SELECT trade_date, lag(trade_date, 20) OVER (ORDER BY trade_date) AS days, CASE WHEN trade_date - INTERVAL 6 MONTH >= low THEN CAST(trade_date - INTERVAL 6 MONTH AS DATE) END AS months, CASE WHEN trade_date - INTERVAL 1 YEAR >= low THEN CAST(trade_date - INTERVAL 1 YEAR AS DATE) END AS years FROM c, l"""), text="trade_date days months years")
def w3(spark, sf_dir):
    """Where look-backs of 20 open days, 6 months and a year begin."""
    c = sql(spark, sf_dir, CALENDAR)
    out = c
    for name, window in (("days", "20D"), ("months", "6M"), ("years", "1Y")):
        out = out.join(contract.window_starts(c, window).withColumnRenamed("start", name), "trade_date")
    return out


@query("p12_fingerprint", "SELECT count(*) AS n, bit_xor(CAST('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority)), 1, 15) AS BIGINT)) AS hash FROM orders")
def p12(spark, sf_dir):
    """A table's content regardless of the order of its rows."""
    return quality.fingerprint(t(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("o2_top_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o2(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("c1_try_conversions", """
SELECT event_id, try_cast(json_extract_string(props, '$.page') AS DOUBLE) AS page, TRY_CAST(substr(CAST(ts AS VARCHAR), 1, 10) AS DATE) AS day, TRY_CAST(event_type AS INT) AS none FROM events""", text="day")
def c1(spark, sf_dir):
    """Conversions that give NULL where a text is no number or date."""
    return t(spark, sf_dir, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.page') AS DOUBLE)").alias("page"), F.expr("try_cast(substr(CAST(ts AS STRING), 1, 10) AS DATE)").alias("day"), F.expr("try_cast(event_type AS INT)").alias("none"))
