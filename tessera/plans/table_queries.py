"""Queries of the plain relational operators: joins, aggregates, windows, ordering and set operations, reads and writes of the store."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import frames, joins, quality
from tessera.plans.operator_queries import PROBES, REVISIONS, WEEKLY, asof_sql, cut, cut_col, query, sql, t
from tessera.sources import panel as source
from tessera.sources import store


@query("j1_equi_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j1(spark, sf_dir):
    return t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j2_equi_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'", numbers="o_orderkey")
def j2(spark, sf_dir):
    o = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return t(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("j3_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS a, b.n AS b FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY k) a FULL JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY k) b ON a.k = b.k", numbers="a b")
def j3(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")
    a = l.where("l_suppkey % 3 > 0").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    return a.join(l.groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("b")), "k", "full")


@query("j8_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j8(spark, sf_dir):
    return t(spark, sf_dir, "customer").join(t(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("j9_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def j9(spark, sf_dir):
    return t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "lineitem").where("l_quantity > 49"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")


@query("j10_spine", f"SELECT ts_code, pos FROM ({WEEKLY})")
def j10(spark, sf_dir):
    """Calendar times stocks: the panel has a row for each pair."""
    return source.panel(spark, sf_dir).select("ts_code", "pos")


@query("j11_first_year", "SELECT o_orderkey, min(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS first_year FROM orders", numbers="first_year")
def j11(spark, sf_dir):
    """A self-join for the first target year of a report, as a window."""
    return t(spark, sf_dir, "orders").select("o_orderkey", F.min(F.year("o_orderdate")).over(Window.partitionBy("o_custkey")).alias("first_year"))


@query("j14_previous_month_close", f"""
WITH p AS (SELECT ts_code, pos, date_trunc('month', trade_date) AS m, close FROM ({WEEKLY})), e AS (SELECT m, max(pos) AS pos FROM p GROUP BY m)
SELECT p.ts_code, p.pos, c.close AS month_close FROM p LEFT JOIN e ON e.m = p.m - INTERVAL 1 MONTH LEFT JOIN p c ON c.ts_code = p.ts_code AND c.pos = e.pos""")
def j14(spark, sf_dir):
    """On each day the price of the last open day of the month before."""
    return frames.previous_month_close(source.panel(spark, sf_dir)).select("ts_code", "pos", "month_close")


@query("p2_range_and_membership", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01' AND o_orderstatus IN ('F', 'O')")
def p2(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.where("o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1996-07-01'").where(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_totalprice")


@query("p11_leaks", f"SELECT ts_code, trade_date, effective FROM ({asof_sql('>=')}) WHERE effective >= trade_date", text="trade_date effective")
def p11(spark, sf_dir):
    """Rows of an inclusive as-of join that use a value on the day it became known."""
    rows = joins.asof_join(sql(spark, sf_dir, PROBES), sql(spark, sf_dir, REVISIONS), ["ts_code"], "trade_date", "effective", ["value"], strict=False, order=["seq"])
    return quality.leaks(rows, "trade_date", "effective").select("ts_code", "trade_date", "effective")


@query("a13_keep_last", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def a13(spark, sf_dir):
    return joins.latest(t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("a14_last_values", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3")
def a14(spark, sf_dir):
    return frames.top(t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 3).select("o_custkey", "o_orderkey")


@query("a15_group_share", f"SELECT s_suppkey, {cut('s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey)')} AS part FROM supplier")
def a15(spark, sf_dir):
    part = F.col("s_acctbal") / F.sum("s_acctbal").over(Window.partitionBy("s_nationkey"))
    return t(spark, sf_dir, "supplier").withColumn("part", part).select("s_suppkey", cut_col("part"))


@query("a17_pivot", "SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r FROM lineitem GROUP BY l_suppkey")
def a17(spark, sf_dir):
    g = t(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return g.withColumnsRenamed({"A": "a", "N": "n", "R": "r"})


@query("w2_count_over", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def w2(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"))


@query("w17_cumulative_growth", f"SELECT ts_code, pos, {cut('exp(sum(ln(1 + q / 1000.0)) OVER (PARTITION BY ts_code ORDER BY pos))')} AS growth FROM ({WEEKLY})")
def w17(spark, sf_dir):
    w = Window.partitionBy("ts_code").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return source.panel(spark, sf_dir).withColumn("growth", F.exp(F.sum(F.log1p(F.col("q") / 1000.0)).over(w))).select("ts_code", "pos", cut_col("growth"))


@query("o5_union_all", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def o5(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return s.unionByName(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))


@query("o6_set_difference", "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5")
def o6(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")
    return l.where("l_quantity > 40").select(F.col("l_partkey").alias("k")).distinct().join(l.where("l_quantity < 5").select(F.col("l_partkey").alias("k")), "k", "left_anti")


@query("o7_distinct", source.duck_sql(PROBES), text="trade_date")
def o7(spark, sf_dir):
    return sql(spark, sf_dir, PROBES)


@query("o8_argmax", "SELECT pos, arg_max(ts_code, (vol, -ts_code)) AS busiest FROM (" + WEEKLY + ") WHERE vol IS NOT NULL GROUP BY pos")
def o8(spark, sf_dir):
    p = source.panel(spark, sf_dir).where("vol IS NOT NULL")
    return p.groupBy("pos").agg(F.max_by("ts_code", F.struct("vol", -F.col("ts_code"))).alias("busiest"))


@query("d1_calendar", f"SELECT DISTINCT trade_date, pos FROM ({WEEKLY}) WHERE pos BETWEEN 50 AND 100", text="trade_date")
def d1(spark, sf_dir):
    return source.panel(spark, sf_dir).where("pos BETWEEN 50 AND 100").select("trade_date", "pos").distinct()


@query("d4_all_stock_universe", f"SELECT pos, string_agg(CAST(ts_code AS VARCHAR), ',' ORDER BY ts_code) AS codes FROM ({WEEKLY}) WHERE vol IS NOT NULL AND ts_code % 13 <> pos % 13 GROUP BY pos")
def d4(spark, sf_dir):
    p = source.panel(spark, sf_dir).where("vol IS NOT NULL AND ts_code % 13 <> pos % 13")
    return p.groupBy("pos").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("ts_code")), lambda c: c.cast("string"))).alias("codes"))


@query("d21_annual_window", f"SELECT * FROM (SELECT a_code, fy, {cut('slope_revenue_ttm')} AS slope, {cut('var_revenue_ttm')} AS spread FROM ({source.duck_sql(source.annual_sql())}))")
def d21(spark, sf_dir):
    """Slope and spread of a field over the last five fiscal years of each stock."""
    a = source.run_sql(spark, sf_dir, source.annual_sql()).select("a_code", "fy", F.col("slope_revenue_ttm").alias("slope"), F.col("var_revenue_ttm").alias("spread"))
    return a.select("a_code", "fy", cut_col("slope"), cut_col("spread"))


@query("d23_latest_annual_value", f"SELECT ts_code, pos, a_revenue_ttm AS revenue FROM ({source.duck_sql(source.joined_sql())})")
def d23(spark, sf_dir):
    return source.annual_panel(spark, sf_dir).select("ts_code", "pos", F.col("a_revenue_ttm").alias("revenue"))


@query("s15_factor_store", f"SELECT CAST(pos AS VARCHAR) AS trade_date, CAST(ts_code AS VARCHAR) AS ts_code, CASE WHEN pos BETWEEN 200 AND 250 THEN q * 2.0 ELSE q * 1.0 END AS q FROM (SELECT ts_code, 1000 + pos AS pos, q FROM ({WEEKLY}))".replace("BETWEEN 200 AND 250", "BETWEEN 1200 AND 1250"), numbers="q")
def s15(spark, sf_dir):
    """Saves a factor, saves a part of its range again, and reads the wide form."""
    path = store.scratch(spark, "store")
    p = source.panel(spark, sf_dir).select((1000 + F.col("pos")).cast("string").alias("trade_date"), F.col("ts_code").cast("string").alias("ts_code"), F.col("q").cast("double").alias("value"))
    store.save_factor(spark, path, "q", p, "0", "9999")
    store.save_factor(spark, path, "q", p.withColumn("value", F.col("value") * 2), "1200", "1250")
    return store.read_factors(spark, path, ["q"])


@query("s18_replace_range", "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' THEN o_totalprice + 1 ELSE o_totalprice END AS v, year(o_orderdate) AS y FROM orders", numbers="y")
def s18(spark, sf_dir):
    """A stored table, of which one year is deleted and inserted again."""
    path = store.scratch(spark, "range")
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"), F.year("o_orderdate").alias("y"))
    store.replace_partitions(o, path, "y")
    store.replace_partitions(o.where("y = 1997").withColumn("v", F.col("v") + 1), path, "y")
    return spark.read.parquet(path)


@query("d22_annual_values", f"""
WITH s AS (SELECT ts_code, trade_date, (1990 + (q - q % 4) / 4) * 10000 + CASE q % 4 WHEN 0 THEN 331 WHEN 1 THEN 630 WHEN 2 THEN 930 ELSE 1231 END AS period, rd_exp_ttm AS value FROM ({WEEKLY}) WHERE q >= 0),
k AS (SELECT ts_code, period, arg_max(value, trade_date) AS value FROM s WHERE period % 10000 = 1231 AND value IS NOT NULL AND trade_date <= DATE '2000-06-30' GROUP BY ALL),
m AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY period DESC) <= 3), y AS (SELECT DISTINCT period FROM m ORDER BY period DESC LIMIT 3)
SELECT c.ts_code, CAST(y.period AS BIGINT) AS period, m.value FROM (SELECT DISTINCT ts_code FROM m) c CROSS JOIN y LEFT JOIN m ON m.ts_code = c.ts_code AND m.period = y.period""")
def d22(spark, sf_dir):
    """The last three year-end values known on a day, years aligned over all stocks."""
    period = F.expr("CAST((1990 + (q - q % 4) / 4) * 10000 + CASE q % 4 WHEN 0 THEN 331 WHEN 1 THEN 630 WHEN 2 THEN 930 ELSE 1231 END AS BIGINT)")
    s = source.panel(spark, sf_dir).where("q >= 0").select("ts_code", "trade_date", period.alias("period"), F.col("rd_exp_ttm").alias("value"))
    return frames.annual_values(s, "2000-06-30", "value", count=3).select("ts_code", "period", "value")


@query("d24_year_end_values", f"SELECT ts_code, CAST(year(trade_date) AS INT) AS year, arg_max(ocf_yoy, trade_date) AS value FROM ({WEEKLY}) WHERE ocf_yoy IS NOT NULL AND year(trade_date) < 2001 GROUP BY ALL")
def d24(spark, sf_dir):
    return frames.year_end_values(source.panel(spark, sf_dir).withColumn("value", F.col("ocf_yoy")), 2001, "value").select("ts_code", "year", "value")


@query("d12_new_columns", "SELECT o_orderkey, o_custkey, o_totalprice * 2 AS twice FROM orders")
def d12(spark, sf_dir):
    """An old table given a column that it did not have."""
    o = t(spark, sf_dir, "orders")
    old = o.select("o_orderkey", "o_custkey")
    return frames.new_columns(old, o.withColumn("twice", F.col("o_totalprice") * 2), ["o_orderkey"], ["twice"], ["o_orderkey", "o_custkey"])


@query("a6_collapse", "SELECT s_nationkey AS k, max(s_acctbal) AS s, (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = s_nationkey) AS c FROM supplier GROUP BY s_nationkey UNION ALL SELECT c_nationkey, NULL, max(c_acctbal) FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier) GROUP BY c_nationkey")
def a6(spark, sf_dir):
    """Sparse sources of one key as one row."""
    s = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("s"))
    c = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("c"))
    return frames.collapse([s, c], ["k"], ["s", "c"])
