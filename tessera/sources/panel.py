"""The test tables as a market panel.

Suppliers are stocks and weeks are trading days. Prices and volumes come from ``lineitem``; statement and forecast
fields are whole-number functions of stock and quarter, so that both sides of a comparison start from equal inputs. The
text is SQL that Spark and DuckDB share; ``{lineitem}`` and ``{supplier}`` are the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fields of the statements that a stock's last visible report gives, each with its least value and spread.
STATEMENT = {
    "revenue_ttm": (600, 900), "oper_cost_ttm": (200, 300), "n_income_attr_p_ttm": (-50, 250), "daa_ttm": (20, 60), "ebit_ttm": (10, 200), "sell_exp_ttm": (10, 50),
    "admin_exp_ttm": (10, 50), "rd_exp_ttm": (1, 60), "biz_tax_surchg_ttm": (1, 20), "n_cashflow_act_ttm": (-40, 200), "n_cashflow_inv_act_ttm": (-100, 150),
    "n_incr_cash_cash_equ_ttm": (-60, 150), "c_pay_acq_const_fiolta_ttm": (5, 90), "depreciation_ttm_pit": (10, 60), "total_assets_mrq": (2000, 2500),
    "total_hldr_eqy_exc_min_int_mrq": (500, 900), "oth_eqt_tools_p_shr_mrq": (0, 40), "total_liab_mrq": (600, 900), "total_cur_assets_mrq": (500, 700),
    "total_cur_liab_mrq": (200, 400), "money_cap_mrq": (50, 300), "trad_asset_mrq": (0, 80), "defer_tax_liab_mrq": (0, 30), "st_borr_mrq": (0, 120), "st_bonds_payable_mrq": (0, 40),
    "non_cur_liab_due_1y_mrq": (0, 40), "lt_borr_mrq": (0, 200), "bond_payable_mrq": (0, 90), "lease_liab_mrq": (0, 30), "fix_assets_mrq": (100, 600), "fix_assets_total_mrq": (100, 700),
}
# Fields that change from week to week.
WEEKLY = {
    "tr_yoy": (-30, 90), "dt_netprofit_yoy": (-60, 160), "ocf_yoy": (-50, 140), "forecast_np_12m": (10, 200), "forecast_eps_12m": (1, 60), "forecast_eps_12m_std": (1, 15),
    "forecast_eps_fy1_fy3_cagr": (-20, 70), "forecast_dividend_yield_12m": (0, 8), "cash_div_tax_ttm": (0, 30), "forecast_revision_up_count": (0, 5), "forecast_revision_down_count": (0, 5),
    "dv_ttm": (0, 8), "pe_ttm": (5, 80), "pb": (1, 12), "ps_ttm": (1, 20),
}
OPTIONAL = ("oth_eqt_tools_p_shr_mrq", "trad_asset_mrq", "rd_exp_ttm", "defer_tax_liab_mrq", "st_bonds_payable_mrq", "sell_exp_ttm", "forecast_np_12m", "ocf_yoy", "pe_ttm")
ANNUAL = ("revenue_ttm", "n_income_attr_p_ttm", "n_incr_cash_cash_equ_ttm", "total_assets_mrq", "c_pay_acq_const_fiolta_ttm", "ebit_ttm", "daa_ttm", "money_cap_mrq", "trad_asset_mrq", "total_liab_mrq", "oper_cost_ttm", "total_cur_liab_mrq", "total_hldr_eqy_exc_min_int_mrq", "oth_eqt_tools_p_shr_mrq", "n_cashflow_act_ttm", "n_cashflow_inv_act_ttm")
DEBT = ("st_borr_mrq", "st_bonds_payable_mrq", "non_cur_liab_due_1y_mrq", "lt_borr_mrq", "bond_payable_mrq", "lease_liab_mrq")


def made_up(name: str, k: int, code: str, time: str, bounds: tuple[int, int]) -> str:
    """A field as a whole number of stock and time, over ten; optional fields are missing now and then."""
    least, spread = bounds
    n = f"({code} * {7919 + 2 * k} + {time} * {104729 + 4 * k} + ({code} * {time}) % {91 + k} * {k + 3})"
    value = f"({least} + {n} % {spread + 1}) / 10.0" if name not in ("forecast_revision_up_count", "forecast_revision_down_count") else f"({least} + {n} % {spread + 1}) * 1.0"
    value = f"CAST({value} AS DOUBLE)"
    return f"CASE WHEN {n} % 19 <> 3 THEN {value} END" if name in OPTIONAL else value


def debt(coalesced: bool = True) -> str:
    return "(" + " + ".join(f"coalesce({x}, 0)" for x in DEBT) + ")"


def weekly_sql() -> str:
    """The panel: a row for each supplier and week, also where nothing was traded; statements are NULL before the first is visible."""
    statement = ",\n".join(f"CASE WHEN q >= 0 THEN {made_up(n, k, 'code', 'q', b)} END AS {n}" for k, (n, b) in enumerate(STATEMENT.items()))
    weekly = ",\n".join(f"{made_up(n, k + 40, 'code', 'pos', b)} AS {n}" for k, (n, b) in enumerate(WEEKLY.items()))
    return f"""
WITH l AS (
  SELECT l_suppkey AS code, CAST(date_trunc('week', l_shipdate) AS DATE) AS wk, l_extendedprice / l_quantity AS px, l_quantity AS q, l_extendedprice AS amt, {{row}}(l_shipdate, l_orderkey, l_linenumber) AS ord FROM {{lineitem}}
), bars AS (
  SELECT code, wk, CAST(floor((min_by(px, ord)) * 100 + 0.3713e0) AS DOUBLE) / 100 AS open, CAST(floor((max(px)) * 100 + 0.3713e0) AS DOUBLE) / 100 AS high, CAST(floor((min(px)) * 100 + 0.3713e0) AS DOUBLE) / 100 AS low, CAST(floor((max_by(px, ord)) * 100 + 0.3713e0) AS DOUBLE) / 100 AS close,
         sum(q) AS vol, CAST(floor((sum(amt)) * 100 + 0.3713e0) AS DOUBLE) / 100 AS amount FROM l GROUP BY code, wk
), cal AS (
  SELECT wk, CAST(row_number() OVER (ORDER BY wk) AS BIGINT) AS pos, CAST(floor((sum(amount) / sum(vol)) * 100 + 0.3713e0) AS DOUBLE) / 100 AS index_close FROM bars GROUP BY wk
), spine AS (
  SELECT s_suppkey AS code, s_nationkey AS sw_l1_industry, wk, pos, index_close FROM cal CROSS JOIN {{supplier}}
), p AS (
  SELECT s.code, s.sw_l1_industry, s.wk AS trade_date, s.pos, s.index_close, open, high, low, close, vol, amount,
         CAST(100 + s.code % 50 AS DOUBLE) AS total_share, CASE WHEN close IS NOT NULL THEN close * (100 + s.code % 50) / 100 END AS total_mv,
         CASE WHEN close IS NOT NULL THEN close * (50 + s.code % 50) / 100 END AS circ_mv, CASE WHEN s.code % 9 = 0 THEN '2' ELSE '1' END AS comp_type,
         CAST(1.5 + s.pos % 7 / 10.0 AS DOUBLE) AS gc001_weight, CAST((s.pos - 4 - (s.pos - 4) % 13) / 13 - 1 AS BIGINT) AS q,
         CASE WHEN vol IS NOT NULL THEN vol / (100 + s.code % 50) END AS turnover_rate_f
  FROM spine s LEFT JOIN bars b ON s.code = b.code AND s.wk = b.wk
)
SELECT code AS ts_code, trade_date, pos, q, sw_l1_industry, index_close, open, high, low, close, vol, amount, total_share, total_mv, circ_mv, comp_type, gc001_weight, turnover_rate_f,
{statement},
{weekly}
FROM p
"""


def annual_sql() -> str:
    """Statistics of the last five fiscal years of each stock, by fiscal year ``fy`` (known from quarter 4 fy + 3 on)."""
    names = list(STATEMENT)
    fields = ",\n".join(f"{made_up(n, names.index(n), 'code', '(4 * fy + 3)', STATEMENT[n])} AS {n}" for n in ANNUAL)
    d = " + ".join(f"coalesce({made_up(n, names.index(n), 'code', '(4 * fy + 3)', STATEMENT[n])}, 0)" for n in DEBT)
    w = "OVER (PARTITION BY code ORDER BY fy RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)"

    def slope(x: str) -> str:
        return f"CASE WHEN count({x}) {w} >= 4 THEN regr_slope({x}, fy) {w} / nullif(avg({x}) {w}, 0) END"

    def var(x: str) -> str:
        return f"CASE WHEN count({x}) {w} >= 4 THEN stddev_samp({x}) {w} / nullif(avg({x}) {w}, 0) END"

    last = ", ".join(f"{n} AS a_{n}" for n in ANNUAL)
    prev = ", ".join(f"first({n}) OVER (PARTITION BY code ORDER BY fy RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS b_{n}" for n in ("total_assets_mrq", "money_cap_mrq", "trad_asset_mrq", "total_liab_mrq", "debt"))
    slopes = ", ".join(f"{slope(x)} AS slope_{x}" for x in ("revenue_ttm", "n_income_attr_p_ttm", "total_assets_mrq", "c_pay_acq_const_fiolta_ttm", "shares", "sales_ps", "eps"))
    variances = ", ".join(f"{var(x)} AS var_{x}" for x in ("revenue_ttm", "n_income_attr_p_ttm", "n_incr_cash_cash_equ_ttm"))
    return f"""
WITH y AS (SELECT s_suppkey AS code, t.fy AS fy FROM {{supplier}} CROSS JOIN (SELECT l_linenumber - 1 AS fy FROM {{lineitem}} GROUP BY l_linenumber) t),
f AS (SELECT code, fy, {fields}, CAST({d} AS DOUBLE) AS debt, CAST(100 + code % 50 + fy * (code % 3) AS DOUBLE) AS shares FROM y),
g AS (SELECT *, revenue_ttm / shares AS sales_ps, n_income_attr_p_ttm / shares AS eps FROM f)
SELECT code AS a_code, fy, {last}, debt AS a_debt, {prev}, {slopes}, {variances} FROM g
"""


def joined_sql() -> str:
    """The weekly panel with the statistics of the last fiscal year that is visible (quarter ``q`` or before)."""
    return f"SELECT p.*, a.* FROM ({weekly_sql()}) p LEFT JOIN ({annual_sql()}) a ON p.ts_code = a.a_code AND a.fy = CAST((p.q + 1 - (p.q + 1) % 4) / 4 - 1 AS BIGINT)"


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs shared SQL over the Parquet tables of a folder."""
    names = ("lineitem", "supplier", "orders", "events", "nation", "region", "customer", "part")
    used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names if f"{{{n}}}" in sql}
    return spark.sql(sql.replace("{row}", "struct"), **used)


def duck_sql(sql: str) -> str:
    """Shared SQL with the tables' own names."""
    for n in ("lineitem", "supplier", "orders", "events", "nation", "region", "customer", "part"):
        sql = sql.replace(f"{{{n}}}", n)
    return sql.replace("{row}", "row")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, weekly_sql())


def annual_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, joined_sql())
