"""Size, value, growth, quality, risk and sentiment factors."""

from __future__ import annotations

from tessera.factors.spec import Layers, factor, simple
from tessera.functions.dialect import Sql, combine, standardise
from tessera.sources.panel import DEBT

MCAP = "(total_mv * 100)"
DEBT_SUM = "(" + " + ".join(f"coalesce({x}, 0)" for x in DEBT) + ")"


def ratio(a: str, b: str, cond: str | None = None) -> str:
    r = f"CAST({a} AS DOUBLE) / nullif({b}, 0)"
    return f"CASE WHEN {cond} THEN {r} END" if cond else r


INDUSTRIAL = "comp_type = '1'"
OPT = "(revenue_ttm - oper_cost_ttm - coalesce(biz_tax_surchg_ttm, 0) - coalesce(sell_exp_ttm, 0) - coalesce(admin_exp_ttm, 0) - coalesce(rd_exp_ttm, 0))"
SGA = "CASE WHEN coalesce(sell_exp_ttm, admin_exp_ttm) IS NOT NULL THEN coalesce(sell_exp_ttm, 0) + coalesce(admin_exp_ttm, 0) END"
NOA = f"(total_assets_mrq - money_cap_mrq - coalesce(trad_asset_mrq, 0) - total_liab_mrq + {DEBT_SUM})"
GROSS = ratio("revenue_ttm - oper_cost_ttm", "revenue_ttm")
ROE = ratio("n_income_attr_p_ttm", "total_hldr_eqy_exc_min_int_mrq")

simple("size", {"Assets": "total_assets_mrq", "MarketCap": "CASE WHEN total_mv > 0 THEN total_mv * 10000 END"})
simple(
    "value",
    {
        "AssetsToMarket": ratio("total_assets_mrq", MCAP),
        "BookToMarket": ratio("total_hldr_eqy_exc_min_int_mrq", MCAP),
        "EarningsToPriceNIProxy": ratio("n_income_attr_p_ttm", MCAP),
        "RDToMarket": ratio("rd_exp_ttm", MCAP, f"{MCAP} > 0"),
        "SalesToPrice": ratio("revenue_ttm", MCAP),
        "TobinsQCN": ratio(f"total_assets_mrq + {MCAP} - money_cap_mrq - coalesce(trad_asset_mrq, 0) - coalesce(defer_tax_liab_mrq, 0)", "total_assets_mrq", INDUSTRIAL),
    },
)
simple(
    "quality",
    {
        "CapitalIntensity": ratio("depreciation_ttm_pit", "total_assets_mrq"),
        "CashFlowToBook": ROE,
        "ReturnOnEquityNIProxy": ROE,
        "CashToShortTermInvestmentsCN": ratio("money_cap_mrq + coalesce(trad_asset_mrq, 0)", "total_assets_mrq", INDUSTRIAL),
        "CurrentRatio": ratio("total_cur_assets_mrq", "total_cur_liab_mrq"),
        "GrossMargin": GROSS,
        "PriceToCostMargin": GROSS,
        "GrossProfitability": ratio("revenue_ttm - oper_cost_ttm", "total_hldr_eqy_exc_min_int_mrq"),
        "NetOperatingAssetsCN": ratio(NOA, "total_assets_mrq", INDUSTRIAL),
        "NetProfitMarginNIProxy": ratio("n_income_attr_p_ttm", "revenue_ttm"),
        "ProfitMarginCN": ratio(OPT, "revenue_ttm", INDUSTRIAL),
        "ReturnOnAssetsNIProxy": ratio("n_income_attr_p_ttm", "total_assets_mrq"),
        "SGAToSales": ratio(SGA, "revenue_ttm"),
        "SalesToAssets": ratio("revenue_ttm", "total_assets_mrq"),
    },
)
simple(
    "risk",
    {
        "CurrentLiabilityRatio": ratio("total_cur_liab_mrq", "total_liab_mrq"),
        "DebtToAssets": ratio("total_liab_mrq", "total_assets_mrq"),
        "FixedAssetsToAssetsCN": ratio("fix_assets_mrq", "total_assets_mrq"),
        "LeverageCN": ratio(DEBT_SUM, f"{DEBT_SUM} + total_hldr_eqy_exc_min_int_mrq", INDUSTRIAL),
        "OperatingLeverage": ratio(f"oper_cost_ttm + {SGA}", "total_assets_mrq"),
    },
)


@factor("size")
def BarraSize(e: Sql) -> Layers:
    return [{"x": e.pos_ln("circ_mv * 10000")}, *standardise(e, ["x"], "total_mv"), {"value": "z_x"}]


@factor("size")
def BarraMidCap(e: Sql) -> Layers:
    """The cube of size made orthogonal to size by a cap-weighted regression."""
    ok = "CASE WHEN circ_mv > 0 AND z_x IS NOT NULL THEN {} END"
    m = {f"w{i}": e.day(f"sum({ok.format('circ_mv' + ' * z_x' * i)})") for i in (0, 1, 2, 3, 4)}
    fit = {"b": "(w4 - w1 * w3 / w0) / nullif(w2 - w1 * w1 / w0, 0)"}
    res = {"r": "z_x * z_x * z_x - (w3 - b * w1) / nullif(w0, 0) - b * z_x"}
    return [{"x": e.pos_ln("circ_mv * 10000")}, *standardise(e, ["x"], "circ_mv"), m, fit, res, *standardise(e, ["r"], "total_mv"), {"value": "z_r"}]


def scored(e: Sql, x: str) -> Layers:
    return [{"x": x}, *standardise(e, ["x"], "total_mv"), {"value": "z_x"}]


@factor("value")
def BarraBookToPrice(e: Sql) -> Layers:
    return scored(e, ratio("total_hldr_eqy_exc_min_int_mrq - coalesce(oth_eqt_tools_p_shr_mrq, 0)", MCAP))


@factor("value")
def BarraDividendYieldProxy(e: Sql) -> Layers:
    return scored(e, "dv_ttm / 100")


@factor("value")
def BarraDividendYield(e: Sql) -> Layers:
    """The price is that of the last open day of the month before."""
    month = {"mo": "year(trade_date) * 12 + month(trade_date)"}
    end = {"mend": "max(pos) OVER (PARTITION BY mo)"}
    at = {"px": "max(CASE WHEN pos = mend THEN close END) OVER (PARTITION BY ts_code ORDER BY mo RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"}
    x = {"dtop": e.div("cash_div_tax_ttm", "px"), "dtopf": "forecast_dividend_yield_12m / 100"}
    return [month, end, at, x, *combine(e, ["dtop", "dtopf"], "total_mv")]


def enterprise(p: str = "") -> str:
    return f"({MCAP} + coalesce(oth_eqt_tools_p_shr_mrq, 0) + {DEBT_SUM} - money_cap_mrq - coalesce(trad_asset_mrq, 0))"


@factor("value", annual=True)
def BarraEarningsYield(e: Sql) -> Layers:
    x = {"etop": ratio("n_income_attr_p_ttm", MCAP), "etopf": ratio("forecast_np_12m", MCAP), "cetop": ratio("n_income_attr_p_ttm + daa_ttm", MCAP), "em": ratio("a_ebit_ttm", enterprise())}
    return [x, *combine(e, list(x), "total_mv")]


@factor("value", annual=True)
def BarraEarningsYieldProxy(e: Sql) -> Layers:
    x = {"etop": ratio("n_income_attr_p_ttm", MCAP), "cetop": ratio("n_income_attr_p_ttm + daa_ttm", MCAP), "em": ratio("a_ebit_ttm", enterprise())}
    return [x, *combine(e, list(x), "total_mv")]


def yearly(e: Sql, *xs: str) -> Layers:
    """Changes against the report of a year before: its value on the last day, within 504, that showed it."""
    key = {"prior_q": "q - 4"}
    last = "arg_max({0}, pos)" if e.duck else "max_by({0}, pos)"
    seen = {f"last_{x}": f"{last.format(x)} FILTER (WHERE {x} IS NOT NULL) OVER (PARTITION BY ts_code ORDER BY q RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING)" if e.duck else f"max_by({x}, CASE WHEN {x} IS NOT NULL THEN pos END) OVER (PARTITION BY ts_code ORDER BY q RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING)" for x in xs}
    return [key, seen]


@factor("growth")
def Investment(e: Sql) -> Layers:
    return [*yearly(e, "total_assets_mrq"), {"value": f"{ratio('total_assets_mrq', 'last_total_assets_mrq')} - 1"}]


@factor("growth")
def PPEChangeToAssets(e: Sql) -> Layers:
    return [*yearly(e, "total_assets_mrq", "fix_assets_total_mrq"), {"value": ratio("fix_assets_total_mrq - last_fix_assets_total_mrq", "last_total_assets_mrq")}]


@factor("quality")
def CapitalTurnover(e: Sql) -> Layers:
    return [*yearly(e, "total_assets_mrq"), {"value": ratio("revenue_ttm", "last_total_assets_mrq")}]


@factor("quality")
def OperatingAccrualsCN(e: Sql) -> Layers:
    near = "(coalesce(st_borr_mrq, 0) + coalesce(st_bonds_payable_mrq, 0) + coalesce(non_cur_liab_due_1y_mrq, 0))"
    ncwc = {"ncwc": f"(total_cur_assets_mrq - money_cap_mrq - coalesce(trad_asset_mrq, 0)) - (total_cur_liab_mrq - {near})"}
    return [ncwc, *yearly(e, "ncwc"), {"value": ratio("ncwc - last_ncwc - depreciation_ttm_pit", "total_assets_mrq", INDUSTRIAL)}]


@factor("quality")
def ReturnOnNOACN(e: Sql) -> Layers:
    return [{"noa": NOA}, *yearly(e, "noa"), {"value": ratio(OPT, "last_noa", INDUSTRIAL)}]


for _name, _x in (("EquityGrowthCN", "total_hldr_eqy_exc_min_int_mrq"), ("NetIncomeGrowthNIProxy", "n_income_attr_p_ttm"), ("RevenueGrowth", "revenue_ttm"), ("TotalAssetGrowth", "total_assets_mrq")):
    factor("growth", _name, n=63, x=_x)(lambda e, n, x: [{"p": e.lag(x, n)}, {"value": ratio(f"{x} - p", "abs(p)")}])


@factor("growth")
def GrowthSizeValueComposite(e: Sql) -> Layers:
    """Mean of three scores; a group's score is the mean of its scores where two of three are there."""
    parts = {"g1": "tr_yoy", "g2": "dt_netprofit_yoy", "g3": "ocf_yoy", "v1": ratio("1.0", "pe_ttm", "pe_ttm > 0"), "v2": ratio("1.0", "pb", "pb > 0"), "v3": ratio("1.0", "ps_ttm", "ps_ttm > 0"), "s1": e.pos_ln("total_mv")}

    def z(xs: list[str]) -> Layers:
        med = {f"m_{x}": e.median(x) for x in xs}
        mad = {f"d_{x}": e.median(f"abs({x} - m_{x})") for x in xs}
        w = f"{5 * 1.4826!r}"
        clip = {f"c_{x}": f"CASE WHEN d_{x} > 0 AND {x} IS NOT NULL THEN least(greatest({x}, m_{x} - {w} * d_{x}), m_{x} + {w} * d_{x}) ELSE {x} END" for x in xs}
        stat = {f"a_{x}": e.day(f"avg(c_{x})") for x in xs} | {f"s_{x}": e.day(f"stddev_pop(c_{x})") for x in xs}
        return [med, mad, clip, stat, {f"z_{x}": f"CASE WHEN s_{x} > 1e-10 THEN (c_{x} - a_{x}) / s_{x} END" for x in xs}]

    def mean(xs: list[str]) -> str:
        n = " + ".join(f"CASE WHEN z_{x} IS NOT NULL THEN 1 ELSE 0 END" for x in xs)
        return f"CASE WHEN {n} >= 2 THEN ({' + '.join(f'coalesce(z_{x}, 0)' for x in xs)}) / ({n}) END"

    group = {"gg": mean(["g1", "g2", "g3"]), "vv": mean(["v1", "v2", "v3"]), "ss": "-z_s1"}
    return [parts, *z(list(parts)), group, *z(["gg", "vv", "ss"]), {"value": "(z_gg + z_vv + z_ss) / 3.0"}]


@factor("growth", annual=True)
def BarraGrowth(e: Sql) -> Layers:
    x = {"egrlf": "forecast_eps_fy1_fy3_cagr", "egro": "slope_eps", "sgro": "slope_sales_ps"}
    return [x, *combine(e, list(x), "total_mv")]


@factor("growth", annual=True)
def BarraGrowthProxy(e: Sql) -> Layers:
    x = {"egro": "slope_eps", "sgro": "slope_sales_ps"}
    return [x, *combine(e, list(x), "total_mv")]


NET = "({0}_total_assets_mrq - {0}_money_cap_mrq - coalesce({0}_trad_asset_mrq, 0)) - ({0}_total_liab_mrq - {0}_debt)"
ACCRUAL = f"(({NET.format('a')}) - ({NET.format('b')}) - a_daa_ttm)"


@factor("quality", annual=True)
def BarraEarningsQuality(e: Sql) -> Layers:
    cash = "(n_income_attr_p_ttm - (n_cashflow_act_ttm + n_cashflow_inv_act_ttm) + coalesce(daa_ttm, depreciation_ttm_pit))"
    x = {"abs_": f"-({ratio(ACCRUAL, 'a_total_assets_mrq')})", "acf": f"-({ratio(cash, 'total_assets_mrq')})"}
    return [x, *combine(e, list(x), "total_mv")]


@factor("quality", annual=True)
def BarraEarningsQualityProxy(e: Sql) -> Layers:
    return scored(e, f"-({ratio(ACCRUAL, 'a_total_assets_mrq')})")


@factor("quality", annual=True)
def BarraEarningsVariability(e: Sql) -> Layers:
    x = {"vsal": "var_revenue_ttm", "vern": "var_n_income_attr_p_ttm", "vflo": "var_n_incr_cash_cash_equ_ttm", "etopf": ratio("forecast_eps_12m_std", "total_mv / total_share")}
    return [x, *combine(e, list(x), "total_mv")]


@factor("quality", annual=True)
def BarraEarningsVariabilityProxy(e: Sql) -> Layers:
    x = {"vsal": "var_revenue_ttm", "vern": "var_n_income_attr_p_ttm"}
    return [x, *combine(e, list(x), "total_mv")]


@factor("quality", annual=True)
def BarraInvestmentQuality(e: Sql) -> Layers:
    x = {"agro": "-slope_total_assets_mrq", "igro": "-slope_shares", "cxgro": "-slope_c_pay_acq_const_fiolta_ttm"}
    return [x, *combine(e, list(x), "total_mv")]


@factor("quality", annual=True)
def BarraProfitability(e: Sql) -> Layers:
    gp = "a_revenue_ttm - a_oper_cost_ttm"
    x = {"ato": ratio("a_revenue_ttm", "a_total_assets_mrq"), "gp": ratio(gp, "a_total_assets_mrq"), "gpm": ratio(gp, "a_revenue_ttm"), "roa": ratio("a_n_income_attr_p_ttm", "a_total_assets_mrq")}
    return [x, *combine(e, list(x), "total_mv")]


@factor("risk", annual=True)
def BarraLeverage(e: Sql) -> Layers:
    """Long-term debt against cap of the day before, against book, and all debt against assets."""
    ld, pe = "(a_total_liab_mrq - a_total_cur_liab_mrq)", "coalesce(a_oth_eqt_tools_p_shr_mrq, 0)"
    be = f"(a_total_hldr_eqy_exc_min_int_mrq - {pe})"
    x = {"mlev": ratio(f"me + {pe} + {ld}", "me"), "blev": ratio(f"{be} + {pe} + {ld}", be), "dtoa": ratio("a_total_liab_mrq", "a_total_assets_mrq")}
    return [{"me": e.lag(MCAP, 1)}, x, *combine(e, list(x), "total_mv")]


@factor("sentiment", m=21, offsets=(252, 189, 126, 63, 0))
def BarraAnalystSentiment(e: Sql, m: int, offsets: tuple) -> Layers:
    up, down = "forecast_revision_up_count", "forecast_revision_down_count"
    bucket = {f"{k}{i}": e.over(f"sum({x})", m * i + m - 1, m * i) for i in range(3) for k, x in (("u", up), ("dn", down), ("t", f"{up} + {down}"))}
    rr = {f"rr{i}": ratio(f"u{i} - dn{i}", f"t{i}") for i in range(3)}
    price = {"ep": ratio("forecast_eps_12m", "total_mv / total_share")}
    snaps = {f"{p}{k}": e.lag(x, o) if o else x for k, o in enumerate(offsets) for p, x in (("p", "ep"), ("f", "forecast_eps_12m"))}
    change = {f"{p}c{k}": ratio(f"{p}{k + 1} - {p}{k}", f"(abs({p}{k + 1}) + abs({p}{k})) / 2") for k in range(4) for p in "pf"}

    def weighted(names: list[str], w: list[int]) -> str:
        num = " + ".join(f"coalesce({x}, 0) * {k}" for x, k in zip(names, w, strict=True))
        return ratio(num, " + ".join(f"CASE WHEN {x} IS NOT NULL THEN {k} ELSE 0 END" for x, k in zip(names, w, strict=True)))

    x = {"rr": weighted(["rr2", "rr1", "rr0"], [1, 2, 3]), "etopf_c": weighted([f"pc{k}" for k in range(4)], [3, 5, 7, 9]), "epsf_c": weighted([f"fc{k}" for k in range(4)], [3, 5, 7, 9])}
    return [bucket, rr, price, snaps, change, x, *combine(e, list(x), "total_mv")]
