"""Technical, momentum, reversal, liquidity and volatility factors."""

from __future__ import annotations

from tessera.factors.spec import Layers, factor, simple
from tessera.functions.dialect import Sql, combine, standardise

E12 = "0.000000000001"

simple(
    "technical",
    {
        "HIGH0": "high / nullif(close, 0)",
        "LOW0": "low / nullif(close, 0)",
        "OPEN0": "open / nullif(close, 0)",
        "KLOW": "(least(open, close) - low) / nullif(open, 0)",
        "KLOW2": f"(least(open, close) - low) / (high - low + {E12})",
        "KMID": "(close - open) / nullif(open, 0)",
        "KMID2": f"(close - open) / (high - low + {E12})",
        "KSFT": "(2 * close - high - low) / nullif(open, 0)",
        "KSFT2": f"(2 * close - high - low) / (high - low + {E12})",
        "KUP": "(high - greatest(open, close)) / nullif(open, 0)",
        "KUP2": f"(high - greatest(open, close)) / (high - low + {E12})",
    },
)
simple("volatility", {"KLEN": "(high - low) / nullif(open, 0)"})


def surge(e: Sql, top: str, base: str, n: int, least: int) -> Layers:
    x = f"CASE WHEN {top} > 0 AND {base} > 0 AND {top} >= {base} THEN ln({top} / {base}) END"
    return [{"x": x}, {"value": f"CASE WHEN {e.over('count(x)', n - 1)} >= {least} THEN {e.over('avg(x)', n - 1)} END"}]


@factor("technical", n=10, least=5)
def DipRebound10(e: Sql, n: int, least: int) -> Layers:
    return surge(e, "close", "low", n, least)


@factor("technical", n=10, least=5)
def OpenHighSurge10(e: Sql, n: int, least: int) -> Layers:
    return surge(e, "high", "open", n, least)


@factor("technical", n=20)
def IMAX(e: Sql, n: int) -> Layers:
    return [{"value": f"CAST({e.first_max('high', n - 1)} - pos + {n} AS DOUBLE) / {n}"}]


@factor("technical", n=20)
def IMIN(e: Sql, n: int) -> Layers:
    return [{"value": f"CAST({e.first_min('low', n - 1)} - pos + {n} AS DOUBLE) / {n}"}]


@factor("technical", n=20)
def IMXD(e: Sql, n: int) -> Layers:
    return [{"value": f"CAST({e.first_max('high', n - 1)} - {e.first_min('low', n - 1)} AS DOUBLE) / {n}"}]


@factor("technical", n=20)
def MAX(e: Sql, n: int) -> Layers:
    return [{"value": e.div(e.over("max(high)", n - 1), "close")}]


@factor("technical", n=20)
def MIN(e: Sql, n: int) -> Layers:
    return [{"value": e.div(e.over("min(low)", n - 1), "close")}]


@factor("technical", n=20)
def QTLD(e: Sql, n: int) -> Layers:
    return [{"value": e.div(e.quantile("close", 0.2, n - 1), "close")}]


@factor("technical", n=20)
def QTLU(e: Sql, n: int) -> Layers:
    return [{"value": e.div(e.quantile("close", 0.8, n - 1), "close")}]


@factor("technical", n=20)
def RANK(e: Sql, n: int) -> Layers:
    return [{"value": e.pct_rank("close", n - 1)}]


@factor("technical", n=20)
def RSQR(e: Sql, n: int) -> Layers:
    sd = e.over("stddev_samp(close)", n - 1)
    return [{"value": f"CASE WHEN {sd} > 0.00002 THEN {e.over('regr_r2(close, pos)', n - 1)} END"}]


@factor("technical", n=20)
def RSV(e: Sql, n: int) -> Layers:
    lo, hi = e.over("min(low)", n - 1), e.over("max(high)", n - 1)
    return [{"value": f"(close - {lo}) / ({hi} - {lo} + {E12})"}]


@factor("technical")
def VWAP0(e: Sql) -> Layers:
    # The panel's adjusted prices are raw ones; ``pre_close + change`` is the raw close.
    raw = {"raw": "close", "implied": e.div("total_mv * 100", "total_share")}
    return [raw, {"value": f"CASE WHEN raw > 0 AND (implied IS NULL OR abs(raw - implied) <= 0.011) THEN {e.div(e.div('amount * 10', 'vol'), 'raw')} END"}]


@factor("momentum", n=20)
def BETA(e: Sql, n: int) -> Layers:
    return [{"value": e.div(e.regr("slope", "close", "pos", n - 1), "close")}]


def diffs(e: Sql, x: str) -> dict[str, str]:
    return {"d": f"{x} - {e.lag(x, 1)}"}


def share(e: Sql, up: str, n: int) -> str:
    return e.over(f"avg(CASE WHEN d IS NOT NULL THEN CASE WHEN {up} THEN 1.0 ELSE 0.0 END END)", n - 1)


@factor("momentum", n=20)
def CNTP(e: Sql, n: int) -> Layers:
    return [diffs(e, "close"), {"value": share(e, "d > 0", n)}]


@factor("momentum", n=20)
def CNTN(e: Sql, n: int) -> Layers:
    return [diffs(e, "close"), {"value": share(e, "d < 0", n)}]


@factor("momentum", n=20)
def CNTD(e: Sql, n: int) -> Layers:
    return [diffs(e, "close"), {"value": f"{share(e, 'd > 0', n)} - {share(e, 'd < 0', n)}"}]


def moved(e: Sql, x: str, what: str, n: int) -> Layers:
    part = {"up": "greatest(d, 0.0)", "down": "greatest(-d, 0.0)", "net": "d"}[what]
    total, some = e.over("sum(abs(d))", n - 1), e.over(f"sum(CASE WHEN d IS NOT NULL THEN {part} END)", n - 1)
    return [diffs(e, x), {"value": f"coalesce({some}, 0.0) / (coalesce({total}, 0.0) + {E12})"}]


for _name, _what in (("P", "up"), ("N", "down"), ("D", "net")):
    factor("momentum", f"SUM{_name}", n=20, what=_what)(lambda e, n, what: moved(e, "close", what, n))
    factor("liquidity", f"VSUM{_name}", n=20, what=_what)(lambda e, n, what: moved(e, "vol", what, n))


def blocks(e: Sql, length: int, count: int, step: int = 21) -> Layers:
    """Sum of the first ``count`` block returns of ``step`` days from t - length on; all are needed."""
    lags = {f"p{i}": e.lag("close", length - step * i) if length > step * i else "close" for i in range(count + 1)}
    return [lags, {"value": " + ".join(f"({e.div(f'p{i + 1}', f'p{i}')} - 1)" for i in range(count))}]


@factor("momentum", length=252)
def IntermediateMomentum(e: Sql, length: int) -> Layers:
    return blocks(e, length, length // 42)


@factor("reversal", length=756)
def LongTermReversal(e: Sql, length: int) -> Layers:
    return blocks(e, length, length * 2 // 63)


@factor("momentum", weeks=52, n=260)
def PriceRelative52WeekHigh(e: Sql, weeks: int, n: int) -> Layers:
    """The close over the highest of the last ``weeks`` weekly closes within ``n`` days back; the running week counts as it stands."""
    ign = "last_value(close IGNORE NULLS)" if e.duck else "last(close, true)"
    week = {"wk": e.week("trade_date")}
    # The close of each week, on its last day with one; and the running close of the week of a row.
    ends = {"endpos": "max(CASE WHEN close IS NOT NULL THEN pos END) OVER (PARTITION BY ts_code, wk)", "running": f"{ign} OVER (PARTITION BY ts_code, wk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}
    closes = {"wc": "CASE WHEN pos = endpos THEN close END"}
    before = {"w0": "count(wc) OVER (PARTITION BY ts_code ORDER BY wk RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "near": f"{e.over('count(wc)', n)} - CASE WHEN pos = endpos THEN 1 ELSE 0 END"}
    high = {"h": f"max(wc) OVER (PARTITION BY ts_code ORDER BY w0 RANGE BETWEEN {weeks - 1} PRECEDING AND 1 PRECEDING)"}
    return [week, ends, closes, before, high, {"value": f"CASE WHEN running IS NOT NULL AND near >= {weeks - 1} AND close IS NOT NULL THEN {e.div('close', 'greatest(h, running)')} END"}]


@factor("momentum", n=252, skip=22)
def STM(e: Sql, n: int, skip: int) -> Layers:
    r = {"r": f"CASE WHEN close > 0 AND {e.lag('close', 1)} > 0 THEN ln(close / {e.lag('close', 1)}) END"}
    return [r, {"value": f"CASE WHEN pos > {n} THEN coalesce({e.over('sum(r)', n - 1, skip)}, 0.0) END"}]


@factor("momentum", years=5, year=252, month=21)
def BarraSeasonality(e: Sql, years: int, year: int, month: int) -> Layers:
    ign = "IGNORE NULLS" if e.duck else ""
    first = lambda y: e.over(f"first_value(close {ign})" if e.duck else "first(close, true)", year * y, year * y - month)
    last = lambda y: e.over(f"last_value(close {ign})" if e.duck else "last(close, true)", year * y, year * y - month)
    r = {f"r{y}": f"{e.div(last(y), first(y))} - 1" for y in range(1, years + 1)}
    return [r, {"x": "(" + " + ".join(r) + f") / {float(years)}"}, *standardise(e, ["x"], "total_mv"), {"value": "z_x"}]


def log_returns(e: Sql) -> Layers:
    """Log return ``lr``, simple return ``sr``, index return ``mr``, daily risk-free ``rf``."""
    lag, ilag = e.lag("close", 1), e.lag("index_close", 1)
    return [
        {"lc": lag, "li": ilag, "rf": "gc001_weight / 100 / 365"},
        {"lr": "CASE WHEN close > 0 AND lc > 0 THEN ln(close / lc) END", "sr": "close / nullif(lc, 0) - 1", "mr": "index_close / nullif(li, 0) - 1"},
        {"xs": "sr - rf", "xm": "mr - rf", "rel": "lr - ln(1 + rf)"},
    ]


@factor("momentum", n=126, hl=21, least=63, lags=(3, 4, 5))
def BarraIndustryMomentum(e: Sql, n: int, hl: float, least: int, lags: tuple) -> Layers:
    """Industry strength without the stock's own share, by square root of cap, averaged over lags."""
    sums, s = e.ewm_sum("ew", "lr", n, hl, least)
    s = {"s": s, "w": "CASE WHEN circ_mv > 0 THEN sqrt(circ_mv) END"}
    ind = "OVER (PARTITION BY pos, sw_l1_industry)"
    tot = {"sw": f"sum(CASE WHEN s IS NOT NULL THEN w END) {ind}", "ss": f"sum(s * w) {ind}"}
    strength = {"st": f"-(coalesce(s * w, 0) / nullif(sw, 0)) * s + {e.div('ss', 'sw')}"}
    mean = {"x": "(" + " + ".join(e.lag("st", k) for k in lags) + f") / {float(len(lags))}"}
    return [*log_returns(e), *sums, s, tot, strength, mean, *standardise(e, ["x"], "total_mv"), {"value": "z_x"}]


@factor("momentum", n=252, hl=126, least=126, lags=(11, 21), an=252, ahl=63, aleast=126)
def BarraMomentum(e: Sql, n: int, hl: float, least: int, lags: tuple, an: int, ahl: float, aleast: int) -> Layers:
    (sums, strength), (moments, fit) = e.ewm_sum("ew", "rel", n, hl, least), e.ewm_wls("ls", "xs", "xm", an, ahl, aleast)
    return [*log_returns(e), *sums, *moments, {"s": strength, "halpha": fit["alpha"]}, {"rstr": e.over("avg(s)", lags[1], lags[0])}, *combine(e, ["rstr", "halpha"], "total_mv")]


@factor("reversal", n=1040, hl=260, least=520, lags=(273, 283))
def BarraLongTermReversal(e: Sql, n: int, hl: float, least: int, lags: tuple) -> Layers:
    (sums, strength), (moments, fit) = e.ewm_sum("ew", "rel", n, hl, least), e.ewm_wls("ls", "xs", "xm", n, hl, least)
    back = {"ltrstr": f"-({e.over('avg(s)', lags[1], lags[0])})", "lthalpha": f"-({e.over('avg(a)', lags[1], lags[0])})"}
    return [*log_returns(e), *sums, *moments, {"s": strength, "a": fit["alpha"]}, back, *combine(e, ["ltrstr", "lthalpha"], "total_mv")]


@factor("reversal", n=21, hl=5)
def BarraShortTermReversal(e: Sql, n: int, hl: float) -> Layers:
    sums, x = e.ewm_sum("ew", "lr", n, hl, n)
    return [*log_returns(e), *sums, {"x": x}, *standardise(e, ["x"], "total_mv"), {"value": "z_x"}]


@factor("reversal", n=20)
def MA(e: Sql, n: int) -> Layers:
    return [{"value": e.div(e.over("avg(close)", n - 1), "close")}]


@factor("reversal", n=20)
def RESI(e: Sql, n: int) -> Layers:
    fit = f"({e.regr('intercept', 'close', 'pos', n - 1)} + {e.regr('slope', 'close', 'pos', n - 1)} * pos)"
    return [{"value": e.div(f"close - {fit}", "close")}]


@factor("reversal", n=20)
def ROC(e: Sql, n: int) -> Layers:
    return [{"value": e.div(e.lag("close", n), "close")}]


@factor("reversal", n=60)
def Reversal3M(e: Sql, n: int) -> Layers:
    return [{"value": f"CASE WHEN {e.lag('close', n)} > 0 THEN -(close / {e.lag('close', n)} - 1) END"}]


@factor("reversal", n=21)
def ShortTermReversal(e: Sql, n: int) -> Layers:
    return [{"value": f"{e.div('close', e.lag('close', n))} - 1"}]


@factor("reversal", n=20, least=5)
def SLPReversal(e: Sql, n: int, least: int) -> Layers:
    at = {"pm": e.first_max("close", n - 1), "pn": e.first_min("close", n - 1), "hi": e.over("max(close)", n - 1), "lo": e.over("min(close)", n - 1), "k": e.over("count(close)", n - 1)}
    late = {"pe": "greatest(pm, pn)", "ce": "CASE WHEN pm >= pn THEN hi ELSE lo END"}
    slope = f"-({e.div('close - ce', 'pos - pe')})"
    return [at, late, {"value": f"CASE WHEN k >= {least} AND close IS NOT NULL THEN CASE WHEN pe = pos THEN 0.0 ELSE {slope} END END"}]


@factor("liquidity", m=21, n=252, hl=63)
def BarraLiquidity(e: Sql, m: int, n: int, hl: float) -> Layers:
    half = m // 2 + 1
    t = {"t": "turnover_rate_f / 100"}
    month = {f"s{i}": f"CASE WHEN {e.over('count(t)', m * i + m - 1, m * i)} >= {half} THEN {e.over('sum(t)', m * i + m - 1, m * i)} END" for i in range(12)}
    mean = lambda k: "(" + " + ".join(f"s{i}" for i in range(k)) + f") / {float(k)}"
    sums, atvr = e.ewm_sum("ew", "t", n, hl, n // 2)
    x = {"stom": e.pos_ln("s0"), "stoq": e.pos_ln(mean(3)), "stoa": e.pos_ln(mean(12)), "atvr": atvr}
    return [t, month, *sums, x, *combine(e, ["stom", "stoq", "stoa", "atvr"], "total_mv")]


@factor("liquidity", n=20)
def CORD(e: Sql, n: int) -> Layers:
    return [{"a": e.div("close", e.lag("close", 1)), "b": f"ln({e.div('vol', e.lag('vol', 1))} + 1)"}, {"value": e.corr("a", "b", n - 1)}]


@factor("liquidity", n=20)
def CORR(e: Sql, n: int) -> Layers:
    return [{"b": "ln(vol + 1)"}, {"value": e.corr("close", "b", n - 1)}]


@factor("liquidity", n=21)
def Turnover(e: Sql, n: int) -> Layers:
    return [{"value": e.div(f"{e.over('sum(vol)', n - 1)} * 100", "CASE WHEN close IS NOT NULL THEN total_share * 10000 END")}]


@factor("liquidity", n=20, least=15)
def TurnoverCV(e: Sql, n: int, least: int) -> Layers:
    mean = e.over("avg(t)", n - 1)
    return [{"t": e.div("vol * 100", "total_share * 10000")}, {"value": f"CASE WHEN {e.over('count(t)', n - 1)} >= {least} AND {mean} > 0 THEN {e.over('stddev_samp(t)', n - 1)} / {mean} END"}]


@factor("liquidity", half=21)
def UnexplainedVolume(e: Sql, half: int) -> Layers:
    r = {"ar": f"abs({e.div('close', e.lag('close', 1))} - 1)"}
    fit = {"b": e.regr("slope", "vol", "ar", 2 * half - 1, half), "a": e.regr("intercept", "vol", "ar", 2 * half - 1, half)}
    both = "CASE WHEN vol IS NOT NULL AND ar IS NOT NULL THEN {} END"
    now = {"mv": e.over(f"avg({both.format('vol')})", half - 1), "mr": e.over(f"avg({both.format('ar')})", half - 1)}
    return [r, fit, now, {"value": "mv - a - b * mr"}]


@factor("liquidity", n=20)
def VMA(e: Sql, n: int) -> Layers:
    return [{"value": f"{e.over('avg(vol)', n - 1)} / (vol + {E12})"}]


@factor("liquidity", n=20)
def VSTD(e: Sql, n: int) -> Layers:
    return [{"value": f"{e.over('stddev_samp(vol)', n - 1)} / (vol + {E12})"}]


@factor("liquidity", n=10)
def VolumePriceCorr(e: Sql, n: int) -> Layers:
    return [{"t": e.div("vol", "total_share")}, {"value": e.corr("close", "t", n - 1, least=n)}]


@factor("volatility", n=252, hl=63, least=126)
def BarraBeta(e: Sql, n: int, hl: float, least: int) -> Layers:
    moments, fit = e.ewm_wls("ls", "xs", "xm", n, hl, least)
    return [*log_returns(e), *moments, {"x": fit["beta"]}, *standardise(e, ["x"], "total_mv"), {"value": "z_x"}]


@factor("volatility", n=252, hl=63, shl=42, least=126, m=21)
def BarraResidualVolatility(e: Sql, n: int, hl: float, shl: float, least: int, m: int) -> Layers:
    (moments, fit), (sums, dastd) = e.ewm_wls("ls", "xs", "xm", n, hl, least), e.ewm_std("ew", "xs", n, shl, least)
    x = {"hsigma": fit["sigma"], "dastd": dastd}
    x |= {f"z{i}": f"CASE WHEN {e.over('count(rel)', m * i - 1)} >= {-(-m * i * 8 // 10)} THEN {e.over('sum(rel)', m * i - 1)} END" for i in range(1, 13)}
    z = [f"z{i}" for i in range(1, 13)]
    valid = " + ".join(f"CASE WHEN {v} IS NOT NULL THEN 1 ELSE 0 END" for v in z)
    cmra = {"cmra": f"CASE WHEN {valid} >= 10 THEN greatest({', '.join(z)}) - least({', '.join(z)}) END"}
    return [*log_returns(e), *moments, *sums, x, cmra, *combine(e, ["hsigma", "dastd", "cmra"], "total_mv")]


def spread(e: Sql, n: int, *xs: str) -> Layers:
    least = -(-n * 8 // 10)
    ok = "close > 0 AND vol > 0"
    lc = {"lc": e.lag(f"CASE WHEN {ok} THEN close END", 1)}
    r = {f"r_{x}": f"CASE WHEN {ok} THEN {x} / nullif(lc, 0) - 1 END" for x in xs}
    sd = [f"CASE WHEN {e.over(f'count(r_{x})', n - 1)} >= {least} THEN {e.over(f'stddev_samp(r_{x})', n - 1)} END" for x in xs]
    return [lc, r, {"value": " - ".join(f"({s})" for s in sd)}]


@factor("volatility", n=84)
def HighLowReturnVolatilitySpread(e: Sql, n: int) -> Layers:
    return spread(e, n, "high", "low")


@factor("volatility", n=84)
def HighReturnVolatility(e: Sql, n: int) -> Layers:
    return spread(e, n, "high")


@factor("volatility", n=84)
def ReturnVolatility(e: Sql, n: int) -> Layers:
    return spread(e, n, "close")


@factor("volatility", n=21, top=5)
def MaxDailyReturn5(e: Sql, n: int, top: int) -> Layers:
    return [{"r": f"{e.div('close', e.lag('close', 1))} - 1"}, {"value": e.top_mean("r", top, n - 1)}]


@factor("volatility", n=20)
def STD(e: Sql, n: int) -> Layers:
    return [{"value": e.div(e.over("stddev_samp(close)", n - 1), "close")}]


@factor("volatility", n=20)
def WVMA(e: Sql, n: int) -> Layers:
    x = {"x": f"abs({e.div('close', e.lag('close', 1))} - 1) * vol"}
    return [x, {"value": f"{e.over('stddev_samp(x)', n - 1)} / ({e.over('avg(x)', n - 1)} + {E12})"}]


@factor("risk", n=252, long=1260)
def MarketBetaCN(e: Sql, n: int, long: int) -> Layers:
    three = {"s3": f"(1 + sr) * (1 + {e.lag('sr', 1)}) * (1 + {e.lag('sr', 2)}) - 1", "m3": f"(1 + mr) * (1 + {e.lag('mr', 1)}) * (1 + {e.lag('mr', 2)}) - 1"}
    ratio = e.div(e.over("stddev_samp(s3)", long - 1), e.over("stddev_samp(CASE WHEN s3 IS NOT NULL THEN m3 END)", long - 1))
    return [*log_returns(e), three, {"value": f"{e.corr('xs', 'xm', n - 1)} * {ratio}"}]


@factor("volatility", needs="ff3", n=21, least=15)
def FF3IdiosyncraticVolatilityCN(e: Sql, n: int, least: int) -> Layers:
    """Standard deviation of the residuals of a regression on the panel's three factors ``mkt, smb, hml`` (``portfolios.three_factors``).

    The regressors are made orthogonal one after the other within the window, so the residual sum of squares is what the
    successive projections leave; only window moments are needed.
    """
    ok = "CASE WHEN sr IS NOT NULL AND rf IS NOT NULL AND mkt IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL THEN {} END"
    v = {"y": "sr - rf", "a": "mkt", "b": "smb", "c": "hml"}
    paired = {k: ok.format(x) for k, x in v.items()}
    pairs = [p + q for i, p in enumerate("abcy") for q in "abcy"[i:]]
    cov = {f"v_{p}": e.over(f"covar_samp({p[0]}, {p[1]})", n - 1) for p in pairs} | {"k": e.over("count(y)", n - 1)}
    b1 = {"bb": "v_bb - v_ab * v_ab / nullif(v_aa, 0)", "bc": "v_bc - v_ab * v_ac / nullif(v_aa, 0)", "cc1": "v_cc - v_ac * v_ac / nullif(v_aa, 0)", "yb": "v_by - v_ab * v_ay / nullif(v_aa, 0)", "yc1": "v_cy - v_ac * v_ay / nullif(v_aa, 0)", "yy1": "v_yy - v_ay * v_ay / nullif(v_aa, 0)"}
    b2 = {"cc": "cc1 - bc * bc / nullif(bb, 0)", "yc": "yc1 - bc * yb / nullif(bb, 0)", "yy2": "yy1 - yb * yb / nullif(bb, 0)"}
    return [*log_returns(e), paired, cov, b1, b2, {"value": f"CASE WHEN k >= {least} AND v_aa > 1e-14 AND bb > 1e-14 AND cc > 1e-14 THEN sqrt(greatest(0.0, yy2 - yc * yc / cc)) END"}]
