"""Factors at their default windows on a daily panel of 1,400 days, against numpy that knows nothing of their layers."""

import numpy as np
import pytest

from tessera.factors import price  # noqa: F401
from tessera.factors.spec import compute
from tessera.functions.dialect import Sql
from tessera.factors.spec import doubles
from pyspark.sql import functions as F

DAYS, STOCKS = 1400, 6


def series(start=0):
    rng = np.random.default_rng(7)
    r = rng.normal(0, 0.02, (DAYS, STOCKS)) + rng.normal(0, 0.01, DAYS)[:, None]
    close = np.round(20 * np.exp(np.cumsum(r, axis=0)), 2)
    close[rng.random((DAYS, STOCKS)) < 0.01] = np.nan
    vol = np.round(rng.lognormal(8, 0.5, (DAYS, STOCKS)))
    index = np.round(1000 * np.exp(np.cumsum(rng.normal(0, 0.01, DAYS))), 2)
    return close, vol, index


@pytest.fixture(scope="module")
def daily(spark):
    import pandas as pd

    close, vol, index = series()
    rows = [(f"s{j}", i + 5_000, close[i, j], vol[i, j], index[i]) for i in range(DAYS) for j in range(STOCKS) if not np.isnan(close[i, j])]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ts_code", "pos", "close", "vol", "index_close"]))
    more = {"total_share": F.lit(1000.0), "total_mv": F.col("close") * 1000, "circ_mv": F.col("close") * 500, "open": F.col("close"), "high": F.col("close") * 1.01, "low": F.col("close") * 0.99, "gc001_weight": F.lit(2.0), "turnover_rate_f": F.col("vol") / 1000, "sw_l1_industry": F.lit("a"), "amount": F.col("vol") * F.col("close"), "trade_date": F.date_add(F.lit("2000-01-03").cast("date"), (F.col("pos") - 5000).cast("int"))}
    return df.withColumns(more).repartition(4, "ts_code").cache()


def returns(x):
    return np.concatenate([np.full((1, *x.shape[1:]), np.nan), x[1:] / x[:-1] - 1])


def weights(n, hl):
    return 0.5 ** (np.arange(n)[::-1] / hl)


def column(df, expression, layers):
    for layer in layers:
        df = df.withColumns({k: F.expr(doubles(v)) for k, v in layer.items()})
    return {(r.ts_code, r.pos - 5_000): r.x for r in df.select("ts_code", "pos", F.expr(doubles(expression)).alias("x")).collect()}


@pytest.mark.parametrize("n, hl, least", [(252, 63, 126), (1040, 260, 520), (21, 5, 21)])
def test_exponential_windows(daily, n, hl, least):
    close, _, index = series()
    sr, mr, rf = returns(close), returns(index), 2.0 / 100 / 365
    xs, xm = sr - rf, mr - rf
    e = Sql()
    sums, total = e.ewm_sum("ew", "xs", n, hl, least)
    deviations, std = e.ewm_std("sd", "xs", n, hl, least)
    moments, fit = e.ewm_wls("ls", "xs", "xm", n, hl, least)
    layers = [*price.log_returns(e), *sums, *deviations, *moments]
    got = column(daily, f"struct({total} AS total, {std} AS std, {fit['beta']} AS beta, {fit['alpha']} AS alpha, {fit['sigma']} AS sigma)", layers)
    seen = 0
    for (code, t), x in got.items():
        if t % 7:
            continue
        a = max(0, t - n + 1)
        y, m, w = xs[a : t + 1, int(code[1:])], xm[a : t + 1], weights(n, hl)[-(t + 1 - a) :]
        ok = ~np.isnan(y)
        if ok.sum() < least:
            assert x.total is None and x.std is None and x.beta is None
            continue
        seen += 1
        assert x.total == pytest.approx((y[ok] * w[ok]).sum() / weights(n, hl).sum(), abs=1e-10)
        mean = np.average(y[ok], weights=w[ok])
        assert x.std == pytest.approx(np.sqrt(np.average((y[ok] - mean) ** 2, weights=w[ok])), rel=1e-7)
        both = ok & ~np.isnan(m)
        d = np.column_stack([np.ones(both.sum()), m[both]]) * np.sqrt(w[both])[:, None]
        alpha, beta = np.linalg.lstsq(d, y[both] * np.sqrt(w[both]), rcond=None)[0]
        assert (x.alpha, x.beta) == (pytest.approx(alpha, abs=1e-9), pytest.approx(beta, rel=1e-6))
        rest = y[both] - alpha - beta * m[both]
        assert x.sigma == pytest.approx(np.sqrt(np.average((rest - np.average(rest, weights=w[both])) ** 2, weights=w[both])), rel=1e-6)
    assert seen > 300


def values(daily, name, **params):
    return {(r.ts_code, r.pos - 5_000): r.value for r in compute(daily, name, **params).collect()}


def window(x, t, n):
    return x[max(0, t - n + 1) : t + 1]


def day_lag(x, t, k):
    return x[t - k] if t >= k else np.nan


FORMULAS = {
    "MA": lambda c, v, t: np.nanmean(window(c, t, 20)) / c[t],
    "STD": lambda c, v, t: np.nanstd(window(c, t, 20), ddof=1) / c[t],
    "ROC": lambda c, v, t: day_lag(c, t, 20) / c[t],
    "MAX": lambda c, v, t: np.nanmax(window(c * 1.01, t, 20)) / c[t],
    "MIN": lambda c, v, t: np.nanmin(window(c * 0.99, t, 20)) / c[t],
    "QTLU": lambda c, v, t: np.nanquantile(window(c, t, 20), 0.8) / c[t],
    "QTLD": lambda c, v, t: np.nanquantile(window(c, t, 20), 0.2) / c[t],
    "RANK": lambda c, v, t: ((window(c, t, 20) < c[t]).sum() + ((window(c, t, 20) == c[t]).sum() + 1) / 2) / (~np.isnan(window(c, t, 20))).sum(),
    "RSV": lambda c, v, t: (c[t] - np.nanmin(window(c * 0.99, t, 20))) / (np.nanmax(window(c * 1.01, t, 20)) - np.nanmin(window(c * 0.99, t, 20))),
    "VMA": lambda c, v, t: np.nanmean(window(v, t, 20)) / v[t],
    "VSTD": lambda c, v, t: np.nanstd(window(v, t, 20), ddof=1) / v[t],
    "ShortTermReversal": lambda c, v, t: c[t] / day_lag(c, t, 21) - 1,
    "Reversal3M": lambda c, v, t: -(c[t] / day_lag(c, t, 60) - 1),
    "IntermediateMomentum": lambda c, v, t: sum(day_lag(c, t, 252 - 21 * (i + 1)) / day_lag(c, t, 252 - 21 * i) - 1 for i in range(6)) if t >= 252 else np.nan,
}


@pytest.mark.parametrize("name", sorted(FORMULAS))
def test_formula(daily, name):
    close, vol, _ = series()
    vol = np.where(np.isnan(close), np.nan, vol)
    got, seen = values(daily, name), 0
    for (code, t), x in got.items():
        if t >= 25 and t % 5 == 0:
            want = FORMULAS[name](close[:, int(code[1:])], vol[:, int(code[1:])], t)
            if np.isnan(want):
                assert x is None
            else:
                seen += 1
                assert x == pytest.approx(want, rel=1e-8, abs=1e-6)
    assert seen > 500
