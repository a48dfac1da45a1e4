import datetime
import math

import numpy as np
import pandas as pd
import pytest

from tessera.factors.spec import REGISTRY, compute
from tessera.operators import crosssec, evaluate, joins, pit, portfolios, quality
from tessera.plans import queries


def d(s):
    return datetime.date(int(s[:4]), int(s[4:6]), int(s[6:]))


def test_asof_is_strict_or_not(spark):
    probes = spark.createDataFrame([("a", "20240430"), ("a", "20240501"), ("b", "20240501")], "c string, t string")
    events = spark.createDataFrame([("a", "20240430", 1.0)], "c string, e string, v double")
    got = lambda strict: {(r.c, r.t): r.v for r in joins.asof_join(probes, events, ["c"], "t", "e", ["v"], strict=strict).collect()}
    assert got(True) == {("a", "20240430"): None, ("a", "20240501"): 1.0, ("b", "20240501"): None}
    assert got(False)["a", "20240430"] == 1.0


CUMULATIVE = [(2023, 1, 8), (2023, 2, 35), (2023, 3, 72), (2023, 4, 100), (2024, 1, 10), (2024, 2, 40), (2024, 3, 80), (2024, 4, 110)]


def when(y, q):
    return d(f"{y}{ {1: '0430', 2: '0831', 3: '1031', 4: '0430'}[q] }")


@pytest.mark.parametrize("drop", [None, (2023, 1)])
def test_trailing_year(spark, drop):
    rows = [("a", y, q, when(y, q), float(v)) for y, q, v in CUMULATIVE if (y, q) != drop]
    got = pit.trailing_year(spark.createDataFrame(rows, "ts_code string, fy int, quarter int, effective date, value double")).collect()
    last = {}
    for r in sorted(got, key=lambda r: r.effective):
        last[r.fy, r.quarter] = r.ttm
    assert [last[2024, q] for q in (2, 3, 4)] == [105, 108, 110]
    assert last[2024, 1] == (None if drop else 102)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, joins.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, joins.insert_missing(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert joins.upsert(joins.upsert(old, new, ["k"]), new, ["k"]).count() == 3


def test_interval_ends_are_inclusive(spark):
    spans = joins.intervals(spark.createDataFrame([("a", d("20240101"), 1), ("a", d("20240110"), 2)], "c string, day date, g int"), ["c"], "day")
    days = spark.createDataFrame([("a", d(x)) for x in ("20231231", "20240101", "20240109", "20240110", "20250101")], "c string, t date")
    assert [r.g for r in joins.interval_join(days, spans, ["c"], "t").orderBy("t").collect()] == [None, 1, 1, 2, 2]


@pytest.mark.parametrize("n", [2, 3, 5, 10])
def test_buckets_equal_pandas(spark, n):
    rng = np.random.default_rng(n)
    frame = pd.DataFrame({"ts_code": np.tile(np.arange(57), 3), "pos": np.repeat([1, 2, 3], 57), "signal": rng.integers(0, 20, 171).astype(float)})
    frame = frame.drop(frame.index[60:75])
    got = crosssec.buckets(spark.createDataFrame(frame), n).toPandas().sort_values(["pos", "ts_code"])
    want = frame.sort_values(["pos", "ts_code"]).groupby("pos")["signal"].transform(lambda s: pd.qcut(s.rank(method="first"), n, labels=False) + 1)
    assert got["bucket"].astype(int).tolist() == want.astype(int).tolist()


def test_rank_ic_and_its_test(spark):
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"pos": np.repeat(np.arange(40), 12), "signal": rng.normal(size=480).round(1), "ret": rng.normal(size=480).round(1)})
    ic = crosssec.rank_ic(spark.createDataFrame(f))
    want = f.groupby("pos").apply(lambda g: g["signal"].rank().corr(g["ret"].rank()), include_groups=False)
    got = ic.toPandas().set_index("pos")["ic"].sort_index()
    assert np.allclose(got, want)
    s, e = evaluate.ic_statistics(ic, 5).first(), (want - want.mean()).to_numpy()
    total = (e * e).sum() + 2 * sum((1 - k / 5) * (e[k:] * e[:-k]).sum() for k in range(1, 5))
    assert s.t_hac == pytest.approx(want.mean() / math.sqrt(total / 40**2 * 40 / 39))
    assert evaluate.t_p_value(2.0, 10) == pytest.approx(0.0733880, abs=1e-6) and evaluate.t_p_value(0.0, 5) == pytest.approx(1)


def test_simulation_locks_suspended_stocks(spark):
    rows = [("a", 1, 10.0, False, 1), ("b", 1, 10.0, False, 1), ("a", 2, 10.0, False, 1), ("b", 2, 20.0, False, 1), ("a", 3, 20.0, False, 1), ("b", 3, None, True, 1), ("a", 4, 20.0, False, None), ("b", 4, 40.0, False, 1)]
    nav = portfolios.simulate(spark.createDataFrame(rows, "ts_code string, pos long, close double, suspended boolean, bucket int"), 2, 1).where("bucket = 1").orderBy("pos").collect()
    # Day 2: half in each. Day 3: a doubled, b locked at its last price. Day 4: b doubled.
    assert [round(r.nav, 6) for r in nav] == [1.0, 1.5, 2.0]


def test_contracts(spark):
    bars = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5, 1.0, 1.0), (1.0, 1.2, 0.5, 1.5, -1.0, 1.0), (None, 1.0, 1.0, 1.0, 0.0, 0.0)], "open double, high double, low double, close double, vol double, amount double")
    assert tuple(quality.bar_violations(bars).first()) == (1, 1, 1)
    assert quality.fingerprint(bars, ["open", "close"]).first() == quality.fingerprint(bars.orderBy("close"), ["open", "close"]).first()
    assert quality.duplicate_keys(bars, ["close"]).count() == 1


def toy(spark):
    rng = np.random.default_rng(7)
    f = pd.DataFrame({"ts_code": np.repeat([1, 2], 40), "pos": np.tile(np.arange(1, 41), 2), "close": rng.uniform(5, 10, 80)})
    f.loc[[5, 17, 50], "close"] = None
    return f, spark.createDataFrame(f.astype(object).where(f.notna(), None), "ts_code long, pos long, close double")


@pytest.mark.parametrize("name,fn", [("MA", lambda s: s.rolling(20, min_periods=1).mean() / s), ("ROC", lambda s: s.shift(20) / s), ("STD", lambda s: s.rolling(20, min_periods=2).std() / s), ("RANK", lambda s: s.rolling(20, min_periods=1).rank(pct=True)), ("QTLU", lambda s: s.rolling(20, min_periods=1).quantile(0.8) / s)])
def test_rolling_factors_equal_pandas(spark, name, fn):
    f, df = toy(spark)
    got = compute(df, name).toPandas().sort_values(["ts_code", "pos"])["value"].to_numpy(float)
    want = f.groupby("ts_code")["close"].transform(fn).to_numpy(float)
    assert np.allclose(got, want, equal_nan=True)


def test_no_look_ahead(spark):
    f, df = toy(spark)
    for name in ("MA", "ROC", "RSQR", "SUMP"):
        full = {(r.ts_code, r.pos): r.value for r in compute(df, name).collect()}
        part = compute(df.where("pos <= 25"), name).collect()
        assert all(full[r.ts_code, r.pos] == r.value or full[r.ts_code, r.pos] == pytest.approx(r.value) for r in part)


def test_registry_and_sql_cover_each_other():
    assert len(REGISTRY) == 123 and all(f"factor_{n}" in queries.SQL for n in REGISTRY) and "factor_TrendScore" in queries.QUERIES
