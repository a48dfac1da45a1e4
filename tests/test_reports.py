"""Consensus, the daily table, portfolios, trend scores and contracts, against small cases and plain replays."""

import datetime

import numpy as np
import pandas as pd
import pytest

from tessera.operators import consensus, contract, crosssec, evaluate, pit, portfolios


def d(s):
    return datetime.date(int(s[:4]), int(s[4:6]), int(s[6:]))


def test_daily_table_is_strict_and_continues(spark):
    market = spark.createDataFrame([("a", d(x)) for x in ("20240429", "20240430", "20240501", "20240502")], "ts_code string, trade_date date")
    active = spark.createDataFrame([("a", d("20240429"), 20240331)], "ts_code string, effective date, period int")
    income = spark.createDataFrame([("a", 20240331, d("20240430"), 11.0, "1"), ("a", 20230331, d("20240430"), 5.0, "9"), ("a", 20240331, d("20240501"), 12.0, None)], "ts_code string, period int, effective date, ebit double, comp_type string")
    balance = spark.createDataFrame([("a", 20240331, d("20240430"), 3.0, "2")], "ts_code string, period int, effective date, minority double, comp_type string")
    got = pit.daily_table(market, active, {"income": income, "balance": balance}, coalesced={"comp_type": ["income", "balance"]}).orderBy("trade_date")
    assert [(r.period, r.income_effective, r.ebit, r.minority, r.comp_type) for r in got.collect()] == [
        (None, None, None, None, None), (20240331, None, None, None, None), (20240331, d("20240430"), 11.0, 3.0, "1"), (20240331, d("20240501"), 12.0, 3.0, "2")]
    filled = pit.backfill_exact(got.drop("ebit"), {"income": income}, {"income": ["ebit"]}).orderBy("trade_date")
    assert [r.ebit for r in filled.collect()] == [None, None, 11.0, 12.0]
    assert pit.key_state(got, market) == d("20240502")
    with pytest.raises(ValueError, match="missing"):
        pit.key_state(got.where("trade_date <> DATE '2024-04-30'"), market)
    with pytest.raises(ValueError, match="empty"):
        pit.key_state(got.limit(0), market)


def test_consensus_of_two_organisations(spark):
    schema = "ts_code string, org_name string, report_date date, create_time timestamp, report_title string, author_name string, quarter string, np string, eps string, rd double"
    rows = [("s", o, d(day), None, "t", "x", q, "100", eps, 1.0) for o, day, q, eps in [
        ("A", "20231201", "2023Q4", "1.0"), ("A", "20231201", "2024Q4", "2.0"), ("A", "20231201", "2025Q4", "4.0"),
        ("A", "20240103", "2024Q4", "3.0"), ("A", "20240103", "2025Q4", "4.0"), ("A", "20240103", "2026Q4", "12.0"), ("B", "20240104", "2024Q4", "5.0"), ("B", "20240104", "2025Q4", "bad"), ("B", "20240104", "2024Q3", "9"), ("", "20240104", "2024Q4", "9")]]
    days = spark.createDataFrame([(d(x),) for x in ("20240102", "20240105")], "trade_date date")
    got = {r.trade_date: r for r in consensus.consensus(spark.createDataFrame(rows, schema), days).collect()}
    first, second = got[d("20240102")], got[d("20240105")]
    w = 365 / 366
    assert first.eps == pytest.approx(w * 2 + (1 - w) * 4) and first.cagr is None and (first.up, first.down, first.total) == (0, 0, 0)
    w = 362 / 366
    assert second.eps == pytest.approx(w * 3 + (1 - w) * 4) and second.eps_std is None and second.cagr == pytest.approx(1.0)
    assert (second.up, second.down, second.total) == (1, 0, 1)  # B's blend is not known
    assert consensus.consensus(spark.createDataFrame([], schema), days).count() == 0


def replay(prices, groups, rebalance):
    """Day by day with plain dictionaries."""
    days = sorted({p for _, p, *_ in prices})
    at = {(c, p): (x, stop, b) for c, p, x, stop, b in prices}
    codes = sorted({c for c, *_ in prices})
    out = {}
    for g in range(1, groups + 1):
        cash, held, last, todo = 1.0, {}, {}, None
        for i, day in enumerate(days):
            for c in codes:
                if at.get((c, day), (None,))[0] is not None:
                    last[c] = at[c, day][0]
            if i:
                worth = cash + sum(n * last[c] for c, n in held.items())
                traded = 0.0
                if todo is not None:
                    stays = {c: n for c, n in held.items() if at[c, day][1]}
                    free = worth - sum(n * last[c] for c, n in stays.items())
                    buy = [c for c in todo if c not in stays]
                    after, cash = dict(stays), free
                    for c in buy:
                        if not at[c, day][1] and free > 1e-12:
                            after[c] = free / len(buy) / last[c]
                            cash -= free / len(buy)
                    traded = sum(abs(after.get(c, 0) - held.get(c, 0)) * last[c] for c in {*after, *held})
                    held = after
                out[g, day] = (worth, traded / worth)
                todo = None
            if i % rebalance == 0 and any(at.get((c, day), (0, 0, None))[2] for c in codes):
                todo = [c for c in codes if at.get((c, day), (0, 0, None))[2] == g]
    return out


def test_net_values_against_a_replay(spark):
    rng = np.random.default_rng(3)
    prices, last = [], {}
    for p in range(1, 25):
        order = rng.permutation(9)
        for c in range(9):
            last[c] = round(float(last.get(c, 10) * np.exp(rng.normal(0, 0.05))), 2)
            stop = bool(p > 2 and rng.random() < 0.25)
            prices.append((f"s{c}", p, None if stop and rng.random() < 0.5 else last[c], stop, None if p in (9, 10) else int(order[c] % 3 + 1)))
    df = spark.createDataFrame(prices, "ts_code string, pos long, close double, suspended boolean, bucket int")
    for every in (1, 4):
        want = replay(prices, 3, every)
        got = {(r.bucket, r.pos): (r.nav, r.turnover) for r in portfolios.simulate(df, 3, every).collect()}
        assert got.keys() == want.keys()
        for k, (nav, turnover) in want.items():
            assert got[k] == (pytest.approx(nav, rel=1e-9), pytest.approx(turnover, abs=1e-9)), k
    # A held stock that is not suspended must have a price.
    with pytest.raises(Exception, match="no price"):
        portfolios.simulate(df.withColumn("close", __import__("pyspark").sql.functions.expr("CASE WHEN pos <> 8 THEN close END")), 3, 4).collect()
    for bad in ((1, 4), (3, 0), (True, 4)):
        with pytest.raises(ValueError):
            portfolios.simulate(df, *bad)


def test_trend_score_against_numpy(spark):
    rng = np.random.default_rng(5)
    days, stocks = 412, 120
    close = np.exp(np.cumsum(rng.normal(0, 0.02, (days, stocks)), axis=0)) * 10
    vol = rng.lognormal(5, 0.4, (days, stocks))
    close[100, 3] = np.nan
    vol[300, 4] = 0
    rows = pd.DataFrame({"ts_code": np.tile([f"s{j}" for j in range(stocks)], days), "pos": np.repeat(np.arange(1, days + 1), stocks), "close": close.ravel(), "vol": vol.ravel()})
    got = {(r.ts_code, r.pos): r.value for r in crosssec.trend_scores(spark.createDataFrame(rows.dropna()).repartition(4)).collect() if r.pos >= 404}

    def features(t):
        out = []
        for x in (np.where(close > 0, close, np.nan), np.where(vol > 0, vol, np.nan)):
            out += [x[t - k + 1 : t + 1].mean(axis=0) / x[t] if t + 1 >= k else np.full(stocks, np.nan) for k in crosssec.TREND_WINDOWS]
        return np.array(out).T

    for t in (404, 405, 411):
        x, y = features(t - 6), close[t] / close[t - 5] - 1
        ok = np.isfinite(x).all(axis=1) & np.isfinite(y)
        now = features(t)
        if ok.sum() < 100:
            assert all(got[f"s{j}", t + 1] is None for j in range(stocks))
            continue
        beta = np.linalg.lstsq(np.column_stack([np.ones(ok.sum()), x[ok]]), y[ok], rcond=None)[0]
        for j in range(stocks):
            want = now[j] @ beta[1:]
            assert got[f"s{j}", t + 1] == pytest.approx(want, rel=1e-5, abs=1e-7) if np.isfinite(want) else got[f"s{j}", t + 1] is None
    assert sum(v is not None for v in got.values()) > 500


def test_contracts(spark):
    days = spark.createDataFrame([(d("20240101") + datetime.timedelta(k),) for k in range(0, 200) if k % 7 < 5], "trade_date date")
    assert contract.window_start(days, d("20240112"), "5D") == d("20240105")
    assert contract.window_start(days, d("20240531"), "3M") == d("20240229")
    for at, window in ((d("20240106"), "5D"), (d("20240103"), "5D"), (d("20240531"), "1Y"), (d("20240112"), "0D"), (d("20240112"), "5W"), (d("20240112"), "D")):
        with pytest.raises(ValueError):
            contract.window_start(days, at, window)
    assert contract.forward_days(days, d("20240112"), 2) == [d("20240115"), d("20240116"), d("20240117")]
    with pytest.raises(ValueError):
        contract.forward_days(days, d("20240716"), 5)
    with pytest.raises(ValueError):
        contract.check_range(days, d("20231231"), d("20240110"))
    with pytest.raises(ValueError, match="vwap, beta"):
        contract.check_fields(["close", "vwap", "beta"], ["close"], days)
    for bad in (0, True, 1.5, "3"):
        with pytest.raises(ValueError):
            contract.check_positive(rebalance=bad)
    assert contract.factor_params('{"n": 5}') == {"n": 5} and contract.factor_params(None) == {}
    with pytest.raises(ValueError):
        contract.factor_params("[1]")
    with pytest.raises(ValueError):
        evaluate.check_groups(1)


def test_benchmark_must_be_complete(spark, tmp_path):
    nav = spark.createDataFrame([(b, p, 1.0 + p / 10 * b, 0.1 * p) for b in (1, 2) for p in (1, 2, 3)], "bucket int, pos long, nav double, turnover double")
    index = spark.createDataFrame([(p, 100.0 * p) for p in (1, 2, 3)], "pos long, index_close double")
    bench = evaluate.benchmark_nav(nav, index)
    assert [r.benchmark for r in bench.orderBy("pos").collect()] == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="no benchmark close"):
        evaluate.benchmark_nav(nav, index.where("pos <> 2")).collect()
    ic = spark.createDataFrame([(p, 0.1 * p) for p in range(1, 8)], "pos long, ic double")
    tables = evaluate.report_tables(nav, bench, ic, 2, 2, 3)
    got = {(r.series, r.pos): r.nav for r in tables["report_nav"].collect()}
    assert got["Excess", 3] == pytest.approx((1.0 + 0.6) / 3)
    up = [1 + 0.1 * p for p in (1, 2, 3)], [1 + 0.2 * p for p in (1, 2, 3)]
    assert got["Spread", 3] == pytest.approx((1 + up[1][1] / up[1][0] - up[0][1] / up[0][0]) * (1 + up[1][2] / up[1][1] - up[0][2] / up[0][1]))
    evaluate.write_report(tables, f"file://{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/report/performance").count() == 4
