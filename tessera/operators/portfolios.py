"""Portfolios sorted on characteristics, and net values of bucket portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEGS = [s + v for s in ("small", "big") for v in ("low", "middle", "high")]


def three_factors(panel: DataFrame) -> DataFrame:
    """``pos, mkt, smb, hml, rf`` of each day.

    ``panel``: ``ts_code, trade_date, pos, close, total_mv, book, index_close, rate`` (a year's percent). Groups are formed on the last open day of June: two sizes, split at the
    median cap, by three of book to market, split at its 30 and 70 percent quantiles; they hold until the next June. A leg's return is weighted by the caps of the
    day before; ``smb`` needs all six legs and ``hml`` its four.
    """
    ends = panel.where(F.month("trade_date") == 6).groupBy(F.year("trade_date").alias("_y")).agg(F.max("pos").alias("pos"))  # a row a year
    last = panel.agg(F.max("pos").alias("_last"), F.max("trade_date").alias("_day"))
    ends = ends.crossJoin(F.broadcast(last)).where((F.col("pos") < F.col("_last")) | (F.month(F.date_add("_day", 1)) != 6)).select("pos")  # a June that has ended
    form = panel.join(F.broadcast(ends), "pos", "left_semi").where("total_mv > 0 AND book IS NOT NULL").withColumn("bm", F.col("book") / F.col("total_mv"))
    cuts = form.groupBy("pos").agg(F.percentile("total_mv", 0.5).alias("mid"), F.percentile("bm", 0.3).alias("lo"), F.percentile("bm", 0.7).alias("hi"))
    value = F.when(F.col("bm") <= F.col("lo"), "low").when(F.col("bm") > F.col("hi"), "high").otherwise("middle")
    legs = form.join(F.broadcast(cuts), "pos").select("ts_code", F.col("pos").alias("formed"), F.concat(F.when(F.col("total_mv") <= F.col("mid"), "small").otherwise("big"), value).alias("leg"))
    by_code = Window.partitionBy("ts_code").orderBy("pos").rangeBetween(-1, -1)
    price = F.when(F.col("close") > 0, F.col("close"))
    moves = panel.select("ts_code", "pos", (price / F.first(price).over(by_code) - 1).alias("r"), F.first("total_mv").over(by_code).alias("w")).where("r IS NOT NULL AND w > 0")
    days = panel.groupBy("pos").agg(F.max("index_close").alias("index_close"), F.max("rate").alias("rate"))
    calendar = Window.partitionBy(F.lit(1)).orderBy("pos")  # a row a day
    formed = F.last(F.when(F.col("_end"), F.col("pos")), ignorenulls=True).over(calendar.rowsBetween(Window.unboundedPreceding, -1))
    days = days.join(F.broadcast(ends.withColumn("_end", F.lit(True))), "pos", "left").withColumns({"formed": formed, "rf": F.col("rate") / 100 / 365, "m": F.col("index_close") / F.lag("index_close").over(calendar) - 1})
    of_day = moves.join(F.broadcast(days.select("pos", "formed")), "pos").join(legs, ["ts_code", "formed"])
    wide = of_day.groupBy("pos").pivot("leg", LEGS).agg(F.sum(F.col("r") * F.col("w")) / F.sum("w"))
    mean = lambda *legs: sum((F.col(x) for x in legs[1:]), F.col(legs[0])) / len(legs)
    smb, hml = mean(*LEGS[:3]) - mean(*LEGS[3:]), mean("smallhigh", "bighigh") - mean("smalllow", "biglow")
    return days.join(wide, "pos", "left").select("pos", (F.col("m") - F.col("rf")).alias("mkt"), smb.alias("smb"), hml.alias("hml"), "rf")


POSITIONS = "bucket int, traded long, ts_code string, shares double, cash double, wealth double, buy double, sell double, holdings long"


def positions(prices: DataFrame, groups: int, rebalance: int) -> DataFrame:
    """What each bucket portfolio holds after each trading day: rows of ``POSITIONS``; the row without a code has the cash, the wealth before the trade and the sums traded.

    ``prices``: ``ts_code, pos, close, suspended, bucket`` (the signal's bucket of that day). Buckets of every ``rebalance``-th day are traded at the next day's close,
    in equal money; a day without buckets trades nothing. A held suspended stock stays as it is and the rest of the wealth is shared; the share of a
    suspended stock that is not held stays cash. A stock that is held or wanted, not suspended and has no price is an error.
    Only a portfolio's sequence of trades is one task, and it is given the stocks it may hold on trading days: its targets, those of the trade before, and suspended ones.
    """
    import numpy as np
    import pandas as pd

    calendar = Window.partitionBy(F.lit(1)).orderBy("pos")
    days = prices.groupBy("pos").agg(F.count("bucket").alias("signals")).withColumns({"i": F.row_number().over(calendar) - 1, "traded": F.lead("pos").over(calendar)})
    trades = days.where((F.col("i") % rebalance == 0) & (F.col("signals") > 0) & F.col("traded").isNotNull()).withColumn("k", F.row_number().over(calendar))
    trades = trades.select(F.col("pos").alias("signal"), "traded", "k")  # at most a row a day
    wanted = prices.where("bucket IS NOT NULL").join(F.broadcast(trades), F.col("pos") == F.col("signal")).select("bucket", "k", "ts_code")
    marks = marked(prices).join(F.broadcast(trades.select("traded", "k")), F.col("pos") == F.col("traded")).select("ts_code", "k", "traded", "mark", "suspended")
    stuck = marks.where("suspended").select("ts_code", (F.col("k") + 1).alias("k")).join(wanted.select("bucket", "ts_code").distinct(), "ts_code").select("bucket", "k", "ts_code")
    may_hold = wanted.unionByName(wanted.withColumn("k", F.col("k") + 1)).unionByName(stuck).distinct()
    rows = may_hold.join(wanted.withColumn("want", F.lit(True)), ["bucket", "k", "ts_code"], "left").join(F.broadcast(trades.select("k", "traded")), "k").join(marks.drop("traded"), ["k", "ts_code"], "left")
    rows = rows.select("bucket", "k", "traded", F.col("ts_code").cast("string").alias("ts_code"), "mark", F.coalesce("suspended", F.lit(False)).alias("suspended"), F.coalesce("want", F.lit(False)).alias("want"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        codes, number = np.unique(p["ts_code"].to_numpy(str), return_inverse=True)
        order = np.lexsort((number, p["k"].to_numpy()))
        k, number = p["k"].to_numpy()[order], number[order]
        mark, stop, want, traded = (p[c].to_numpy()[order] for c in ("mark", "suspended", "want", "traded"))
        held, cash, out = np.zeros(len(codes)), 1.0, []
        edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        for a, b in zip(edge, edge[1:], strict=False):
            at, price, halt, target = number[a:b], mark[a:b].astype(float), stop[a:b].astype(bool), want[a:b].astype(bool)
            now = held[at]
            need = (now > 0) | (target & ~halt)
            if np.isnan(price[need]).any() or held.astype(bool).sum() != (now > 0).sum():
                raise ValueError(f"no price on day {traded[a]}: {codes[at][need & np.isnan(price)][:10].tolist()}")
            worth = np.where(now > 0, now * price, 0.0)
            wealth = cash + worth.sum()
            locked = halt & (now > 0)
            free = wealth - worth[locked].sum()
            slots = target & ~locked
            part = free / max(1, slots.sum())
            bought = slots & ~halt & (part > 1e-12 * wealth)  # what rounding leaves when all is locked buys nothing
            new = np.where(locked, now, np.where(bought, part / np.where(bought, price, 1.0), 0.0))
            cash = free - part * bought.sum()
            moved = np.where(need, (new - now) * np.nan_to_num(price), 0.0)
            held[at] = new
            left = np.flatnonzero(held)
            out.append((None, np.nan, cash, wealth, moved[moved > 0].sum(), -moved[moved < 0].sum(), len(left), traded[a]))
            out += [(codes[i], held[i], np.nan, np.nan, np.nan, np.nan, 0, traded[a]) for i in left]
        frame = pd.DataFrame(out, columns=["ts_code", "shares", "cash", "wealth", "buy", "sell", "holdings", "traded"])
        frame.insert(0, "bucket", int(p["bucket"].iloc[0]))
        return frame[["bucket", "traded", "ts_code", "shares", "cash", "wealth", "buy", "sell", "holdings"]]

    return rows.withColumn("bucket", F.col("bucket").cast("int")).where(F.col("bucket").between(1, groups)).groupBy("bucket").applyInPandas(run, POSITIONS)


def marked(prices: DataFrame) -> DataFrame:
    """``mark``: the price of the day, or a suspended stock's last one."""
    close = F.when(F.col("close") > 0, F.col("close"))
    last = F.last(close, ignorenulls=True).over(Window.partitionBy("ts_code").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return prices.withColumn("mark", F.when(F.col("suspended"), last).otherwise(close))


def net_values(prices: DataFrame, held: DataFrame, groups: int) -> DataFrame:
    """``bucket, pos, nav, turnover`` of every day but the first; a day's value is that of what was held before its trade, ``turnover`` is what was bought and sold over it."""
    days = prices.select("pos").distinct()
    cash = held.where("ts_code IS NULL").select("bucket", "traded", "cash", "wealth", "buy", "sell", "holdings")
    until = F.lead("traded").over(Window.partitionBy("bucket").orderBy("traded"))
    spans = cash.withColumn("until", until)
    first = days.agg(F.min("pos").alias("_first"))
    grid = days.crossJoin(F.broadcast(first)).where("pos > _first").select("pos", F.explode(F.sequence(F.lit(1), F.lit(groups))).alias("bucket"))
    on = (F.col("pos") > F.col("traded")) & (F.col("until").isNull() | (F.col("pos") <= F.col("until")))
    of = grid.join(F.broadcast(spans.withColumnRenamed("bucket", "_b")), (F.col("bucket") == F.col("_b")) & on, "left").select("bucket", "pos", "traded", "cash", "holdings")  # a row for each trade
    shares = held.where("ts_code IS NOT NULL").select("bucket", "traded", F.col("ts_code").alias("_code"), "shares")
    worth = of.where("traded IS NOT NULL").join(shares, ["bucket", "traded"]).join(marked(prices).select(F.col("ts_code").cast("string").alias("_code"), "pos", "mark"), ["_code", "pos"])
    value = worth.groupBy("bucket", "pos").agg(F.sum(F.col("shares") * F.col("mark")).alias("worth"), F.count("mark").alias("found"))
    out = of.join(value, ["bucket", "pos"], "left").join(cash.select("bucket", F.col("traded").alias("pos"), "buy", "sell", "wealth"), ["bucket", "pos"], "left")
    missing = F.coalesce("found", F.lit(0)) != F.coalesce("holdings", F.lit(0))
    nav = F.when(missing, F.raise_error(F.concat(F.lit("no price of a held stock on day "), F.col("pos").cast("string"))).cast("double")).otherwise(F.coalesce("cash", F.lit(1.0)) + F.coalesce("worth", F.lit(0.0)))
    return out.select("bucket", "pos", nav.alias("nav"), F.coalesce((F.col("buy") + F.col("sell")) / F.col("wealth"), F.lit(0.0)).alias("turnover"))


def simulate(prices: DataFrame, groups: int, rebalance: int) -> DataFrame:
    """Daily net values of bucket portfolios: ``bucket, pos, nav, turnover``. See ``positions`` for the rules."""
    if isinstance(groups, bool) or groups < 2 or isinstance(rebalance, bool) or rebalance < 1:
        raise ValueError("two groups or more, and a rebalance of one day or more")
    prices = prices.select("ts_code", "pos", "close", "suspended", "bucket").persist()  # read for the calendar, the signals, the trades and the daily values
    held = positions(prices, groups, rebalance).persist()  # read twice; the stocks held on trading days
    return net_values(prices, held, groups)
