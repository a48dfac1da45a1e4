"""The library's queries over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.factors import price, statement  # noqa: F401  they register their factors
from tessera.factors.spec import CUT, REGISTRY, compute, twin
from tessera.plans import operator_queries, report_queries, table_queries  # noqa: F401  the others add to operator_queries
from tessera.session import ship
from tessera.sources import panel as source

#: Windows that the weekly test panel can fill; the defaults are days of a market calendar.
WEEKS = {
    "LongTermReversal": {"length": 126},
    "BarraLongTermReversal": {"n": 104, "hl": 26, "least": 52, "lags": (27, 37)},
    "BarraSeasonality": {"year": 52, "month": 4},
    "MarketBetaCN": {"n": 52, "long": 156},
}


def factor_panel(spark: SparkSession, sf_dir: str, needs: str) -> DataFrame:
    """The panel with what a factor reads besides it."""
    if needs == "annual":
        return source.annual_panel(spark, sf_dir)
    p = source.panel(spark, sf_dir)
    if needs == "ff3":
        p = p.join(F.broadcast(report_queries.factor_days(p).drop("rf")), "pos")  # a row a day
    return p


def factor_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    f = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return compute(factor_panel(spark, sf_dir, f.needs), name, **WEEKS.get(name, {})).select("ts_code", "pos", F.expr(CUT).alias("value"))

    run.__doc__ = f"The {f.family} factor {name} on the weekly panel."
    return run


def factor_sql(name: str) -> str:
    f = REGISTRY[name]
    base = source.duck_sql(source.joined_sql() if f.needs == "annual" else source.weekly_sql())
    if f.needs == "ff3":
        base = f"SELECT p.*, mkt, smb, hml FROM ({base}) p JOIN ({report_queries.FF3_SQL}) USING (pos)"
    return f"SELECT ts_code, pos, {CUT} AS value FROM ({twin(base, name, **WEEKS.get(name, {}))})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"factor_{n}": factor_query(n) for n in REGISTRY}
SQL: dict[str, str] = {f"factor_{n}": factor_sql(n) for n in REGISTRY}
QUERIES |= operator_queries.QUERIES
SQL |= operator_queries.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum of the weekly panel and its rank correlation with the return that follows, by week."""
    return QUERIES["x10_rank_ic"](spark, sf_dir)
