"""Data contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).count().where("count > 1")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and the exclusive or of 60 bits of the rows' MD5 (values as text, joined by pipes): equal for equal rows in any order, in any engine."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")).alias("hash"))


def bar_violations(bars: DataFrame) -> DataFrame:
    """Counts of bars that break a rule: missing or negative numbers, high or low out of order."""
    bad = {
        "missing": "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL",
        "negative": "vol < 0 OR amount < 0 OR low <= 0",
        "high_low": "high < greatest(open, close, low) OR low > least(open, close, high)",
    }
    return bars.agg(*[F.count_if(F.expr(v)).alias(k) for k, v in bad.items()])


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has: ``side`` and the keys."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, keys, "left_anti").withColumn("side", F.lit("right")))


def leaks(df: DataFrame, at: str, effective: str) -> DataFrame:
    """Rows that use a value on the day it became known or before."""
    return df.where(F.col(effective).isNotNull() & (F.col(effective) >= F.col(at)))
