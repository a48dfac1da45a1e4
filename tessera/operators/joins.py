"""Point-in-time joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(probes: DataFrame, events: DataFrame, by: list[str], at: str, event_at: str, values: list[str], strict: bool = True, order: list[str] | None = None) -> DataFrame:
    """``probes`` with the ``values`` of the last event at or (``strict``) before each probe's time.

    Both sides go into one stream that is sorted once by key and time; the last event is carried forward. At
    equal times an event comes after the probe if the join is strict, before it otherwise. ``order`` breaks ties of
    events. One shuffle on ``by``, whatever the number of events.
    """
    order = order or []
    rank = 1 if strict else -1
    carried = F.struct(*[F.col(v) for v in [event_at, *values]])
    left = probes.select(*by, F.col(at).alias("_t"), F.lit(0).alias("_side"), *[F.lit(None).cast(events.schema[o].dataType).alias(f"_o_{o}") for o in order], F.struct(*probes.columns).alias("_probe"), F.lit(None).cast(events.select(carried).schema[0].dataType).alias("_event"))
    right = events.select(*by, F.col(event_at).alias("_t"), F.lit(rank).alias("_side"), *[F.col(o).alias(f"_o_{o}") for o in order], F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType).alias("_probe"), carried.alias("_event"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", *[f"_o_{o}" for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    joined = left.unionByName(right).withColumn("_last", F.last("_event", ignorenulls=True).over(w)).where(F.col("_probe").isNotNull())
    return joined.select("_probe.*", *[F.col(f"_last.{v}").alias(v if v not in probes.columns else f"event_{v}") for v in [event_at, *values]])


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under ``order``."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def intervals(events: DataFrame, by: list[str], at: str, start: str = "in_date", end: str = "out_date") -> DataFrame:
    """Events as validity intervals: from ``at`` to the day before the next event; null is open."""
    nxt = F.lead(at).over(Window.partitionBy(*by).orderBy(at))
    return events.withColumns({start: F.col(at), end: F.date_sub(nxt, 1)})


def interval_join(days: DataFrame, spans: DataFrame, by: list[str], day: str, start: str = "in_date", end: str = "out_date", how: str = "left") -> DataFrame:
    """Days with the intervals that contain them, ends included; an equi-join on ``by`` with a range condition."""
    s = spans.select(*[F.col(b).alias(f"_{b}") for b in by], *[c for c in spans.columns if c not in by])
    on = [F.col(b) == F.col(f"_{b}") for b in by] + [F.col(day) >= F.col(start), F.coalesce(F.col(day) <= F.col(end), F.lit(True))]
    return days.join(s, on, how).drop(*[f"_{b}" for b in by])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``old`` and ``new``; of a key that both have, the new row (of several new ones, the last by ``order``)."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.col("_batch").desc(), *([F.col(order).desc_nulls_last()] if order else [])]).drop("_batch")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old, keys, "left_anti"), allowMissingColumns=True)


def fill_from(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``old`` with its null ``columns`` taken from ``new``."""
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return old.join(n, keys, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])
