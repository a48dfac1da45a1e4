"""Connected components of an edge table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, staged


def are_stars(edges: DataFrame) -> bool:
    """Whether every ``a`` has one ``b`` and no ``b`` is an ``a``: each ``b``, being the smaller end, is then its component's smallest vertex."""
    ends = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    many = ends.where("n > 1").select(F.col("a").alias("v"))
    inner = edges.select("b").distinct().join(ends.select(F.col("a").alias("v")), F.col("b") == F.col("v"), "left_semi").select(F.col("b").alias("v"))
    return many.unionByName(inner).agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``v, root`` for every vertex of ``edges (a, b)``: the smallest vertex it can reach.

    Rounds of large stars and small stars (each vertex links its larger, then its smaller
    neighbours to the smallest one it knows) until all that is left are stars. Minima are aggregated map-side and joined
    back, so a hub with very many neighbours is never gathered in one task; each round's edges are
    written to the shared folder and deleted after the next. Edges that name a null vertex are left out.
    """
    known = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now, path = staged(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while not are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        links = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        small = large.join(least, F.col("a") == F.col("k")).select(F.explode(links).alias("e")).select("e.*").where("a > b").distinct()
        old = path
        now, path = staged(small, label)
        discard(now.sparkSession, old)
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
