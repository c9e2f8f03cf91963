"""Connected components of an edge table, by stars that are drawn to smaller nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medstrand.sources.sinks import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for all nodes that are not their own root.

    ``edges`` has columns ``a`` and ``b`` of one orderable kind; repeats, loops and nulls do no harm.
    A large star ties the larger neighbours of a node to its smallest one, a small star the smaller
    ones; the rounds, each written to the shared folder, grow with the logarithm of the longest
    path. Minima are taken with map-side combine and joined back, so no node's neighbours are
    gathered and a hub's rows can be split.
    """
    oriented = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    now = materialise(oriented.distinct(), "edges")
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        nearest = both.groupBy("hi").agg(F.min("lo").alias("_m")).withColumn("_m", F.least("hi", "_m"))
        large = (
            both.filter("lo > hi")
            .join(nearest, "hi")
            .select(F.col("lo").alias("hi"), F.col("_m").alias("lo"))
            .filter("hi <> lo")
            .distinct()
        )
        smallest = large.groupBy("hi").agg(F.min("lo").alias("_m"))
        small = (
            large.join(smallest, "hi")
            .filter("lo <> _m")
            .select(F.col("lo").alias("hi"), F.col("_m").alias("lo"))
            .unionByName(smallest.select("hi", F.col("_m").alias("lo")))
            .distinct()
        )
        now = materialise(small, "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
