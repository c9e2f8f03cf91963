"""Joins that follow the measured skew of their keys.

A summary of the large side's keys is one mergeable sketch of frequent items with the number of rows:
made once, kept beside a table, merged when rows are added. A key is heavy when it has more rows than
one task's fair share. Only heavy keys are spread, over as many tasks as their share asks for, and only
their lookup rows are copied; all other keys are joined plainly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Items of a summary; counts are exact to 3.5 rows in so many. Fixed value: the sketch's upper limit.
TRACKED, MOST_TRACKED = 16_384, 1_000_000

Heavy = list[tuple[int, int]]


def _hash(on: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in on])


def key_summary(df: DataFrame, on: Sequence[str], tracked: int = TRACKED) -> DataFrame:
    """One row, ``rows`` and ``heavy``: how many rows and a sketch of the most frequent keys, combined map-side.

    Keys of several columns are held by their hash; two keys with one hash count as one, which spreads
    both and changes no row.
    """
    sketch = F.call_function("approx_top_k_accumulate", _hash(on), F.lit(tracked))
    return df.agg(F.count("*").alias("rows"), sketch.alias("heavy"))


def merge_summaries(summaries: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """One summary of several, as rows of one table."""
    sketch = F.call_function("approx_top_k_combine", F.col("heavy"), F.lit(tracked))
    return summaries.agg(F.sum("rows").alias("rows"), sketch.alias("heavy"))


def heavy_keys(summary: DataFrame, tasks: int) -> Heavy:
    """``(hash, copies)`` of keys with more than the ``tasks``-th part of all rows, copies in proportion to their share.

    There are at most ``tasks`` such keys, and the sketch's error adds no more than that again, so the
    list is bounded by the tasks. A sketch never counts a key too low, so no heavy key is missed.
    """
    top = F.call_function("approx_top_k_estimate", F.col("heavy"), F.lit(2 * tasks))
    row = summary.select("rows", F.when(F.col("rows") > 0, top).alias("top")).first()
    return [(x["item"], -(-x["count"] * tasks // row["rows"])) for x in row["top"] or () if x["count"] * tasks > row["rows"]]


def measured_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    summary: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Equi-join of a large side with a lookup, with heavy keys of ``fact`` spread and no others.

    ``how`` may be anything that keeps the left side whole or filters it. Without a ``summary`` the keys
    of ``fact`` are read once for it, now; a stored summary saves that pass. ``tasks`` is the number of
    shuffle partitions where it is not given.
    """
    on = list(on)
    spark = fact.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if summary is None:
        summary = key_summary(fact, on, min(max(TRACKED, 16 * tasks), MOST_TRACKED))
    heavy = heavy_keys(summary, tasks)
    if not heavy:
        return fact.join(lookup, on, how)
    # At most twice as many rows as there are tasks.
    copies = F.broadcast(spark.createDataFrame(heavy, "_hash long, _copies int"))
    hashable = [F.col(f"`{name}`") for name, kind in fact.dtypes if "map<" not in kind]
    drawn = F.when(F.col("_copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(*hashable), F.col("_copies")).cast("int"))
    spread = fact.withColumn("_hash", _hash(on)).join(copies, "_hash", "left").withColumn("_salt", drawn).drop("_hash", "_copies")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1))
    copied = lookup.withColumn("_hash", _hash(on)).join(copies, "_hash", "left").withColumn("_salt", every).drop("_hash", "_copies")
    return spread.join(copied, on=[*on, "_salt"], how=how).drop("_salt")
