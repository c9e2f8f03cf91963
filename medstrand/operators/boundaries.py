"""Percentile boundaries that can be added to: mergeable sketches of lab values a code and day.

A quantile sketch (KLL) of a code's values on one day is stored as one row. Boundaries of any span of
days come from merging those rows, never from the values again: a new day adds its rows, a corrected
day replaces them. A rank read from a sketch of size ``k`` is off by at most ``rank_error(k)`` of the
values with 99 % confidence, merged or not, and not at all while a code has fewer values than ``k``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medstrand.operators.scale import salted_join
from medstrand.sources.sinks import materialise

# Values a sketch keeps exactly; a rank is then off by at most 0.14 % of the values.
SKETCH_SIZE = 2048
# Size merged sketches take, not less than that of the days' own. Fixed value: the smallest size of a sketch.
MERGED_SIZE, LEAST_SIZE = 8192, 8


def rank_error(k: int) -> float:
    """Part of all values by which the rank of a boundary can be off (99 % confidence)."""
    # The published error curve of this sketch.
    return 2.296 / k**0.9723


def day_sketches(converted: DataFrame, k: int = SKETCH_SIZE, date: str = "date") -> DataFrame:
    """``lx_lab_code, on, n, sketch`` from labs with ``lx_result_val_converted``; combined map-side.

    A sketch takes the memory of ``k`` values however few it holds, and most codes have few values a day.
    So every code and day first gets a sketch of ``LEAST_SIZE``, which keeps so many values; these are
    stored, and only codes and days with more values are read again for a sketch of size ``k``.
    ``converted`` is read twice, so it should be stored.
    """
    value = F.col("lx_result_val_converted")
    values = converted.filter(value.isNotNull() & ~F.isnan(value)).select("lx_lab_code", F.to_date(date).alias("on"), value.alias("_value"))

    def sketched(rows: DataFrame, size: int) -> DataFrame:
        return rows.groupBy("lx_lab_code", "on").agg(
            F.count("*").alias("n"), F.kll_sketch_agg_double("_value", F.lit(size)).alias("sketch")
        )

    if k <= LEAST_SIZE:
        return sketched(values, k)
    small = materialise(sketched(values, LEAST_SIZE), "small_sketches")
    # Stored first: then the join knows how few they are. Null keys are equal inside a struct.
    key = F.struct("lx_lab_code", "on").alias("_key")
    many = materialise(small.filter(F.col("n") > LEAST_SIZE).select(key), "many_values")
    again = salted_join(values.withColumn("_key", key), many, ["_key"], "left_semi").drop("_key")
    return small.filter(F.col("n") <= LEAST_SIZE).unionByName(sketched(again, k))


def with_days(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` day sketches with the days of ``new`` added, or put in place of their own."""
    # Days are few: a join of day sketches by code and day would keep codes a corrected day no longer has.
    fresh = new.select(F.struct("on").alias("_on")).distinct()
    kept = stored.withColumn("_on", F.struct("on")).join(fresh, "_on", "left_anti").drop("_on")
    return kept.unionByName(new)


def merged(sketches: DataFrame, k: int = MERGED_SIZE) -> DataFrame:
    """One sketch a code: ``lx_lab_code, n, sketch``; ``k`` is not less than the size of the day sketches."""
    return sketches.groupBy("lx_lab_code").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def _quantiles(step: int) -> list[float]:
    if 100 % step:
        raise ValueError("the percentile step must divide 100")
    return [i * step / 100 for i in range(1, 100 // step)]


def boundaries(sketches: DataFrame, step: int = 10, where: Column | None = None, k: int = MERGED_SIZE) -> DataFrame:
    """Boundaries as ``labs.percentiles`` gives them, from day sketches, of the days ``where`` holds.

    ``lx_lab_code, n, percentile_boundaries`` and ``percentile_<p>``; what ``labs.apply`` takes. ``k`` as in ``merged``.
    """
    quantiles = _quantiles(step)
    days = sketches if where is None else sketches.filter(where)
    read = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for q in quantiles])
    found = merged(days, k).select("lx_lab_code", "n", read.alias("percentile_boundaries"))
    named = [F.get("percentile_boundaries", F.lit(i)).alias(f"percentile_{(i + 1) * step}") for i in range(len(quantiles))]
    return found.select("lx_lab_code", "n", "percentile_boundaries", *named)


def worst_ranks(converted: DataFrame, table: DataFrame, step: int = 10) -> DataFrame:
    """``lx_lab_code, n, off``: the largest part by which a boundary's true rank misses its percentile.

    Values are first counted by code and value. A value that many rows share spans their ranks, so only
    what lies outside that span counts.
    """
    quantiles = _quantiles(step)
    value = F.col("lx_result_val_converted")
    counted = converted.groupBy("lx_lab_code", value.alias("_v")).agg(F.count("*").alias("_n"))
    joined = counted.join(table.select("lx_lab_code", "percentile_boundaries"), "lx_lab_code")
    sums = [
        F.sum(F.when(test(F.col("_v"), F.get("percentile_boundaries", F.lit(i))), F.col("_n")).otherwise(0)).alias(f"_{name}{i}")
        for i in range(len(quantiles))
        for name, test in (("below", lambda v, b: v < b), ("upto", lambda v, b: v <= b))
    ]
    ranks = joined.groupBy("lx_lab_code").agg(F.sum("_n").alias("n"), *sums)
    missed = [
        F.greatest(F.col(f"_below{i}") / F.col("n") - q, q - F.col(f"_upto{i}") / F.col("n"), F.lit(0.0)) for i, q in enumerate(quantiles)
    ]
    return ranks.select("lx_lab_code", "n", F.array_max(F.array(*missed)).alias("off"))
