"""Nested event format: per person an array of ``{time, measurements: [{code, numeric_value, text_value}]}``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medstrand.functions.codes import contains_any, plain_number

# The birth code as it appears in sequences and as the nested format wants it.
BIRTH_IN, BIRTH_OUT = "SNOMED/3950001", "SNOMED/184099003"
# Code fragments that mark a demographic measurement.
DEMOGRAPHIC = ("gender", "ethnicity", "race", "region")


def _measurement(order: Column, token: Column) -> Column:
    """Text before the first colon is the code; the rest is a number when it reads as one, else text."""
    code = F.substring_index(token, ":", 1)
    rest = F.when(token.contains(":"), F.substr(token, F.length(code) + 2))
    number = plain_number(rest)
    return F.struct(
        order.alias("pos"),
        code.alias("code"),
        number.alias("numeric_value"),
        F.when(number.isNull(), rest).alias("text_value"),
    )


def to_meds(df: DataFrame, keys: Sequence[str] = ("person_id",)) -> DataFrame:
    """``keys, events`` from ``seq``: one event per calendar day, in array order, repeats within a day dropped.

    All inside the row, without a shuffle: sorted by day and token the repeats are neighbours, and
    sorted by day and place the days are slices.
    """

    def item(x: Column, i: Column) -> Column:
        token = F.when(x["token"] == BIRTH_IN, BIRTH_OUT).otherwise(x["token"])
        return F.struct(
            F.to_date(x["date"]).alias("on"), token.alias("token"), i.alias("pos"), x["date"].alias("time")
        )

    def changes(column: str, fields: Sequence[str]):
        def changed(x: Column, i: Column) -> Column:
            before = F.get(F.col(column), i - 1)
            same = F.lit(True)
            for field in fields:
                same = same & before[field].eqNullSafe(x[field])
            return (i == 0) | ~same

        return changed

    placed = F.transform("_d", lambda x: F.struct(x["on"].alias("on"), x["pos"].alias("pos"), x["time"].alias("time"), x["token"].alias("token")))
    work = (
        df.select(*keys, "seq")
        .withColumn("_i", F.array_sort(F.transform("seq", item)))
        .withColumn("_d", F.filter("_i", changes("_i", ["on", "token"])))
        .withColumn("_d", F.array_sort(placed))
        .withColumn("_starts", F.filter(F.transform("_d", lambda x, i: F.when(changes("_d", ["on"])(x, i), i)), lambda i: i.isNotNull()))
    )

    def day(start: Column, number: Column) -> Column:
        stop = F.coalesce(F.get(F.col("_starts"), number + 1), F.size("_d"))
        first = F.get(F.col("_d"), start)
        return F.struct(
            first["pos"].alias("pos"),
            first["time"].alias("time"),
            F.transform(F.slice("_d", start + 1, stop - start), lambda x: _measurement(x["pos"], x["token"])).alias("measurements"),
        )

    days = F.array_sort(F.transform("_starts", day))
    event = F.transform(
        days,
        lambda e: F.struct(
            e["time"].alias("time"),
            F.transform(e["measurements"], lambda m: m.dropFields("pos")).alias("measurements"),
        ),
    )
    return work.select(*keys, event.alias("events"))


def trim_meds(df: DataFrame, max_length: int) -> DataFrame:
    """Keep the birth event, demographic measurements and the latest others, at most ``max_length`` in all.

    The kept measurements are sorted by time (birth, then demographics, then the rest on a tie) and
    regrouped by equal time. A history without a birth event is trimmed the same way.
    """
    flat = F.flatten(
        F.transform(
            "events",
            lambda e: F.transform(e["measurements"], lambda m: F.struct(e["time"].alias("time"), m.alias("m"))),
        )
    )

    def demographic(y: Column) -> Column:
        return contains_any(F.lower(y["m"]["code"]), list(DEMOGRAPHIC))

    def birth(y: Column) -> Column:
        return y["m"]["code"] == BIRTH_OUT

    def ranked(items: Column, group: int) -> Column:
        return F.transform(
            items,
            lambda y, i: F.struct(
                y["time"].alias("time"), F.lit(group).alias("group"), i.alias("i"), y["m"].alias("m")
            ),
        )

    work = df.withColumn("_flat", flat).withColumns(
        {
            "_birth": F.filter("_flat", birth),
            "_demo": F.filter("_flat", demographic),
            "_other": F.filter("_flat", lambda y: ~birth(y) & ~demographic(y)),
        }
    )
    work = work.withColumn("_birth", F.slice("_birth", F.greatest(F.size("_birth"), F.lit(1)), 1))
    keep = F.least(F.greatest(F.lit(max_length - 1) - F.size("_demo"), F.lit(0)), F.size("_other"))
    work = work.withColumn("_other", F.slice("_other", F.size("_other") - keep + 1, keep))
    work = work.withColumn(
        "_kept",
        F.array_sort(F.concat(ranked(F.col("_birth"), 0), ranked(F.col("_demo"), 1), ranked(F.col("_other"), 2))),
    )
    times = F.array_distinct(F.transform("_kept", lambda y: y["time"]))
    events = F.transform(
        times,
        lambda t: F.struct(
            t.alias("time"),
            F.transform(
                F.filter("_kept", lambda y: y["time"].eqNullSafe(t)), lambda y: y["m"]
            ).alias("measurements"),
        ),
    )
    return work.withColumn("events", events).drop("_flat", "_birth", "_demo", "_other", "_kept")
