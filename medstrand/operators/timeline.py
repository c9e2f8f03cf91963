"""From long events to one ordered sequence per person."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medstrand.operators.scale import running_total
from medstrand.schema import sequence_element


def first_dates(events: DataFrame, by: Sequence[str] = ("person_id",)) -> DataFrame:
    return events.groupBy(*by).agg(F.min("date").alias("first_date"))


def align_to_first_date(events: DataFrame) -> DataFrame:
    """Add ``days_since_begin``: 1 on the person's first date.

    Events look up their person's one date: a hash of a task's persons is smaller than its events sorted.
    """
    joined = events.join(first_dates(events).hint("shuffle_hash"), "person_id")
    return joined.select(
        "person_id",
        "general_event_token",
        (F.datediff("date", "first_date") + 1).cast("int").alias("days_since_begin"),
        "date",
    )


def age_in_years(at: Column, birth: Column) -> Column:
    return F.floor(F.datediff(at, birth) / 365).cast("bigint")


def baseline_rows(patients: DataFrame, keep: Sequence[str] = ("person_id",)) -> DataFrame:
    """Long rows of demographic tokens at birth; ``AGE`` still waits for the first event date.

    One pass over the patient table: the tokens are an array of structs exploded in place.
    """
    def token(prefix: str, column: str) -> Column:
        text = F.concat(F.lit(prefix + ":"), F.col(column)) if column in patients.columns else F.lit(None)
        return text.cast("string")

    tokens = F.array(
        F.when(F.col("px_birth_date").isNotNull(), F.lit("AGE")),
        token("ETHNICITY", "px_ethnicity"),
        token("GENDER", "px_gender"),
        token("RACE", "px_race"),
        token("REGION", "px_region"),
    )
    return patients.select(
        *keep,
        F.col("px_birth_date").alias("date"),
        F.explode(F.filter(tokens, lambda t: t.isNotNull())).alias("general_event_token"),
    )


def baseline_tokens(events: DataFrame, patients: DataFrame) -> DataFrame:
    """Day-0 rows for every patient who has an event (``events`` are aligned, so day 1 is the first date)."""
    rows = baseline_rows(patients).join(first_dates(events).hint("shuffle_hash"), "person_id")
    age = F.concat(F.lit("AGE:"), age_in_years(F.col("first_date"), F.col("date")))
    return rows.select(
        "person_id",
        F.when(F.col("general_event_token") == "AGE", age)
        .otherwise(F.col("general_event_token"))
        .alias("general_event_token"),
        F.lit(0).alias("days_since_begin"),
        "date",
    )


def add_baseline(events: DataFrame, patients: DataFrame, dated: DataFrame | None = None) -> DataFrame:
    """Aligned ``events`` with their day-0 rows. ``dated``, the same events before they were aligned, spares a second alignment."""
    return events.unionByName(baseline_tokens(events if dated is None else dated, patients))


def filter_by_span(events: DataFrame, min_days: int) -> DataFrame:
    """Events of persons whose last day is at or above ``min_days``."""
    long_enough = (
        events.groupBy("person_id")
        .agg(F.max("days_since_begin").alias("_last"))
        .filter(F.col("_last") >= min_days)
        .select("person_id")
    )
    return events.join(long_enough, "person_id", "left_semi")


def consolidate(events: DataFrame, by: Sequence[str] = ("person_id",)) -> DataFrame:
    """Aligned events to one row of an ordered ``seq`` array per key: by date, day and token; null tokens drop out.

    A key's events meet in one row. Where only some of them are wanted, cut the long form first
    (``recent_events``, ``oldest_events``, ``window_events``, ``label_samples_from_events``).
    """
    by = list(by)
    date = F.col("date") if "date" in events.columns else F.lit(None).cast("timestamp")
    element = sequence_element(date, F.col("days_since_begin"), F.col("general_event_token"))
    present = events.filter(F.col("general_event_token").isNotNull())
    return present.groupBy(*by).agg(F.array_sort(F.collect_list(element)).alias("seq"))


def parallel_arrays(sequences: DataFrame, with_date: bool = True) -> DataFrame:
    """``seq`` as the parallel arrays ``day_position_tokens``, ``sorted_event_tokens`` and ``date``."""
    arrays = [
        F.col("seq.day").alias("day_position_tokens"),
        F.col("seq.token").alias("sorted_event_tokens"),
    ]
    if with_date:
        arrays.append(F.col("seq.date").alias("date"))
    return sequences.select(*[c for c in sequences.columns if c != "seq"], *arrays)


def zip_arrays(wide: DataFrame) -> DataFrame:
    """The inverse of ``parallel_arrays``."""
    zipped = F.arrays_zip("date", "day_position_tokens", "sorted_event_tokens")
    seq = F.transform(
        zipped,
        lambda x: sequence_element(x["date"], x["day_position_tokens"], x["sorted_event_tokens"]),
    )
    rest = [c for c in wide.columns if c not in ("date", "day_position_tokens", "sorted_event_tokens")]
    return wide.select(*rest, seq.alias("seq"))


def build_sequences(
    events: DataFrame,
    patients: DataFrame | None = None,
    min_days: int | None = None,
    by: Sequence[str] = ("person_id",),
) -> DataFrame:
    """Raw ``person_id, date, general_event_token`` events to one ordered sequence per person in one shuffle.

    Alignment, baseline tokens, ages and the span filter need nothing but a person's own rows, so
    demographic rows ride along in the same union and all of it is settled inside the collected
    array: no join with first dates, no second pass. The row is as long as the person's history;
    model rows are made from the long form instead, which is cut before it is gathered.
    """
    by = list(by)
    rows = events.filter(F.col("general_event_token").isNotNull()).select(
        *by, "date", F.lit(1).alias("_event"), "general_event_token"
    )
    if patients is not None:
        base = baseline_rows(patients, by).select(
            *by, "date", F.lit(0).alias("_event"), "general_event_token"
        )
        rows = rows.unionByName(base)

    own = F.when(F.col("_event") == 1, F.col("date"))
    collected = (
        rows.groupBy(*by)
        .agg(
            F.min(own).alias("_first"),
            F.max(own).alias("_last"),
            F.array_sort(
                F.collect_list(F.struct("date", "_event", "general_event_token"))
            ).alias("_rows"),
        )
        .filter(F.col("_first").isNotNull())
    )
    if min_days is not None:
        collected = collected.filter(F.datediff("_last", "_first") + 1 >= min_days)

    def settle(x: Column) -> Column:
        is_event = x["_event"] == 1
        day = F.when(is_event, F.datediff(x["date"], F.col("_first")) + 1).otherwise(0)
        age = F.concat(F.lit("AGE:"), age_in_years(F.col("_first"), x["date"]))
        waiting = (~is_event) & (x["general_event_token"] == "AGE")
        return sequence_element(
            x["date"], day, F.when(waiting, age).otherwise(x["general_event_token"])
        )

    return collected.select(*by, F.transform("_rows", settle).alias("seq"))


def event_positions(aligned: DataFrame) -> DataFrame:
    """Long-form order: each event's position (from 0) in its person's sequence.

    The person's time line is bucketed by day, so even one very long person is ranked by many tasks.
    """
    ranked = running_total(
        aligned.filter(F.col("general_event_token").isNotNull()),
        order=[("date", True), ("days_since_begin", True), ("general_event_token", True)],
        levels=[("_on", F.to_date("date"), True)],
        by=["person_id"],
        out="position",
    )
    return ranked.withColumn("position", F.col("position") - 1)
