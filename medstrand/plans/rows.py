"""Long events to model-input rows, and the nested labelled samples.

Events are aligned: ``person_id, date, days_since_begin, general_event_token`` with the day-0 rows
(``timeline.add_baseline``). They are cut to what ``max_length`` lets through before they are gathered,
so a row is bounded however long a person's history is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medstrand.functions.codes import contains_any, is_label
from medstrand.operators import labs, meds, timeline
from medstrand.operators import sequence as sq
from medstrand.sources.sinks import materialise

SAMPLE_KEYS = ["person_id", "label_count"]


def pretrain_rows(
    events: DataFrame,
    vocabulary: DataFrame,
    max_length: int,
    max_position: int,
    window_seed: str | int | None = None,
    percentile_step: int | None = None,
    single_age_token: bool = False,
) -> DataFrame:
    """Unlabelled path: baseline first, optional random window, length and day trims, age, encoding."""
    if window_seed is None:
        rows = sq.baseline_first(timeline.consolidate(sq.recent_events(events, max_length)))
    else:
        chosen = sq.window_events(events, max_length, window_seed, materialise)
        rows = sq.baseline_first(timeline.consolidate(chosen, ["person_id", "windowed"]))
        rows = sq.settle_window(rows, max_position)
    rows = sq.trim_position(sq.trim_length(rows, max_length), max_position)
    rows = sq.correct_age(rows)
    return sq.encode(
        rows, vocabulary, max_length, percentile_step=percentile_step, single_age_token=single_age_token
    )


def labelled_rows(
    events: DataFrame,
    labels: DataFrame,
    vocabulary: DataFrame,
    max_length: int,
    label: str = "label",
    keys: Sequence[str] = ("person_id",),
    percentile_step: int | None = None,
) -> DataFrame:
    """One label per sequence (``labels`` has ``keys`` and ``label``): encoding only, which keeps the oldest elements."""
    rows = timeline.consolidate(sq.oldest_events(events, max_length, keys), keys)
    rows = rows.join(labels.select(*keys, F.col(label).alias("labels")), list(keys))
    return sq.encode(rows, vocabulary, max_length, keys, percentile_step)


def multilabel_rows(
    events: DataFrame,
    vocabulary: DataFrame,
    max_length: int,
    max_position: int,
    label: int | None = None,
    percentile_step: int | None = None,
    tie: str = "general_event_token",
    counted: DataFrame | None = None,
) -> DataFrame:
    """One row per label among the events, keeping the latest history before it.

    The parts of the samples are encoded apart: those that are together by person are not shuffled again.
    ``tie`` and ``counted`` are those of ``sequence.label_sample_parts``.
    """
    def encoded(samples: DataFrame) -> DataFrame:
        rows = samples.withColumnRenamed("label", "labels")
        rows = sq.trim_position(sq.trim_length(rows, max_length), max_position)
        return sq.encode(rows, vocabulary, max_length, SAMPLE_KEYS, percentile_step)

    parts = sq.label_sample_parts(events, max_length, materialise, label, drop_repeats=True, tie=tie, counted=counted)
    return reduce(DataFrame.unionByName, [encoded(part) for part in parts])


def multilabel_lab_rows(
    events: DataFrame,
    vocabulary: DataFrame,
    conversions: DataFrame,
    percentiles: DataFrame,
    max_length: int,
    max_position: int,
    label: int | None = None,
    groups: int = 10,
) -> DataFrame:
    """As ``multilabel_rows`` for events whose lab tokens still carry value and unit.

    Lab tokens are rewritten before the samples are cut: a rewrite looks at one token only, so
    doing it once per person gives what doing it once per label would. Equal times stay in the
    order of the tokens as they came. Events are stored as they come and nothing made of them is.
    """
    stored = materialise(events, "events")
    named = stored.withColumn("_was", F.col("general_event_token"))
    rewritten = labs.event_percentiles(named, conversions, percentiles, groups)
    return multilabel_rows(rewritten, vocabulary, max_length, max_position, label, 100 // groups, "_was", stored)


def meds_samples(events: DataFrame, max_length: int, label: int | None = None) -> DataFrame:
    """Nested history before each label, at most ``max_length`` measurements, demographic ones always.

    Repeats within a day leave first, so the latest ``max_length`` events hold all that can stay.
    """

    def demographic(token: Column) -> Column:
        code = F.lower(F.substring_index(token, ":", 1))
        return contains_any(code, list(meds.DEMOGRAPHIC)) | (token == meds.BIRTH_IN)

    day = Window.partitionBy("person_id", F.to_date("date"), "general_event_token").orderBy("date", "days_since_begin")
    once = events.withColumn("_again", F.row_number().over(day))
    once = once.filter((F.col("_again") == 1) | is_label(F.col("general_event_token"))).drop("_again")
    samples = sq.label_samples_from_events(once, max_length, label, save=materialise, always=demographic)
    return meds.trim_meds(meds.to_meds(samples, [*SAMPLE_KEYS, "label"]), max_length)
