"""Blocked histories: equal to the one-row form, bounded under one very long person."""

import pytest
from pyspark.sql import functions as F

from medstrand.operators import blocks as bl
from medstrand.operators import meds, sequence, timeline
from medstrand.sources.sinks import materialise

SIZE = 7


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small tables are still dealt to several ranges."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def events(spark):
    """One person holds most events, many at one time and many equal; some dates and tokens are null."""
    n = F.col("id")
    person = F.when(n % 3 > 0, 0).when(n % 50 == 0, F.lit(None)).otherwise(n % 40).cast("bigint")
    at = F.timestamp_seconds(F.lit(946684800) + F.when(n % 5 < 2, 86_400 * 300).otherwise((n * 7919) % 900 * 43_200))
    token = F.when(n % 97 == 0, F.lit(None)).when(n % 4 == 0, F.lit("T:same")).otherwise(F.concat(F.lit("T:"), (n % 211).cast("string")))
    date = F.when(n % 89 != 0, at)
    return spark.range(4000).select(person.alias("person_id"), date.alias("date"), token.alias("general_event_token"))


@pytest.fixture(scope="module")
def patients(spark):
    rows = spark.range(60).select(
        F.when(F.col("id") < 59, F.col("id")).alias("person_id"),
        F.timestamp_seconds(F.lit(-500_000_000) + F.col("id") * 86_400 * 40).alias("px_birth_date"),
        F.when(F.col("id") % 3 > 0, F.lit("R")).alias("px_race"),
        F.lit("G").alias("px_gender"),
    )
    return rows


@pytest.fixture(scope="module")
def stored(events, patients):
    return materialise(bl.build_blocks(events, patients, size=SIZE), "blocks")


@pytest.fixture(scope="module")
def whole(events, patients):
    return timeline.build_sequences(events, patients)


def same(a, b):
    columns = sorted(b.columns)
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and b.count() > 0


def test_one_row_is_the_plain_form(stored, whole):
    assert same(bl.one_row(stored), whole)


def test_blocks_are_full_but_the_last(stored):
    rows = stored.select("person_id", "block", "first", "events_before", "events", "total", "events_total", "base_total", F.size("seq").alias("n")).collect()
    for r in rows:
        assert r["first"] == r["block"] * SIZE
        assert r["n"] == min(SIZE, r["total"] - r["first"])
    for person in {r["person_id"] for r in rows}:
        own = sorted((r for r in rows if r["person_id"] == person), key=lambda r: r["block"])
        seen = 0
        for i, r in enumerate(own):
            assert (r["block"], r["events_before"]) == (i, seen)
            seen += r["events"]
        assert {r["events_total"] for r in own} == {seen}


@pytest.mark.parametrize("length", [1, 4, 30, 500, 10_000])
def test_trim_length(stored, whole, length):
    assert same(bl.trim_length(stored, length), sequence.trim_length(whole, length))


@pytest.mark.parametrize("position", [2, 60, 301, 100_000])
def test_trim_position(stored, whole, position):
    got = bl.trim_position(stored, position)
    want = sequence.baseline_first(sequence.trim_position(whole, position))
    assert same(sequence.baseline_first(bl.one_row(got)), want)
    # What is left is blocks again, on which the next step works.
    again = sequence.trim_length(want, 12).withColumn("seq", F.sort_array("seq"))
    assert same(bl.trim_length(got, 12).withColumn("seq", F.sort_array("seq")), again)


@pytest.mark.parametrize("length", [3, 25, 5_000])
def test_random_window(stored, whole, length):
    assert same(bl.random_window(stored, length, 200, "s"), sequence.random_window(whole, length, 200, "s"))


def test_min_days(events, patients):
    got = bl.one_row(bl.build_blocks(events, patients, 440, SIZE))
    assert same(got, timeline.build_sequences(events, patients, 440))


@pytest.mark.parametrize("size", [1, 5, 10_000])
def test_meds_parts_of_days_make_the_day(events, patients, whole, size):
    parts = bl.meds_blocks(bl.numbered_events(events, patients), size)
    assert parts.filter(F.aggregate("events", F.lit(0), lambda a, e: a + F.size(e["measurements"])) > size).isEmpty()
    assert parts.filter("continued").isEmpty() == (size == 10_000)
    flat = lambda df: df.select(
        "person_id", F.explode(F.flatten(F.transform("events", lambda e: F.transform(e["measurements"], lambda m: F.struct(e["time"].alias("time"), m.alias("m"))))))
    )
    assert same(flat(parts), flat(meds.to_meds(whole)))


def test_nothing(spark, events, patients):
    none = events.limit(0)
    assert bl.build_blocks(none, patients).count() == 0
    assert bl.meds_blocks(bl.numbered_events(none, patients)).count() == 0
    assert bl.trim_length(bl.build_blocks(none), 5).count() == 0


def test_no_task_holds_a_person(spark, events, patients):
    """Ranges split the long person, and stored blocks are gathered by person and block."""
    kept = []

    def save(df, name):
        kept.append(materialise(df, name))
        return kept[-1]

    bl.build_blocks(events, patients, size=SIZE, save=save)
    sizes = {r["_range"]: r["count"] for r in kept[0].groupBy("_range").count().collect()}
    total = sum(sizes.values())
    assert len(sizes) > 1 and max(sizes.values()) < 2.5 * total / len(sizes)
    plan = bl.build_blocks(events, patients, size=SIZE)._jdf.queryExecution().executedPlan().toString()
    by = [line for line in plan.splitlines() if "Exchange hashpartitioning(person_id" in line]
    assert by and all("block" in line for line in by)


def test_short_histories_take_one_shuffle(spark, events, patients, monkeypatch):
    """Persons of whom none is long: dealt by person once, with the rows that the ranges give."""
    short = events.filter("person_id <> 0")
    ours = bl.build_blocks(short, patients, 100, SIZE)
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    monkeypatch.setattr(bl, "WHOLE", 0)
    ranged = bl.build_blocks(short, patients, 100, SIZE)
    assert "rangepartitioning" not in plan and "_range" in ranged._jdf.queryExecution().executedPlan().toString()
    assert same(ours, ranged)
