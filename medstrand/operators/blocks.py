"""Sequences in blocks: histories of any length in rows of bounded length.

A person's ordered sequence is cut into blocks of ``size`` elements, one row each:

- ``person_id, block``: the key, blocks counted from 0;
- ``first``: elements of the person before the block;
- ``events_before, events``: elements after day 0 before and in the block;
- ``total, events_total, base_total, last_day``: numbers of the whole person, the same in all its blocks;
- ``seq``: at most ``size`` elements, as in the one-row form.

Because each block knows the counts before it and those of its person, trims and windows choose their
blocks by a filter and slice them in place; only what is left is gathered. No row holds a person. Where no
person has more than ``WHOLE`` rows, nor more than a task's share of all, events are numbered and gathered in
one shuffle by person. Otherwise no task holds a person either: events are dealt in even ranges of person and
time, counts are summed by range, and blocks are gathered by person and block. Repeated events are then one
row with a count until they are put in blocks, so even a million equal events do not meet in one task.

``one_row`` gives the plain form back, and is as long as the history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medstrand.functions.keyed import keyed_uniform
from medstrand.operators import meds
from medstrand.operators import sequence as sq
from medstrand.operators.scale import ranged
from medstrand.operators.timeline import age_in_years, baseline_rows
from medstrand.schema import sequence_element
from medstrand.sources.sinks import materialise

BLOCK_SIZE = 1024
# Rows of a person up to which one task numbers them all.
WHOLE = 65_536
Save = Callable[[DataFrame, str], DataFrame]
_UP = (Window.unboundedPreceding, -1)
PERSON = ["total", "events_total", "base_total", "last_day"]


def _placed(rows: DataFrame, order: list[str], sums: dict[str, Column], whole: dict[str, Column], save: Save) -> DataFrame:
    """``rows`` in order of person and ``order``: ``_before_x`` and ``x`` sums before a row and of its person.

    ``whole`` are further aggregates of the person, which must be minima or maxima. Rows are dealt to
    even ranges, ranges are summed, and only the sums meet by person.
    """
    dealt = ranged(rows, [(c, True) for c in ("person_id", *order)], save)
    dealt = dealt.withColumns({f"_{x}": v for x, v in sums.items()}).withColumn("_key", F.struct("person_id", "_range"))
    parts = dealt.groupBy("_key").agg(
        *[F.sum(f"_{x}").alias(f"_{x}") for x in sums], *[v.alias(x) for x, v in whole.items()]
    )
    person = Window.partitionBy("_key.person_id")
    up = person.orderBy("_key._range").rowsBetween(*_UP)
    fold = {x: F.min(x) if x.startswith("first") else F.max(x) for x in whole}
    parts = parts.select(
        "_key",
        *[F.coalesce(F.sum(f"_{x}").over(up), F.lit(0)).alias(f"_part_{x}") for x in sums],
        *[F.sum(f"_{x}").over(person).alias(x) for x in sums],
        *[v.over(person).alias(x) for x, v in fold.items()],
    )
    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(*_UP)
    within = {f"_before_{x}": F.coalesce(F.sum(f"_{x}").over(inside), F.lit(0)) for x in sums}
    out = dealt.withColumns(within).join(parts, "_key")
    out = out.withColumns({f"_before_{x}": F.col(f"_before_{x}") + F.col(f"_part_{x}") for x in sums})
    return out.drop("_key", "_range", *[f"_{x}" for x in sums], *[f"_part_{x}" for x in sums])


def _placed_whole(rows: DataFrame, order: list[str], sums: dict[str, Column], whole: dict[str, Column]) -> DataFrame:
    """``_placed`` where one task may hold a person's rows: a window by person, and no other shuffle."""
    person = Window.partitionBy("person_id")
    up = person.orderBy(*order).rowsBetween(*_UP)
    before = {f"_before_{x}": F.coalesce(F.sum(v).over(up), F.lit(0)) for x, v in sums.items()}
    return rows.withColumns(
        {**before, **{x: F.sum(v).over(person) for x, v in sums.items()}, **{x: v.over(person) for x, v in whole.items()}}
    )


def _short(rows: DataFrame) -> bool:
    """Whether one task can number each person; two numbers are read for that, now."""
    found = rows.groupBy("person_id").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found["most"] is None or (found["most"] <= WHOLE and found["most"] * tasks <= found["all"])


def numbered_events(
    events: DataFrame, patients: DataFrame | None = None, min_days: int | None = None, save: Save = materialise
) -> DataFrame:
    """Raw ``person_id, date, general_event_token`` events with day-0 rows, days and places, in long form.

    ``person_id, date, day, token, copies, first`` (elements before it), ``events_before`` and the numbers
    of its person. Equal elements are one row with their ``copies`` where a person is long, else a row each.
    ``min_days`` keeps persons whose events span so many. ``events`` are read twice, so they should be stored.
    """
    rows = events.filter(F.col("general_event_token").isNotNull()).select(
        "person_id", "date", F.lit(1).alias("_event"), "general_event_token"
    )
    if patients is not None:
        base = baseline_rows(patients).select("person_id", "date", F.lit(0).alias("_event"), "general_event_token")
        rows = rows.unionByName(base)
    is_event = (F.col("_event") == 1) & F.col("date").isNotNull()
    sums = {
        "total": F.col("copies"),
        "events_total": F.when(is_event, F.col("copies")).otherwise(0),
        "base_total": F.when(F.col("_event") == 0, F.col("copies")).otherwise(0),
    }
    own = F.when(F.col("_event") == 1, F.col("date"))
    whole = {"first_date": F.min(own), "last_date": F.max(own)}
    order = ["date", "_event", "general_event_token"]
    if _short(rows):
        placed = _placed_whole(rows.withColumn("copies", F.lit(1).cast("bigint")), order, sums, whole)
    else:
        counted = rows.groupBy("person_id", *order).agg(F.count("*").alias("copies"))
        placed = _placed(counted, order, sums, whole, save)
    placed = placed.filter(F.col("first_date").isNotNull())
    last = (F.datediff("last_date", "first_date") + 1).cast("int")
    if min_days is not None:
        placed = placed.filter(last >= min_days)
    day = F.when(F.col("_event") == 1, F.datediff("date", "first_date") + 1).otherwise(0)
    age = F.concat(F.lit("AGE:"), age_in_years(F.col("first_date"), F.col("date")))
    waiting = (F.col("_event") == 0) & (F.col("general_event_token") == "AGE")
    return placed.select(
        "person_id",
        "date",
        day.cast("int").alias("day"),
        F.when(waiting, age).otherwise(F.col("general_event_token")).alias("token"),
        "copies",
        F.col("_before_total").alias("first"),
        F.col("_before_events_total").alias("events_before"),
        "total",
        "events_total",
        "base_total",
        last.alias("last_day"),
    )


def to_blocks(numbered: DataFrame, size: int = BLOCK_SIZE) -> DataFrame:
    """Blocks of ``size`` elements from ``numbered_events``; copies of an element may span several."""
    end = F.col("first") + F.col("copies")
    blocks = F.sequence(F.floor(F.col("first") / size), F.floor((end - 1) / size))
    rows = numbered.withColumn("block", F.explode(blocks))
    start = F.greatest(F.col("first"), F.col("block") * size)
    here = F.least(end, (F.col("block") + 1) * size) - start
    is_event = F.coalesce(F.col("day") != 0, F.lit(False))
    skipped = F.when(is_event, start - F.col("first")).otherwise(0)
    rows = rows.withColumns({"_start": start, "_here": here, "_seen": F.col("events_before") + skipped})
    element = sequence_element(F.col("date"), F.col("day"), F.col("token"))
    gathered = rows.groupBy("person_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("_start", F.col("_here").cast("int").alias("_here"), element.alias("_e")))).alias("_rows"),
        F.min("_seen").alias("events_before"),
        F.sum(F.when(is_event, F.col("_here")).otherwise(0)).alias("events"),
        *[F.max(c).alias(c) for c in PERSON],
    )
    seq = F.flatten(F.transform("_rows", lambda x: F.array_repeat(x["_e"], x["_here"])))
    return gathered.select(
        "person_id", "block", (F.col("block") * size).alias("first"), "events_before", "events", *PERSON, seq.alias("seq")
    )


def build_blocks(
    events: DataFrame,
    patients: DataFrame | None = None,
    min_days: int | None = None,
    size: int = BLOCK_SIZE,
    save: Save = materialise,
) -> DataFrame:
    """Blocks of raw events: what ``timeline.build_sequences`` gives, in rows of at most ``size`` elements."""
    return to_blocks(numbered_events(events, patients, min_days, save), size)


def one_row(blocks: DataFrame) -> DataFrame:
    """The plain form, one row a person, as long as the history."""
    return _together(blocks.select("person_id", "block", "seq"), ["person_id"])


def _together(parts: DataFrame, keys: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("block", "seq")))
    return parts.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda x: x["seq"])).alias("seq"))


def _chosen(blocks: DataFrame, cut: Column, low: Column, high: Column) -> DataFrame:
    """``person_id, cut, seq``: whole sequences, or where ``cut`` the day-0 elements and the events from place ``low`` to before ``high``.

    Blocks that hold nothing wanted are dropped before anything is gathered.
    """
    work = blocks.withColumns({"_cut": cut, "_low": low, "_high": high})
    meets = (F.col("events_before") < F.col("_high")) & (F.col("events_before") + F.col("events") > F.col("_low"))
    has_base = F.exists("seq", lambda x: x["day"] == 0)
    work = work.filter(~F.col("_cut") | meets | has_base)
    events = F.filter("seq", lambda x: x["day"] != 0)
    start = F.greatest(F.col("_low") - F.col("events_before"), F.lit(0)).cast("int")
    stop = F.least(F.col("_high") - F.col("events_before"), F.col("events")).cast("int")
    taken = F.when(F.col("_cut"), F.slice(events, start + 1, F.greatest(stop - start, F.lit(0)))).otherwise(F.col("seq"))
    base = F.when(F.col("_cut"), F.filter("seq", lambda x: x["day"] == 0)).otherwise(F.slice("seq", 1, 0))
    ordered = F.array_sort(F.collect_list(F.struct("block", base.alias("base"), taken.alias("seq"))))
    gathered = work.groupBy("person_id", "_cut").agg(ordered.alias("_p"))
    both = F.concat(F.flatten(F.transform("_p", lambda x: x["base"])), F.flatten(F.transform("_p", lambda x: x["seq"])))
    return gathered.select("person_id", F.col("_cut").alias("cut"), both.alias("seq"))


def trim_length(blocks: DataFrame, max_length: int) -> DataFrame:
    """``sequence.trim_length`` of each person, one row of at most ``max_length - 1`` elements.

    (More only where a person has more day-0 elements than that.)
    """
    keep = F.greatest(F.lit(max_length - 1) - F.col("base_total"), F.lit(0))
    low = F.greatest(F.col("events_total") - keep, F.lit(0))
    rows = _chosen(blocks, F.col("total") >= max_length - 1, low, F.col("events_total"))
    return sq.trim_length(rows.drop("cut"), max_length)


def random_window(blocks: DataFrame, max_length: int, max_position: int, seed: str | int) -> DataFrame:
    """``sequence.random_window`` of each person, one row of at most ``max_length`` elements."""
    width = F.least(F.greatest(F.lit(max_length) - F.col("base_total"), F.lit(0)), F.col("events_total"))
    low = F.floor(keyed_uniform(seed, "person_id") * (F.col("events_total") - width + 1))
    rows = _chosen(blocks, F.col("total") > max_length, low, low + width)
    return sq.settle_window(rows, max_position, "cut")


def trim_position(blocks: DataFrame, max_position: int, save: Save = materialise) -> DataFrame:
    """``sequence.trim_position`` in blocks: the last ``max_position - 1`` days of a person who goes past them.

    Day-0 elements stay in their blocks, events of the first kept day become day 1 and the age is
    restated. Emptied blocks leave; the others keep their numbers, and their counts are those of what is left.
    """
    cut = F.col("last_day") >= max_position
    bound = F.col("last_day") - (max_position - 1)
    kept = F.when(cut, F.filter("seq", lambda x: (x["day"] == 0) | (x["day"] > bound))).otherwise(F.col("seq"))
    work = save(blocks.withColumn("seq", kept).filter(F.size("seq") > 0), "kept")
    events = F.filter("seq", lambda x: x["day"] != 0)
    birth = F.array_min(F.transform(F.filter("seq", lambda x: x["day"] == 0), lambda x: x["date"]))
    # Rows without their elements: only these meet by person.
    counts = work.select(
        "person_id",
        "block",
        F.size("seq").cast("bigint").alias("_n"),
        F.size(events).cast("bigint").alias("events"),
        F.get(events, F.lit(0)).alias("_e"),
        birth.alias("_birth"),
    )
    person = Window.partitionBy("person_id")
    up = person.orderBy("block").rowsBetween(*_UP)
    counts = counts.select(
        F.struct("person_id", "block").alias("_key"),
        F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("first"),
        F.coalesce(F.sum("events").over(up), F.lit(0)).alias("events_before"),
        "events",
        F.sum("_n").over(person).alias("total"),
        F.sum("events").over(person).alias("events_total"),
        F.min_by("_e", F.when(F.col("_e").isNotNull(), F.col("block"))).over(person).alias("_e"),
        F.min("_birth").over(person).alias("_birth"),
    )
    replaced = ["first", "events_before", "events", "total", "events_total"]
    # Nulls are equal in a struct, so a null person stays.
    joined = work.drop(*replaced).withColumn("_key", F.struct("person_id", "block")).join(counts, "_key").withColumn("_cut", cut)
    age = F.concat(F.lit("AGE:"), age_in_years(F.col("_e.date"), F.col("_birth")).cast("string"))
    joined = joined.withColumns({"_age": age, "_by": F.col("_e.day") - 1})

    def settled(x: Column) -> Column:
        old = x["token"].startswith("AGE") & F.col("_age").isNotNull()
        return sequence_element(
            x["date"], F.when(x["day"] == 0, 0).otherwise(x["day"] - F.col("_by")), F.when(old, F.col("_age")).otherwise(x["token"])
        )

    seq = F.when(F.col("_cut"), F.transform("seq", settled)).otherwise(F.col("seq"))
    last = F.when(F.col("_cut"), F.col("last_day") - F.col("_by")).otherwise(F.col("last_day"))
    out = joined.withColumns({"seq": seq, "last_day": last.cast("int")})
    return out.select("person_id", "block", "first", "events_before", "events", *PERSON, "seq")


def meds_blocks(numbered: DataFrame, size: int = BLOCK_SIZE, save: Save = materialise) -> DataFrame:
    """The nested format of ``meds.to_meds`` in blocks of ``size`` measurements, from ``numbered_events``.

    ``person_id, block, first`` (measurements before), ``continued`` and ``events``. A calendar day with
    more measurements than a block has room for goes on in the next one: there ``continued`` is true and
    the first event repeats the day's time, so the parts of a day can be put together.
    """
    token = F.when(F.col("token") == meds.BIRTH_IN, meds.BIRTH_OUT).otherwise(F.col("token"))
    rows = numbered.withColumn("token", token).withColumn("on", F.to_date("date"))
    once = rows.groupBy("person_id", "on", "token").agg(F.min(F.struct("first", "date", "day")).alias("_x"))
    once = once.select("person_id", F.col("_x.first").alias("_place"), F.col("_x.date").alias("date"), F.col("_x.day").alias("day"), "token")
    placed = _placed(once, ["_place"], {"n": F.lit(1).cast("bigint")}, {}, save)
    element = sequence_element(F.col("date"), F.col("day"), F.col("token"))
    block = F.floor(F.col("_before_n") / size).alias("block")
    gathered = placed.groupBy("person_id", block).agg(
        F.array_sort(F.collect_list(F.struct("_before_n", element.alias("_e")))).alias("_rows")
    )
    blocks = save(gathered.select("person_id", "block", F.transform("_rows", lambda x: x["_e"]).alias("seq")), "meds")

    def on(x: Column) -> Column:
        return F.to_date(x["date"])

    last = F.element_at("seq", -1)
    days = blocks.select(
        "person_id",
        "block",
        on(F.col("seq")[0]).alias("_from"),
        on(last).alias("_to"),
        F.get(F.filter("seq", lambda x: on(x).eqNullSafe(on(last))), F.lit(0))["date"].alias("_start"),
    )
    person = Window.partitionBy("person_id").orderBy("block")
    continued = F.coalesce(F.lag(F.struct("_to")).over(person).eqNullSafe(F.struct(F.col("_from").alias("_to"))), F.lit(False))
    days = days.withColumn("continued", continued)
    begins = ~(F.col("continued") & F.col("_from").eqNullSafe(F.col("_to")))
    opened = F.last(F.when(begins, F.struct("_start")), ignorenulls=True).over(person.rowsBetween(*_UP))
    days = days.withColumn("_time", F.when(F.col("continued"), opened["_start"]))
    days = days.select(F.struct("person_id", "block").alias("_key"), "continued", "_time")
    nested = meds.to_meds(blocks, ["person_id", "block"]).withColumn("_key", F.struct("person_id", "block")).join(days, "_key")
    timed = F.transform(
        "events",
        lambda e, i: F.struct(
            F.when((i == 0) & F.col("continued"), F.col("_time")).otherwise(e["time"]).alias("time"),
            e["measurements"].alias("measurements"),
        ),
    )
    return nested.select("person_id", "block", (F.col("block") * size).alias("first"), "continued", timed.alias("events"))
