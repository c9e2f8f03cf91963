"""Array operators on one person's ordered ``seq``: trims, labels, encoding, batches, masking.

Everything is a higher-order function on the row's own array: no shuffle, no Python.
Each step is its own projection so that an array is computed once and then referred to.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medstrand.functions.codes import is_label
from medstrand.functions.keyed import keyed_hash, keyed_uniform
from medstrand.operators.scale import hash_rank, running_totals, salted_join
from medstrand.operators.timeline import age_in_years, event_positions
from medstrand.operators.vocab import CLS, MASK, UNK
from medstrand.schema import sequence_element

# Rows of a person up to which one task cuts all of their label samples.
WHOLE = 65_536


def _baseline(seq: str | Column) -> Column:
    return F.filter(seq, lambda x: x["day"] == 0)


def _events(seq: str | Column) -> Column:
    return F.filter(seq, lambda x: x["day"] != 0)


def _shift(seq: str | Column, by: Column) -> Column:
    return F.transform(seq, lambda x: sequence_element(x["date"], x["day"] + by, x["token"]))


def _rebased(events: str | Column) -> Column:
    """Events shifted so that the first day is 1."""
    first = F.array_min(F.transform(events, lambda x: x["day"]))
    return _shift(events, 1 - first)


def _last(events: str, keep: Column) -> Column:
    """The last ``keep`` elements (all of them when there are fewer)."""
    count = F.least(F.greatest(keep, F.lit(0)), F.size(events))
    return F.slice(events, F.size(events) - count + 1, count)


def baseline_first(df: DataFrame) -> DataFrame:
    """Day-0 elements first; order otherwise kept."""
    return df.withColumn("seq", F.concat(_baseline("seq"), _events("seq")))


def _correct_age(df: DataFrame, when: Column | None = None) -> DataFrame:
    first_event = F.get(_events("seq"), F.lit(0))["date"]
    birth = F.array_min(F.transform(_baseline("seq"), lambda x: x["date"]))
    age = F.concat(F.lit("AGE:"), age_in_years(F.col("_from"), F.col("_birth")).cast("string"))
    dated = df.withColumns({"_from": first_event, "_birth": birth}).withColumn("_age", age)
    renamed = F.transform(
        "seq",
        lambda x: sequence_element(
            x["date"], x["day"], F.when(x["token"].startswith("AGE"), F.col("_age")).otherwise(x["token"])
        ),
    )
    wanted = F.col("_age").isNotNull() if when is None else F.col("_age").isNotNull() & when
    return dated.withColumn("seq", F.when(wanted, renamed).otherwise(F.col("seq"))).drop(
        "_from", "_birth", "_age"
    )


def correct_age(df: DataFrame) -> DataFrame:
    """``AGE`` tokens restated for the first event still in the sequence, from the birth date at day 0."""
    return _correct_age(df)


def trim_length(df: DataFrame, max_length: int) -> DataFrame:
    """Keep day-0 elements and the latest others so that ``max_length - 1`` remain, room for ``[CLS]``.

    Shorter sequences are left as they are; in trimmed ones the first day becomes 1 and the age is corrected.
    """
    cut = df.withColumns(
        {"_b": _baseline("seq"), "_e": _events("seq"), "_cut": F.size("seq") >= max_length - 1}
    ).withColumn("_e", _last("_e", F.lit(max_length - 1) - F.size("_b")))
    cut = cut.withColumn(
        "seq", F.when(F.col("_cut"), F.concat("_b", _rebased("_e"))).otherwise(F.col("seq"))
    )
    return _correct_age(cut, F.col("_cut")).drop("_b", "_e", "_cut")


def trim_position(df: DataFrame, max_position: int) -> DataFrame:
    """Keep the events of the last ``max_position - 1`` days when the last day is at or past ``max_position``."""
    last = F.array_max(F.transform("seq", lambda x: x["day"]))
    cut = df.withColumn("_top", F.coalesce(last, F.lit(0))).withColumn("_cut", F.col("_top") >= max_position)
    cut = cut.withColumns({"_b": _baseline("seq"), "_e": _events("seq")})
    shifted = _shift("_e", F.lit(max_position - 1) - F.col("_top"))
    cut = cut.withColumn("_e", F.filter(shifted, lambda x: x["day"] > 0))
    cut = cut.withColumn(
        "seq", F.when(F.col("_cut"), F.concat("_b", _rebased("_e"))).otherwise(F.col("seq"))
    )
    return _correct_age(cut, F.col("_cut")).drop("_top", "_b", "_e", "_cut")


def random_window(
    df: DataFrame, max_length: int, max_position: int, seed: str | int, keys: Sequence[str] = ("person_id",)
) -> DataFrame:
    """Keep day-0 elements and a random full window of consecutive events, then trim by day."""
    cut = df.withColumns(
        {"_b": _baseline("seq"), "_e": _events("seq"), "_long": F.size("seq") > max_length}
    )
    width = F.greatest(F.lit(max_length) - F.size("_b"), F.lit(0))
    cut = cut.withColumn("_w", F.least(width, F.size("_e")))
    start = F.floor(keyed_uniform(seed, *keys) * (F.size("_e") - F.col("_w") + 1)).cast("int")
    chosen = F.concat("_b", F.slice("_e", start + 1, F.col("_w")))
    cut = cut.withColumn("seq", F.when(F.col("_long"), chosen).otherwise(F.col("seq"))).drop("_b", "_e", "_w")
    return settle_window(cut, max_position, "_long")


def dedupe_consecutive(df: DataFrame) -> DataFrame:
    """Of consecutive elements with equal token and day, keep the last."""
    def differs(x: Column, i: Column) -> Column:
        following = F.get(F.col("seq"), i + 1)
        same = (following["token"] == x["token"]) & (following["day"] == x["day"])
        return ~F.coalesce(same, F.lit(False))

    return df.withColumn("seq", F.filter("seq", differs))


def label_index(df: DataFrame, label: int | None = None) -> DataFrame:
    """One row per label of each sequence: its ordinal, position and value."""
    marks = F.filter(
        F.transform("seq", lambda x, i: F.struct(i.alias("pos"), x["token"].alias("token"))),
        lambda m: is_label(m["token"]),
    )
    rest = [F.col(c) for c in df.columns if c != "seq"]
    found = df.select(*rest, F.posexplode(marks).alias("label_count", "_m"))
    value = F.expr("try_cast(get(split(_m.token, ':'), 1) as int)")
    found = found.withColumn("label", value).withColumn("label_position", F.col("_m.pos")).drop("_m")
    return found if label is None else found.filter(F.col("label") == label)


def label_event_count(df: DataFrame, label: int | None = None) -> DataFrame:
    """Number of labels in the dataset, or of one class."""
    wanted = is_label if label is None else (lambda t: t == f"LABEL:{label}")
    per_row = F.size(F.filter("seq", lambda x: wanted(x["token"])))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint").alias("n_labels"))


def label_samples(
    df: DataFrame, label: int | None = None, recent: int | None = None, drop_repeats: bool = False
) -> DataFrame:
    """One row per label with the non-label history before it, in ``seq``.

    With ``recent``, day-0 elements and only the last ``recent`` others are copied into each row,
    which is all a later length trim can keep: the rows stay bounded while the labels multiply.
    ``drop_repeats`` removes consecutive repeats before that cut. It keeps the first of a run
    where ``dedupe_consecutive`` keeps the last; both have the same token and day, and a run cut
    by a label then needs no second look.
    """
    indexed = F.transform("seq", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    rest = [c for c in df.columns if c != "seq"]
    work = df.withColumn("_all", F.filter(indexed, lambda y: ~F.coalesce(is_label(y["x"]["token"]), F.lit(False))))
    if drop_repeats:
        def is_new(y: Column, i: Column) -> Column:
            before = F.get(F.col("_all"), i - 1)["x"]
            same = (before["token"] == y["x"]["token"]) & (before["day"] == y["x"]["day"])
            return (i == 0) | ~F.coalesce(same, F.lit(False))

        work = work.withColumn("_all", F.filter("_all", is_new))
    marks = F.filter(
        F.transform("seq", lambda x, i: F.struct(i.alias("pos"), x["token"].alias("token"))),
        lambda m: is_label(m["token"]),
    )
    if recent is None:
        work = work.select(*rest, "_all", F.posexplode(marks).alias("label_count", "_m"))
        before = F.filter("_all", lambda y: y["i"] < F.col("_m.pos"))
    else:
        work = work.select(
            *rest,
            F.filter("_all", lambda y: y["x"]["day"] == 0).alias("_b"),
            F.filter("_all", lambda y: y["x"]["day"] != 0).alias("_e"),
            marks.alias("_marks"),
        )
        # Cut inside the array of labels, so the explode copies only what each label keeps.
        def sample(m: Column) -> Column:
            seen = F.size(F.filter("_e", lambda y: y["i"] < m["pos"]))
            keep = F.least(seen, F.lit(recent))
            base = F.filter("_b", lambda y: y["i"] < m["pos"])
            return F.struct(
                m["token"].alias("token"),
                F.concat(base, F.slice("_e", seen - keep + 1, keep)).alias("before"),
            )

        work = work.select(*rest, F.posexplode(F.transform("_marks", sample)).alias("label_count", "_m"))
        before = F.array_sort("_m.before")
    value = F.expr("try_cast(get(split(_m.token, ':'), 1) as int)")
    samples = work.select(
        *rest, "label_count", value.alias("label"), F.transform(before, lambda y: y["x"]).alias("seq")
    )
    return samples if label is None else samples.filter(F.col("label") == label)


def with_cls(df: DataFrame) -> DataFrame:
    """Put ``[CLS]`` at day 0 in front unless it is there already."""
    head = F.array(sequence_element(F.lit(None), F.lit(0), F.lit(CLS)))
    starts = F.coalesce(F.get(F.col("seq"), F.lit(0))["token"] == CLS, F.lit(False))
    return df.withColumn("seq", F.when(starts, F.col("seq")).otherwise(F.concat(head, F.col("seq"))))


def percentile_type_ids(df: DataFrame, step: int) -> DataFrame:
    """Tokens cut to ``TYPE:CODE`` and ``token_type_ids`` = upper percentile bound div ``step``, else 0.

    A band whose lower bound is not a multiple of ``step`` fails the job.
    """
    def type_id(x: Column) -> Column:
        band = F.element_at(F.split(x["token"], ":"), -1)
        lower = F.get(F.split(band, "-"), F.lit(0)).try_cast("int")
        upper = F.get(F.split(band, "-"), F.lit(1)).try_cast("int")
        off_step = F.raise_error(F.concat(F.lit("percentile band off the step: "), x["token"])).cast("int")
        in_step = F.when(lower % step == 0, F.floor(upper / step).cast("int")).otherwise(off_step)
        return F.when(F.size(F.split(x["token"], ":")) > 2, in_step).otherwise(0)

    return df.withColumn("token_type_ids", F.transform("seq", type_id)).withColumn(
        "seq",
        F.transform(
            "seq",
            lambda x: sequence_element(x["date"], x["day"], F.substring_index(x["token"], ":", 2)),
        ),
    )


def encode(
    df: DataFrame,
    vocabulary: DataFrame,
    max_length: int,
    keys: Sequence[str] = ("person_id",),
    percentile_step: int | None = None,
    add_cls: bool = True,
    single_age_token: bool = False,
) -> DataFrame:
    """``input_ids, position_ids, attention_mask`` (and ``token_type_ids``) of each sequence.

    Arrays are cut to ``max_length`` before the tokens become rows, so each row gathers back a
    bounded number of ids. Common tokens are hot keys, so the vocabulary meets salted tokens.
    Unknown tokens take the id of ``[UNK]``. ``keys`` identify a row.
    """
    keys = list(keys)
    work = with_cls(df) if add_cls else df
    if percentile_step is None:
        work = work.withColumn("token_type_ids", F.transform("seq", lambda x: F.lit(0)))
    else:
        work = percentile_type_ids(work, percentile_step)
    rest = [c for c in df.columns if c not in ("seq", *keys)]
    cut = F.slice(F.arrays_zip("seq", "token_type_ids"), 1, max_length)
    items = work.select(*keys, *rest, F.posexplode_outer(cut).alias("_pos", "_x")).select(
        *keys, *rest, "_pos",
        F.col("_x.seq.day").alias("_day"),
        F.col("_x.seq.token").alias("token"),
        F.col("_x.token_type_ids").alias("_type"),
    )
    if single_age_token:
        items = items.withColumn(
            "token", F.when(F.col("token").startswith("AGE:"), "AGE").otherwise(F.col("token"))
        )
    unknown = vocabulary.filter(F.col("token") == UNK).agg(F.max("id")).scalar()
    found = salted_join(items, vocabulary.select("token", "id"), ["token"], "left")
    found = found.withColumn("id", F.coalesce("id", unknown))
    item = F.struct("_pos", "id", "_day", "_type")
    rows = found.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), item))).alias("_items"),
        *[F.first(c).alias(c) for c in rest],
    )
    columns = [
        F.transform("_items", lambda y: y["id"]).alias("input_ids"),
        F.transform("_items", lambda y: y["_day"]).alias("position_ids"),
        F.transform("_items", lambda y: F.lit(1)).alias("attention_mask"),
    ]
    if percentile_step is not None:
        columns.append(F.transform("_items", lambda y: y["_type"]).alias("token_type_ids"))
    return rows.select(*keys, *rest, *columns)


def dataset_length(files: DataFrame, fraction: float | None = None, file: str = "file") -> DataFrame:
    """Rows of the dataset; with ``fraction`` each file counts ``floor(rows * fraction)``."""
    per_file = files.groupBy(file).agg(F.count("*").alias("n"))
    amount = F.col("n") if fraction is None else F.floor(F.col("n") * F.lit(fraction))
    return per_file.agg(F.coalesce(F.sum(amount), F.lit(0)).cast("bigint").alias("length"))


def _padded(column: str, length: Column, fill: int = 0) -> Column:
    return F.concat(column, F.array_repeat(F.lit(fill), length - F.size(column)))


ENCODED = ("input_ids", "position_ids", "attention_mask", "token_type_ids")


def pad_batches(
    encoded: DataFrame, batch_size: int, seed: str | int, keys: Sequence[str] = ("person_id",)
) -> DataFrame:
    """Group rows into batches in hash order and right-pad each array with 0 to the batch's longest."""
    ranked = hash_rank(encoded.withColumn("_h", keyed_hash(seed, *keys)), "_h", list(keys), out="_rank")
    batched = ranked.withColumn("batch_id", F.floor((F.col("_rank") - 1) / batch_size)).drop("_h", "_rank")
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch_id"))  # batch_size rows each
    sized = batched.withColumn("_length", longest)
    present = [c for c in ENCODED if c in encoded.columns]
    return sized.withColumns({c: _padded(c, F.col("_length")) for c in present}).drop("_length")


def mask_tokens(
    encoded: DataFrame,
    vocabulary: DataFrame,
    length: int,
    seed: str | int,
    keys: Sequence[str] = ("person_id",),
    prediction_fraction: float = 0.15,
    masking_fraction: float = 0.8,
    random_fraction: float = 0.1,
) -> DataFrame:
    """Masked-token rows of fixed ``length``: changed ``input_ids`` and ``labels``, -100 where not predicted."""
    if masking_fraction + random_fraction > 1.0:
        raise ValueError("masking and random fractions must not exceed 1")
    mask_id = vocabulary.filter(F.col("token") == MASK).agg(F.max("id")).scalar()
    ordinary = ~F.col("token").startswith("[") & ~F.col("token").endswith("]")
    # One array of at most the vocabulary's size, which the vocabulary limit bounds.
    pool = vocabulary.filter(ordinary).agg(F.array_sort(F.collect_list("id"))).scalar()

    def draw(kind: str, i: Column) -> Column:
        return keyed_uniform(f"{seed}-{kind}", *keys, i)

    work = encoded.withColumns({"_pool": pool, "_mask": mask_id})
    decided = F.transform(
        "input_ids",
        lambda x, i: F.struct(
            x.alias("id"), (draw("pick", i) < prediction_fraction).alias("chosen"), draw("kind", i).alias("u"),
            F.floor(draw("word", i) * F.size("_pool")).cast("int").alias("word"),
        ),
    )
    work = work.withColumn("_d", decided)

    def changed(d: Column) -> Column:
        return (
            F.when(~d["chosen"], d["id"])
            .when(d["u"] <= masking_fraction, F.col("_mask"))
            .when(d["u"] < masking_fraction + random_fraction, F.get(F.col("_pool"), d["word"]))
            .otherwise(d["id"])
        )

    work = work.withColumns(
        {
            "input_ids": F.transform("_d", changed),
            "labels": F.transform("_d", lambda d: F.when(d["chosen"], d["id"]).otherwise(-100)),
        }
    )
    present = [c for c in ENCODED if c in encoded.columns]
    padded = {c: _padded(c, F.lit(length)) for c in present}
    padded["labels"] = _padded("labels", F.lit(length), -100)
    return work.withColumns(padded).drop("_pool", "_mask", "_d")


def recent_events(
    aligned: DataFrame, keep: int, keys: Sequence[str] = ("person_id",)
) -> DataFrame:
    """Day-0 rows and the last ``keep`` other events of each person, from long form.

    For a length trim this gives the same result as trimming the whole sequence. The row-number
    limit is applied in each task before the shuffle, so a very long person sends ``keep`` rows
    per task and its sequence can then be collected safely.
    """
    present = aligned.filter(F.col("general_event_token").isNotNull())
    window = Window.partitionBy(*keys).orderBy(
        F.desc("date"), F.desc("days_since_begin"), F.desc("general_event_token")
    )
    events = present.filter("days_since_begin <> 0").withColumn("_rank", F.row_number().over(window))
    kept = events.filter(F.col("_rank") <= keep).drop("_rank")
    return present.filter("days_since_begin = 0").unionByName(kept)


def oldest_events(aligned: DataFrame, keep: int, keys: Sequence[str] = ("person_id",)) -> DataFrame:
    """The first ``keep`` rows of each person's order, limited in each task before the shuffle."""
    present = aligned.filter(F.col("general_event_token").isNotNull())
    window = Window.partitionBy(*keys).orderBy("date", "days_since_begin", "general_event_token")
    ranked = present.withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") <= keep).drop("_rank")


def window_events(
    aligned: DataFrame, max_length: int, seed: str | int, save: Callable[[DataFrame, str], DataFrame] | None = None
) -> DataFrame:
    """Long form of ``random_window``'s choice: day-0 rows and a random full window of the others.

    Positions come from ``event_positions``, so a very long person is ranked by many tasks and
    only ``max_length`` of its rows remain. ``windowed`` tells whose events were cut, as
    ``settle_window`` needs to know. Counts, positions and choice all read the rows; ``save`` may store them.
    """
    present = aligned.filter(F.col("general_event_token").isNotNull())
    if save is not None:
        present = save(present, "present")
    base, events = present.filter("days_since_begin = 0"), present.filter("days_since_begin <> 0")
    counts = present.groupBy("person_id").agg(
        F.count(F.when(F.col("days_since_begin") == 0, 1)).alias("_b"),
        F.count(F.when(F.col("days_since_begin") != 0, 1)).alias("_n"),
    )
    width = F.least(F.greatest(F.lit(max_length) - F.col("_b"), F.lit(0)), F.col("_n"))
    counts = counts.withColumn(
        "_w", F.when(F.col("_b") + F.col("_n") > max_length, width).otherwise(F.col("_n"))
    ).withColumn("_off", F.floor(keyed_uniform(seed, "person_id") * (F.col("_n") - F.col("_w") + 1)))
    counts = counts.withColumn("windowed", F.col("_b") + F.col("_n") > max_length)
    placed = event_positions(events).join(counts, "person_id")
    kept = placed.filter((F.col("position") >= F.col("_off")) & (F.col("position") < F.col("_off") + F.col("_w")))
    base = base.join(counts.select("person_id", "windowed"), "person_id")
    return base.unionByName(kept.select(*base.columns))


def settle_window(df: DataFrame, max_position: int, windowed: str = "windowed") -> DataFrame:
    """What follows the choice of a window: its first day becomes 1, it is trimmed by day, the age corrected."""
    cut = df.withColumns({"_b": _baseline("seq"), "_e": _events("seq"), "_long": F.col(windowed)})
    cut = cut.withColumn(
        "seq", F.when(F.col("_long"), F.concat("_b", _rebased("_e"))).otherwise(F.col("seq"))
    ).drop("_b", "_e")
    trimmed = trim_position(cut.withColumn("_kept", F.col("seq")), max_position)
    trimmed = trimmed.withColumn(
        "seq", F.when(F.col("_long"), F.col("seq")).otherwise(F.col("_kept"))
    ).drop("_kept")
    return _correct_age(trimmed, F.col("_long")).drop("_long", windowed)


def label_samples_from_events(
    aligned: DataFrame,
    recent: int,
    label: int | None = None,
    drop_repeats: bool = False,
    save: Callable[[DataFrame, str], DataFrame] | None = None,
    tie: str = "general_event_token",
    always: Callable[[Column], Column] | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """``label_samples(recent=...)`` straight from long form, for persons of any length.

    Events are numbered in order and put in blocks of ``recent``; a label needs its own block and
    the one before. Each block is gathered once, with the one before, and every label cuts its sample
    from that row, so events are not repeated by label. Events whose token ``always`` accepts are gathered
    whatever their age. ``tie`` is the column that orders equal dates and days.

    With ``save``, which stores its argument, rows are counted first: see ``label_sample_parts``. Without it, and with
    ``always``, all persons are numbered by person and day and joined by person and block, so no task holds a person.
    """
    if save is None or always is not None:
        rows = aligned.filter(F.col("general_event_token").isNotNull())
        return _samples_by_block(rows, recent, label, drop_repeats, save, tie, always)
    return reduce(DataFrame.unionByName, label_sample_parts(aligned, recent, save, label, drop_repeats, tie, counted))


def label_sample_parts(
    aligned: DataFrame,
    recent: int,
    save: Callable[[DataFrame, str], DataFrame],
    label: int | None = None,
    drop_repeats: bool = False,
    tie: str = "general_event_token",
    counted: DataFrame | None = None,
) -> list[DataFrame]:
    """The samples of ``label_samples_from_events`` in parts: of persons one task may hold, and of the others if there are any.

    The first part takes one shuffle by person and stays together by person, so what follows by person and label
    need not shuffle it again. The rows are read twice: ``save`` stores them, unless ``counted``, rows of which a
    person has no fewer, is given as well.
    """
    rows = aligned.filter(F.col("general_event_token").isNotNull())
    if counted is None:
        counted = rows = save(rows, "rows")
    held = _held_by_no_task(counted, save)
    if held is None:
        return [_samples_by_person(rows, recent, label, drop_repeats, tie)]
    on = F.col("person_id").eqNullSafe(F.col("_held"))
    return [
        _samples_by_person(rows.join(held, on, "left_anti"), recent, label, drop_repeats, tie),
        _samples_by_block(rows.join(held, on, "left_semi"), recent, label, drop_repeats, save, tie),
    ]


def _held_by_no_task(rows: DataFrame, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame | None:
    """``_held``: persons with more than ``WHOLE`` rows or more than a task's share of all, and null; None if there are none."""
    counts = rows.groupBy("person_id").count()
    found = counts.agg(F.max("count").alias("most"), F.sum("count").alias("all"), F.count_if(F.col("person_id").isNull()).alias("nulls")).first()
    if found["most"] is None:
        return None
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = min(WHOLE, found["all"] // tasks)
    if found["most"] <= limit and not found["nulls"]:
        return None
    held = counts.filter((F.col("count") > limit) | F.col("person_id").isNull()).select(F.col("person_id").alias("_held"))
    # At most one for each task and each ``WHOLE`` rows.
    return F.broadcast(save(held, "held"))


def _samples_by_person(rows: DataFrame, recent: int, label: int | None, drop_repeats: bool, tie: str) -> DataFrame:
    """Label samples where one task may hold a person's rows: they are dealt by person, and nothing is shuffled after."""
    mark, base, is_mark = F.col("_mark"), F.col("_base"), is_label(F.col("general_event_token"))
    rows = rows.filter(is_mark | F.col("days_since_begin").isNotNull()).repartition("person_id")
    rows = rows.withColumns({"_mark": is_mark, "_base": ~is_mark & (F.col("days_since_begin") == 0)})
    if drop_repeats:
        within = Window.partitionBy("person_id", "days_since_begin", "_mark").orderBy("date", tie).rowsBetween(-1, -1)
        rows = rows.withColumn("_before", F.last("general_event_token").over(within))
        rows = rows.filter(mark | base | ~F.col("_before").eqNullSafe(F.col("general_event_token"))).drop("_before")
    person = Window.partitionBy("person_id")
    up = person.orderBy("date", "days_since_begin", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {"_seen": F.sum(F.when(mark | base, 0).otherwise(1)).over(up), "_labels": F.sum(F.when(mark, 1).otherwise(0)).over(up)}
    )
    start = F.when(base, _sample_item(F.lit(0).cast("bigint")))
    rows = rows.withColumn("_start", F.collect_list(start).over(person)).filter(~base)
    value = _label_value()
    wanted = mark if label is None else mark & (value == label)
    block = F.floor((F.col("_seen") - 1) / recent)
    # An event is near labels of its own block and of the next.
    rows = rows.select(
        "person_id",
        F.when(wanted, F.struct("_seen", (F.col("_labels") - 1).alias("label_count"), value.alias("label"))).alias("_m"),
        F.when(wanted, F.col("_start")).alias("_start"),
        F.when(~mark, _sample_item(F.col("_seen"))).alias("_item"),
        F.explode(F.when(mark, F.array(block)).otherwise(F.array(block, block + 1))).alias("_block"),
    )
    gathered = rows.groupBy("person_id", "_block").agg(
        F.collect_list("_m").alias("_marks"), F.array_sort(F.first("_start", ignorenulls=True)).alias("_start"), F.array_sort(F.collect_list("_item")).alias("_near")
    )
    samples = gathered.select("person_id", "_start", "_near", F.explode("_marks").alias("_m"))
    return _cut_samples(samples.select("person_id", "_start", "_near", "_m.*"), recent)


def _label_value() -> Column:
    return F.expr("try_cast(get(split(general_event_token, ':'), 1) as int)")


def _sample_item(at: Column) -> Column:
    return F.struct(
        at.alias("_at"), "date", F.col("days_since_begin").cast("int").alias("day"), F.col("general_event_token").alias("token")
    )


def _cut_samples(samples: DataFrame, recent: int, old: str | None = None) -> DataFrame:
    """Each label's sample from ``_start``, ``old`` and the last ``recent`` of ``_near`` up to ``_seen``."""
    since = F.col("_seen") - recent
    parts = [F.col("_start"), F.filter("_near", lambda x: (x["_at"] > since) & (x["_at"] <= F.col("_seen")))]
    if old is not None:
        parts.insert(1, F.col(old))
    # A label without history keeps an empty sample.
    none = F.slice(F.array(_no_item()), 1, 0)
    seq = F.transform(
        F.concat(*[F.coalesce(x, none) for x in parts]), lambda y: sequence_element(y["date"], y["day"], y["token"])
    )
    return samples.select("person_id", "label_count", "label", seq.alias("seq"))


def _samples_by_block(
    rows: DataFrame,
    recent: int,
    label: int | None,
    drop_repeats: bool,
    save: Callable[[DataFrame, str], DataFrame] | None,
    tie: str,
    always: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Label samples by a numbering and a join by person and block, so no person is held in one task.

    Labels and events both read the numbering; ``save`` may store it and the rows it numbers.
    """
    mark = is_label(F.col("general_event_token"))
    base = rows.filter((F.col("days_since_begin") == 0) & ~mark)
    ordered = rows.filter((F.col("days_since_begin") != 0) | mark)
    if drop_repeats:
        # A repeat has the same day, so looking back inside the day is enough.
        within = Window.partitionBy("person_id", "days_since_begin").orderBy("date", tie)
        events = ordered.filter(~mark).withColumn("_before", F.lag("general_event_token").over(within))
        events = events.filter(~F.col("_before").eqNullSafe(F.col("general_event_token"))).drop("_before")
        ordered = events.unionByName(ordered.filter(mark))
    if save is not None:
        # Totals and numbering both read these rows.
        ordered = save(ordered, "ordered")
    numbered = running_totals(
        ordered,
        order=[("date", True), ("days_since_begin", True), (tie, True)],
        levels=[("_on", F.to_date("date"), True)],
        values={"_seen": F.when(mark, 0).otherwise(1), "_labels": F.when(mark, 1).otherwise(0)},
        by=["person_id"],
    )
    if save is not None:
        numbered = save(numbered, "numbered")
    marks = numbered.filter(mark).select(
        "person_id", "_seen", (F.col("_labels") - 1).alias("label_count"), _label_value().alias("label")
    )
    if label is not None:
        marks = marks.filter(F.col("label") == label)
    block = F.floor((F.col("_seen") - 1) / recent)
    item = _sample_item(F.col("_seen"))
    ordered_items = F.array_sort(F.collect_list("_item")).alias("_items")
    events = numbered.filter(~mark).select("person_id", block.alias("_block"), item.alias("_item"))
    # An event is near labels of its own block and of the next: one row of at most twice ``recent`` events for both.
    near = (
        events.withColumn("_block", F.explode(F.array("_block", F.col("_block") + 1)))
        .groupBy("person_id", "_block")
        .agg(ordered_items.alias("_near"))
    )
    at_start = base.withColumn("_seen", F.lit(0).cast("bigint")).select("person_id", item.alias("_item"))
    at_start = at_start.groupBy("person_id").agg(ordered_items.alias("_start"))
    samples = marks.join(at_start, "person_id", "left").withColumn("_block", block).join(near, ["person_id", "_block"], "left")
    if always is None:
        return _cut_samples(samples, recent)
    old = events.filter(always(F.col("_item.token"))).drop("_block")
    kept = marks.join(old, "person_id").filter(F.col("_item._at") <= F.col("_seen") - recent)
    kept = kept.groupBy("person_id", "label_count").agg(ordered_items.alias("_old"))
    return _cut_samples(samples.join(kept, ["person_id", "label_count"], "left"), recent, "_old")


def _no_item() -> Column:
    """An element with nulls only, for the type of an empty array."""
    kinds = (("_at", "bigint"), ("date", "timestamp"), ("day", "int"), ("token", "string"))
    return F.struct(*[F.lit(None).cast(kind).alias(name) for name, kind in kinds])
