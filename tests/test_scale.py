"""Hot keys, bounded pieces, stable results and plan shapes."""

import glob
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import q_pipelines
from checks import standins as st
from medstrand.functions.keyed import keyed_hash
from medstrand.operators import events as ev
from medstrand.operators import labels, labs, meds, scale, sequence, splits, terms, timeline
from medstrand.plans import rows
from medstrand.plans.base import prepare
from medstrand.sources import sinks


@pytest.fixture(scope="module")
def skewed(spark):
    """One person holds a third of all events."""
    person = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 200).cast("bigint")
    date = F.timestamp_seconds(F.lit(946684800) + (F.col("id") * 7919) % 3000 * 86400)
    return spark.range(6000).select(
        person.alias("person_id"), date.alias("date"), F.concat(F.lit("T:"), F.col("id").cast("string")).alias("general_event_token")
    )


@pytest.fixture(scope="module")
def busy(skewed):
    """A third of all events are one person's, most of them on one day, and labels stand among them."""
    day = F.when((F.col("person_id") == 0) & (F.crc32("general_event_token") % 3 > 0), F.lit("2001-01-01").cast("timestamp"))
    events = skewed.withColumn("date", F.coalesce(day, "date"))
    marks = events.filter("crc32(general_event_token) % 60 = 0").withColumn("general_event_token", F.lit("LABEL:1")).distinct()
    return timeline.align_to_first_date(events.union(marks))


@pytest.fixture(scope="module")
def words(spark):
    tokens = [("[CLS]",), ("[MASK]",), ("[UNK]",), ("LABEL:1",)] + [(f"T:{i}",) for i in range(0, 6000, 2)]
    return spark.createDataFrame([(i, t) for i, (t,) in enumerate(tokens)], "id int, token string")


def same(a, b, *columns):
    shown = [c for c in (*columns, "input_ids", "position_ids", "attention_mask")]
    a, b = (x.select(*[F.col(c).cast("bigint") if c in columns else c for c in shown]) for x in (a, b))
    return a.exceptAll(b).count() == 0 and a.count() == b.count() > 0


@pytest.mark.parametrize("seed", [None, "w"])
def test_pretrain_rows_equal_the_array_route(busy, words, seed):
    whole = sequence.baseline_first(timeline.consolidate(busy))
    if seed is not None:
        whole = sequence.random_window(whole, 20, 300, seed)
    whole = sequence.correct_age(sequence.trim_position(sequence.trim_length(whole, 20), 300))
    assert same(rows.pretrain_rows(busy, words, 20, 300, seed), sequence.encode(whole, words, 20), "person_id")


def test_labelled_rows_equal_the_array_route(busy, words):
    people = busy.select("person_id").distinct().withColumn("label", F.col("person_id") % 2)
    got = rows.labelled_rows(busy, people, words, 20)
    assert same(got, sequence.encode(timeline.consolidate(busy), words, 20), "person_id")


def test_multilabel_rows_equal_the_array_route(busy, words):
    samples = sequence.label_samples(timeline.consolidate(busy), recent=20, drop_repeats=True)
    whole = sequence.trim_position(sequence.trim_length(samples, 20), 300)
    want = sequence.encode(whole, words, 20, ["person_id", "label_count"])
    assert same(rows.multilabel_rows(busy, words, 20, 300), want, "person_id", "label_count")


def test_bounded_meds_samples_equal_full_history(busy):
    full = sequence.label_samples(timeline.consolidate(busy)).withColumn("label_count", F.col("label_count").cast("bigint"))
    want = meds.trim_meds(meds.to_meds(full, [*rows.SAMPLE_KEYS, "label"]), 9)
    got = rows.meds_samples(busy, 9).select(*want.columns)
    assert got.count() == want.count() > 50 and got.exceptAll(want).count() == 0


def test_meds_need_no_shuffle_after_the_sequence(spark, sf):
    text = plan_of(meds.to_meds(st.sequences(spark, sf)))
    assert text.count("Exchange") == plan_of(st.sequences(spark, sf)).count("Exchange")


def test_buckets_are_even_for_equal_prefixes_and_tiny_scores(spark):
    tokens = spark.range(9000).select(F.lit(1).alias("n"), F.concat(F.lit("LOINC:12345-6:"), "id").alias("token"))
    scores = spark.range(9000).select(F.lit(0).alias("class"), (F.col("id") * 1e-14).alias("score"))
    for df, order in ((tokens, [("n", False), ("token", True)]), (scores, [("class", True), ("score", True)])):
        sizes = [r["count"] for r in scale.ranged(df.repartition(6), order, sinks.materialise).groupBy("_range").count().collect()]
        assert sum(sizes) == 9000 and (len(sizes) == 1 or max(sizes) < 9000 / len(sizes) * 2)


def test_persons_are_joined_without_salt(spark, sf):
    for name in ("pretrain_rows", "label_sequences", "person_sequences"):
        for line in plan_of(entry.queries()[name](spark, sf)).split("\n"):
            assert not ("_salt" in line and "person_id" in line and "keys" in line.lower())


def test_running_total_equals_plain_window(spark, skewed):
    hashed = skewed.withColumn("h", keyed_hash("s", "general_event_token"))
    ours = scale.hash_rank(hashed, "h", ["general_event_token"], by=["person_id"], out="r")
    plain = F.row_number().over(Window.partitionBy("person_id").orderBy("h", "general_event_token"))
    assert ours.withColumn("p", plain).filter("r <> p").count() == 0
    assert ours.count() == 6000


def test_running_total_keeps_null_groups(spark):
    rows = spark.createDataFrame([(None, 3), (None, 1), (1, 2)], "g int, v int")
    got = scale.running_total(rows, [("v", True)], [("b", F.col("v") % 1 + F.col("v"), True)], by=["g"], value=F.col("v"), out="t")
    assert sorted((r["g"] or 0, r["v"], r["t"]) for r in got.collect()) == [(0, 1, 1), (0, 3, 4), (1, 2, 2)]


def test_salted_join_equals_join(spark, skewed):
    lookup = spark.range(150).select(F.col("id").alias("person_id"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = scale.salted_join(skewed, lookup, ["person_id"], how)
        b = skewed.join(lookup, "person_id", how)
        assert a.select(*b.columns).exceptAll(b).count() == 0 and a.count() == b.count()


def test_numbered_rows(spark):
    frame = spark.createDataFrame([("a", 70000), ("b", 0), ("c", 3)], "k string, n bigint")
    got = {r["k"]: (r["c"], r["m"]) for r in scale.numbered_rows(frame, "n").groupBy("k").agg(F.count("*").alias("c"), F.max("i").alias("m")).collect()}
    assert got == {"a": (70000, 69999), "c": (3, 2)}


def test_recent_events_equal_length_trim(spark, skewed):
    aligned = timeline.align_to_first_date(skewed)
    short = timeline.consolidate(sequence.recent_events(aligned, 20))
    trimmed = sequence.trim_length(short, 12)
    full = sequence.trim_length(timeline.consolidate(aligned), 12)
    assert trimmed.exceptAll(full).count() == 0


@pytest.mark.parametrize("repeats", [False, True])
def test_samples_from_events_equal_samples_from_arrays(spark, skewed, repeats):
    marks = skewed.filter("crc32(general_event_token) % 40 = 0").withColumn(
        "general_event_token", F.concat(F.lit("LABEL:"), (F.crc32("general_event_token") % 2).cast("string"))
    ).distinct()
    few = skewed.withColumn("general_event_token", F.concat(F.lit("T:"), (F.crc32("general_event_token") % 2).cast("string")))
    aligned = timeline.align_to_first_date(few.union(marks))
    arrays = sequence.label_samples(timeline.consolidate(aligned), recent=7, drop_repeats=repeats)
    longs = sequence.label_samples_from_events(aligned, 7, drop_repeats=repeats)
    columns = ["person_id", "label_count", "label", "seq"]
    a = arrays.select(F.col("person_id"), F.col("label_count").cast("bigint"), "label", "seq")
    assert a.count() > 100
    assert a.exceptAll(longs.select(*columns)).count() == 0 and longs.count() == a.count()


def test_matched_controls_cover_every_case(spark):
    people = spark.range(300).select(F.col("id").alias("person_id"), F.when(F.col("id") == 299, "b").otherwise("a").alias("g"))
    pairs = labels.matched_controls(people, people, ["g"], "s")
    assert pairs.count() == 299 and pairs.filter("case_id = control_id").count() == 0


def test_splits_are_whole_and_disjoint(spark):
    people = spark.range(3000).select(F.col("id").alias("person_id"))
    split = splits.random_split(people, 0.2, "s")
    assert split.count() == 3000
    assert split.exceptAll(splits.random_split(people.repartition(7), 0.2, "s")).count() == 0


def test_sequences_do_not_depend_on_partitioning(spark, sf):
    a = st.sequences(spark, sf)
    b = timeline.build_sequences(st.tokens(spark, sf).repartition(13), st.patient(spark, sf))
    assert a.exceptAll(b).count() == 0


def test_step_by_step_equals_one_shuffle(spark, sf):
    aligned = timeline.align_to_first_date(st.tokens(spark, sf))
    steps = timeline.consolidate(timeline.add_baseline(aligned, st.patient(spark, sf)))
    assert steps.exceptAll(st.sequences(spark, sf)).count() == 0


def test_parallel_arrays_round_trip(spark, sf):
    rows = st.sequences(spark, sf)
    back = timeline.zip_arrays(timeline.parallel_arrays(rows))
    assert back.exceptAll(rows).count() == 0


def plan_of(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", ["person_sequences", "lab_tokens", "encode_sequences", "multilabel_rows", "matched_controls", "translate_events", "meds_events", "mlm_rows"])
def test_plans_have_no_python_and_no_products(spark, sf, name):
    text = plan_of(entry.queries()[name](spark, sf))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan_of(entry.queries()["scan_parquet"](spark, sf))
    assert "PushedFilters: [IsNotNull(o_totalprice)" in text or "GreaterThan(o_totalprice,100000.0)" in text
    assert "o_orderdate" not in text.split("ReadSchema")[1].split("\n")[0]


def test_group_limit_runs_before_the_shuffle(spark, sf):
    orders = st.table(spark, sf, "orders")
    text = plan_of(labels.top_n_per_group(orders, ["o_custkey"], "o_totalprice", 3))
    assert text.count("WindowGroupLimit") >= 2


def test_split_files_are_bounded(spark, tmp_path):
    rows = spark.range(5000).select(
        F.col("id").alias("person_id"), F.when(F.col("id") % 9 == 0, "test").otherwise("train").alias("split"), (F.col("id") % 2).alias("label")
    )
    sinks.write_splits(rows.repartition(20), str(tmp_path / "s"), tasks=3, rows_per_file=1000)
    assert len(glob.glob(str(tmp_path / "s/split=train/label=0/*.parquet"))) <= 6
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 5000 and back.filter("split = 'test'").count() == rows.filter("split = 'test'").count()


def test_lab_tokens_are_rewritten_by_code_and_unit(spark):
    """Tokens with values are nearly all different: no lookup of them is copied once a salt."""
    events = spark.range(400).select(
        F.col("id").alias("person_id"), F.concat(F.lit("LOINC:1-1:"), F.col("id").cast("string"), F.lit(":g/L")).alias("general_event_token")
    )
    malformed = spark.createDataFrame([(1, "LOINC:1-1"), (2, "LOINC:1-1:x:g/L"), (3, "LOINC:2-2:5:g/L"), (4, "LOINC:1-1:5:mmol/L"), (5, "OTHER:1"), (6, None)], "person_id long, general_event_token string")
    conversions = spark.createDataFrame([("1-1", "g/L", "g/L", 1.0, 0.0)], "lx_lab_code string, lx_result_unit string, lx_result_other_unit string, conversion_factor double, conversion_offset double")
    table = spark.createDataFrame([("1-1", [100.0, 200.0, 300.0])], "lx_lab_code string, percentile_boundaries array<double>")
    out = labs.event_percentiles(events.union(malformed), conversions, table, 4)
    got = {(r[0], r[1]): r[2] for r in out.groupBy("general_event_token", F.col("person_id") > 5).count().collect()}
    assert sum(got.values()) == 402 and got[("LOINC:1-1:75-100", True)] == 100 and got[("OTHER:1", False)] == got[(None, True)] == 1
    assert "_token" not in plan_of(out).replace("general_event_token", "")


def test_window_events_reads_stored_rows(spark, sf):
    """Alignment is worked out once, before counts, positions and the choice read its rows."""
    long = timeline.add_baseline(timeline.align_to_first_date(st.tokens(spark, sf)), st.patient(spark, sf))
    stored = sequence.window_events(long, 20, "w", sinks.materialise)
    lazy = sequence.window_events(long, 20, "w")
    assert "datediff" not in plan_of(stored) and "datediff" in plan_of(lazy)
    assert sorted(map(str, stored.collect())) == sorted(map(str, lazy.collect()))
    assert "AGE" in plan_of(entry.queries()["window_events"](spark, sf)) and "customer" not in plan_of(entry.queries()["window_events"](spark, sf))


def test_code_variants_spread_the_rows_before_they_multiply(spark):
    rows = [("C", "A.Σ.", "s"), ("C", "a.σ.", "s"), ("C", "A.Σ.", "s"), ("D", "İ.1", "s"), ("D", None, None), (None, "x.Y", "s")]
    codes = spark.createDataFrame(rows, "CUI string, code string, source string")
    got = terms.code_variants(codes)
    bare = F.replace("code", F.lit("."), F.lit(""))
    want = codes.select("CUI", F.explode(F.array("code", bare, F.lower("code"), F.lower(bare))).alias("code"), "source").distinct()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = plan_of(terms.code_variants(codes))
    assert plan.count("hashpartitioning") == 1
    assert plan.index("Generate") < plan.index("Exchange")


def test_labs_are_converted_once_for_thresholds_and_tokens(spark, sf):
    """Stored labs serve both; a lazy plan joins the raw tables for each."""
    conversions, table = labs.fit(st.lab(spark, sf), 5, 5, save=sinks.materialise)
    lazy = labs.apply(st.lab(spark, sf), conversions, table, 5, 5)
    stored = labs.apply(st.lab(spark, sf), conversions, table, 5, 5, save=sinks.materialise)
    assert "l_orderkey" in plan_of(lazy) and "l_orderkey" not in plan_of(stored)
    assert sorted(map(str, stored.collect())) == sorted(map(str, lazy.collect())) and stored.count() > 0


def test_raw_labs_are_read_once(spark, sf):
    """Conversions and the report read stored labs, not the raw table again."""
    plans = {}

    def save(df, name):
        plans[name] = plan_of(df)
        return sinks.materialise(df, name)

    labs.fit_apply(st.lab(spark, sf), 5, 5, save=save)
    assert "l_orderkey" not in plans["conversions"]
    out = prepare(q_pipelines.CONFIG, q_pipelines.tables(spark, sf))
    assert "l_extendedprice" not in plan_of(out.cutflow)


def test_concept_maps_and_their_copies_are_not_broadcast(spark, sf):
    """Spark takes a map for as large as its files; its rows, and the copies of a salted join, fill many times that."""
    assert "BroadcastHashJoin" not in plan_of(entry.queries()["concept_translate"](spark, sf))
    codes = spark.createDataFrame([(f"c{i % 40}", "s") for i in range(80)] + [("none", "s"), (None, "s")], "code string, source string")
    vocabulary = codes.filter("code < 'c2'").withColumn("vocab_token", F.concat("source", "code"))
    concepts = spark.createDataFrame([(f"C{i % 40 // 7}", f"c{i % 40}", "s") for i in range(80)] + [("C1", None, "s")], "CUI string, code string, source string")
    ours = terms.matching_translations(concepts, codes, vocabulary, "original", "vocab")
    a, b, m, v = (x.distinct() for x in (codes, concepts, concepts.withColumnRenamed("code", "vocab_code"), vocabulary))
    want = a.join(b, "code").join(m, "CUI").join(v.withColumnRenamed("code", "vocab_code"), "vocab_code")
    got = sorted(map(tuple, ours.select("CUI", "original_code", "vocab_code", "vocab_token").collect()))
    assert got == sorted(map(tuple, want.select("CUI", "code", "vocab_code", "vocab_token").collect())) and len(got) > 40
    names, used = st.used_code_names(spark, sf), st.used_codes(spark, sf).select("source", "code").distinct()
    assert names.exceptAll(used).count() == 0 and names.count() == used.count() > 0


def test_a_mapping_does_not_gather_rows_by_value(spark):
    """Raw sources are few: a join by them would bring all events of one into one task."""
    rows = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3), (None, 4)], "raw_source string, n int")
    out = ev.apply_mapping(rows, {"A": "x", "C": "y"}, "raw_source", "source")
    assert sorted(map(tuple, out.select("n", "source").collect())) == [(1, "x"), (2, "x"), (3, None), (4, None)]
    plan = plan_of(out)
    assert "BroadcastHashJoin" in plan and "hashpartitioning(raw_source" not in plan


def test_alignment_sorts_no_events(spark, skewed):
    """A task holds its persons' first dates, not its events sorted, however many events a person has."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = timeline.align_to_first_date(skewed)
        people = skewed.select("person_id", F.lit("1990-01-01").cast("timestamp").alias("px_birth_date")).distinct()
        assert "SortMergeJoin" not in plan_of(out) and "SortMergeJoin" not in plan_of(timeline.add_baseline(out, people))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    day = F.datediff("date", F.min("date").over(Window.partitionBy("person_id"))) + 1
    want = skewed.withColumn("days_since_begin", day).select(*out.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))


def test_label_samples_read_stored_rows(spark, sf):
    """Repeats are dropped and events numbered once, before labels and events are taken from them."""
    assert "lag(" not in plan_of(entry.queries()["label_samples_from_events"](spark, sf))
    long = st.labelled_events(spark, sf)
    stored = sequence.label_samples_from_events(long, 6, drop_repeats=True, save=sinks.materialise)
    lazy = sequence.label_samples_from_events(long, 6, drop_repeats=True)
    assert "lag(" in plan_of(lazy)
    assert sorted(map(str, stored.collect())) == sorted(map(str, lazy.collect())) and stored.count() > 0


def test_label_samples_of_long_and_short_persons_are_the_same(spark, skewed):
    """Persons a task may hold take one shuffle; the long one and null go by person and block, with the same rows."""
    odd = spark.createDataFrame([(None, "2001-01-01", "T:1"), (None, "2001-01-02", "LABEL:1"), (7, None, "LABEL:0"), (7, None, "T:2"), (8, "2001-01-05", "LABEL:x"), (8, "2001-01-05", None)], "person_id long, date string, general_event_token string")
    odd = odd.withColumn("date", F.col("date").cast("timestamp"))
    few = skewed.withColumn("general_event_token", F.concat(F.lit("T:"), (F.crc32("general_event_token") % 2).cast("string")))
    marks = skewed.filter("crc32(general_event_token) % 40 = 0").withColumn("general_event_token", F.concat(F.lit("LABEL:"), F.pmod("person_id", F.lit(2)).cast("string")))
    people = skewed.select("person_id", F.lit("1990-01-01").cast("timestamp").alias("px_birth_date")).distinct().union(spark.sql("select 7L, null"))
    aligned = timeline.add_baseline(timeline.align_to_first_date(few.union(marks).union(odd)), people)
    aligned = aligned.union(spark.sql("select cast(null as long), 'T:1', 1, timestamp'2001-01-01' union all select null, 'LABEL:1', 2, timestamp'2001-01-02'"))
    parts = sequence.label_sample_parts(aligned, 7, sinks.materialise, drop_repeats=True)
    assert len(parts) == 2 and all(part.count() > 10 for part in parts)
    assert plan_of(parts[0]).count("hashpartitioning") == 1
    for repeats in (False, True):
        for label in (None, 1):
            got = sequence.label_samples_from_events(aligned, 7, label, repeats, sinks.materialise)
            lazy = sequence.label_samples_from_events(aligned, 7, label, repeats)
            assert sorted(map(str, got.collect())) == sorted(map(str, lazy.collect())) and got.count() > 20


def test_multilabel_lab_rows_write_little(spark, sf, monkeypatch):
    """Events are stored as they come and dealt by person once more; samples and their items are not shuffled."""
    stored = {}

    def save(df, name):
        stored[name] = df.columns
        return sinks.materialise(df, name)

    monkeypatch.setattr(rows, "materialise", save)
    plan = plan_of(entry.queries()["multilabel_lab_rows"](spark, sf))
    assert stored == {"events": ["person_id", "general_event_token", "days_since_begin", "date"]}
    assert plan.count("hashpartitioning") == 1


def test_day_0_rows_do_not_align_again(spark, sf):
    """First dates come from the events as they were, so events are dealt by person once to be aligned."""
    raw, people = st.tokens(spark, sf), st.patient(spark, sf)
    aligned = timeline.align_to_first_date(raw)
    once, twice = timeline.add_baseline(aligned, people, raw), timeline.add_baseline(aligned, people)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert plan_of(st.aligned(spark, sf, raw)).count("datediff") < plan_of(twice).count("datediff")
