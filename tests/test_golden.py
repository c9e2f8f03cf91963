"""Hand-made rows for the rules that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from medstrand.functions import codes
from medstrand.operators import labels, labs, meds, metrics, sequence, splits, terms, timeline, vocab
from medstrand.sources import readers

DAY0 = dt.datetime(2000, 1, 1)


def seq(spark, items, person=1, **extra):
    """Sequence from ``(day, token)`` pairs; day 0 is a birth in 1975, day d the d-th day of 2000."""
    rows = [
        (dt.datetime(1975, 1, 1) if day == 0 else DAY0 + dt.timedelta(days=day - 1), day, token) for day, token in items
    ]
    ddl = "person_id bigint, seq array<struct<date: timestamp, day: int, token: string>>"
    return spark.createDataFrame([(person, rows)], ddl)


def pairs(df):
    return [(x["day"], x["token"]) for x in df.first()["seq"]]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("code, want", [("123-123-11", "001230123"), ("12345678901", "123456789"), ("12345678", "12345678")])
def test_ndc(spark, code, want):
    assert one(spark, codes.ndc9(F.lit(code))) == want


@pytest.mark.parametrize(
    "kind, code, kept",
    [("LOINC", "9472-1", True), ("LOINC", "0000-0", False), ("LOINC", "00000-0", False), ("LOINC", "12-3", False), ("TNX", "12-3", True)],
)
def test_lab_code_shape(spark, kind, code, kept):
    assert one(spark, codes.valid_lab_code(F.lit(kind), F.lit(code))) is kept


@pytest.mark.parametrize("unit, want", [("mm3", "mm**3"), ("mm*3", "mm**3"), ("mm**3", "mm**3"), ("mg/dL", "mg/dL")])
def test_unit_text(spark, unit, want):
    assert one(spark, codes.clean_unit(F.lit(unit))) == want


@pytest.mark.parametrize(
    "base, other, want",
    [
        ("mg/dL", "g/L", 100.0), ("g/L", "mg/dL", 0.01), ("mg/dL", "mg/dL", 1.0), ("mg/dL", "mmol/L", None),
        ("10*9/L", "10*3/uL", 1.0), ("/uL", "10*3/uL", 1000.0), ("odd thing", "odd thing", 1.0), ("g", "oddity", None), ("min", "h", 60.0),
        ("cells", "g", None), ("m2", "cm2", 0.0001), ("mm3", "uL", 1.0),
    ],
)
def test_conversion_factor(spark, base, other, want):
    frame = spark.createDataFrame([(base, other)], "b string, o string")
    got = labs.conversion_factors(frame, "b", "o").first()["conversion_factor"]
    assert got == want if want is None else got == pytest.approx(want, rel=1e-9)


def test_percentile_edges(spark):
    bounds = F.array(*[F.lit(float(10 * i)) for i in range(1, 10)])
    group = lambda v: one(spark, codes.percentile_group(F.lit(v), bounds, 10))
    assert [group(9.9), group(10.0), group(89.9), group(90.0), group(1e9)] == ["0-10", "10-20", "80-90", "90-100", "90-100"]


def test_alignment_starts_at_one(spark):
    rows = [(1, dt.datetime(2020, 1, 5, 23), "A:1"), (1, dt.datetime(2020, 1, 6, 1), "A:2")]
    events = spark.createDataFrame(rows, "person_id bigint, date timestamp, general_event_token string")
    got = {r["general_event_token"]: r["days_since_begin"] for r in timeline.align_to_first_date(events).collect()}
    assert got == {"A:1": 1, "A:2": 2}


def test_day_trim(spark):
    items = [(0, "AGE:25"), (0, "ETHNICITY:UNK"), (0, "GENDER:F"), (1, "a"), (2, "b"), (101, "c"), (110, "d")]
    got = pairs(sequence.trim_position(seq(spark, items), 10))
    assert got == [(0, "AGE:25"), (0, "ETHNICITY:UNK"), (0, "GENDER:F"), (1, "d")]


def test_length_trim_leaves_room_for_cls(spark):
    items = [(0, "AGE:1"), (0, "E"), (0, "G"), (1, "a"), (2, "b"), (3, "c")]
    assert [t for _, t in pairs(sequence.trim_length(seq(spark, items), 4))] == ["AGE:1", "E", "G"]
    got = pairs(sequence.trim_length(seq(spark, items), 6))
    assert got == [(0, "AGE:25"), (0, "E"), (0, "G"), (1, "b"), (2, "c")]
    assert pairs(sequence.trim_length(seq(spark, items), 8)) == items


def test_label_prefixes(spark):
    items = [(1, "A"), (1, "B"), (2, "LABEL:0"), (3, "C"), (3, "D"), (4, "LABEL:1")]
    for recent in (None, 10):
        rows = sequence.label_samples(seq(spark, items), recent=recent).orderBy("label_count").collect()
        assert [([x["token"] for x in r["seq"]], r["label"]) for r in rows] == [(["A", "B"], 0), (["A", "B", "C", "D"], 1)]


def test_bounded_samples_equal_full_ones_after_trim(spark):
    items = [(0, "G")] + [(d, t) for d in range(1, 9) for t in ("A", "A", "LABEL:0", "A", "B")]
    full = sequence.dedupe_consecutive(sequence.label_samples(seq(spark, items)))
    short = sequence.label_samples(seq(spark, items), recent=6, drop_repeats=True)
    read = lambda df: {r["label_count"]: [(x["day"], x["token"]) for x in r["seq"]] for r in sequence.trim_length(df, 6).collect()}
    assert read(full) == read(short)


def test_repeats_keep_last(spark):
    items = [(1, "A"), (1, "A"), (1, "B"), (2, "B"), (2, "B")]
    assert pairs(sequence.dedupe_consecutive(seq(spark, items))) == [(1, "A"), (1, "B"), (2, "B")]


def test_percentile_type_ids(spark):
    out = sequence.percentile_type_ids(seq(spark, [(0, "AGE:25"), (1, "LOINC:1-1:20-30")]), 10)
    assert out.first()["token_type_ids"] == [0, 3]
    assert pairs(out) == [(0, "AGE:25"), (1, "LOINC:1-1")]
    with pytest.raises(Exception, match="off the step"):
        sequence.percentile_type_ids(seq(spark, [(1, "LOINC:1-1:25-35")]), 10).collect()


def test_null_token_parts_leave_no_element(spark):
    rows = [(1, dt.datetime(2020, 1, 5), "A:1"), (1, dt.datetime(2020, 1, 6), None)]
    events = spark.createDataFrame(rows, "person_id bigint, date timestamp, general_event_token string")
    assert pairs(timeline.build_sequences(events)) == [(1, "A:1")]


def test_age_before_birth_is_floored(spark):
    events = spark.createDataFrame([(1, dt.datetime(2000, 1, 1), "A:1")], "person_id bigint, date timestamp, general_event_token string")
    patients = spark.createDataFrame([(1, dt.datetime(2000, 1, 2), None, None, None, None)],
        "person_id bigint, px_birth_date timestamp, px_race string, px_ethnicity string, px_gender string, px_region string")
    assert ("AGE:-1" in [t for _, t in pairs(timeline.build_sequences(events, patients))])


def test_label_twice_fails(spark):
    people = spark.createDataFrame([(1, "x"), (2, "y")], "person_id bigint, v string")
    cohort = spark.createDataFrame([(1, 1), (1, 0)], "person_id bigint, flag int")
    rule = {"positive_class_criteria": "CASE WHEN flag = 1 THEN 1 ELSE 0 END"}
    with pytest.raises(Exception, match="one row in the labels"):
        labels.join_labels(people, cohort, rule).collect()
    assert labels.join_labels(people, cohort.filter("flag = 1"), rule).collect()[0]["label"] == 1


def test_two_label_types_fail(spark):
    rows = [(1, "True", "boolean", "2020-01-01 00:00:00"), (2, "3", "categorical", "2020-01-01 00:00:00")]
    frame = spark.createDataFrame(rows, "patient_id bigint, value string, label_type string, prediction_time string")
    with pytest.raises(Exception, match="one label_type"):
        labels.cast_labels(frame).collect()
    assert labels.cast_labels(frame.filter("patient_id = 2")).first()["value"] == 3


def test_cap_below_and_above_threshold(spark):
    rows = [(p, f"{p}-{i}", "LABEL:1") for p in range(10) for i in range(p + 1)] + [(1, f"z{i}", "LABEL:0") for i in range(5)]
    frame = spark.createDataFrame(rows, "person_id bigint, k string, general_event_token string")
    kept = labels.capped_sample(frame, "s", ["k"], threshold=20).groupBy("general_event_token", "person_id").count().collect()
    per = {(r[0], r[1]): r[2] for r in kept}
    assert per[("LABEL:0", 1)] == 5
    # Caps 1 and 2 keep 10 and 19 rows; 3 keeps 27, the first above 20.
    assert all(per[("LABEL:1", p)] == min(p + 1, 3) for p in range(10))


def test_prior_above_train_share_fails(spark):
    people = spark.createDataFrame([(i,) for i in range(10)], "person_id bigint")
    with pytest.raises(Exception, match="more prior data"):
        splits.split_with_prior(people, people.filter("person_id < 9"), "s").collect()


def test_codes_with_dots_and_case(spark):
    frame = spark.createDataFrame([("C1", "J45.9", "ICD10CM")], "CUI string, code string, source string")
    assert {r["code"] for r in terms.code_variants(frame).collect()} == {"J45.9", "J459", "j45.9", "j459"}


def test_vocabulary_order(spark):
    counts = spark.createDataFrame([("b", 5), ("a", 5), ("AGE:3", 9), ("c", 1)], "token string, n bigint")
    got = [r["token"] for r in vocab.vocabulary(counts, 3, single_age_token=True).orderBy("id").collect()]
    assert got == ["a", "b", "AGE", "[MASK]", "[CLS]", "[UNK]"]


def test_vocabulary_with_two_colons_fails(spark):
    frame = spark.createDataFrame([("a:b:c", 0)], "token string, id int")
    with pytest.raises(Exception, match="more than one"):
        readers.parse_vocabulary(frame).collect()


def test_single_age_token_encodes(spark):
    words = spark.createDataFrame([("A", 0), ("AGE", 1), ("[MASK]", 2), ("[CLS]", 3), ("[UNK]", 4)], "token string, id int")
    rows = seq(spark, [(0, "AGE:25"), (1, "A"), (2, "zzz")])
    got = sequence.encode(rows, words, 10, single_age_token=True).first()
    assert got["input_ids"] == [3, 1, 0, 4] and got["position_ids"] == [0, 0, 1, 2]


def test_nested_numbers_and_birth(spark):
    rows = seq(spark, [(0, "SNOMED/3950001"), (0, "Gender:M"), (1, "X:1"), (1, "X:1F"), (1, "X:1"), (2, "Y")])
    events = meds.to_meds(rows).first()["events"]
    assert [m["code"] for m in events[0]["measurements"]] == ["SNOMED/184099003", "Gender"]
    assert [(m["numeric_value"], m["text_value"]) for m in events[1]["measurements"]] == [(1.0, None), (None, "1F")]
    kept = meds.trim_meds(meds.to_meds(rows), 3).first()["events"]
    assert [m["code"] for e in kept for m in e["measurements"]] == ["SNOMED/184099003", "Gender", "Y"]


def test_auc_with_ties(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.1, 0.9]), (0, [0.8, 0.2])]
    frame = spark.createDataFrame(rows, "label int, probabilities array<double>")
    got = {r["class"]: r["roc_auc"] for r in metrics.roc_auc(frame).collect()}
    assert got == {0: 0.875, 1: 0.875}


def test_missing_class_ids(spark):
    frame = spark.createDataFrame([(1,), (3,)], "label int")
    assert [r[0] for r in splits.class_id_violations(frame).orderBy("missing_class").collect()] == [0, 2]


def test_fitted_tables_give_the_same_sequences(spark, sf):
    from checks import q_pipelines as qp
    from medstrand.plans.base import prepare

    first = prepare(qp.CONFIG, qp.tables(spark, sf))
    again = prepare(qp.CONFIG, qp.tables(spark, sf), conversions=first.conversions, percentiles=first.percentiles)
    assert first.sequences.exceptAll(again.sequences).count() == 0
    assert first.sequences.count() == again.sequences.count() > 0
    counts = [r["number_patients"] for r in first.cutflow.orderBy("step").collect()]
    assert counts == sorted(counts, reverse=True)


def test_absent_tables_are_skipped(spark, sf):
    from checks import q_pipelines as qp
    from medstrand.plans.base import prepare

    tables = dict(qp.tables(spark, sf), lab=None, prescription=None)
    out = prepare(qp.CONFIG, tables)
    assert out.conversions is None and out.sequences.count() > 0
