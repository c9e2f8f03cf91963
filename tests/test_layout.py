"""Bucketed tables, measured skew, boundaries that add up, persons as bitmaps."""

import uuid

import pytest
from pyspark.sql import functions as F

from medstrand.operators import boundaries, labels, labs, skew, splits, timeline
from medstrand.sources import bucketed


@pytest.fixture()
def no_broadcast(spark):
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
    yield
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.unset(name)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    events = spark.range(3000).select(
        (F.col("id") % 70).alias("person_id"), F.timestamp_seconds(F.col("id") * 86_400).alias("date"), F.concat(F.lit("T:"), "id").alias("general_event_token")
    )
    members = spark.range(50).select(F.col("id").alias("person_id"), F.when(F.col("id") % 3 == 0, "train").otherwise("test").alias("split"))
    cohort = spark.range(40).select(F.col("id").alias("person_id"), (F.col("id") % 2).alias("sick"))
    plain = {"events": events, "members": members, "cohort": cohort}
    base = str(tmp_path_factory.mktemp("family"))
    kept = bucketed.write_family(plain, base, f"f{uuid.uuid4().hex}", sort={"events": ["date"]}, bucket_bytes=4096)
    return base, plain, kept


def members_of(df):
    return df.withColumnRenamed("person_id", "omop_person_id")


RULE = {"positive_class_criteria": "case when sick = 1 then 1 else 0 end"}


def same(a, b):
    columns = sorted(b.columns)
    a, b = (sorted(map(str, x.select(*columns).collect())) for x in (a, b))
    return a == b and len(b) > 0


def test_joins_of_a_family_have_no_exchange(people, no_broadcast):
    _, plain, kept = people
    pairs = [
        (timeline.align_to_first_date(kept["events"]), timeline.align_to_first_date(plain["events"])),
        (splits.split_membership(kept["events"], members_of(kept["members"])), splits.split_membership(plain["events"], members_of(plain["members"]))),
        (labels.join_labels(kept["members"], kept["cohort"], RULE), labels.join_labels(plain["members"], plain["cohort"], RULE)),
    ]
    for ours, theirs in pairs:
        assert "Exchange" not in plan_of(ours)
        assert "Exchange" in plan_of(theirs)
        assert same(ours, theirs)


def test_a_later_session_opens_the_layout(spark, people, no_broadcast):
    base, plain, kept = people
    later = spark.newSession()
    later.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    events = bucketed.open_bucketed(later, f"{base}/events", f"again{uuid.uuid4().hex}")
    assert events.count() == 3000 and events.schema == kept["events"].schema
    assert "Exchange" not in plan_of(timeline.align_to_first_date(events))
    later.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    one = plan_of(events.filter("person_id = 7"))
    assert "SelectedBucketsCount: 1 out of" in one
    with pytest.raises(ValueError):
        bucketed.open_bucketed(later, f"{base}/events", "a; drop table b")


def test_every_bucket_is_one_file(spark, people):
    base, _, kept = people
    files = kept["events"].select(F.input_file_name()).distinct().count()
    buckets = spark.read.json(f"{base}/events.layout").first()["buckets"]
    assert 2 < files <= buckets and buckets & (buckets - 1) == 0


def test_buckets_follow_the_bytes():
    assert bucketed.plan_buckets([], 10) == 1
    assert bucketed.plan_buckets([0, 10], 10) == 1
    assert bucketed.plan_buckets([11, 3], 10) == 2
    assert bucketed.plan_buckets([1 << 40], 256 << 20) == 4096
    assert bucketed.plan_buckets([1 << 60], 1) == bucketed.MOST_BUCKETS


@pytest.fixture(scope="module")
def hot(spark):
    """A key with a third of the rows, one with a tenth, null keys, many small ones."""
    n = F.col("id")
    key = F.when(n % 3 == 0, "hot").when(n % 10 == 1, "warm").when(n % 10 != 2, F.concat(F.lit("k"), n % 4000))
    return spark.range(12_000).select(key.alias("code"), (n % 2).alias("kind"), n.alias("v"))


@pytest.fixture(scope="module")
def lookup(spark):
    rows = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("code"), F.lit(0).cast("long").alias("kind"), F.col("id").alias("w"))
    named = spark.createDataFrame([("hot", 0, -1), ("hot", 1, -2), ("warm", 1, -3), (None, 0, -4), ("hot", 0, -5)], "code string, kind long, w long")
    return rows.union(named)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("tasks", [1, 8, 5000])
def test_measured_join_gives_the_plain_rows(hot, lookup, how, tasks, no_broadcast):
    assert same(skew.measured_join(hot, lookup, ["code", "kind"], how, tasks=tasks), hot.join(lookup, ["code", "kind"], how))


def test_only_heavy_keys_are_copied(spark, hot, lookup, no_broadcast):
    heavy = skew.heavy_keys(skew.key_summary(hot, ["code"]), 8)
    exact = {r["h"]: r["count"] for r in hot.groupBy(F.xxhash64("code").alias("h")).count().collect()}
    assert heavy and {h for h, _ in heavy} == {h for h, n in exact.items() if n * 8 > 12_000}
    assert all(copies == -(-exact[h] * 8 // 12_000) for h, copies in heavy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    joined = skew.measured_join(hot, lookup, ["code"], tasks=8)
    shares = joined.filter("code = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) > 1
    even = spark.range(4000).select((F.col("id") % 1000).alias("code"))
    assert skew.heavy_keys(skew.key_summary(even, ["code"]), 8) == []
    assert "_salt" not in plan_of(skew.measured_join(even, even.distinct(), ["code"], tasks=8))


def test_summaries_add_up(spark, hot):
    parts = [skew.key_summary(hot.filter(f"v % 4 = {i}"), ["code"]) for i in range(4)] + [skew.key_summary(hot.limit(0), ["code"])]
    both = parts[0]
    for part in parts[1:]:
        both = both.union(part)
    assert sorted(skew.heavy_keys(skew.merge_summaries(both), 8)) == sorted(skew.heavy_keys(skew.key_summary(hot, ["code"]), 8))
    assert skew.heavy_keys(skew.key_summary(hot.limit(0), ["code"]), 8) == []
    assert skew.measured_join(hot.limit(0), hot, ["code"]).count() == 0


@pytest.fixture(scope="module")
def values(spark):
    """Values of one hot and several small codes over 40 days; some equal, some null."""
    n = F.col("id")
    code = F.when(n % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), (n % 30).cast("string")))
    value = F.when(n % 50 == 0, None).when(n % 5 == 0, 7.0).otherwise((F.xxhash64(n) % 100_000) / 10.0)
    return spark.range(60_000).select(code.alias("lx_lab_code"), value.alias("lx_result_val_converted"), F.timestamp_seconds(n % 40 * 86_400).alias("date"))


def worst(values, table):
    return boundaries.worst_ranks(values.dropna(), table).agg(F.max("off")).first()[0]


@pytest.mark.parametrize("k", [64, 512])
def test_boundaries_of_merged_halves_lie_within_the_error(values, k):
    halves = [boundaries.day_sketches(values.filter(f"day(date) % 2 = {i}"), k) for i in (0, 1)]
    table = boundaries.boundaries(boundaries.with_days(*halves))
    assert 0 < worst(values, table) <= boundaries.rank_error(k)
    assert {r["lx_lab_code"]: r["n"] for r in table.collect()} == {
        r["lx_lab_code"]: r["count"] for r in values.dropna().groupBy("lx_lab_code").count().collect()
    }


def test_sketches_that_keep_all_are_exact(values):
    few = values.filter("lx_lab_code <> 'hot'")
    table = boundaries.boundaries(boundaries.day_sketches(few, 8192))
    assert worst(few, table) == 0
    assert same(table.select("lx_lab_code", "percentile_boundaries"), labs.percentiles(few.dropna(), accuracy=1_000_000).select("lx_lab_code", "percentile_boundaries"))


def test_a_corrected_day_replaces_its_own(values):
    old = boundaries.day_sketches(values, 8192)
    right = values.filter("day(date) = 3 and lx_lab_code <> 'c3'").withColumn("lx_result_val_converted", F.lit(1.0))
    got = boundaries.with_days(old, boundaries.day_sketches(right, 8192))
    want = boundaries.day_sketches(values.filter("day(date) <> 3").unionByName(right), 8192)
    counts = lambda df: df.select("lx_lab_code", "on", "n")
    assert same(counts(got), counts(want))
    days = boundaries.boundaries(got, where=F.dayofmonth("on") == 3)
    assert all(set(r["percentile_boundaries"]) == {1.0} for r in days.collect())


def test_codes_with_few_values_a_day_get_small_sketches(spark):
    """One value a day and 3,000 on one day: the first take no room for ``k`` values, and none is lost."""
    n = F.col("id")
    rows = spark.range(6000).select(
        F.when(n < 3000, "few").when(n < 5999, "many").alias("lx_lab_code"), n.cast("double").alias("lx_result_val_converted"),
        F.when(n < 3000, F.timestamp_seconds(n * 86_400)).when(n < 5999, F.timestamp_seconds(F.lit(0))).alias("date"),
    )
    days = boundaries.day_sketches(rows, 4096)
    size = "regexp_extract(kll_sketch_to_string_double(sketch), 'Capacity Items +: ([0-9]+)', 1)"
    got = {(r["lx_lab_code"], r["k"]): (r["days"], r["n"]) for r in days.groupBy("lx_lab_code", F.expr(size).alias("k")).agg(F.count("*").alias("days"), F.sum("n").alias("n")).collect()}
    assert got == {("few", "8"): (3000, 3000), ("many", "4096"): (1, 2999), (None, "8"): (1, 1)}
    assert worst(rows.dropna(), boundaries.boundaries(days)) == 0


def test_no_values(values, spark):
    assert boundaries.boundaries(boundaries.day_sketches(values.limit(0))).count() == 0
    with pytest.raises(ValueError):
        boundaries.boundaries(boundaries.day_sketches(values), step=7)


def test_softmax_works_its_maximum_out_once(spark):
    """Values as by hand, and one maximum and one sum in the plan however often they are used."""
    import math

    from medstrand.functions.scores import softmax

    rows = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1e4, 1e4],), ([],), (None,)], "s array<double>")
    out = rows.select(softmax(F.col("s")).alias("p"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max(") == 1 and plan.count("aggregate(") == 1
    total = sum(math.exp(x) for x in (1, 2, 3))
    got = [r["p"] for r in out.collect()]
    assert got[0] == pytest.approx([math.exp(x) / total for x in (1, 2, 3)]) and got[1:] == [[0.5, 0.5], [], None]
