"""Bucketed tables, measured skew, mergeable boundaries and persons as bitmaps."""

from pyspark.sql import functions as F

from checks import q_events, q_labels, q_labs, q_terms  # noqa: F401 - their SQL serves here too
from checks import standins as st
from checks.registry import big, query, query_like, time_text
from medstrand.operators import boundaries, labels, labs, skew, splits, terms, timeline
from medstrand.sources import bucketed
from medstrand.sources.sinks import materialise, scratch_path


def family(spark, d, key="person_id", **tables):
    """The tables bucketed in a new scratch folder; so small a bucket makes several even here."""
    base = scratch_path(spark, "family")
    prefix = "t" + base.rsplit("-", 1)[1]
    return bucketed.write_family(tables, base, prefix, key, bucket_bytes=1 << 16)


@query_like("align_first_date_bucketed", "align_first_date")
def align_first_date_bucketed(spark, d):
    events = family(spark, d, events=st.tokens(spark, d))["events"]
    aligned = timeline.align_to_first_date(events)
    return aligned.withColumn("date", time_text("date")).withColumn("days_since_begin", big("days_since_begin"))


@query_like("split_membership_bucketed", "split_membership")
def split_membership_bucketed(spark, d):
    members = st.split_map(spark, d).withColumnRenamed("omop_person_id", "person_id")
    kept = family(spark, d, events=st.tokens(spark, d), members=members)
    rows = splits.split_membership(kept["events"], kept["members"].withColumnRenamed("person_id", "omop_person_id"))
    return rows.select("person_id", "general_event_token", "split")


@query_like("join_labels_bucketed", "join_labels")
def join_labels_bucketed(spark, d):
    docs = st.table(spark, d, "documents").select(F.col("doc_id").alias("person_id"), "lang", "n_chars")
    kept = family(spark, d, docs=docs, cohort=st.cohort(spark, d))
    return labels.join_labels(kept["docs"], kept["cohort"], st.COHORT_RULE).withColumn("label", big("label"))


@query_like("convert_units_measured", "convert_units")
def convert_units_measured(spark, d):
    usable = labs.clean(st.lab(spark, d))
    conversions = materialise(labs.unit_conversions(usable), "conversions")
    return labs.convert(usable, conversions, skew.measured_join).select(
        "person_id", "lx_lab_code", "lx_result_other_unit", "lx_result_unit",
        F.round("lx_result_val_converted", 6).alias("lx_result_val_converted"),
    )


@query_like("lab_tokens_measured", "lab_tokens")
def lab_tokens_measured(spark, d):
    tokens, _, _ = labs.fit_apply(st.lab(spark, d), *q_labs.LIMITS, accuracy=st.ACCURACY, save=materialise, join=skew.measured_join)
    return tokens.withColumn("date", time_text("date"))


@query_like("translate_events_measured", "translate_events")
def translate_events_measured(spark, d):
    used = st.used_codes(spark, d)
    chosen = terms.derive_translation(used, st.vocabulary_codes(spark, d), st.concept_map(spark, d))
    return terms.translate_events(used, chosen, skew.measured_join).withColumn("l_linenumber", big("l_linenumber"))


@query(
    "heavy_keys",
    """SELECT source, count(*) AS n, CAST(ceil(count(*) * 64.0 / (SELECT count(*) FROM used)) AS BIGINT) AS copies
       FROM used GROUP BY ALL HAVING count(*) * 64 > (SELECT count(*) FROM used)""",
)
def heavy_keys(spark, d):
    """Keys with more than a 64th of the rows, from two halves' summaries, with the copies their lookup rows get."""
    used = st.used_codes(spark, d)
    halves = [skew.key_summary(used.filter(f"l_orderkey % 2 = {i}"), ["source"]) for i in (0, 1)]
    found = skew.heavy_keys(skew.merge_summaries(halves[0].union(halves[1])), 64)
    copies = spark.createDataFrame(found or [(0, 0)], "h long, copies long")
    counts = used.groupBy("source").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("source"))
    return counts.join(F.broadcast(copies), "h").drop("h")


# Rows a sketch keeps exactly here: enough for the small tables, where SQL has exact boundaries.
EXACT = 8192


def _day_sketches(spark, d, k):
    usable = labs.clean(st.lab(spark, d))
    conversions = materialise(labs.unit_conversions(usable), "conversions")
    converted = labs.convert(usable, conversions).select("lx_lab_code", "date", "lx_result_val_converted")
    converted = materialise(converted, "converted")
    # Two halves of the days are sketched apart; the second is added twice and replaces itself.
    even = F.dayofmonth("date") % 2 == 0
    early = boundaries.day_sketches(converted.filter(even), k)
    late = boundaries.day_sketches(converted.filter(~even), k)
    stored = materialise(boundaries.with_days(early.unionByName(late), late), "day_sketches")
    return converted, conversions, stored


@query_like("lab_tokens_sketches", "lab_tokens")
def lab_tokens_sketches(spark, d):
    """Tokens from boundaries that merged day sketches give."""
    _, conversions, stored = _day_sketches(spark, d, EXACT)
    tokens = labs.apply(st.lab(spark, d), conversions, boundaries.boundaries(stored, k=EXACT), *q_labs.LIMITS, save=materialise)
    return tokens.withColumn("date", time_text("date"))


@query("day_sketches", "SELECT lx_lab_code, count(DISTINCT CAST(date AS DATE)) AS days, count(*) AS n, TRUE AS within FROM converted GROUP BY 1")
def day_sketches(spark, d):
    """Whether every boundary of small sketches lies within their stated rank error."""
    k = 256
    converted, _, stored = _day_sketches(spark, d, k)
    ranks = boundaries.worst_ranks(converted, boundaries.boundaries(stored, k=k))
    days = stored.groupBy("lx_lab_code").agg(F.count("*").alias("days"), F.sum("n").alias("n"))
    checked = ranks.select("lx_lab_code", (F.col("off") <= 1.0 / k + boundaries.rank_error(k)).alias("within"))
    return days.join(checked, "lx_lab_code").select("lx_lab_code", "days", "n", "within")
