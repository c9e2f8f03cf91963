"""Outcome labels: derivation, casting, joining, per-person caps and matched controls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medstrand.functions.keyed import keyed_hash
from medstrand.operators.scale import hash_rank, salted_join

# Fixed value: a label with more rows than this in the validation split is capped per person.
LABEL_ROWS = 1000
# Fixed value: largest cap tried.
MAX_CAP = 99


def derive_labels(cohort: DataFrame, config: Mapping) -> DataFrame:
    """Apply the optional inclusion predicate, then the SQL label expression."""
    if "inclusion_criteria" in config:
        cohort = cohort.filter(config["inclusion_criteria"])
    return cohort.withColumn("label", F.expr(config["positive_class_criteria"]))


def join_labels(sequences: DataFrame, cohort: DataFrame, config: Mapping) -> DataFrame:
    """Sequences, one a person, with the person's label; a person labelled twice fails the job.

    The check travels with the data: the aggregate that makes labels unique raises when it meets
    a second row, so there is no separate counting job.
    """
    key = config.get("join_column_name", "person_id")
    twice = F.raise_error("each person should have one row in the labels dataset").cast("int")
    labels = (
        derive_labels(cohort, config)
        .groupBy(key)
        .agg(F.count("*").alias("_n"), F.first("label").alias("_label"))
        .select(key, F.when(F.col("_n") == 1, F.col("_label")).otherwise(twice).alias("label"))
    )
    return sequences.dropDuplicates([key]).join(labels, key)


def cast_labels(labels: DataFrame) -> DataFrame:
    """``value`` as int: boolean text to 1 or 0, categorical text by number; two label types are an error."""
    kinds = labels.agg(F.count_distinct("label_type")).scalar()
    value = F.when(
        F.col("label_type") == "boolean", F.when(F.col("value") == "True", 1).otherwise(0)
    ).otherwise(F.expr("try_cast(value as int)"))
    many = F.raise_error("labels must all have one label_type").cast("int")
    time = F.try_to_timestamp(F.col("prediction_time"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return labels.withColumn("value", F.when(kinds <= 1, value).otherwise(many)).withColumn(
        "prediction_time", time
    )


def label_events(labels: DataFrame) -> DataFrame:
    """Cast labels as events ``LABEL:<value>`` at prediction time."""
    return labels.select(
        F.col("patient_id").alias("person_id"),
        F.col("prediction_time").alias("date"),
        F.concat(F.lit("LABEL:"), F.col("value").cast("string")).alias("general_event_token"),
    )


def top_n_per_group(
    df: DataFrame, group: Sequence[str], order: str, n: int, ties: Sequence[str] = ()
) -> DataFrame:
    """The ``n`` rows of each group with the largest ``order``.

    Spark turns a row-number limit into a per-task group limit before the shuffle, so a hot group
    sends at most ``n`` rows from each task.
    """
    window = Window.partitionBy(*group).orderBy(F.desc(order), *[F.asc(t) for t in ties])
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def capped_sample(
    labels: DataFrame,
    seed: str | int,
    key: Sequence[str],
    threshold: int = LABEL_ROWS,
    max_cap: int = MAX_CAP,
) -> DataFrame:
    """Thin frequent labels evenly over persons.

    Per ``general_event_token`` with more than ``threshold`` rows, keep the smallest per-person
    count n (0..``max_cap``) whose kept rows exceed the threshold, or ``max_cap`` when none does.
    Rarer labels keep every row. ``key`` identifies a row and drives its random order. All n are
    judged at once: kept rows at n are the sum over persons of min(rows, n).
    """
    label = "general_event_token"
    drawn = labels.withColumn("_h", keyed_hash(seed, *key))
    per_person = labels.groupBy(label, "person_id").agg(F.count("*").alias("_rows"))
    at_rank = (
        per_person.withColumn(
            "_n", F.explode(F.sequence(F.lit(1), F.least(F.col("_rows"), F.lit(max_cap)).cast("int")))
        )
        .groupBy(label, "_n")
        .agg(F.count("*").alias("_added"))
    )
    upto = Window.partitionBy(label).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    reached = at_rank.withColumn("_kept", F.sum("_added").over(upto))
    caps = reached.groupBy(label).agg(F.min(F.when(F.col("_kept") > threshold, F.col("_n"))).alias("_cap"))
    totals = per_person.groupBy(label).agg(F.sum("_rows").alias("_total"))
    rule = totals.join(caps, label, "left").select(
        label,
        (F.col("_total") > threshold).alias("_capped"),
        F.coalesce("_cap", F.lit(max_cap)).alias("_cap"),
    )
    with_rule = salted_join(drawn, rule, [label])
    columns = labels.columns
    frequent = with_rule.filter("_capped")
    window = Window.partitionBy(label, "person_id").orderBy(F.desc("_h"), *[F.asc(k) for k in key])
    kept = (
        frequent.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= max_cap)
        .filter(F.col("_rank") <= F.col("_cap"))
    )
    return kept.select(*columns).unionByName(with_rule.filter("NOT _capped").select(*columns))


def label_metadata(labels: DataFrame, splits: DataFrame) -> DataFrame:
    """Labels per split and value; counted per person before the join, so a hot person is one row per value."""
    person = splits.select(F.col("omop_person_id").alias("patient_id"), "split").distinct()
    counts = labels.groupBy("patient_id", "value").agg(F.count("*").alias("n"))
    return counts.join(person, "patient_id").groupBy("split", "value").agg(F.sum("n").alias("n"))


def matched_controls(
    cases: DataFrame,
    candidates: DataFrame,
    matching: Sequence[str],
    seed: str | int,
    one_per_stratum: bool = False,
) -> DataFrame:
    """A random control with equal ``matching`` values and a different ``person_id`` for each case.

    Both sides are ranked in hash order within their stratum and joined on rank, so the work is
    linear in rows and a hot stratum is ranked by many tasks. A case that meets itself takes the
    next candidate; one whose stratum holds only itself has no control.
    """
    matching = list(matching)
    keyed = lambda df, salt: df.select("person_id", *matching).dropna(subset=matching).withColumn(
        "_h", keyed_hash(f"{seed}-{salt}", "person_id")
    )
    pool = hash_rank(keyed(candidates, "control"), "_h", ["person_id"], by=matching, out="_rank")
    pool = pool.select(*matching, F.col("person_id").alias("control_id"), (F.col("_rank") - 1).alias("_slot"))
    sizes = candidates.dropna(subset=matching).groupBy(*matching).agg(F.count("*").alias("_n"))
    asked = hash_rank(keyed(cases, "case"), "_h", ["person_id"], by=matching, out="_rank")
    asked = salted_join(asked.drop("_h"), sizes, matching).withColumnRenamed("person_id", "case_id")
    # The own slot and the next one, met in one join; a case takes the first that is not itself.
    slots = F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.struct(i.alias("try"), F.pmod(F.col("_rank") - 1 + i, F.col("_n")).alias("slot")))
    tried = asked.withColumn("_s", F.explode(slots)).withColumns({"_try": F.col("_s.try"), "_slot": F.col("_s.slot")}).drop("_s")
    met = tried.join(pool, [*matching, "_slot"]).filter("case_id <> control_id")
    chosen = met.groupBy(*matching, "_rank", "case_id").agg(F.min_by("control_id", "_try").alias("control_id"))
    pairs = chosen.select("case_id", "control_id", *matching, "_rank")
    if one_per_stratum:
        return (
            pairs.groupBy(*matching)
            .agg(F.min_by(F.struct("case_id", "control_id"), F.struct("_rank", "case_id")).alias("_p"))
            .select("_p.case_id", "_p.control_id", *matching)
        )
    return pairs.drop("_rank")
