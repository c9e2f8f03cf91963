"""Data checks and the persons-per-step report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def data_checks(wide: DataFrame, patients: DataFrame, splits: DataFrame) -> DataFrame:
    """``rule, violations``; every count is 0 on good data."""
    days = wide.agg(
        F.coalesce(F.sum(F.size(F.filter("day_position_tokens", lambda d: d < 0))), F.lit(0)).alias("v")
    )
    nulls = patients.agg(F.count(F.when(F.col("person_id").isNull(), 1)).alias("v"))
    per_person = wide.groupBy("person_id").agg(F.count("*").alias("n"))
    repeated = per_person.agg(F.count(F.when(F.col("n") > 1, 1)).alias("v"))
    per_member = splits.groupBy("omop_person_id").agg(
        F.min("split").alias("a"), F.max("split").alias("b")
    )
    overlap = per_member.agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("v"))
    named = [
        ("negative_days", days),
        ("null_person_ids", nulls),
        ("repeated_persons", repeated),
        ("persons_in_several_splits", overlap),
    ]
    frames = [df.select(F.lit(name).alias("rule"), F.col("v").cast("bigint").alias("violations")) for name, df in named]
    result = frames[0]
    for frame in frames[1:]:
        result = result.union(frame)
    return result


def unique_key_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that appear on more than one row."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def cutflow(tagged: DataFrame, names: Sequence[str], min_days: int) -> DataFrame:
    """Persons left after each step, from rows tagged with the step they ``reached``.

    ``tagged`` has ``person_id, reached, date``; token rows carry their date, earlier steps null.
    Steps are nested, so a person counts in every step up to the furthest one, and the counts
    cannot rise. The last three steps follow from the person's own first and last date.
    """
    last = len(names)
    token_step = last - 4
    persons = tagged.groupBy("person_id").agg(
        F.max("reached").alias("reached"),
        F.datediff(F.max("date"), F.min("date")).alias("_days"),
    )
    spans = (F.col("reached") >= token_step) & (F.col("_days") + 1 >= min_days)
    furthest = F.when(spans, last).when(F.col("reached") >= token_step, token_step + 1).otherwise(F.col("reached"))
    ends = persons.groupBy(furthest.alias("_end")).agg(F.count("*").alias("_n"))
    steps = ends.select(F.explode(F.sequence(F.lit(1), F.col("_end"))).alias("step"), "_n")
    counts = steps.groupBy("step").agg(F.sum("_n").alias("number_patients"))
    spark = tagged.sparkSession
    labels = spark.createDataFrame(list(enumerate(names, 1)), "step int, cut_name string")
    return labels.join(counts, "step", "left").select(
        "step", "cut_name", F.coalesce("number_patients", F.lit(0)).alias("number_patients")
    )
