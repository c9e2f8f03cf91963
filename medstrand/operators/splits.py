"""Reproducible sampling, splitting and class mixing, keyed by person and never by row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medstrand.functions.keyed import keyed_hash, keyed_uniform
from medstrand.operators.scale import BLOCK, hash_rank, numbered_rows, running_total


def hash_sample(df: DataFrame, fraction: float, seed: str | int, key: str = "person_id") -> DataFrame:
    return df.filter(keyed_uniform(seed, key) < fraction)


def _pick(u: Column, names: Sequence[str], weights: Sequence) -> Column:
    """Name whose stretch of the running weights holds ``u``; weights need not sum to 1."""
    as_columns = [w if isinstance(w, Column) else F.lit(float(w)) for w in weights]
    total = sum(as_columns[1:], as_columns[0])
    chosen, bound = None, F.lit(0.0)
    for name, weight in zip(names[:-1], as_columns[:-1]):
        bound = bound + weight
        test = u * total < bound
        chosen = F.when(test, name) if chosen is None else chosen.when(test, name)
    return chosen.otherwise(names[-1])


def random_split(
    df: DataFrame, validation_fraction: float, seed: str | int, key: str = "person_id"
) -> DataFrame:
    """Add ``split``: train, test and valid with weights ``[0.5 + v, 0.5, v]``."""
    v = validation_fraction
    return df.withColumn(
        "split", _pick(keyed_uniform(seed, key), ["train", "test", "valid"], [0.5 + v, 0.5, v])
    )


def prior_overlap(df: DataFrame, prior: DataFrame, key: str = "person_id") -> DataFrame:
    """Add ``in_prior``: whether the row's key appears in ``prior``."""
    seen = prior.select(key).distinct().withColumn("_seen", F.lit(True))
    joined = df.join(seen, key, "left")
    return joined.withColumn("in_prior", F.coalesce("_seen", F.lit(False))).drop("_seen")


def split_with_prior(
    df: DataFrame,
    prior: DataFrame,
    seed: str | int,
    train: float = 0.7,
    validation: float = 0.15,
    test: float = 0.15,
    key: str = "person_id",
) -> DataFrame:
    """Add ``split`` with persons seen before forced into train.

    The others draw from ``[train - prior share, validation, test]``. When the prior share is
    above the train share the job fails, because held-out persons would have been seen.
    """
    flagged = prior_overlap(df, prior, key)
    share = flagged.agg(F.try_divide(F.sum(F.col("in_prior").cast("int")).cast("double"), F.count("*"))).scalar()
    left = F.when(share <= train, F.lit(train) - share).otherwise(
        F.raise_error("more prior data than training data: lower it or raise the train ratio").cast("double")
    )
    drawn = _pick(keyed_uniform(seed, key), ["train", "valid", "test"], [left, validation, test])
    return flagged.withColumn("split", F.when(F.col("in_prior"), "train").otherwise(drawn))


def split_membership(df: DataFrame, splits: DataFrame, key: str = "person_id") -> DataFrame:
    """Keep rows of persons in a predefined split and add ``split``."""
    member = splits.select(F.col("omop_person_id").alias(key), "split").distinct()
    return df.join(member, key)


def min_history(df: DataFrame, minimum: int, column: str = "sorted_event_tokens") -> DataFrame:
    """Rows with strictly more than ``minimum`` elements; adds ``size``."""
    return df.withColumn("size", F.size(column)).filter(F.col("size") > minimum)


def class_distribution(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Rows per split and class with the class's percentage of its split."""
    counts = df.groupBy(split, label).agg(F.count("*").alias("n"))
    totals = counts.groupBy(split).agg(F.sum("n").alias("_total"))
    return counts.join(totals, split).select(
        split, label, "n", (F.col("n") * 100.0 / F.col("_total")).alias("percent")
    )


def class_id_violations(df: DataFrame, label: str = "label") -> DataFrame:
    """Gaps in the class ids 0..N: empty when they start at 0 and rise by 1."""
    ids = df.agg(F.array_sort(F.collect_set(label)).alias("_ids"))  # one entry per class
    return ids.select(
        F.explode(
            F.array_except(
                F.sequence(F.lit(0), F.greatest(F.array_max("_ids"), F.lit(0))), F.col("_ids").cast("array<int>")
            )
        ).alias("missing_class")
    )


def class_weights(df: DataFrame, label: str = "label", max_proportion: float = 10.0) -> DataFrame:
    """Class counts, ``proportion`` = count over the smallest count, capped, and weights summing to 1."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    smallest = counts.agg(F.min("n")).scalar()
    shares = counts.withColumn("proportion", F.least(F.col("n") / smallest, F.lit(float(max_proportion))))
    inverse = shares.agg(F.sum(1.0 / F.col("proportion"))).scalar()
    return shares.withColumn("weight", (1.0 / F.col("proportion")) / inverse)


def proportional_mix(
    df: DataFrame,
    proportions: Mapping[int, float],
    seed: str | int,
    key: str = "person_id",
    label: str = "label",
) -> DataFrame:
    """Draw classes with given odds until the smallest class could have been seen ``sum(odds)`` times over.

    Adds ``draw``. The k-th draw of a class takes its row ``k mod size``, so smaller classes repeat.
    """
    classes = sorted(proportions)
    total = float(sum(proportions.values()))
    rows = df.filter(F.col(label).isin(classes)).withColumn("_h", keyed_hash(f"{seed}-row", key))
    rows = hash_rank(rows, "_h", [key], by=[label], out="_slot").drop("_h")
    rows = rows.withColumn("_slot", F.col("_slot") - 1)

    sizes = df.filter(F.col(label).isin(classes)).groupBy(label).agg(F.count("*").alias("_n"))
    length = sizes.agg(F.floor(F.min("_n") * total).cast("bigint").alias("_length"))
    draws = numbered_rows(length, "_length", "draw").drop("_length")
    draws = draws.withColumn(
        label, _pick_number(keyed_uniform(f"{seed}-draw", "draw"), classes, [proportions[c] for c in classes])
    )
    draws = running_total(
        draws, order=[("draw", True)], levels=[("_block", F.floor(F.col("draw") / BLOCK), True)],
        by=[label], out="_k",
    )
    asked = draws.join(F.broadcast(sizes), label).withColumn("_slot", F.pmod(F.col("_k") - 1, F.col("_n")))
    return asked.select("draw", label, "_slot").join(rows, [label, "_slot"]).drop("_slot")


def _pick_number(u: Column, classes: Sequence[int], weights: Sequence[float]) -> Column:
    return _pick(u, [str(c) for c in classes], weights).cast("int") if len(classes) > 1 else F.lit(classes[0])


def seeded_shuffle(df: DataFrame, seed: str | int, key: Sequence[str]) -> DataFrame:
    """A reproducible random order: a range-partitioned sort on a keyed hash."""
    return df.withColumn("_h", keyed_hash(seed, *key)).orderBy("_h", *key).drop("_h")
