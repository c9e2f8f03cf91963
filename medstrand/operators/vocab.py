"""Token frequencies and the vocabulary table (``token``, ``id``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medstrand.operators.scale import ranged, running_total
from medstrand.sources.sinks import materialise

# Special tokens, in the order their ids follow the ranked tokens.
MASK, CLS, UNK = "[MASK]", "[CLS]", "[UNK]"


def token_counts(
    wide: DataFrame, split_percentile_tokens: bool = False, column: str = "sorted_event_tokens"
) -> DataFrame:
    """Frequency of each token; with the option, only its first two ``:`` parts count."""
    tokens = wide.select(F.explode(column).alias("token"))
    if split_percentile_tokens:
        tokens = tokens.withColumn("token", F.substring_index("token", ":", 2))
    return tokens.filter(F.col("token").isNotNull()).groupBy("token").agg(F.count("*").alias("n"))


def cumulative_fractions(counts: DataFrame, save=materialise) -> DataFrame:
    """Running count and fraction in order of frequency, then token.

    Buckets are even ranges of that order, whatever the tokens look like; they are stored once.
    """
    order = [("n", False), ("token", True)]
    counts = ranged(counts, order, save)
    running = running_total(
        counts, order=order, levels=[("_range", F.col("_range"), True)], value=F.col("n"), out="cum_count"
    ).drop("_range")
    total = counts.agg(F.sum("n")).scalar()
    return running.withColumn("cum_count_frac", F.col("cum_count") / total)


def vocabulary(
    counts: DataFrame,
    size: int,
    single_age_token: bool = False,
    skip_special_tokens: bool = False,
) -> DataFrame:
    """The ``size`` most frequent tokens with ids from 0, then the special tokens.

    The limit keeps at most ``size`` rows of each task, so the final ranking sees ``size`` rows
    whatever the number of distinct tokens.
    """
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(size)
    tail = ([] if skip_special_tokens else [MASK, CLS]) + [UNK]
    if single_age_token:
        top = top.filter(~F.col("token").startswith("AGE:"))
        tail = ["AGE", *tail]
    spark = counts.sparkSession
    special = spark.createDataFrame([(1, i, 0, t) for i, t in enumerate(tail)], "_g int, _i int, n bigint, token string")
    ranked = top.select(F.lit(0).alias("_g"), F.lit(0).alias("_i"), "n", "token").unionByName(special)
    order = Window.orderBy("_g", "_i", F.desc("n"), "token")  # at most size + 4 rows
    return ranked.select("token", (F.row_number().over(order) - 1).cast("int").alias("id"))
