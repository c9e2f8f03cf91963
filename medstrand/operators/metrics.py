"""Scores of a prediction table (``label``, ``scores``) as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medstrand.functions import scores as sc
from medstrand.operators.scale import ranged, running_total
from medstrand.sources.sinks import materialise


def score_rows(predictions: DataFrame) -> DataFrame:
    """Add ``prediction`` (argmax) and ``probabilities`` (softmax)."""
    return predictions.withColumn("prediction", sc.argmax(F.col("scores"))).withColumn(
        "probabilities", sc.softmax(F.col("scores"))
    )


def roc_auc(predictions: DataFrame, scores: str = "probabilities", save=materialise) -> DataFrame:
    """One-vs-rest AUC of each class among the labels; null when a class has no negatives.

    Scores are first counted by distinct value, then negatives below each score are a running
    total over even, stored ranges of scores, so a class is not sorted in one task.
    """
    present = predictions.agg(F.collect_set("label")).scalar()  # one entry per class
    long = predictions.select("label", F.posexplode(scores).alias("class", "score"))
    long = long.filter(F.array_contains(present, F.col("class")))
    counts = long.groupBy("class", "score").agg(
        F.count(F.when(F.col("label") == F.col("class"), 1)).alias("_pos"),
        F.count(F.when(F.col("label") != F.col("class"), 1)).alias("_neg"),
    )
    # Stored, because the ranges below read it once for their bounds and once more to be dealt.
    counts = ranged(save(counts, "scores"), [("class", True), ("score", True)], save)
    running = running_total(
        counts,
        order=[("score", True)],
        levels=[("_range", F.col("_range"), True)],
        by=["class"],
        value=F.col("_neg"),
        out="_upto",
    )
    area = F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2))
    return running.groupBy("class").agg(
        F.try_divide(area, (F.sum("_pos") * F.sum("_neg")).cast("double")).alias("roc_auc")
    )


def roc_report(auc: DataFrame) -> DataFrame:
    """``metric, value`` rows: each class's AUC and their mean."""
    named = auc.select(
        F.concat(F.lit("eval_roc_auc_"), F.col("class").cast("string"), F.lit("_vs_rest")).alias("metric"),
        F.col("roc_auc").alias("value"),
    )
    return named.union(auc.select(F.lit("eval_roc_auc_average"), F.avg("roc_auc")))


def classification_report(predictions: DataFrame) -> DataFrame:
    """``metric, value`` rows: precision, recall, F1 and support by class, accuracy, plain and weighted means."""
    cells = predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("p"), hit.alias("t")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("t")),
            )
        ).alias("x")
    )
    per_class = sides.groupBy(F.col("x.class").alias("class")).agg(
        F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"), F.sum("x.t").alias("hits")
    )
    zero = F.lit(0.0)
    rates = per_class.select(
        "class",
        "hits",
        F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("predicted")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("support")), zero).alias("recall"),
        F.coalesce(F.try_divide(F.col("hits") * 2.0, F.col("support") + F.col("predicted")), zero).alias("f1"),
        "support",
    )

    def rows(prefix, *columns):
        names = ["precision", "recall", "f1-score", "support"]
        return F.explode(
            F.array(
                *[
                    F.struct(F.concat(F.lit("eval_"), prefix, F.lit(f"_{n}")).alias("metric"), c.cast("double").alias("value"))
                    for n, c in zip(names, columns)
                ]
            )
        ).alias("m")

    measures = [F.col("precision"), F.col("recall"), F.col("f1")]
    by_class = rates.select(rows(F.col("class").cast("string"), *measures, F.col("support")))
    weighted = [F.try_divide(F.sum(m * F.col("support")), F.sum("support").cast("double")) for m in measures]
    whole = rates.agg(
        *[F.avg(m).alias(f"m{i}") for i, m in enumerate(measures)],
        *[w.alias(f"w{i}") for i, w in enumerate(weighted)],
        F.sum("support").alias("support"),
        F.try_divide(F.sum("hits").cast("double"), F.sum("support")).alias("accuracy"),
    )
    macro = whole.select(rows(F.lit("macro avg"), *[F.col(f"m{i}") for i in range(3)], F.col("support")))
    weight = whole.select(rows(F.lit("weighted avg"), *[F.col(f"w{i}") for i in range(3)], F.col("support")))
    accuracy = whole.select(F.lit("eval_accuracy").alias("metric"), F.col("accuracy").alias("value"))
    return by_class.union(macro).union(weight).select("m.metric", "m.value").union(accuracy)


def masked_accuracy(rows: DataFrame, predicted: str = "predictions", labels: str = "labels") -> DataFrame:
    """Share of predicted positions (label above -50) that are right; counted inside each row first."""
    pairs = F.arrays_zip(F.col(predicted).alias("p"), F.col(labels).alias("l"))
    chosen = F.filter(pairs, lambda x: x["l"] > -50)
    per_row = rows.select(
        F.size(chosen).alias("n"), F.size(F.filter(chosen, lambda x: x["l"] == x["p"])).alias("hits")
    )
    return per_row.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(
        "n", "hits", F.try_divide(F.col("hits").cast("double"), F.col("n")).alias("accuracy")
    )


def best_run(runs: DataFrame, config: str, metric: str, order: str) -> DataFrame:
    """The configuration with the highest metric; the earliest by ``order`` on a tie."""
    return runs.agg(
        F.max_by(config, F.struct(metric, -F.col(order))).alias(config), F.max(metric).alias(metric)
    )
