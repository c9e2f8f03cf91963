"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last return the columns of ``documents``.

Nulls, empty and very long texts, repeated rows, empty tables and other columns are dealt with as
each operator's module says; a stage passes other columns on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medstrand.llm import decontaminate, packing, simhash_dedup, substring_dedup, toxicity
from medstrand.llm.queries import tokenizer_files
from medstrand.sources.sinks import materialise, scratch_path

# Part of the labels that is never learned from, and the score from which a document is rejected.
HELD = 2
TOXIC_FROM = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of these documents, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held=HELD)
    return toxicity.reject(docs, model, TOXIC_FROM)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike at 0.8 in runs of five words, the one with the smallest id."""
    return simhash_dedup.deduplicate(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier one holds.

    ``n_chars``, where there is one, counts what is left. A document with nothing left goes.
    """
    found = materialise(substring_dedup.passages(docs), "passages")
    kept = substring_dedup.cut(docs, found)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item stand."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in full windows."""
    _, places = packing.pack_documents(docs, *tokenizer_files())
    return places.drop("_row")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

# No SQL can say boosted trees, a search of trees or a chain of seeds; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
