"""Table, split, vocabulary and report sinks, and shared scratch space."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: rows per output file of a split.
ROWS_PER_FILE = 10_000


def write_table(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_splits(
    df: DataFrame,
    path: str,
    by: Sequence[str] = ("split", "label"),
    rows_per_file: int = ROWS_PER_FILE,
    tasks: int | None = None,
    key: str = "person_id",
) -> None:
    """All splits and classes in one pass, one directory each, files bounded by row count.

    As it stands every task writes to every directory it has rows for. With ``tasks`` the rows are
    first gathered so that a directory is written by at most that many tasks: fewer files, and a
    directory with most of the rows is still shared out.
    """
    if tasks is not None:
        share = F.pmod(F.xxhash64(key), F.lit(tasks))
        df = df.repartition(*[F.col(c) for c in by], share)
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def write_vocabulary(vocabulary: DataFrame, path: str, parts: int = 1) -> None:
    """One token per line in id order: one file, or ``parts`` files whose names are in id order too."""
    ordered = vocabulary.repartition(1) if parts == 1 else vocabulary.repartitionByRange(parts, "id")
    ordered.sortWithinPartitions("id").select("token").write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/medstrand/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder ``spark.checkpoint.dir`` names, in a folder of this application.

    Where the session does not set it, the warehouse directory serves, which driver and executors
    share as well; a machine's own temporary folder is never used.
    """
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables of this application; results that still read them must be done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: cuts lineage so that later steps do not repeat the work after a lost executor."""
    path = scratch_path(df.sparkSession, name)
    write_table(df, path, overwrite=False)
    return df.sparkSession.read.parquet(path)


