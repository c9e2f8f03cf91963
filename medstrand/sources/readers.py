"""Table, file and vocabulary scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medstrand.sources.sinks import materialise

# Columns of the terminology release's own description files.
FILE_COLUMNS = ("FIL", "DES", "FMT", "CLS", "RWS", "BTS")
COLUMN_COLUMNS = ("COL", "DES", "REF", "MIN", "AV", "MAX", "FIL", "DTY")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV with a header and a given schema; nothing is inferred, so nothing is read twice."""
    return spark.read.schema(ddl).option("header", True).option("enforceSchema", False).csv(path)


def read_table(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    """CSV when the path says so, else Parquet."""
    if ".csv" not in path:
        return read_parquet(spark, path)
    if ddl is None:
        raise ValueError("a CSV table needs a schema")
    return read_csv(spark, path, ddl)


def resolve_path(base: str, tail: str | None) -> str | None:
    return None if tail is None else base.rstrip("/") + "/" + tail.lstrip("/")


def read_catalog(
    spark: SparkSession, base: str, tails: Mapping[str, str | None], ddls: Mapping[str, str] | None = None
) -> dict[str, DataFrame | None]:
    """Named tables under one base directory; a table without a tail is absent. ``ddls`` are the CSV tables' schemas."""
    return {
        name: None if tail is None else read_table(spark, resolve_path(base, tail), (ddls or {}).get(name))
        for name, tail in tails.items()
    }


def read_rrf(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    usecols: Sequence[str] | None = None,
    selection: str | None = None,
) -> DataFrame:
    """Pipe-delimited file without header or quoting, whose rows end in a delimiter.

    All columns read as strings; only ``usecols`` and the columns of ``selection`` are parsed.
    """
    unknown = sorted(set(usecols or ()) - set(columns))
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    ddl = ", ".join(f"`{c}` string" for c in [*columns, "_end"])
    frame = spark.read.schema(ddl).option("sep", "|").option("quote", "").csv(path).drop("_end")
    if selection is not None:
        frame = frame.filter(selection)
    return frame.select(*(usecols or columns))


def rrf_lines(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Every line of such a file: its columns, and ``_line, _file, _fault``.

    ``_fault`` is null where the line has as many delimiters as columns and ends in one; else it is
    ``short``, ``long`` or ``open``, and the columns are null. Nothing of a line is lost: it is whole in ``_line``.
    """
    width = len(columns)
    parts = F.split("value", r"\|", -1)
    delimiters = F.size(parts) - 1
    fault = (
        F.when(delimiters > width, "long")
        .when(delimiters == width, F.when(F.element_at(parts, -1) != "", "long"))
        .when((delimiters == width - 1) & (F.element_at(parts, -1) != ""), "open")
        .otherwise("short")
    )
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), fault.alias("_fault"))
    value = lambda i: F.when(F.col("_fault").isNull(), F.nullif(F.get(parts, F.lit(i)), F.lit("")))
    return lines.select(*[value(i).alias(c) for i, c in enumerate(columns)], F.col("value").alias("_line"), "_file", "_fault")


def read_rrf_checked(
    spark: SparkSession, path: str, columns: Sequence[str], usecols: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``read_rrf`` of the lines that fit, and ``_line, _file, _fault`` of those that do not."""
    lines = rrf_lines(spark, path, columns)
    good = lines.filter(F.col("_fault").isNull()).select(*(usecols or columns))
    return good, lines.filter(F.col("_fault").isNotNull()).select("_line", "_file", "_fault")


def rrf_columns(files: DataFrame, name: str) -> list[str]:
    """Column names of one file, from the release's file list (one small row)."""
    row = files.filter(F.col("FIL") == name).select("FMT").first()
    if row is None:
        raise ValueError(f"{name} is not in the file list")
    return row["FMT"].split(",")


def column_descriptions(descriptions: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    return descriptions.filter((F.col("FIL") == name) & F.col("COL").isin(list(columns)))


def parse_vocabulary(lines: DataFrame) -> DataFrame:
    """``id, source, code, vocab_token`` from ``id, token``: tokens without ``:`` are skipped, more than one is an error."""
    part = F.split("token", ":")
    bad = F.raise_error(F.concat(F.lit("more than one ':' in vocabulary token "), F.col("token"))).cast("string")
    source = F.when(F.size(part) == 2, F.get(part, F.lit(0))).otherwise(bad)
    return lines.filter(F.col("token").contains(":")).select(
        "id", source.alias("source"), F.get(part, F.lit(1)).alias("code"), F.col("token").alias("vocab_token")
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, id`` of a text file or of the files of a folder in the order of their names; ids from 0 over all lines.

    Files are read by splits. A line's number is its place in its split and the lines of the splits
    before, whose counts are all that one task adds up: one row a split. The lines are stored once, so
    both passes see the same splits.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r$", "").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    lines = materialise(lines, "lines")
    split = ["_file", "_start"]
    counts = lines.groupBy(*split).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return lines.join(starts, split).select("line", (F.col("_before") + F.col("_at") - F.col("_first")).alias("id"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``token, id`` from a file of one token per line, or a folder of such files; the id is the line number from 0.

    Empty lines are counted but give no token.
    """
    return numbered_lines(spark, path).filter(F.col("line") != "").select(
        F.col("line").alias("token"), F.col("id").cast("int").alias("id")
    )


def read_label_tasks(spark: SparkSession, base: str, ddl: str, skipped: Sequence[str] = ()) -> DataFrame:
    """All prediction tasks in one scan but the ``skipped`` ones, ``<base>/<task>/labeled_patients.csv``, with a ``task`` column."""
    frame = read_csv(spark, f"{base.rstrip('/')}/*/labeled_patients.csv", ddl)
    task = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/labeled_patients\.csv", 1)
    tasks = frame.withColumn("task", task)
    return tasks.filter(~F.col("task").isin(*skipped)) if skipped else tasks


def with_file(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.col("_metadata.file_path"))
