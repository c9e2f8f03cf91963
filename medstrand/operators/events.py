"""Configured projections and filters, token building, unions and differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medstrand.functions import codes
from medstrand.schema import CODE_COLUMNS

Tables = Mapping[str, DataFrame | None]


def select_columns(tables: Tables, config: Mapping) -> dict[str, DataFrame | None]:
    """Project each present table with its ``select_expr`` list; later entries may use earlier aliases."""
    return {
        name: None if df is None else df.selectExpr(*config["tables"][name]["select_expr"])
        for name, df in tables.items()
    }


def filter_rows(tables: Tables, config: Mapping) -> dict[str, DataFrame | None]:
    """Keep the rows of each present table that satisfy its ``filter_expr``."""
    return {
        name: None if df is None else df.where(config["tables"][name]["filter_expr"])
        for name, df in tables.items()
    }


def filter_dates(tables: Tables, predicate: str) -> dict[str, DataFrame | None]:
    """Apply one date predicate to every event table (all but ``patient``)."""
    return {
        name: df if df is None or name == "patient" else df.where(predicate)
        for name, df in tables.items()
    }


def create_tokens(df: DataFrame, code_column: str, type_column: str) -> DataFrame:
    return df.withColumn(
        "general_event_token", codes.event_token(F.col(type_column), F.col(code_column))
    )


def event_tokens(tables: Tables) -> DataFrame | None:
    """Long-form tokens of the diagnosis, prescription and procedure tables that are present."""
    frames = [
        create_tokens(tables[name], code, kind)
        for name, (kind, code) in CODE_COLUMNS.items()
        if tables.get(name) is not None
    ]
    return merge_frames(["person_id", "date", "general_event_token"], *frames)


def merge_frames(columns: Sequence[str], *frames: DataFrame | None) -> DataFrame | None:
    """Union of the frames that are present, in a fixed column order."""
    present = [df.select(*columns) for df in frames if df is not None]
    return reduce(DataFrame.union, present) if present else None


def recombine(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column one frame lacks is null for its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe_events(events: DataFrame, keys: Sequence[str], by: str = "date") -> DataFrame:
    """One row per key, keeping the smallest ``by``; partial aggregation combines before the shuffle."""
    return events.groupBy(*keys).agg(F.min(by).alias(by))


def split_by_keys(df: DataFrame, keys: list[str], column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` contains any key, and the others; null goes to neither side."""
    found = codes.contains_any(F.col(column), keys)
    return df.filter(found), df.filter(~found)


def split_source_code(raw: DataFrame) -> DataFrame:
    """``Source/Code`` into ``raw_source`` and a lower-cased ``code``."""
    return raw.withColumn("raw_source", codes.code_part(F.col("code"), "/", 0)).withColumn(
        "code", F.lower(codes.code_part(F.col("code"), "/", 1))
    )


def mapping_table(spark, mapping: Mapping[str, str], column: str, new_column: str) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), f"`{column}` string, `{new_column}` string")


def apply_mapping(df: DataFrame, mapping: Mapping[str, str], column: str, new_column: str) -> DataFrame:
    """Add ``new_column`` = mapping of ``column``, null where the mapping has no such key.

    The mapping is the caller's and does not grow with the rows, so it is broadcast: Spark does not know
    its size, and would gather all rows of one value, of which there are few, in one task.
    """
    table = mapping_table(df.sparkSession, mapping, column, new_column)
    return df.join(F.broadcast(table), on=column, how="left")


def value_differences(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` found on one side only, with ``missing_from`` left or right.

    Each side is reduced to distinct values before they meet, so the shuffle carries values, not rows.
    """
    tagged = (
        left.select(column).distinct().withColumn("_side", F.lit(1))
        .union(right.select(column).distinct().withColumn("_side", F.lit(2)))
    )
    return (
        tagged.groupBy(column)
        .agg(F.sum("_side").alias("_side"))
        .filter("_side < 3")
        .select(column, F.when(F.col("_side") == 1, "right").otherwise("left").alias("missing_from"))
    )


def missing_mappings(df: DataFrame, mapping: Mapping[str, str], column: str) -> DataFrame:
    """Mapping keys absent from the data and data values absent from the mapping."""
    table = mapping_table(df.sparkSession, mapping, column, "_value").select(column)
    return value_differences(df, table, column).select(
        column,
        F.when(F.col("missing_from") == "left", "data").otherwise("mapping").alias("missing_from"),
    )
