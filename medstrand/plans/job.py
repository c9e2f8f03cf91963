"""The whole base job: a configuration file, tables in, and outputs that appear together."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from medstrand import schema
from medstrand.operators.events import Tables
from medstrand.plans.base import OPTIONAL, Prepared, prepare
from medstrand.sources import outputs, sinks

SETTINGS = ("tables", "event_date_filter", "number_of_days_threshold")
LAB_SETTINGS = ("min_loinc_counts", "min_loinc_value_counts")


def read_config(spark: SparkSession, path: str) -> dict:
    """The mapping in a JSON file, or in any other file as YAML, from wherever Spark can read; needs PyYAML for YAML."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith(".json"):
        config = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as error:
            raise ImportError(f"reading {path} needs the package PyYAML; JSON files are read without it") from error
        config = yaml.safe_load(text)
    if not isinstance(config, dict):
        raise ValueError(f"{path} holds no mapping")
    return config


def check_config(config: Mapping, tables: Tables) -> None:
    """Every fault of a configuration against its tables' columns, in one error before any job runs.

    Settings that are missing, expressions that do not resolve (later entries may use earlier aliases),
    filters that are not true or false, aggregates, which would turn a table into one row, and columns
    that the next steps need. Analysis reads schemas, not data.
    """
    present = {name: df for name, df in tables.items() if df is not None}
    needed = SETTINGS + (LAB_SETTINGS if "lab" in present else ())
    faults = [f"{key}: missing" for key in needed if key not in config]
    for name, df in present.items():
        entry = config.get("tables", {}).get(name)
        if not isinstance(entry, Mapping):
            faults.append(f"tables.{name}: missing")
            continue
        faults += _table_faults(name, df, entry, config.get("event_date_filter"))
    if faults:
        raise ValueError("faults in the configuration:\n" + "\n".join(faults))


def _table_faults(name: str, df, entry: Mapping, dates: str | None) -> list[str]:
    faults = [f"tables.{name}.{key}: missing" for key in ("select_expr", "filter_expr") if key not in entry]
    if faults:
        return faults
    expressions = entry["select_expr"]
    for i, text in enumerate(expressions):
        at = f"tables.{name}.select_expr[{i}] ({text})"
        try:
            # With its predecessors, whose aliases it may use.
            so_far = df.selectExpr(*expressions[: i + 1])
            if text.strip() != "*":
                # An aggregate among plain columns does not resolve; alone, it would give one row.
                df.selectExpr("*", *expressions[: i + 1])
        except AnalysisException as error:
            return [f"{at}: {_first_line(error)}"]
    for key, text in (("filter_expr", entry["filter_expr"]), ("event_date_filter", None if name == "patient" else dates)):
        if text is None:
            continue
        try:
            so_far.where(text)
        except AnalysisException as error:
            at = f"tables.{name}.{key}" if key == "filter_expr" else f"{key} on {name}"
            faults.append(f"{at} ({text}): {_first_line(error)}")
    try:
        schema.require(so_far, schema.TABLES.get(name, ""), OPTIONAL) if name in schema.TABLES else None
    except ValueError as error:
        faults.append(f"tables.{name}.select_expr: {error}")
    return faults


def _first_line(error: Exception) -> str:
    return str(error).splitlines()[0]


def output_paths(base: str) -> dict[str, str]:
    root = base.rstrip("/")
    return {name: f"{root}/{name}" for name in ("sequences", "conversions", "percentiles", "cutflow")}


def run_job(spark: SparkSession, config: Mapping, tables: Tables, base: str, **settings) -> Prepared:
    """``plans.base.prepare`` with its outputs under ``base``, named in ``base/manifest.json`` when all are there.

    Configuration and targets are checked before the first scan. ``settings`` go to ``prepare``. The
    report is one CSV file, the rest Parquet; lab tables are there where there are labs.
    """
    check_config(config, tables)
    paths, manifest = output_paths(base), f"{base.rstrip('/')}/manifest.json"
    outputs.require_absent(spark, [*paths.values(), manifest])
    made = prepare(config, tables, **settings)
    frames = {paths[name]: getattr(made, name) for name in paths if getattr(made, name) is not None}
    outputs.write_together(spark, frames, manifest, {paths["cutflow"]: sinks.write_report})
    return made
