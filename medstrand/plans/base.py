"""Raw clinical tables to person sequences."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medstrand import schema
from medstrand.operators import blocks as bl
from medstrand.operators import events as ev
from medstrand.operators import labs as lb
from medstrand.operators import quality, timeline
from medstrand.sources import sinks

COLUMNS = ["person_id", "date", "general_event_token"]
# Demographic columns a patient table may lack.
OPTIONAL = ("px_race", "px_ethnicity", "px_gender", "px_region")
EVENT_TABLES = ("diagnosis", "prescription", "procedure", "lab")


@dataclass
class Prepared:
    sequences: DataFrame
    conversions: DataFrame | None
    percentiles: DataFrame | None
    cutflow: DataFrame
    tokens: DataFrame
    patients: DataFrame | None
    min_days: int

    def blocks(self, size: int = bl.BLOCK_SIZE) -> DataFrame:
        """The sequences in blocks of ``size`` elements, for histories longer than a row can be."""
        return bl.build_blocks(self.tokens, self.patients, self.min_days, size)


def step_names(min_days: int) -> list[str]:
    # Names of the report's steps.
    return [
        "overall patients",
        "After yaml selections",
        "After date day filtering",
        "patients after yaml selections",
        "patients days aligned to first diagnosis",
        f"patients filtered to have at least {min_days} days of data",
        "duplicate events dropped",
        "consolidated into arrays",
    ]


def prepare(
    config: Mapping,
    tables: ev.Tables,
    conversions: DataFrame | None = None,
    percentiles: DataFrame | None = None,
    accuracy: int = 10_000,
) -> Prepared:
    """Project, filter, tokenise, merge, deduplicate and collect.

    Lab tables are learned from the data unless both ``conversions`` and ``percentiles`` are given.
    Filters stay in the plan next to the scans so they reach the files. Duplicates leave by
    calendar day, which is the same as by day number, so the dates need no alignment first.

    The fitted lab tables and the merged tokens are written to the shared scratch folder when this
    is called, because several later steps read them; the sequences and the report stay lazy.
    """
    min_days = config["number_of_days_threshold"]
    selected = ev.select_columns(tables, config)
    for name, df in selected.items():
        if df is not None and name in schema.TABLES:
            schema.require(df, schema.TABLES[name], OPTIONAL)
    kept = ev.filter_dates(ev.filter_rows(selected, config), config["event_date_filter"])

    lab_frame, tokens, tagged = None, ev.event_tokens(kept), []
    if kept.get("lab") is not None:
        limits = config["min_loinc_counts"], config["min_loinc_value_counts"]
        if conversions is None or percentiles is None:
            # Read once from the raw table; the report's tags stand beside the labs that pass, and alone where none does.
            labs = sinks.materialise(_tagged_labs(selected["lab"], config), "labs")
            usable = labs.filter(F.col("lx_result_val").isNotNull()).drop("reached")
            lab_frame, conversions, percentiles = lb.fit_apply_clean(
                usable, *limits, accuracy=accuracy, save=sinks.materialise
            )
            selected = {**selected, "lab": None}
            tagged.append(labs)
        else:
            lab_frame = lb.apply(kept["lab"], conversions, percentiles, *limits, save=sinks.materialise)
    merged = ev.merge_frames(COLUMNS, tokens, lab_frame)

    present = merged.filter(F.col("general_event_token").isNotNull()).withColumn("_on", F.to_date("date"))
    unique = ev.dedupe_events(present, ["person_id", "_on", "general_event_token"]).select(*COLUMNS)
    unique = sinks.materialise(unique, "tokens")
    patients = kept.get("patient")
    sequences = timeline.build_sequences(unique, patients, min_days=min_days)
    steps = _tagged_steps(selected, config, unique, tagged)
    report = quality.cutflow(steps, step_names(min_days), min_days)
    return Prepared(sequences, conversions, percentiles, report, unique, patients, min_days)


def _reached(name: str, config: Mapping) -> Column:
    """The furthest step of the report that a raw row of a table comes to."""
    passes = F.coalesce(F.expr(config["tables"][name]["filter_expr"]), F.lit(False))
    in_dates = F.coalesce(F.expr(config["event_date_filter"]), F.lit(False))
    return F.when(~passes, 1).when(~in_dates, 2).otherwise(3)


def _tagged_labs(selected: DataFrame, config: Mapping) -> DataFrame:
    """Every row of the lab table as ``person_id, reached`` and, where it is kept and ``labs.clean``, what tokens are made of."""
    tagged = selected.withColumn("reached", _reached("lab", config))
    usable = (F.col("reached") == 3) & lb.clean_code() & F.col("lx_result_unit").isNotNull()
    tagged = tagged.withColumn("_value", F.when(usable, lb.clean_value()))
    kept = ["date", "lx_lab_code", "lx_lab_code_type", "lx_result_unit"]
    return tagged.select(
        "person_id", "reached", F.col("_value").alias("lx_result_val"),
        *[F.when(F.col("_value").isNotNull(), F.col(c)).alias(c) for c in kept],
    )


def _tagged_steps(selected: ev.Tables, config: Mapping, tokens: DataFrame, tagged: list[DataFrame]) -> DataFrame:
    """``person_id, reached, date`` of every raw event row, tagged in the scan that reads it, and of every token.

    ``tagged`` are tables whose rows are already stored with their tag.
    """
    none = F.lit(None).cast("timestamp").alias("date")
    rows = [tokens.select("person_id", F.lit(4).alias("reached"), "date")]
    rows += [df.select("person_id", "reached", none) for df in tagged]
    for name in EVENT_TABLES:
        df = selected.get(name)
        if df is not None:
            rows.append(df.select("person_id", _reached(name, config).alias("reached"), none))
    return reduce(DataFrame.union, rows)
