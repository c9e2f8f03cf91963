"""Canonical table schemas and a conforming projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATIENT = (
    "person_id bigint, px_birth_date timestamp, px_race string, px_ethnicity string, "
    "px_gender string, px_region string"
)
DIAGNOSIS = "person_id bigint, date timestamp, dx_diagnosis_code string, dx_diagnosis_code_type string"
PRESCRIPTION = (
    "person_id bigint, date timestamp, rx_prescription_code string, rx_prescription_code_type string"
)
PROCEDURE = "person_id bigint, date timestamp, pr_procedure_code string, pr_procedure_code_type string"
LAB = (
    "person_id bigint, date timestamp, lx_lab_code string, lx_lab_code_type string, "
    "lx_result_val string, lx_result_unit string"
)
RAW_EVENTS = "patient_id string, start string, end string, code string, value string, unit string"
PREDICTION_LABELS = "patient_id string, value string, label_type string, prediction_time string"
SPLIT_MAP = "omop_person_id string, split string"

# One element of a person's ordered sequence.
SEQUENCE = "array<struct<date: timestamp, day: int, token: string>>"

TABLES = {
    "patient": PATIENT,
    "diagnosis": DIAGNOSIS,
    "prescription": PRESCRIPTION,
    "procedure": PROCEDURE,
    "lab": LAB,
}

CODE_COLUMNS = {
    "diagnosis": ("dx_diagnosis_code_type", "dx_diagnosis_code"),
    "prescription": ("rx_prescription_code_type", "rx_prescription_code"),
    "procedure": ("pr_procedure_code_type", "pr_procedure_code"),
}


def require(df: DataFrame, ddl: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as it is, if it has the columns of ``ddl``; else an error here, not later."""
    missing = [name for name in (part.strip().split(" ", 1)[0] for part in ddl.split(",")) if name not in (*df.columns, *optional)]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project ``df`` to the columns and types of ``ddl``; a missing column is an error here, not later."""
    fields = [part.strip().split(" ", 1) for part in ddl.split(",")]
    return require(df, ddl).select(*[F.col(name).cast(kind).alias(name) for name, kind in fields])


def sequence_element(date: Column, day: Column, token: Column) -> Column:
    return F.struct(
        date.cast("timestamp").alias("date"), day.cast("int").alias("day"), token.alias("token")
    )
