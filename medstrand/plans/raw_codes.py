"""A raw ``Source/Code`` event table to translated events and demographics."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medstrand.operators import events as ev
from medstrand.operators import terms

DEMOGRAPHIC_KEYS = ["Race", "Gender", "Ethnicity"]
# Meaning of the numbered race codes.
RACE_CODES = {
    "Race/5": "Race/White",
    "Race/4": "Race/Pacific_Islander",
    "Race/3": "Race/Black",
    "Race/2": "Race/Asian",
    "Race/1": "Race/American_Indian",
}


@dataclass
class Translated:
    """Lazy results; nothing has run yet."""

    events: DataFrame
    demographics: DataFrame
    null_rate_events: DataFrame
    null_rate_codes: DataFrame
    valid_tests: DataFrame
    coverage: DataFrame
    demographic_violations: DataFrame


def parse_times(raw: DataFrame) -> DataFrame:
    fmt = F.lit("yyyy-MM-dd HH:mm:ss")
    return raw.withColumn("start", F.try_to_timestamp("start", fmt)).withColumn(
        "end", F.try_to_timestamp("end", fmt)
    )


def map_demographics(wide: DataFrame, mappings: Mapping[str, Mapping[str, str]]) -> DataFrame:
    named = ev.apply_mapping(wide, RACE_CODES, "race_code", "race_code_mapped")
    named = ev.apply_mapping(named, mappings["race_mapping"], "race_code_mapped", "px_race")
    named = ev.apply_mapping(named, mappings["gender_mapping"], "gender_code", "px_gender")
    named = ev.apply_mapping(named, mappings["ethnicity_mapping"], "ethnicity_code", "px_ethnicity")
    return named.select(
        F.col("patient_id").alias("person_id"),
        "px_race",
        "px_gender",
        "px_ethnicity",
        F.col("gender_date").alias("px_birth_date"),
    )


def translate_raw(
    raw: DataFrame,
    vocabulary: DataFrame,
    concepts: DataFrame,
    mappings: Mapping[str, Mapping[str, str]],
) -> Translated:
    """``raw`` has text times; ``vocabulary`` is ``source, code, vocab_token``; ``concepts`` is the concept map."""
    timed = parse_times(raw)
    demographic, medical = ev.split_by_keys(timed, DEMOGRAPHIC_KEYS, "code")
    wide = terms.demographics_wide(demographic)

    medical = ev.split_source_code(medical)
    medical = ev.apply_mapping(medical, mappings["data_to_umls_source_map"], "raw_source", "source")
    target = ev.apply_mapping(
        vocabulary.select(F.col("source").alias("vocab_source"), "code", "vocab_token"),
        mappings["vocab_to_umls_source_map"],
        "vocab_source",
        "source",
    ).select("source", "code", "vocab_token")

    translation = terms.derive_translation(medical, target, concepts)
    translated = terms.translate_events(medical, translation)
    return Translated(
        events=terms.lab_value_suffix(translated),
        demographics=map_demographics(wide, mappings),
        null_rate_events=terms.null_rates(translated),
        null_rate_codes=terms.null_rates(translated, distinct_codes=True),
        valid_tests=terms.valid_test_rate(translated),
        coverage=terms.translation_coverage(medical, target, translation),
        demographic_violations=terms.demographics_violations(wide, timed),
    )
