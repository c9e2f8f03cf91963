"""Whole pipelines: base tables to sequences, and labels for all splits."""

import re

from pyspark.sql import functions as F

from checks import standins as st
from checks.q_labels import CAPPED_SQL
from checks.registry import CTES, query, seq_text
from medstrand.plans.base import prepare, step_names
from medstrand.plans.labelled import label_sequences as build_label_sequences

DAYS = 365
SINCE = "1996-01-01"
CONFIG = {
    "tables": {
        "patient": {"select_expr": ["*"], "filter_expr": "person_id IS NOT NULL"},
        "diagnosis": {"select_expr": ["*"], "filter_expr": "dx_diagnosis_code IS NOT NULL AND dx_diagnosis_code NOT LIKE '%P'"},
        "prescription": {"select_expr": ["*"], "filter_expr": "rx_prescription_code IS NOT NULL"},
        "procedure": {"select_expr": ["*"], "filter_expr": "pr_procedure_code IS NOT NULL"},
        "lab": {"select_expr": ["*"], "filter_expr": "lx_result_val IS NOT NULL AND lx_result_unit IS NOT NULL"},
    },
    "event_date_filter": f"date >= TIMESTAMP'{SINCE}' AND date <= TIMESTAMP'2300-12-31'",
    "number_of_days_threshold": DAYS,
    "min_loinc_counts": st.MIN_COUNT,
    "min_loinc_value_counts": st.MIN_VALUES,
}

_STEPS = ["lab_ok", "unit_rank", "conversion", "converted", "frequent", "bounds", "grouped", "labtok"]
CTES["lab_since"] = f"SELECT * FROM lab WHERE date >= TIMESTAMP '{SINCE}'"
for _name in _STEPS:
    _body = re.sub(r"\blab\b", "lab_since", CTES[_name])
    CTES[_name + "_since"] = re.sub(rf"\b({'|'.join(_STEPS)})\b", r"\1_since", _body)
CTES["full_tok"] = f"""
SELECT person_id, date, token FROM dx_tok WHERE token NOT LIKE '%P' AND date >= TIMESTAMP '{SINCE}'
UNION ALL SELECT person_id, date, token FROM rx_tok WHERE date >= TIMESTAMP '{SINCE}'
UNION ALL SELECT person_id, date, token FROM pr_tok WHERE date >= TIMESTAMP '{SINCE}'
UNION ALL SELECT person_id, date, token FROM labtok_since"""
CTES["full_aligned"] = st._aligned("full_tok")
CTES["full_base"] = st._base("full_tok")
CTES["full_unique"] = f"""
SELECT person_id, min(date) AS date, day, token FROM full_aligned
WHERE person_id IN (SELECT person_id FROM full_aligned GROUP BY 1 HAVING max(day) >= {DAYS}) GROUP BY ALL"""


def tables(spark, d):
    return {
        "patient": st.patient(spark, d),
        "diagnosis": st.diagnosis(spark, d),
        "prescription": st.prescription(spark, d),
        "procedure": st.procedure(spark, d),
        "lab": st.lab(spark, d),
    }


@query(
    "person_sequences_full",
    """SELECT person_id, count(*) AS n_tokens, string_agg(day || '@' || token, '|' ORDER BY date NULLS FIRST, day, token) AS seq FROM (
         SELECT * FROM full_unique UNION ALL
         SELECT person_id, date, day, token FROM full_base WHERE person_id IN (SELECT person_id FROM full_unique)) GROUP BY 1""",
)
def person_sequences_full(spark, d):
    out = prepare(CONFIG, tables(spark, d), accuracy=st.ACCURACY)
    return out.sequences.select("person_id", F.size("seq").cast("bigint").alias("n_tokens"), seq_text().alias("seq"))


def _persons(*sources):
    return "(SELECT count(DISTINCT person_id) FROM (" + " UNION ALL ".join(sources) + "))"


_ALL = [f"SELECT person_id FROM {t}" for t in ("diagnosis", "prescription", "procedure_t", "lab")]
_KEPT = ["SELECT person_id FROM diagnosis WHERE dx_diagnosis_code NOT LIKE '%P'", *_ALL[1:]]
_DATED = [s + (" AND" if "WHERE" in s else " WHERE") + f" date >= TIMESTAMP '{SINCE}'" for s in _KEPT]
_COUNTS = [_persons(*_ALL), _persons(*_KEPT), _persons(*_DATED)] + [_persons("SELECT person_id FROM full_tok")] * 2
_COUNTS += [_persons("SELECT person_id FROM full_unique")] * 3


@query(
    "cutflow",
    " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS step, '{name}' AS cut_name, {count} AS number_patients"
        for i, (name, count) in enumerate(zip(step_names(DAYS), _COUNTS), 1)
    ),
)
def cutflow(spark, d):
    out = prepare(CONFIG, tables(spark, d), accuracy=st.ACCURACY)
    return out.cutflow.withColumn("step", F.col("step").cast("bigint"))


CTES["smark"] = "SELECT m.person_id, date, token, split FROM lab_marks m JOIN splitmap ON person_id = omop_person_id"
CTES["ssmall"] = CAPPED_SQL.format(
    h=st.sql_hash("ls", "person_id", "date", "token"), ties="person_id, date, token", t=100,
    rows="(SELECT person_id, date, token, 0 AS o_orderkey FROM smark WHERE split = 'val')",
).replace("SELECT person_id, o_orderkey, r.token AS general_event_token", "SELECT person_id, date, r.token AS token")
CTES["srows"] = """
SELECT e.person_id, e.date, e.token, s.split FROM ev e JOIN splitmap s ON e.person_id = s.omop_person_id
UNION ALL SELECT e.person_id, e.date, e.token, 'small_val' FROM ev e JOIN splitmap s ON e.person_id = s.omop_person_id WHERE s.split = 'val'
UNION ALL SELECT person_id, date, token, split FROM smark
UNION ALL SELECT person_id, date, token, 'small_val' FROM ssmall"""
CTES["sfirst"] = "SELECT person_id, split, min(date) AS f FROM srows GROUP BY 1, 2"


@query(
    "label_sequences",
    """SELECT person_id, split, string_agg(day || '@' || token, '|' ORDER BY date NULLS FIRST, day, token) AS seq FROM (
         SELECT person_id, split, date, date_diff('day', f, date) + 1 AS day, token FROM srows JOIN sfirst USING (person_id, split)
         UNION ALL
         SELECT person_id, split, px_birth_date, 0, unnest(list_filter(['AGE:' || CAST(floor(date_diff('day', px_birth_date, f) / 365) AS BIGINT),
           'ETHNICITY:' || px_ethnicity, 'GENDER:' || px_gender, 'RACE:' || px_race, 'REGION:' || px_region], lambda x: x IS NOT NULL))
         FROM patient JOIN sfirst USING (person_id)) GROUP BY 1, 2""",
)
def label_sequences(spark, d):
    labels = st.prediction_labels(spark, d)
    sequences, _ = build_label_sequences(
        st.tokens(spark, d), st.patient(spark, d), labels, st.split_map(spark, d), "ls", threshold=100
    )
    return sequences.select("person_id", "split", seq_text().alias("seq"))
