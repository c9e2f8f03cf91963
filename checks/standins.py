"""Canonical clinical tables as plain expressions over the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import CTES
from medstrand.functions.codes import event_token
from medstrand.functions.keyed import keyed_uniform
from medstrand.operators import events as ev
from medstrand.operators import timeline


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- clinical tables -------------------------------------------------------------------------

def patient(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    days = F.expr("cast((c_custkey * 37) % 20000 as int)")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("person_id"),
        F.date_add(F.lit("1930-01-01").cast("date"), days).cast("timestamp").alias("px_birth_date"),
        F.col("c_mktsegment").alias("px_race"),
        F.concat(F.lit("E"), F.col("n_regionkey").cast("string")).alias("px_ethnicity"),
        F.expr("case when c_custkey % 11 = 0 then null when c_custkey % 2 = 0 then 'F' else 'M' end").alias("px_gender"),
        F.col("n_name").alias("px_region"),
    )


CTES["patient"] = """
SELECT c_custkey AS person_id,
  CAST(DATE '1930-01-01' + CAST((c_custkey * 37) % 20000 AS INTEGER) AS TIMESTAMP) AS px_birth_date,
  c_mktsegment AS px_race, 'E' || n_regionkey AS px_ethnicity,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS px_gender,
  n_name AS px_region
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def diagnosis(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("person_id"),
        F.col("o_orderdate").cast("timestamp").alias("date"),
        F.concat(F.substring("o_orderpriority", 1, 1), "o_orderstatus").alias("dx_diagnosis_code"),
        F.lit("ICD10CM").alias("dx_diagnosis_code_type"),
    )


CTES["diagnosis"] = """
SELECT o_custkey AS person_id, o_orderdate AS date,
  substr(o_orderpriority, 1, 1) || o_orderstatus AS dx_diagnosis_code, 'ICD10CM' AS dx_diagnosis_code_type
FROM orders"""


def order_lines(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey)


def prescription(spark, d):
    return order_lines(spark, d).select(
        F.col("o_custkey").alias("person_id"),
        F.col("l_shipdate").cast("timestamp").alias("date"),
        F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("rx_prescription_code"),
        F.lit("NDC").alias("rx_prescription_code_type"),
    )


CTES["prescription"] = """
SELECT o_custkey AS person_id, l_shipdate AS date,
  lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS rx_prescription_code, 'NDC' AS rx_prescription_code_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def procedure(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("person_id"),
        F.col("ts").cast("timestamp").alias("date"),
        F.col("event_type").alias("pr_procedure_code"),
        F.lit("CPT").alias("pr_procedure_code_type"),
    )


CTES["procedure_t"] = """
SELECT user_id AS person_id, ts AS date, event_type AS pr_procedure_code, 'CPT' AS pr_procedure_code_type
FROM events"""


def lab(spark, d):
    return order_lines(spark, d).select(
        F.col("o_custkey").alias("person_id"),
        F.col("l_shipdate").cast("timestamp").alias("date"),
        F.expr("lpad(cast(l_suppkey as string), 4, '0') || '-' || cast(l_suppkey % 10 as string)").alias("lx_lab_code"),
        F.expr("case when l_linenumber = 7 then 'TNX' else 'LOINC' end").alias("lx_lab_code_type"),
        F.expr("case when l_orderkey % 97 = 0 then 'n/a' else cast(l_extendedprice as string) end").alias("lx_result_val"),
        F.expr(
            "case when l_orderkey % 50 = 0 then 'mmol/L' when l_returnflag = 'A' then 'mg/dL' "
            "when l_returnflag = 'N' then 'g/L' else 'ug/mL' end"
        ).alias("lx_result_unit"),
    )


CTES["lab"] = """
SELECT o_custkey AS person_id, l_shipdate AS date,
  lpad(CAST(l_suppkey AS VARCHAR), 4, '0') || '-' || (l_suppkey % 10) AS lx_lab_code,
  CASE WHEN l_linenumber = 7 THEN 'TNX' ELSE 'LOINC' END AS lx_lab_code_type,
  CASE WHEN l_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(l_extendedprice AS VARCHAR) END AS lx_result_val,
  CASE WHEN l_orderkey % 50 = 0 THEN 'mmol/L' WHEN l_returnflag = 'A' THEN 'mg/dL'
       WHEN l_returnflag = 'N' THEN 'g/L' ELSE 'ug/mL' END AS lx_result_unit
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

# ---- lab steps in SQL ------------------------------------------------------------------------

MIN_COUNT, MIN_VALUES, ACCURACY = 100, 100, 1_000_000

CTES["lab_ok"] = """
SELECT person_id, date, lx_lab_code, lx_lab_code_type, lx_result_unit, TRY_CAST(lx_result_val AS DOUBLE) AS lx_result_val
FROM lab
WHERE (regexp_full_match(lx_lab_code, '\\d{4,}-\\d') OR lx_lab_code_type <> 'LOINC')
  AND lx_lab_code NOT IN ('0000-0', '00000-0')
  AND lx_result_unit IS NOT NULL AND TRY_CAST(lx_result_val AS DOUBLE) IS NOT NULL"""
CTES["unit_size"] = """
SELECT * FROM (VALUES ('mg/dL', 0.01, 'mass'), ('g/L', 1.0, 'mass'), ('ug/mL', 0.001, 'mass'), ('mmol/L', 0.001, 'amount'))
  AS t(unit, size, kind)"""
CTES["unit_rank"] = """
SELECT lx_lab_code, lx_result_unit, count(*) AS n,
  row_number() OVER (PARTITION BY lx_lab_code ORDER BY count(*) DESC, lx_result_unit) AS rank
FROM lab_ok GROUP BY lx_lab_code, lx_result_unit"""
CTES["conversion"] = """
SELECT o.lx_lab_code, b.lx_result_unit, o.lx_result_unit AS lx_result_other_unit,
  CASE WHEN so.kind = sb.kind THEN so.size / sb.size END AS conversion_factor
FROM unit_rank o JOIN unit_rank b ON o.lx_lab_code = b.lx_lab_code AND b.rank = 1
JOIN unit_size so ON so.unit = o.lx_result_unit JOIN unit_size sb ON sb.unit = b.lx_result_unit"""
CTES["converted"] = """
SELECT l.person_id, l.date, l.lx_lab_code, l.lx_lab_code_type, l.lx_result_val, c.lx_result_unit, c.lx_result_other_unit,
  l.lx_result_val * round(c.conversion_factor, 9) AS lx_result_val_converted
FROM lab_ok l JOIN conversion c ON l.lx_lab_code = c.lx_lab_code AND l.lx_result_unit = c.lx_result_other_unit
WHERE c.conversion_factor IS NOT NULL"""
CTES["frequent"] = f"""
SELECT lx_lab_code, count(DISTINCT lx_result_val) AS value_counts FROM converted GROUP BY 1
HAVING count(*) > {MIN_COUNT} AND count(DISTINCT lx_result_val) > {MIN_VALUES}"""
CTES["bounds"] = """
SELECT lx_lab_code, quantile_disc(lx_result_val_converted, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b
FROM converted SEMI JOIN frequent USING (lx_lab_code) GROUP BY 1"""
CTES["grouped"] = """
SELECT c.*, (len(list_filter(b, lambda x: x <= lx_result_val_converted)) * 10) || '-' ||
  (len(list_filter(b, lambda x: x <= lx_result_val_converted)) * 10 + 10) AS percentile_group
FROM converted c JOIN bounds USING (lx_lab_code)"""
CTES["labtok"] = """
SELECT person_id, date, lx_lab_code_type || ':' || lx_lab_code || ':' || percentile_group AS token FROM grouped"""

# ---- sequences -------------------------------------------------------------------------------

COLUMNS = ["person_id", "date", "general_event_token"]


def coded(spark, d, *names):
    makers = {"diagnosis": diagnosis, "prescription": prescription, "procedure": procedure}
    return ev.event_tokens({n: makers[n](spark, d) for n in names})


def tokens(spark, d):
    """Diagnosis and procedure tokens."""
    return coded(spark, d, "diagnosis", "procedure")


def sequences(spark, d):
    return timeline.build_sequences(tokens(spark, d), patient(spark, d))


def aligned(spark, d, rows):
    """Long form of the same sequences: aligned rows with their day-0 rows."""
    return timeline.add_baseline(timeline.align_to_first_date(rows), patient(spark, d), rows)


def labelled_events(spark, d):
    return aligned(spark, d, tokens(spark, d).union(label_marks(spark, d)))


CTES["dx_tok"] = "SELECT person_id, date, dx_diagnosis_code_type || ':' || dx_diagnosis_code AS token FROM diagnosis"
CTES["rx_tok"] = "SELECT person_id, date, rx_prescription_code_type || ':' || rx_prescription_code AS token FROM prescription"
CTES["pr_tok"] = "SELECT person_id, date, pr_procedure_code_type || ':' || pr_procedure_code AS token FROM procedure_t"
CTES["ev"] = "SELECT * FROM dx_tok UNION ALL SELECT * FROM pr_tok"


def _aligned(source: str) -> str:
    return f"""
SELECT e.person_id, e.date, date_diff('day', f.first_date, e.date) + 1 AS day, e.token
FROM {source} e JOIN (SELECT person_id, min(date) AS first_date FROM {source} GROUP BY 1) f USING (person_id)"""


def _base(source: str) -> str:
    return f"""
SELECT p.person_id, px_birth_date AS date, 0 AS day, unnest(list_filter([
    'AGE:' || CAST(floor(date_diff('day', px_birth_date, first_date) / 365) AS BIGINT), 'ETHNICITY:' || px_ethnicity,
    'GENDER:' || px_gender, 'RACE:' || px_race, 'REGION:' || px_region], lambda x: x IS NOT NULL)) AS token
FROM patient p JOIN (SELECT person_id, min(date) AS first_date FROM {source} GROUP BY 1) f USING (person_id)"""


CTES["aligned"] = _aligned("ev")
CTES["base"] = _base("ev")
CTES["seqrows"] = """
SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY date NULLS FIRST, day, token) - 1 AS pos
FROM (SELECT * FROM aligned UNION ALL SELECT * FROM base)"""


def banded_sequences(spark, d):
    """Diagnosis tokens with lab tokens that already carry a percentile band."""
    band = F.expr(
        "concat('LOINC:', lpad(cast(l_suppkey as string), 4, '0'), '-1:', "
        "cast((l_linenumber % 10) * 10 as string), '-', cast((l_linenumber % 10) * 10 + 10 as string))"
    )
    labs = order_lines(spark, d).select(
        F.col("o_custkey").alias("person_id"),
        F.col("l_shipdate").cast("timestamp").alias("date"),
        band.alias("general_event_token"),
    )
    rows = coded(spark, d, "diagnosis").union(labs)
    return timeline.build_sequences(rows, patient(spark, d))


CTES["bev"] = """
SELECT * FROM dx_tok UNION ALL
SELECT o_custkey, l_shipdate, 'LOINC:' || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') || '-1:' || ((l_linenumber % 10) * 10)
  || '-' || ((l_linenumber % 10) * 10 + 10)
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
CTES["baligned"] = _aligned("bev")
CTES["bbase"] = _base("bev")
CTES["bseqrows"] = """
SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY date NULLS FIRST, day, token) - 1 AS pos
FROM (SELECT * FROM baligned UNION ALL SELECT * FROM bbase)"""

# ---- labels, splits --------------------------------------------------------------------------


def prediction_labels(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("patient_id"),
        F.expr("case when o_orderstatus = 'F' then 'True' else 'False' end").alias("value"),
        F.lit("boolean").alias("label_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("prediction_time"),
    )


CTES["plabels"] = """
SELECT o_custkey AS patient_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS value, o_orderdate AS prediction_time
FROM orders"""


def label_marks(spark, d):
    return prediction_labels(spark, d).select(
        F.col("patient_id").alias("person_id"),
        F.to_timestamp("prediction_time").alias("date"),
        F.when(F.col("value") == "True", "LABEL:1").otherwise("LABEL:0").alias("general_event_token"),
    )


def labelled_sequences(spark, d):
    """Diagnosis and procedure sequences with their labels placed inside."""
    rows = tokens(spark, d).union(label_marks(spark, d))
    return timeline.build_sequences(rows, patient(spark, d))


CTES["lab_marks"] = "SELECT patient_id AS person_id, prediction_time AS date, 'LABEL:' || value AS token FROM plabels"
CTES["lev"] = "SELECT * FROM ev UNION ALL SELECT * FROM lab_marks"
CTES["laligned"] = _aligned("lev")
CTES["lbase"] = _base("lev")
CTES["lseqrows"] = """
SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY date NULLS FIRST, day, token) - 1 AS pos
FROM (SELECT * FROM laligned UNION ALL SELECT * FROM lbase)"""


def sql_hash(seed, *keys: str) -> str:
    text = "concat_ws(':', " + ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys]) + ")"
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def sql_uniform(seed, *keys: str) -> str:
    return f"({sql_hash(seed, *keys)} / 4294967296.0::DOUBLE)"


def split_map(spark, d):
    u = keyed_uniform("split", "c_custkey")
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("omop_person_id"),
        F.when(u < 0.7, "train").when(u < 0.85, "val").otherwise("test").alias("split"),
    )


CTES["splitmap"] = f"""
SELECT c_custkey AS omop_person_id, CASE WHEN {sql_uniform('split', 'c_custkey')} < 0.7 THEN 'train'
  WHEN {sql_uniform('split', 'c_custkey')} < 0.85 THEN 'val' ELSE 'test' END AS split
FROM customer"""


def cohort(spark, d):
    return table(spark, d, "labels").withColumnRenamed("doc_id", "person_id")


COHORT_RULE = {
    "join_column_name": "person_id",
    "inclusion_criteria": "quality = 1",
    "positive_class_criteria": "CASE WHEN toxic = 1 THEN 1 ELSE 0 END",
}
CTES["cohort"] = "SELECT doc_id AS person_id, quality, toxic FROM labels"


def classed(spark, d):
    """Persons with a class 0, 1 or 2 of uneven size."""
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("person_id"),
        F.expr("cast(case when c_custkey % 10 < 6 then 0 when c_custkey % 10 < 9 then 1 else 2 end as int)").alias("label"),
        "c_nationkey",
    )


CTES["classed"] = """
SELECT c_custkey AS person_id, CASE WHEN c_custkey % 10 < 6 THEN 0 WHEN c_custkey % 10 < 9 THEN 1 ELSE 2 END AS label,
  c_nationkey FROM customer"""

# ---- terminology -----------------------------------------------------------------------------


def concept_map(spark, d):
    """Each code belongs to a small concept and to a second, overlapping one."""
    p = table(spark, d, "part")
    code = F.col("p_partkey").cast("string")
    cuis = F.expr(
        "array(concat('C', cast(p_partkey div 8 as string)), concat('K', cast((p_partkey + 5) div 12 as string)))"
    )
    return p.select(F.explode(cuis).alias("CUI"), code.alias("code"), F.col("p_type").alias("source"))


CTES["concepts"] = """
SELECT unnest(['C' || (p_partkey // 8), 'K' || ((p_partkey + 5) // 12)]) AS CUI, CAST(p_partkey AS VARCHAR) AS code,
  p_type AS source FROM part"""


def vocabulary_codes(spark, d):
    return table(spark, d, "part").filter("p_size <= 10").select(
        F.col("p_type").alias("source"),
        F.col("p_partkey").cast("string").alias("code"),
        event_token(F.col("p_type"), F.col("p_partkey").cast("string")).alias("vocab_token"),
    )


CTES["vcodes"] = """
SELECT p_type AS source, CAST(p_partkey AS VARCHAR) AS code, p_type || ':' || p_partkey AS vocab_token
FROM part WHERE p_size <= 10"""


def used_codes(spark, d):
    """Every order line with the code of its part."""
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return l.join(p, l.l_partkey == p.p_partkey).select(
        F.col("p_type").alias("source"), F.col("p_partkey").cast("string").alias("code"), "l_orderkey", "l_linenumber"
    )


def used_code_names(spark, d):
    """The distinct codes of ``used_codes``: the numbers of parts are made distinct before they meet their parts."""
    numbers = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return numbers.join(table(spark, d, "part").hint("merge"), "p_partkey").select(
        F.col("p_type").alias("source"), F.col("p_partkey").cast("string").alias("code")
    )


CTES["used"] = """
SELECT p_type AS source, CAST(p_partkey AS VARCHAR) AS code, l_orderkey, l_linenumber
FROM lineitem JOIN part ON l_partkey = p_partkey"""
CTES["usedcodes"] = "SELECT DISTINCT source, code FROM used"
CTES["chosen"] = """
SELECT source AS original_source, code AS original_code, source AS vocab_source, code AS vocab_code, vocab_token
FROM usedcodes JOIN vcodes USING (source, code)
UNION ALL
SELECT source, code, vs, vc, vt FROM (
  SELECT u.source, u.code, v.source AS vs, v.code AS vc, v.vocab_token AS vt,
    row_number() OVER (PARTITION BY u.source, u.code ORDER BY v.source, v.code, a.CUI) AS r
  FROM usedcodes u ANTI JOIN vcodes x ON u.source = x.source AND u.code = x.code
  JOIN concepts a ON a.source = u.source AND a.code = u.code
  JOIN concepts b ON a.CUI = b.CUI
  JOIN vcodes v ON v.source = b.source AND v.code = b.code) WHERE r = 1"""

# ---- raw coded events ------------------------------------------------------------------------

RAW_MAPPINGS = {
    "race_mapping": {
        "Race/White": "RACE:White",
        "Race/Black": "RACE:Black",
        "Race/Asian": "RACE:Asian",
        "Race/Pacific_Islander": "RACE:Pacific Islander",
    },
    "gender_mapping": {"Gender/M": "GENDER:M", "Gender/F": "GENDER:F"},
    "ethnicity_mapping": {"Ethnicity/E0": "ETHNICITY:Zero", "Ethnicity/E1": "ETHNICITY:One"},
    # One source has no mapping, so its events find no equivalent.
    "data_to_umls_source_map": {
        "LARGE": "LARGE", "MEDIUM": "MEDIUM", "SMALL": "SMALL", "ECONOMY": "LOINC", "PROMO": "PROMO",
    },
    "vocab_to_umls_source_map": {
        "LARGE": "LARGE", "MEDIUM": "MEDIUM", "SMALL": "SMALL", "ECONOMY": "LOINC", "PROMO": "PROMO",
        "LOINC": "LOINC",
    },
}


def raw_events(spark, d):
    """All-text coded events: order lines as ``Type/Part`` and customers' demographics at birth."""
    l, o, p = (table(spark, d, n) for n in ("lineitem", "orders", "part"))
    medical = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey).select(
        F.col("o_custkey").cast("string").alias("patient_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("start"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("end"),
        F.expr("concat(p_type, '/', cast(p_partkey as string), 'X')").alias("code"),
        F.expr("case when l_linenumber % 2 = 1 then cast(l_quantity as string) end").alias("value"),
        F.expr("case when l_linenumber <> 3 then 'mg/dL' end").alias("unit"),
    )
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    birth = F.expr("date_add(date'1930-01-01', cast((c_custkey * 37) % 20000 as int))")
    kinds = F.expr(
        "filter(array(case when c_custkey % 2 = 0 then 'Gender/F' else 'Gender/M' end, "
        "case when c_custkey % 7 > 0 then concat('Race/', cast(c_custkey % 5 + 1 as string)) end, "
        "case when c_custkey % 3 > 0 then concat('Ethnicity/E', cast(n_regionkey as string)) end), x -> x is not null)"
    )
    people = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("patient_id"),
        F.date_format(birth, "yyyy-MM-dd HH:mm:ss").alias("start"),
        F.date_format(birth, "yyyy-MM-dd HH:mm:ss").alias("end"),
        F.explode(kinds).alias("code"),
        F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("string").alias("unit"),
    )
    return medical.union(people)


CTES["raw"] = """
SELECT CAST(o_custkey AS VARCHAR) AS patient_id, l_shipdate AS start, p_type || '/' || p_partkey || 'X' AS code,
  CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS VARCHAR) END AS value,
  CASE WHEN l_linenumber <> 3 THEN 'mg/dL' END AS unit
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
UNION ALL
SELECT CAST(c_custkey AS VARCHAR), CAST(DATE '1930-01-01' + CAST((c_custkey * 37) % 20000 AS INTEGER) AS TIMESTAMP),
  unnest(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'Gender/F' ELSE 'Gender/M' END,
    CASE WHEN c_custkey % 7 > 0 THEN 'Race/' || (c_custkey % 5 + 1) END,
    CASE WHEN c_custkey % 3 > 0 THEN 'Ethnicity/E' || n_regionkey END], lambda x: x IS NOT NULL)), NULL, NULL
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def raw_concepts(spark, d):
    """Concept map whose codes carry the same suffix; variants add the lower-case spelling."""
    base = concept_map(spark, d)
    return base.select(
        "CUI",
        F.concat("code", F.lit("X")).alias("code"),
        F.when(F.col("source") == "ECONOMY", "LOINC").otherwise(F.col("source")).alias("source"),
    )


def raw_vocabulary(spark, d):
    return table(spark, d, "part").filter("p_size <= 10").select(
        F.expr("case when p_type = 'ECONOMY' then 'LOINC' else p_type end").alias("source"),
        F.expr("concat(cast(p_partkey as string), case when p_partkey % 2 = 0 then 'x' else 'X' end)").alias("code"),
    ).withColumn("vocab_token", event_token(F.col("source"), F.col("code")))


CTES["rawmap"] = """
SELECT * FROM (VALUES ('LARGE', 'LARGE'), ('MEDIUM', 'MEDIUM'), ('SMALL', 'SMALL'), ('ECONOMY', 'LOINC'), ('PROMO', 'PROMO'))
  AS t(raw_source, source)"""
CTES["rmed"] = """
SELECT patient_id, start, value, unit, split_part(raw.code, '/', 1) AS raw_source, lower(split_part(raw.code, '/', 2)) AS code,
  rawmap.source
FROM raw LEFT JOIN rawmap ON split_part(raw.code, '/', 1) = rawmap.raw_source
WHERE NOT (raw.code LIKE '%Race%' OR raw.code LIKE '%Gender%' OR raw.code LIKE '%Ethnicity%')"""
CTES["rvoc"] = """
SELECT CASE WHEN p_type = 'ECONOMY' THEN 'LOINC' WHEN p_type = 'STANDARD' THEN NULL ELSE p_type END AS source,
  p_partkey || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'X' END AS code,
  CASE WHEN p_type = 'ECONOMY' THEN 'LOINC' ELSE p_type END || ':' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'X' END AS vocab_token
FROM part WHERE p_size <= 10"""
CTES["rcon"] = """
SELECT CUI, unnest([code || 'X', lower(code || 'X')]) AS code, CASE WHEN source = 'ECONOMY' THEN 'LOINC' ELSE source END AS source
FROM concepts"""
CTES["rchosen"] = """
WITH seen AS (SELECT DISTINCT source, code FROM rmed)
SELECT source, code, source AS vocab_source, code AS vocab_code, vocab_token FROM seen JOIN rvoc USING (source, code)
UNION ALL
SELECT source, code, vs, vc, vt FROM (
  SELECT u.source, u.code, v.source AS vs, v.code AS vc, v.vocab_token AS vt,
    row_number() OVER (PARTITION BY u.source, u.code ORDER BY v.source, v.code, a.CUI) AS r
  FROM seen u ANTI JOIN rvoc x ON u.source = x.source AND u.code = x.code
  JOIN rcon a ON a.source = u.source AND a.code = u.code
  JOIN rcon b ON a.CUI = b.CUI
  JOIN rvoc v ON v.source = b.source AND v.code = b.code) WHERE r = 1"""
CTES["rtrans"] = """
SELECT m.*, c.vocab_source, c.vocab_code, c.vocab_token
FROM rmed m LEFT JOIN rchosen c ON m.source = c.source AND m.code = c.code"""

# ---- documents and predictions ---------------------------------------------------------------


def documents(spark, d):
    """Each document's whole text as an array of tokens."""
    words = F.filter(F.split("text", "[ \\t\\r\\n]+"), lambda w: w != "")
    return table(spark, d, "documents").select(F.col("doc_id").alias("person_id"), words.alias("sorted_event_tokens"))


CTES["words"] = r"""
SELECT doc_id AS person_id, unnest(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '')) AS token
FROM documents"""
CTES["wordcounts"] = "SELECT token, count(*) AS n FROM words GROUP BY 1"


def predictions(spark, d):
    scores = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("person_id"), F.col("label").cast("int").alias("label"), scores.alias("scores")
    )


CTES["preds"] = """
SELECT vec_id AS person_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS scores FROM embeddings"""
CTES["scored"] = """
SELECT person_id, label, list_position(scores, list_max(scores)) - 1 AS prediction,
  list_transform(scores, lambda x: exp(x - list_max(scores)) / list_sum(list_transform(scores, lambda y: exp(y - list_max(scores))))) AS prob
FROM preds"""
