"""Projections, filters, unions, alignment and sequences."""

from pyspark.sql import functions as F

from checks import standins as st
from checks.registry import big, query, seq_text, time_text
from medstrand.functions import codes
from medstrand.operators import events as ev
from medstrand.operators import quality, splits, timeline

CONFIG = {
    "tables": {
        "patient": {
            "select_expr": [
                "CAST(c_custkey AS BIGINT) AS person_id",
                "YEAR(b) || '-' || MONTH(b) || '-' || DAY(b) AS px_birth_date_raw",
                "TRY_TO_TIMESTAMP(px_birth_date_raw, 'yyyy-M-d') AS px_birth_date",
                "c_mktsegment AS px_race",
            ],
            "filter_expr": "person_id IS NOT NULL AND px_race <> 'MACHINERY'",
        },
        "diagnosis": {
            "select_expr": [
                "CAST(o_custkey AS BIGINT) AS person_id",
                "CAST(o_orderdate AS TIMESTAMP) AS date",
                "SUBSTRING(o_orderpriority, 1, 1) || o_orderstatus AS dx_diagnosis_code",
                "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'ICD10CM' END AS dx_diagnosis_code_type",
            ],
            "filter_expr": "dx_diagnosis_code IS NOT NULL and dx_diagnosis_code_type IS NOT NULL",
        },
    },
    "event_date_filter": "(date >= TO_TIMESTAMP('1996-01-01', 'yyyy-MM-dd') and date <= TO_TIMESTAMP('2300-12-31', 'yyyy-MM-dd'))",
}


def _people(spark, d):
    return st.table(spark, d, "customer").withColumn(
        "b", F.date_add(F.lit("1930-01-01").cast("date"), F.expr("cast((c_custkey * 37) % 20000 as int)"))
    )


@query(
    "config_select",
    """SELECT c_custkey AS person_id, year(b) || '-' || month(b) || '-' || day(b) AS px_birth_date_raw,
         strftime(b, '%Y-%m-%d %H:%M:%S') AS px_birth_date, c_mktsegment AS px_race
       FROM (SELECT *, CAST(DATE '1930-01-01' + CAST((c_custkey * 37) % 20000 AS INTEGER) AS TIMESTAMP) AS b FROM customer)""",
)
def config_select(spark, d):
    chosen = ev.select_columns({"patient": _people(spark, d)}, CONFIG)["patient"]
    return chosen.withColumn("px_birth_date", time_text("px_birth_date"))


@query(
    "config_filter",
    """SELECT o_custkey AS person_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date,
         substr(o_orderpriority, 1, 1) || o_orderstatus AS dx_diagnosis_code, 'ICD10CM' AS dx_diagnosis_code_type
       FROM orders WHERE o_orderstatus <> 'P'""",
)
def config_filter(spark, d):
    tables = {"patient": None, "diagnosis": st.table(spark, d, "orders")}
    kept = ev.filter_rows(ev.select_columns(tables, CONFIG), CONFIG)
    return kept["diagnosis"].withColumn("date", time_text("date"))


@query(
    "date_range_filter",
    """SELECT person_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, dx_diagnosis_code FROM diagnosis
       WHERE date >= TIMESTAMP '1996-01-01' AND date <= TIMESTAMP '2300-12-31'""",
)
def date_range_filter(spark, d):
    kept = ev.filter_dates({"diagnosis": st.diagnosis(spark, d)}, CONFIG["event_date_filter"])
    return kept["diagnosis"].select("person_id", time_text("date").alias("date"), "dx_diagnosis_code")


@query(
    "event_tokens",
    """SELECT person_id, CASE WHEN dx_diagnosis_code LIKE '%P' THEN NULL ELSE dx_diagnosis_code_type END || ':' || dx_diagnosis_code
         AS general_event_token FROM diagnosis""",
)
def event_tokens(spark, d):
    dx = st.diagnosis(spark, d).withColumn(
        "dx_diagnosis_code_type", F.when(~F.col("dx_diagnosis_code").endswith("P"), F.col("dx_diagnosis_code_type"))
    )
    return ev.create_tokens(dx, "dx_diagnosis_code", "dx_diagnosis_code_type").select("person_id", "general_event_token")


@query(
    "merge_events",
    """SELECT person_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, token AS general_event_token FROM dx_tok
       UNION ALL SELECT person_id, strftime(date, '%Y-%m-%d %H:%M:%S'), token FROM pr_tok""",
)
def merge_events(spark, d):
    merged = ev.merge_frames(
        st.COLUMNS, st.coded(spark, d, "diagnosis"), None, st.coded(spark, d, "procedure")
    )
    return merged.withColumn("date", time_text("date"))


@query(
    "union_by_name",
    """SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer
       UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier""",
)
def union_by_name(spark, d):
    c = st.table(spark, d, "customer").selectExpr("c_custkey id", "c_nationkey nation", "c_acctbal balance")
    s = st.table(spark, d, "supplier").selectExpr("s_acctbal balance", "s_suppkey id", "s_nationkey nation")
    return ev.recombine([c, s])


@query(
    "union_missing_cols",
    """SELECT c_custkey AS id, c_mktsegment AS segment, NULL AS balance FROM customer
       UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier""",
)
def union_missing_cols(spark, d):
    c = st.table(spark, d, "customer").selectExpr("c_custkey id", "c_mktsegment segment")
    s = st.table(spark, d, "supplier").selectExpr("s_suppkey id", "s_acctbal balance")
    return ev.recombine([c, s])


@query("except_rows", "SELECT c_nationkey, c_mktsegment FROM customer EXCEPT SELECT s_nationkey, 'HOUSEHOLD' FROM supplier")
def except_rows(spark, d):
    s = st.table(spark, d, "supplier").select("s_nationkey", F.lit("HOUSEHOLD"))
    return st.table(spark, d, "customer").select("c_nationkey", "c_mktsegment").subtract(s)


@query("distinct_rows", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_rows(spark, d):
    return st.table(spark, d, "orders").select("o_custkey", "o_orderstatus").distinct()


@query(
    "dedupe_events",
    """SELECT person_id, day AS days_since_begin, token AS general_event_token, strftime(min(date), '%Y-%m-%d %H:%M:%S') AS date
       FROM aligned GROUP BY 1, 2, 3""",
)
def dedupe_events(spark, d):
    aligned = timeline.align_to_first_date(st.tokens(spark, d))
    unique = ev.dedupe_events(aligned, ["person_id", "days_since_begin", "general_event_token"])
    return unique.withColumn("date", time_text("date")).withColumn("days_since_begin", big("days_since_begin"))


@query(
    "value_diff",
    """SELECT code, 'right' AS missing_from FROM (SELECT DISTINCT code FROM used) u ANTI JOIN vcodes v ON u.code = v.code
       UNION ALL
       SELECT code, 'left' FROM (SELECT DISTINCT code FROM vcodes) v ANTI JOIN used u ON u.code = v.code""",
)
def value_diff(spark, d):
    return ev.value_differences(st.used_codes(spark, d), st.vocabulary_codes(spark, d), "code")


@query(
    "align_first_date",
    "SELECT person_id, token AS general_event_token, day AS days_since_begin, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM aligned",
)
def align_first_date(spark, d):
    aligned = timeline.align_to_first_date(st.tokens(spark, d))
    return aligned.withColumn("date", time_text("date")).withColumn("days_since_begin", big("days_since_begin"))


@query(
    "baseline_tokens",
    """SELECT person_id, token AS general_event_token, day::BIGINT AS days_since_begin,
         strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM base""",
)
def baseline_tokens(spark, d):
    rows = timeline.baseline_tokens(st.tokens(spark, d), st.patient(spark, d))
    return rows.withColumn("date", time_text("date")).withColumn("days_since_begin", big("days_since_begin"))


@query(
    "span_filter",
    """SELECT person_id, token AS general_event_token, day AS days_since_begin FROM aligned
       WHERE person_id IN (SELECT person_id FROM aligned GROUP BY 1 HAVING max(day) >= 1500)""",
)
def span_filter(spark, d):
    kept = timeline.filter_by_span(timeline.align_to_first_date(st.tokens(spark, d)), 1500)
    return kept.select("person_id", "general_event_token", big("days_since_begin").alias("days_since_begin"))


SEQ_SQL = "SELECT person_id, string_agg(day || '@' || token, '|' ORDER BY pos) AS seq FROM {rows} GROUP BY 1"


@query("person_sequences", SEQ_SQL.format(rows="seqrows"))
def person_sequences(spark, d):
    aligned = timeline.align_to_first_date(st.tokens(spark, d))
    long = timeline.add_baseline(aligned, st.patient(spark, d))
    return timeline.consolidate(long).select("person_id", seq_text().alias("seq"))


@query(
    "event_positions",
    "SELECT person_id, token AS general_event_token, day AS days_since_begin, row_number() OVER "
    "(PARTITION BY person_id ORDER BY date, day, token) - 1 AS position FROM aligned",
)
def event_positions(spark, d):
    ranked = timeline.event_positions(timeline.align_to_first_date(st.tokens(spark, d)))
    return ranked.select(
        "person_id", "general_event_token", big("days_since_begin").alias("days_since_begin"), "position"
    )


@query(
    "min_history",
    """SELECT person_id, count(*)::BIGINT AS size FROM seqrows GROUP BY 1 HAVING count(*) > 16""",
)
def min_history(spark, d):
    wide = timeline.parallel_arrays(st.sequences(spark, d))
    return splits.min_history(wide, 16).select("person_id", big("size").alias("size"))


@query(
    "dq_checks",
    """SELECT 'negative_days' AS rule, count(*) FILTER (WHERE day < 0) AS violations
         FROM (SELECT CASE WHEN person_id % 6 = 0 THEN -day ELSE day END AS day FROM seqrows UNION ALL SELECT day FROM seqrows WHERE person_id % 9 = 1)
       UNION ALL SELECT 'null_person_ids', count(*) FILTER (WHERE person_id % 8 = 0) FROM patient
       UNION ALL SELECT 'repeated_persons', count(DISTINCT person_id) FILTER (WHERE person_id % 9 = 1) FROM seqrows
       UNION ALL SELECT 'persons_in_several_splits', count(*) FROM
         (SELECT c_nationkey FROM customer JOIN splitmap ON c_custkey = omop_person_id GROUP BY 1 HAVING count(DISTINCT split) > 1)""",
)
def dq_checks(spark, d):
    """Rows that break each rule are planted: turned days, repeated persons, lost ids; nations stand in for split persons."""
    wide = timeline.parallel_arrays(st.sequences(spark, d))
    wide = wide.unionByName(wide.filter("person_id % 9 = 1"))
    turned = F.when(F.col("person_id") % 6 == 0, F.transform("day_position_tokens", lambda x: -x)).otherwise(F.col("day_position_tokens"))
    wide = wide.withColumn("day_position_tokens", turned)
    people = st.patient(spark, d).withColumn("person_id", F.when(F.col("person_id") % 8 != 0, F.col("person_id")))
    c = st.table(spark, d, "customer")
    s = st.split_map(spark, d)
    members = s.join(c, s.omop_person_id == c.c_custkey).select(F.col("c_nationkey").alias("omop_person_id"), "split")
    return quality.data_checks(wide, people, members)


@query("unique_keys", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def unique_keys(spark, d):
    return quality.unique_key_violations(st.table(spark, d, "orders"), "o_custkey")


@query(
    "contains_split",
    """SELECT code, count(*) AS n, max(CASE WHEN code LIKE '%Race%' OR code LIKE '%Gender%' OR code LIKE '%Ethnicity%' THEN 1 ELSE 2 END)::BIGINT AS side
       FROM raw GROUP BY 1""",
)
def contains_split(spark, d):
    found, rest = ev.split_by_keys(st.raw_events(spark, d), ["Race", "Gender", "Ethnicity"], "code")
    both = found.withColumn("side", F.lit(1)).union(rest.withColumn("side", F.lit(2)))
    return both.groupBy("code").agg(F.count("*").alias("n"), big(F.max("side")).alias("side"))


@query(
    "code_split",
    """SELECT patient_id, split_part(code, '/', 1) AS raw_source, lower(split_part(code, '/', 2)) AS code FROM raw""",
)
def code_split(spark, d):
    return ev.split_source_code(st.raw_events(spark, d)).select("patient_id", "raw_source", "code")


@query(
    "code_system_case",
    """SELECT code, CASE WHEN left(code, 5) = 'PROMO' THEN 'RXNORM' WHEN left(code, 5) = 'SMALL' THEN 'ICD10CM' ELSE split_part(code, '/', 1) END
         AS system, split_part(code, '/', 2) AS value, count(*) AS n FROM raw GROUP BY ALL""",
)
def code_system_case(spark, d):
    rows = st.raw_events(spark, d).selectExpr(
        "code",
        "CASE WHEN get(split(code, '/'), 0) = 'PROMO' THEN 'RXNORM' WHEN get(split(code, '/'), 0) = 'SMALL' THEN 'ICD10CM' "
        "ELSE get(split(code, '/'), 0) END AS system",
        "get(split(code, '/'), 1) AS value",
    )
    return rows.groupBy("code", "system", "value").agg(F.count("*").alias("n"))


@query(
    "ndc_normalize",
    """SELECT code, CASE WHEN code LIKE '%-%' THEN lpad(split_part(code, '-', 1), 5, '0') || lpad(split_part(code, '-', 2), 4, '0')
         ELSE substr(code, 1, 9) END AS ndc FROM
       (SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_partkey || '-' || l_suppkey || '-11'
          ELSE lpad(CAST(l_orderkey AS VARCHAR), 11, '7') END AS code FROM lineitem)""",
)
def ndc_normalize(spark, d):
    code = F.expr(
        "case when l_linenumber % 2 = 0 then concat(l_partkey, '-', l_suppkey, '-11') else lpad(cast(l_orderkey as string), 11, '7') end"
    )
    return st.table(spark, d, "lineitem").select(code.alias("code")).withColumn("ndc", codes.ndc9(F.col("code")))
