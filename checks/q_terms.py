"""Terminology, raw coded events, demographics."""

from pyspark.sql import functions as F

from checks import standins as st
from checks.registry import big, query, time_text
from medstrand.functions import codes
from medstrand.operators import events as ev
from medstrand.operators import terms
from medstrand.plans import raw_codes


@query(
    "code_variants",
    """SELECT DISTINCT CUI, unnest([code, replace(code, '.', ''), lower(code), lower(replace(code, '.', ''))]) AS code, source
       FROM (SELECT CUI, 'J' || code || '.X' AS code, source FROM concepts)""",
)
def code_variants(spark, d):
    dotted = F.concat(F.lit("J"), "code", F.lit(".X"))
    return terms.code_variants(st.concept_map(spark, d).withColumn("code", dotted))


@query(
    "concept_map",
    """SELECT DISTINCT CUI, unnest([code, lower(code)]) AS code, source FROM (
         SELECT CUI, code || 'A' AS code, source FROM concepts
         UNION ALL
         SELECT 'C' || (p_partkey // 8), CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 5, '0') || lpad(CAST(p_size AS VARCHAR), 4, '0')
           ELSE substr(lpad(CAST(p_partkey AS VARCHAR), 11, '8'), 1, 9) END, 'NDC' FROM part WHERE p_type IN ('SMALL', 'LARGE'))""",
)
def concept_map(spark, d):
    p = st.table(spark, d, "part")
    concepts = st.concept_map(spark, d).select(
        "CUI", F.concat("code", F.lit("A")).alias("CODE"), F.col("source").alias("SAB")
    )
    attributes = p.select(
        F.expr("concat('C', cast(p_partkey div 8 as string))").alias("CUI"),
        F.lit("NDC").alias("ATN"),
        F.expr("case p_type when 'SMALL' then 'RXNORM' when 'LARGE' then 'MTHSPL' else 'OTHER' end").alias("SAB"),
        F.expr("case when p_partkey % 2 = 0 then concat(p_partkey, '-', p_size, '-11') else lpad(cast(p_partkey as string), 11, '8') end").alias("ATV"),
    )
    return terms.concept_map(concepts, attributes)


@query("distinct_values", "SELECT DISTINCT source FROM concepts")
def distinct_values(spark, d):
    return terms.distinct_values(st.concept_map(spark, d), "source")


@query("vocab_hit", "SELECT source, code, vocab_token FROM usedcodes JOIN vcodes USING (source, code)")
def vocab_hit(spark, d):
    return terms.vocabulary_hits(st.used_codes(spark, d), st.vocabulary_codes(spark, d))


@query("vocab_miss", "SELECT source, code FROM usedcodes EXCEPT SELECT source, code FROM vcodes")
def vocab_miss(spark, d):
    return terms.vocabulary_misses(st.used_codes(spark, d), st.vocabulary_codes(spark, d))


@query(
    "concept_translate",
    """SELECT a.CUI, u.source AS original_source, u.code AS original_code, v.source AS vocab_source, v.code AS vocab_code, v.vocab_token
       FROM (SELECT * FROM usedcodes) u JOIN concepts a ON a.source = u.source AND a.code = u.code
       JOIN concepts b ON a.CUI = b.CUI JOIN vcodes v ON v.source = b.source AND v.code = b.code""",
)
def concept_translate(spark, d):
    used = st.used_code_names(spark, d)
    return terms.matching_translations(
        st.concept_map(spark, d), used, st.vocabulary_codes(spark, d), "original", "vocab"
    )


@query("translate_to_vocab", "SELECT * FROM chosen")
def translate_to_vocab(spark, d):
    chosen = terms.derive_translation(
        st.used_codes(spark, d), st.vocabulary_codes(spark, d), st.concept_map(spark, d)
    )
    return chosen.drop("CUI")


@query(
    "translate_events",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, source, code, vocab_source, vocab_code, vocab_token
       FROM used LEFT JOIN chosen ON source = original_source AND code = original_code""",
)
def translate_events(spark, d):
    used = st.used_codes(spark, d)
    chosen = terms.derive_translation(used, st.vocabulary_codes(spark, d), st.concept_map(spark, d))
    return terms.translate_events(used, chosen).withColumn("l_linenumber", big("l_linenumber"))


@query(
    "translation_coverage",
    """SELECT n_codes, n_needing, n_translated, round(n_needing / n_codes, 6) AS fraction_needing,
         round(n_translated / n_needing, 6) AS fraction_translated, round((n_codes - n_needing + n_translated) / n_codes, 6) AS fraction_covered
       FROM (SELECT (SELECT count(*) FROM usedcodes) AS n_codes,
               (SELECT count(*) FROM usedcodes ANTI JOIN vcodes USING (source, code)) AS n_needing,
               (SELECT count(*) FROM chosen WHERE original_code <> vocab_code OR original_source <> vocab_source) AS n_translated)""",
)
def translation_coverage(spark, d):
    used, vocabulary = st.used_codes(spark, d), st.vocabulary_codes(spark, d)
    chosen = terms.derive_translation(used, vocabulary, st.concept_map(spark, d))
    out = terms.translation_coverage(used, vocabulary, chosen)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("fraction")})


@query(
    "map_values",
    """SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END AS segment FROM customer""",
)
def map_values(spark, d):
    c = st.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return ev.apply_mapping(c, {"BUILDING": "b", "MACHINERY": "m", "NOWHERE": "n"}, "c_mktsegment", "segment")


@query(
    "missing_mappings",
    """SELECT 'NOWHERE' AS c_mktsegment, 'data' AS missing_from
       UNION ALL SELECT DISTINCT c_mktsegment, 'mapping' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""",
)
def missing_mappings(spark, d):
    return ev.missing_mappings(
        st.table(spark, d, "customer"), {"BUILDING": "b", "MACHINERY": "m", "NOWHERE": "n"}, "c_mktsegment"
    )


@query(
    "demographics_wide",
    """SELECT patient_id, max(code) FILTER (WHERE code LIKE 'Gender/%') AS gender_code, max(code) FILTER (WHERE code LIKE 'Race/%') AS race_code,
         max(code) FILTER (WHERE code LIKE 'Ethnicity/%') AS ethnicity_code,
         strftime(max(start) FILTER (WHERE code LIKE 'Gender/%'), '%Y-%m-%d %H:%M:%S') AS gender_date
       FROM raw WHERE code LIKE '%Race%' OR code LIKE '%Gender%' OR code LIKE '%Ethnicity%' GROUP BY 1""",
)
def demographics_wide(spark, d):
    wide = terms.demographics_wide(raw_codes.parse_times(st.raw_events(spark, d)))
    return wide.select("patient_id", "gender_code", "race_code", "ethnicity_code", time_text("gender_date").alias("gender_date"))


@query(
    "demographics_mapped",
    """SELECT patient_id AS person_id, CASE max(code) FILTER (WHERE code LIKE 'Race/%') WHEN 'Race/5' THEN 'RACE:White' WHEN 'Race/4' THEN 'RACE:Pacific Islander'
           WHEN 'Race/3' THEN 'RACE:Black' WHEN 'Race/2' THEN 'RACE:Asian' END AS px_race,
         CASE max(code) FILTER (WHERE code LIKE 'Gender/%') WHEN 'Gender/M' THEN 'GENDER:M' WHEN 'Gender/F' THEN 'GENDER:F' END AS px_gender,
         CASE max(code) FILTER (WHERE code LIKE 'Ethnicity/%') WHEN 'Ethnicity/E0' THEN 'ETHNICITY:Zero' WHEN 'Ethnicity/E1' THEN 'ETHNICITY:One' END AS px_ethnicity,
         strftime(max(start) FILTER (WHERE code LIKE 'Gender/%'), '%Y-%m-%d %H:%M:%S') AS px_birth_date
       FROM raw WHERE code LIKE '%Race%' OR code LIKE '%Gender%' OR code LIKE '%Ethnicity%' GROUP BY 1""",
)
def demographics_mapped(spark, d):
    return _translated(spark, d).demographics.withColumn("px_birth_date", time_text("px_birth_date"))


@query(
    "demographics_violations",
    """WITH planted AS (
         SELECT patient_id, code, start FROM raw
         WHERE NOT (patient_id::BIGINT % 7 = 0 AND code LIKE 'Gender/%') AND NOT (patient_id::BIGINT % 11 = 0 AND regexp_matches(code, 'Race|Gender|Ethnicity'))
         UNION ALL SELECT patient_id, 'Race/9', start FROM raw WHERE patient_id::BIGINT % 5 = 0 AND code LIKE 'Race/%'
         UNION ALL SELECT patient_id, 'Ethnicity/E9', start + INTERVAL 1 DAY FROM raw WHERE patient_id::BIGINT % 13 = 0 AND code LIKE 'Ethnicity/%'),
       w AS (SELECT patient_id, count(*) FILTER (WHERE code LIKE '%Gender/%') AS ng, count(*) FILTER (WHERE code LIKE '%Race/%') AS nr,
           count(*) FILTER (WHERE code LIKE '%Ethnicity/%') AS ne, max(start) FILTER (WHERE code LIKE '%Gender/%') AS gd,
           max(start) FILTER (WHERE code LIKE '%Race/%') AS rd, max(start) FILTER (WHERE code LIKE '%Ethnicity/%') AS ed
         FROM planted WHERE regexp_matches(code, 'Race|Gender|Ethnicity') GROUP BY 1),
       e AS (SELECT DISTINCT p.patient_id, w.patient_id IS NULL AS missing, ng, nr, ne, gd, rd, ed FROM planted p LEFT JOIN w USING (patient_id))
       SELECT count(*) FILTER (WHERE missing) AS without_demographics, count(*) FILTER (WHERE ng = 0) AS without_gender,
         count(*) FILTER (WHERE ng > 1 OR nr > 1 OR ne > 1) AS repeated_kind, count(*) FILTER (WHERE gd <> rd OR ed <> rd) AS differing_dates FROM e""",
)
def demographics_violations(spark, d):
    """Rows that break each rule are planted among the raw events."""
    raw = raw_codes.parse_times(st.raw_events(spark, d)).select("patient_id", "code", "start")
    number, code = F.col("patient_id").cast("bigint"), F.col("code")
    known = code.contains("Race") | code.contains("Gender") | code.contains("Ethnicity")
    kept = raw.filter(~((number % 7 == 0) & code.startswith("Gender/")) & ~((number % 11 == 0) & known))
    second = raw.filter((number % 5 == 0) & code.startswith("Race/")).withColumn("code", F.lit("Race/9"))
    later = raw.filter((number % 13 == 0) & code.startswith("Ethnicity/")).select(
        "patient_id", F.lit("Ethnicity/E9").alias("code"), (F.col("start") + F.expr("interval 1 day")).alias("start")
    )
    planted = kept.unionByName(second).unionByName(later)
    return terms.demographics_violations(terms.demographics_wide(planted, strict=False), planted)


def _translated(spark, d):
    concepts = terms.code_variants(st.raw_concepts(spark, d))
    return raw_codes.translate_raw(st.raw_events(spark, d), st.raw_vocabulary(spark, d), concepts, st.RAW_MAPPINGS)


@query(
    "raw_to_translated",
    """SELECT patient_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, raw_source, source, code, value, unit, vocab_source, vocab_code,
         CASE WHEN unit IS NOT NULL AND value IS NOT NULL AND vocab_source = 'LOINC' THEN vocab_token || ':' || value || ':' || unit ELSE vocab_token END AS vocab_token
       FROM rtrans""",
)
def raw_to_translated(spark, d):
    return _translated(spark, d).events.drop("end").withColumn("start", time_text("start"))


@query(
    "null_rate_events",
    """SELECT round(count(*) FILTER (WHERE vocab_token IS NULL) / count(*), 9) AS null_frac, raw_source, count(*) AS total_count FROM rtrans GROUP BY 2""",
)
def null_rate_events(spark, d):
    return _translated(spark, d).null_rate_events.withColumn("null_frac", F.round("null_frac", 9))


@query(
    "null_rate_codes",
    """SELECT round(count(*) FILTER (WHERE t IS NULL) / count(*), 9) AS null_frac, raw_source, count(*) AS total_count
       FROM (SELECT raw_source, code, max(vocab_token) AS t FROM rtrans GROUP BY 1, 2) GROUP BY 2""",
)
def null_rate_codes(spark, d):
    return _translated(spark, d).null_rate_codes.withColumn("null_frac", F.round("null_frac", 9))


@query(
    "valid_tests",
    """SELECT count(*) AS n_tests, count(*) FILTER (WHERE value IS NOT NULL AND unit IS NOT NULL) AS n_valid,
         round(count(*) FILTER (WHERE value IS NOT NULL AND unit IS NOT NULL) / count(*), 9) AS valid_fraction FROM rtrans WHERE source = 'LOINC'""",
)
def valid_tests(spark, d):
    return _translated(spark, d).valid_tests.withColumn("valid_fraction", F.round("valid_fraction", 9))


@query(
    "lab_value_suffix",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0 THEN 'LOINC:1-1:' || o_orderkey || ':g/L' ELSE 'LOINC:1-1' END AS vocab_token
       FROM orders""",
)
def lab_value_suffix(spark, d):
    rows = st.table(spark, d, "orders").select(
        "o_orderkey",
        F.lit("LOINC:1-1").alias("vocab_token"),
        F.when(F.col("o_orderstatus") == "F", "LOINC").otherwise("CPT").alias("vocab_source"),
        F.col("o_orderkey").cast("string").alias("value"),
        F.when(F.col("o_orderkey") % 3 > 0, "g/L").alias("unit"),
    )
    return terms.lab_value_suffix(rows).select("o_orderkey", "vocab_token")


@query(
    "fn_string",
    """SELECT c_custkey, c_mktsegment || '-' || c_custkey AS joined, split_part(c_name, '#', 2) AS part, c_name LIKE '%00%' AS found, lower(c_name) AS low,
         replace(c_name, '0', '') AS replaced, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS padded, substr(c_name, 3, 5) AS sub,
         'Customer' AS first_part FROM customer""",
)
def fn_string(spark, d):
    return st.table(spark, d, "customer").select(
        "c_custkey",
        F.concat("c_mktsegment", F.lit("-"), F.col("c_custkey").cast("string")).alias("joined"),
        codes.code_part(F.col("c_name"), "#", 1).alias("part"),
        F.col("c_name").contains("00").alias("found"),
        F.lower("c_name").alias("low"),
        F.replace(F.col("c_name"), F.lit("0"), F.lit("")).alias("replaced"),
        F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("padded"),
        F.substring("c_name", 3, 5).alias("sub"),
        F.substring_index("c_name", "#", 1).alias("first_part"),
    )


@query(
    "fn_regex",
    r"""SELECT c_custkey, regexp_full_match(c_name, 'Customer#\d+5') AS ends_in_five, regexp_replace(c_name, '([A-Za-z]+)#0*(\d+)', '\2-\1') AS swapped FROM customer""",
)
def fn_regex(spark, d):
    return st.table(spark, d, "customer").select(
        "c_custkey",
        F.col("c_name").rlike(r"^Customer#\d+5$").alias("ends_in_five"),
        F.regexp_replace("c_name", r"([A-Za-z]+)#0*(\d+)", "$2-$1").alias("swapped"),
    )


@query(
    "fn_date",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day_text, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days,
         date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS epoch_day, CAST(NULL AS VARCHAR) AS bad FROM orders""",
)
def fn_date(spark, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    return st.table(spark, d, "orders").select(
        "o_orderkey",
        F.date_format(parsed, "yyyy-MM-dd").alias("day_text"),
        big(F.datediff(parsed, F.lit("1995-01-01").cast("date"))).alias("days"),
        big(F.unix_date(F.to_date(parsed))).alias("epoch_day"),
        F.date_format(F.try_to_timestamp(F.lit("not a date"), F.lit("yyyy-MM-dd")), "yyyy").alias("bad"),
    )


@query(
    "fn_math",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CAST(l_quantity AS BIGINT) AS whole, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net,
         CASE WHEN l_linenumber = 1 THEN NULL ELSE round(l_quantity / (l_linenumber - 1), 6) END AS ratio, CAST(NULL AS BIGINT) AS bad FROM lineitem""",
)
def fn_math(spark, d):
    return st.table(spark, d, "lineitem").select(
        "l_orderkey",
        big("l_linenumber").alias("l_linenumber"),
        big("l_quantity").alias("whole"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.col("l_tax"), 4).alias("net"),
        F.round(F.try_divide(F.col("l_quantity"), F.col("l_linenumber") - 1), 6).alias("ratio"),
        F.concat(F.lit("x"), "l_returnflag").try_cast("bigint").alias("bad"),
    )


@query(
    "fn_case",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS band FROM orders""",
)
def fn_case(spark, d):
    price = F.col("o_totalprice")
    band = F.when(price < 50000, "low").when(price < 150000, "mid").otherwise("high")
    return st.table(spark, d, "orders").select("o_orderkey", band.alias("band"))


@query(
    "fn_array",
    """SELECT l_orderkey, count(*)::BIGINT AS size, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS items,
         min(l_linenumber)::BIGINT AS first_line FROM lineitem GROUP BY 1""",
)
def fn_array(spark, d):
    rows = st.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a")
    )
    text = F.transform("a", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))
    return rows.select(
        "l_orderkey", big(F.size("a")).alias("size"), F.array_join(text, ",").alias("items"),
        big(F.col("a.l_linenumber")[0]).alias("first_line"),
    )
