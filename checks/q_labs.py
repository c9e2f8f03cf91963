"""Lab cleaning, units, percentiles."""

from pyspark.sql import functions as F

from checks import standins as st
from checks.registry import query, time_text
from medstrand.functions import codes
from medstrand.operators import labs
from medstrand.operators import timeline
from medstrand.sources.sinks import materialise

LIMITS = (st.MIN_COUNT, st.MIN_VALUES)


def _converted(spark, d):
    usable = labs.clean(st.lab(spark, d))
    return labs.convert(usable, labs.unit_conversions(usable))


@query(
    "lab_code_filter",
    r"""SELECT lx_lab_code, lx_lab_code_type, count(*) AS n FROM
       (SELECT CASE WHEN l_suppkey % 7 = 0 THEN '0000-0' WHEN l_suppkey % 5 = 0 THEN '12-3' ELSE lpad(CAST(l_suppkey AS VARCHAR), 4, '0') || '-1' END AS lx_lab_code,
          CASE WHEN l_linenumber = 7 THEN 'TNX' ELSE 'LOINC' END AS lx_lab_code_type FROM lineitem)
       WHERE (regexp_full_match(lx_lab_code, '\d{4,}-\d') OR lx_lab_code_type <> 'LOINC') AND lx_lab_code NOT IN ('0000-0', '00000-0')
       GROUP BY 1, 2""",
)
def lab_code_filter(spark, d):
    rows = st.table(spark, d, "lineitem").select(
        F.expr("case when l_suppkey % 7 = 0 then '0000-0' when l_suppkey % 5 = 0 then '12-3' "
               "else concat(lpad(cast(l_suppkey as string), 4, '0'), '-1') end").alias("lx_lab_code"),
        F.expr("case when l_linenumber = 7 then 'TNX' else 'LOINC' end").alias("lx_lab_code_type"),
    )
    return labs.filter_codes(rows).groupBy("lx_lab_code", "lx_lab_code_type").agg(F.count("*").alias("n"))


@query(
    "lab_clean",
    "SELECT person_id, lx_lab_code, lx_lab_code_type, lx_result_unit, lx_result_val FROM lab_ok",
)
def lab_clean(spark, d):
    return labs.clean(st.lab(spark, d)).select(
        "person_id", "lx_lab_code", "lx_lab_code_type", "lx_result_unit", "lx_result_val"
    )


@query("unit_counts", "SELECT lx_lab_code_type, lx_lab_code, lx_result_unit, count(*) AS n FROM lab_ok GROUP BY 1, 2, 3")
def unit_counts(spark, d):
    return labs.unit_counts(labs.clean(st.lab(spark, d)))


@query("base_unit", "SELECT lx_lab_code, lx_result_unit, n FROM unit_rank WHERE rank = 1")
def base_unit(spark, d):
    return labs.base_units(labs.clean(st.lab(spark, d)))


@query(
    "unit_clean",
    r"""SELECT unit, regexp_replace(regexp_replace(unit, '([a-zA-Z]+)(\d+)', '\1**\2', 'g'), '([a-zA-Z]+)\*(\d+)', '\1**\2', 'g') AS cleaned, count(*) AS n
        FROM (SELECT CASE l_linenumber WHEN 1 THEN 'mm3' WHEN 2 THEN 'mm*3' WHEN 3 THEN 'mm**3' WHEN 4 THEN 'mg/dL'
                WHEN 5 THEN 'cells/mm3' ELSE 'ug/m2/h' || l_suppkey END AS unit FROM lineitem)
        GROUP BY 1""",
)
def unit_clean(spark, d):
    unit = F.expr(
        "case l_linenumber when 1 then 'mm3' when 2 then 'mm*3' when 3 then 'mm**3' when 4 then 'mg/dL' "
        "when 5 then 'cells/mm3' else concat('ug/m2/h', l_suppkey) end"
    )
    counted = st.table(spark, d, "lineitem").select(unit.alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    return counted.withColumn("cleaned", codes.clean_unit(F.col("unit")))


@query(
    "unit_factors",
    """SELECT lx_result_unit, lx_result_other_unit, n, round(conversion_factor, 9) AS conversion_factor FROM (
         SELECT a.u AS lx_result_unit, b.u AS lx_result_other_unit, a.n AS n,
           CASE WHEN a.u = b.u THEN 1.0 WHEN sa.kind = sb.kind THEN sb.size / sa.size END::DOUBLE AS conversion_factor
         FROM (SELECT l_returnflag AS f, CASE l_returnflag WHEN 'A' THEN 'mg/dL' WHEN 'N' THEN 'g/L' ELSE 'ug/mL' END AS u, count(*) AS n FROM lineitem GROUP BY 1, 2) a
         JOIN (SELECT DISTINCT l_returnflag AS f, CASE l_linenumber WHEN 1 THEN 'kg/m3' WHEN 2 THEN 'mmol/L' WHEN 3 THEN '10*3/uL'
             WHEN 4 THEN '10**9/L' WHEN 5 THEN 'furlong' ELSE 'g/L' END AS u FROM lineitem) b ON a.f = b.f
         LEFT JOIN (VALUES ('mg/dL', 0.01, 'mass'), ('g/L', 1.0, 'mass'), ('ug/mL', 0.001, 'mass')) sa(unit, size, kind) ON sa.unit = a.u
         LEFT JOIN (VALUES ('kg/m3', 1.0, 'mass'), ('g/L', 1.0, 'mass'), ('mmol/L', 0.001, 'amount')) sb(unit, size, kind) ON sb.unit = b.u)""",
)
def unit_factors(spark, d):
    l = st.table(spark, d, "lineitem")
    base = F.expr("case l_returnflag when 'A' then 'mg/dL' when 'N' then 'g/L' else 'ug/mL' end")
    other = F.expr(
        "case l_linenumber when 1 then 'kg/m3' when 2 then 'mmol/L' when 3 then '10*3/uL' when 4 then '10**9/L' "
        "when 5 then 'furlong' else 'g/L' end"
    )
    a = l.groupBy("l_returnflag", base.alias("lx_result_unit")).agg(F.count("*").alias("n"))
    b = l.select("l_returnflag", other.alias("lx_result_other_unit")).distinct()
    pairs = a.join(b, "l_returnflag").drop("l_returnflag")
    factors = labs.conversion_factors(pairs, "lx_result_unit", "lx_result_other_unit")
    return factors.withColumn("conversion_factor", F.round("conversion_factor", 9)).drop("conversion_offset")


# Unit texts and what they come to in kg, m3 and mol; null where they cannot be read.
UNIT_TEXTS = [
    ("mg/dL", 0.01), ("mg / dL", 0.01), ("mg/(dL)", 0.01), ("milligram/dL", 0.01), ("milligrams/deciliter", 0.01), ("grams/L", 1.0),
    ("gram/liter", 1.0), ("g/L", 1.0), ("ug/mL", 0.001), ("microgram/milliliter", 0.001), ("ng/mL", 1e-6), ("nanograms / mL", 1e-6),
    ("pg/mL", 1e-9), ("kg/m^3", 1.0), ("kg/m**3", 1.0), ("kg / m ^ 3", 1.0), ("mmol/L", 1.0), ("millimole/liter", 1.0), ("umol/L", 0.001),
    ("mol/L", 1000.0), ("10^3/uL", 1e12), ("10*3/uL", 1e12), ("10**3/uL", 1e12), ("10^9/L", 1e12), ("10^6/mL", 1e12), ("1/L", 1000.0),
    ("mL", 1e-6), ("milliliters", 1e-6), ("minutes", 60.0), ("hours", 3600.0), ("%", 0.01), ("cm^2", 1e-4), ("furlong", None), ("(g", None),
]


@query(
    "unit_texts",
    f"""SELECT t.unit, count(*) AS n, t.factor FROM lineitem JOIN (VALUES {", ".join(f"({i}, '{u}', {f if f is not None else 'NULL'}::DOUBLE)" for i, (u, f) in enumerate(UNIT_TEXTS))}) t(i, unit, factor)
       ON l_partkey % {len(UNIT_TEXTS)} = t.i GROUP BY ALL""",
)
def unit_texts(spark, d):
    texts = F.array(*[F.lit(u) for u, _ in UNIT_TEXTS])
    used = st.table(spark, d, "lineitem").select(F.element_at(texts, (F.col("l_partkey") % len(UNIT_TEXTS) + 1).cast("int")).alias("unit"))
    factors = labs.unit_factors(used, "unit")
    counted = used.groupBy("unit").agg(F.count("*").alias("n")).join(factors, "unit")
    return counted.select("unit", "n", labs._significant(F.col("factor"), 9).alias("factor"))


@query(
    "unit_conversions",
    """SELECT lx_lab_code, lx_result_unit, lx_result_other_unit, round(conversion_factor::DOUBLE, 9) AS conversion_factor FROM conversion""",
)
def unit_conversions(spark, d):
    table = labs.unit_conversions(labs.clean(st.lab(spark, d)))
    return table.withColumn("conversion_factor", F.round("conversion_factor", 9)).drop("conversion_offset")


# Groups, powers of groups, words and temperatures: factor to base units and base units at zero.
UNIT_GRAMMAR = [
    ("mL/(min*kg)", 1e-6 / 60, 0), ("mL/min/kg", 1e-6 / 60, 0), ("mL/min*kg", 1e-6 / 60, 0), ("mg/(kg h)", 1e-6 / 3600, 0), ("(mg/dL)**2", 1e-4, 0),
    ("1/(g/(L*(m/s)**2))", 1, 0), ("((m))", 1, 0), ("mL/(min*(1.73 m^2))", 1e-6 / 60 / 1.73, 0), ("m squared", 1, 0),
    ("cubic m", 1, 0), ("mg per dL", 0.01, 0), ("5e3/uL", None, None), ("/uL", 1e9, 0), ("degC", 1, 273.15), ("Cel", 1, 273.15),
    ("degF", 5 / 9, 459.67 * 5 / 9), ("J/degC", 1, 0), ("K", 1, 0), ("mL/(min*kg", None, None), ("mL/min)*kg", None, None), ("m//s", None, None),
    ("m/", None, None), ("()", None, None), ("m**2**3", None, None), ("m**0.5", None, None), ("mg!", None, None),
]


@query(
    "unit_grammar",
    f"""SELECT t.unit, count(*) AS n, t.factor, t.zero FROM lineitem JOIN (VALUES {", ".join(
        f"({i}, '{u}', " + ("NULL::DOUBLE, NULL::DOUBLE)" if f is None else f"{float(f'{f:.8e}')!r}::DOUBLE, {float(f'{z:.8e}')!r}::DOUBLE)") for i, (u, f, z) in enumerate(UNIT_GRAMMAR)
    )}) t(i, unit, factor, zero) ON l_partkey % {len(UNIT_GRAMMAR)} = t.i GROUP BY ALL""",
)
def unit_grammar(spark, d):
    texts = F.array(*[F.lit(u) for u, _, _ in UNIT_GRAMMAR])
    used = st.table(spark, d, "lineitem").select(F.element_at(texts, (F.col("l_partkey") % len(UNIT_GRAMMAR) + 1).cast("int")).alias("unit"))
    factors = labs.unit_factors(used, "unit")
    counted = used.groupBy("unit").agg(F.count("*").alias("n")).join(factors, "unit")
    return counted.select("unit", "n", *[labs._significant(F.col(c), 9).alias(c) for c in ("factor", "zero")])


@query(
    "unit_offsets",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, u) AS r, u
         FROM (SELECT l.*, CASE l_linenumber % 3 WHEN 0 THEN 'degF' WHEN 1 THEN 'degC' ELSE 'K' END AS u,
                 count(*) OVER (PARTITION BY l_returnflag, l_linenumber % 3) AS n FROM lineitem l)),
         b AS (SELECT l_returnflag, u AS base FROM t WHERE r = 1),
         k AS (SELECT t.*, base, CASE u WHEN 'degF' THEN (v + 459.67) * 5 / 9 WHEN 'degC' THEN v + 273.15 ELSE v END AS kelvin FROM t JOIN b USING (l_returnflag))
       SELECT l_orderkey, l_linenumber, u AS unit, base,
         round((CASE base WHEN 'degF' THEN kelvin * 9 / 5 - 459.67 WHEN 'degC' THEN kelvin - 273.15 ELSE kelvin END)::DOUBLE, 3) AS value FROM k""",
)
def unit_offsets(spark, d):
    """Temperatures of each flag in its most frequent unit."""
    unit = F.expr("case l_linenumber % 3 when 0 then 'degF' when 1 then 'degC' else 'K' end")
    rows = st.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit("LOCAL").alias("lx_lab_code_type"), F.col("l_returnflag").alias("lx_lab_code"),
        F.col("l_quantity").cast("double").alias("lx_result_val"), unit.alias("lx_result_unit"),
    )
    out = labs.convert(rows, labs.unit_conversions(rows))
    return out.select(
        "l_orderkey", "l_linenumber", F.col("lx_result_other_unit").alias("unit"), F.col("lx_result_unit").alias("base"),
        F.round("lx_result_val_converted", 3).alias("value"),
    )


@query(
    "convert_units",
    "SELECT person_id, lx_lab_code, lx_result_other_unit, lx_result_unit, round(lx_result_val_converted, 6) AS lx_result_val_converted FROM converted",
)
def convert_units(spark, d):
    return _converted(spark, d).select(
        "person_id", "lx_lab_code", "lx_result_other_unit", "lx_result_unit",
        F.round("lx_result_val_converted", 6).alias("lx_result_val_converted"),
    )


@query(
    "having_semi",
    """SELECT lx_lab_code, value_counts, count(*) AS n FROM converted JOIN
         (SELECT lx_lab_code, count(DISTINCT lx_result_val) AS value_counts FROM converted GROUP BY 1
          HAVING count(*) > 500 AND count(DISTINCT lx_result_val) > 400) USING (lx_lab_code) GROUP BY 1, 2""",
)
def having_semi(spark, d):
    kept = labs.filter_frequent(_converted(spark, d), 500, 400)
    return kept.groupBy("lx_lab_code", "value_counts").agg(F.count("*").alias("n"))


@query(
    "percentiles",
    """SELECT lx_lab_code, array_to_string(list_transform(b, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ',') AS boundaries,
         round(b[1], 6) AS percentile_10, round(b[9], 6) AS percentile_90 FROM bounds""",
)
def percentiles(spark, d):
    _, table = labs.fit(st.lab(spark, d), *LIMITS, accuracy=st.ACCURACY, save=materialise)
    micros = F.transform("percentile_boundaries", lambda x: F.round(x * 1000000).cast("bigint").cast("string"))
    return table.select(
        "lx_lab_code", F.array_join(micros, ",").alias("boundaries"),
        F.round("percentile_10", 6).alias("percentile_10"), F.round("percentile_90", 6).alias("percentile_90"),
    )


@query(
    "percentile_group",
    """SELECT c_custkey, CAST(least(greatest(floor(c_acctbal / 1000) , 0), 9) AS BIGINT) * 10 || '-' || (CAST(least(greatest(floor(c_acctbal / 1000), 0), 9) AS BIGINT) * 10 + 10)
         AS percentile_group FROM customer""",
)
def percentile_group(spark, d):
    bounds = F.array(*[F.lit(float(1000 * i)) for i in range(1, 10)])
    return st.table(spark, d, "customer").select(
        "c_custkey", codes.percentile_group(F.col("c_acctbal"), bounds, 10).alias("percentile_group")
    )


@query("lab_tokens", "SELECT person_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, token AS general_event_token FROM labtok")
def lab_tokens(spark, d):
    tokens, _, _ = labs.fit_apply(st.lab(spark, d), *LIMITS, accuracy=st.ACCURACY, save=materialise)
    return tokens.withColumn("date", time_text("date"))


@query("lab_tokens_apply", "SELECT person_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, token AS general_event_token FROM labtok")
def lab_tokens_apply(spark, d):
    conversions, table = labs.fit(st.lab(spark, d), *LIMITS, accuracy=st.ACCURACY, save=materialise)
    tokens = labs.apply(st.lab(spark, d), conversions, table, *LIMITS, save=materialise)
    return tokens.withColumn("date", time_text("date"))


@query(
    "pass_rates",
    """SELECT (SELECT count(*) FROM lab) AS n_before, (SELECT count(*) FROM lab_ok) AS n_clean, (SELECT count(*) FROM converted) AS n_converted,
         round((SELECT count(*) FROM lab_ok) * 100.0 / (SELECT count(*) FROM lab), 6)::DOUBLE AS clean_percent,
         round((SELECT count(*) FROM converted) * 100.0 / (SELECT count(*) FROM lab_ok), 6)::DOUBLE AS converted_percent""",
)
def pass_rates(spark, d):
    rates = labs.pass_rates(st.lab(spark, d))
    return rates.withColumn("clean_percent", F.round("clean_percent", 6)).withColumn(
        "converted_percent", F.round("converted_percent", 6)
    )


def value_sequences(spark, d):
    """Diagnosis tokens with lab tokens that still carry value and unit; some are malformed."""
    lab = st.lab(spark, d)
    token = F.concat_ws(":", F.lit("LOINC"), "lx_lab_code", "lx_result_val", "lx_result_unit")
    short = F.concat_ws(":", F.lit("LOINC"), "lx_lab_code")
    marked = lab.select(
        "person_id", "date", F.when(F.col("lx_lab_code_type") == "TNX", short).otherwise(token).alias("general_event_token")
    )
    return timeline.build_sequences(st.coded(spark, d, "diagnosis").union(marked), st.patient(spark, d))


TOKEN_PCT_SQL = """WITH vev AS (
  SELECT person_id, date, token, token AS new FROM dx_tok
  UNION ALL
  SELECT l.person_id, l.date, CASE WHEN l.lx_lab_code_type = 'TNX' THEN 'LOINC:' || l.lx_lab_code
      ELSE 'LOINC:' || l.lx_lab_code || ':' || l.lx_result_val || ':' || l.lx_result_unit END,
    CASE WHEN l.lx_lab_code_type <> 'TNX' AND b.b IS NOT NULL AND v IS NOT NULL THEN
      'LOINC:' || l.lx_lab_code || ':' || (len(list_filter(b.b, lambda x: x <= v)) * 10) || '-' || (len(list_filter(b.b, lambda x: x <= v)) * 10 + 10) END
  FROM (SELECT lab.*, TRY_CAST(lab.lx_result_val AS DOUBLE) * round(c.conversion_factor, 9) AS v FROM lab LEFT JOIN conversion c
        ON c.lx_lab_code = lab.lx_lab_code AND c.lx_result_other_unit = lab.lx_result_unit) l
  LEFT JOIN bounds b ON b.lx_lab_code = l.lx_lab_code),
vf AS (SELECT person_id, min(date) AS f FROM vev GROUP BY 1),
vrows AS (
  SELECT vev.person_id, vev.date, date_diff('day', f, vev.date) + 1 AS day, token, new FROM vev JOIN vf USING (person_id)
  UNION ALL
  SELECT p.person_id, px_birth_date, 0, t, t FROM (SELECT p.person_id, px_birth_date, unnest(list_filter([
    'AGE:' || CAST(floor(date_diff('day', px_birth_date, f) / 365) AS BIGINT), 'ETHNICITY:' || px_ethnicity,
    'GENDER:' || px_gender, 'RACE:' || px_race, 'REGION:' || px_region], lambda x: x IS NOT NULL)) AS t
    FROM patient p JOIN vf USING (person_id)) p)
SELECT person_id, string_agg(day || '@' || new, '|' ORDER BY date, day, token) AS seq FROM vrows WHERE new IS NOT NULL GROUP BY 1"""


@query("token_lab_percentiles", TOKEN_PCT_SQL)
def token_lab_percentiles(spark, d):
    from checks.registry import seq_text

    conversions, table = labs.fit(st.lab(spark, d), *LIMITS, accuracy=st.ACCURACY, save=materialise)
    rows = labs.token_percentiles(materialise(value_sequences(spark, d), "sequences"), ["person_id"], conversions, table)
    return rows.select("person_id", seq_text().alias("seq"))
