"""Labels, splits, sampling, class mixing and vocabulary."""

from pyspark.sql import functions as F

from checks import standins as st
from checks.registry import big, query, time_text
from medstrand.functions.keyed import keyed_hash
from medstrand.operators import labels, sequence, splits, vocab
from medstrand.sources.sinks import materialise

U, H = st.sql_uniform, st.sql_hash


@query(
    "derive_labels",
    "SELECT person_id, toxic, CASE WHEN toxic = 1 THEN 1 ELSE 0 END::BIGINT AS label FROM cohort WHERE quality = 1",
)
def derive_labels(spark, d):
    rows = labels.derive_labels(st.cohort(spark, d), st.COHORT_RULE)
    return rows.select("person_id", "toxic", big("label").alias("label"))


@query(
    "label_cast",
    "SELECT patient_id, value, strftime(prediction_time, '%Y-%m-%d %H:%M:%S') AS prediction_time FROM plabels",
)
def label_cast(spark, d):
    rows = labels.cast_labels(st.prediction_labels(spark, d))
    return rows.select("patient_id", "value", time_text("prediction_time").alias("prediction_time"))


@query(
    "label_events",
    "SELECT person_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, token AS general_event_token FROM lab_marks",
)
def label_events(spark, d):
    rows = labels.label_events(labels.cast_labels(st.prediction_labels(spark, d)))
    return rows.withColumn("date", time_text("date"))


@query(
    "join_labels",
    """SELECT doc_id AS person_id, lang, n_chars, CASE WHEN toxic = 1 THEN 1 ELSE 0 END::BIGINT AS label
       FROM documents JOIN labels USING (doc_id) WHERE quality = 1""",
)
def join_labels(spark, d):
    docs = st.table(spark, d, "documents").select(F.col("doc_id").alias("person_id"), "lang", "n_chars")
    joined = labels.join_labels(docs, st.cohort(spark, d), st.COHORT_RULE)
    return joined.withColumn("label", big("label"))


@query(
    "matched_controls",
    f"""WITH pool AS (SELECT person_id, px_gender, px_region, row_number() OVER (PARTITION BY px_gender, px_region
           ORDER BY {H('m-control', 'person_id')}, person_id) - 1 AS slot FROM patient WHERE px_gender IS NOT NULL),
         sizes AS (SELECT px_gender, px_region, count(*) AS n FROM pool GROUP BY 1, 2),
         asked AS (SELECT person_id, px_gender, px_region, row_number() OVER (PARTITION BY px_gender, px_region
           ORDER BY {H('m-case', 'person_id')}, person_id) - 1 AS r FROM patient WHERE px_gender IS NOT NULL AND px_race = 'BUILDING'),
         f AS (SELECT a.*, n, r % n AS slot FROM asked a JOIN sizes USING (px_gender, px_region)),
         g AS (SELECT f.person_id AS case_id, f.px_gender, f.px_region, n,
                 CASE WHEN p.person_id = f.person_id THEN (f.slot + 1) % n ELSE f.slot END AS slot
               FROM f JOIN pool p ON p.px_gender = f.px_gender AND p.px_region = f.px_region AND p.slot = f.slot)
       SELECT g.case_id, p.person_id AS control_id, g.px_gender, g.px_region FROM g JOIN pool p
         ON p.px_gender = g.px_gender AND p.px_region = g.px_region AND p.slot = g.slot WHERE p.person_id <> g.case_id""",
)
def matched_controls(spark, d):
    everyone = st.patient(spark, d)
    cases = everyone.filter("px_race = 'BUILDING'")
    return labels.matched_controls(cases, everyone, ["px_gender", "px_region"], "m")


@query(
    "split_membership",
    "SELECT person_id, token AS general_event_token, split FROM ev JOIN splitmap ON person_id = omop_person_id",
)
def split_membership(spark, d):
    rows = splits.split_membership(st.tokens(spark, d), st.split_map(spark, d))
    return rows.select("person_id", "general_event_token", "split")


PRIOR = "c_custkey % 4 = 1 AND c_nationkey < 12"


@query(
    "prior_overlap",
    f"""SELECT person_id, label, person_id IN (SELECT c_custkey FROM customer WHERE {PRIOR}) AS in_prior FROM classed""",
)
def prior_overlap(spark, d):
    prior = st.table(spark, d, "customer").filter(PRIOR).select(F.col("c_custkey").alias("person_id"))
    return splits.prior_overlap(st.classed(spark, d), prior).select("person_id", "label", "in_prior")


@query(
    "label_metadata",
    "SELECT split, value, count(*) AS n FROM plabels JOIN splitmap ON patient_id = omop_person_id GROUP BY 1, 2",
)
def label_metadata(spark, d):
    cast = labels.cast_labels(st.prediction_labels(spark, d))
    return labels.label_metadata(cast, st.split_map(spark, d))


@query(
    "class_distribution",
    """SELECT split, label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS percent
       FROM classed JOIN splitmap ON person_id = omop_person_id GROUP BY 1, 2""",
)
def class_distribution(spark, d):
    rows = splits.split_membership(st.classed(spark, d), st.split_map(spark, d))
    return splits.class_distribution(rows).withColumn("percent", F.round("percent", 6))


@query(
    "class_id_violations",
    "SELECT x::BIGINT AS missing_class FROM range(0, 3) t(x) WHERE x NOT IN (SELECT label FROM classed WHERE label <> 1)",
)
def class_id_violations(spark, d):
    gaps = splits.class_id_violations(st.classed(spark, d).filter("label <> 1"))
    return gaps.withColumn("missing_class", big("missing_class"))


@query(
    "class_weights",
    """WITH c AS (SELECT label, count(*) AS n FROM classed GROUP BY 1),
         s AS (SELECT label, n, least(n / (SELECT min(n) FROM c), 4.0::DOUBLE) AS proportion FROM c)
       SELECT label, n, round(proportion, 9) AS proportion, round((1 / proportion) / (SELECT sum(1 / proportion) FROM s), 9) AS weight FROM s""",
)
def class_weights(spark, d):
    out = splits.class_weights(st.classed(spark, d), max_proportion=4.0)
    return out.withColumn("proportion", F.round("proportion", 9)).withColumn("weight", F.round("weight", 9))


@query(
    "hash_sample",
    f"SELECT o_orderkey, o_custkey FROM orders WHERE {U('sample', 'o_custkey')} < 0.1",
)
def hash_sample(spark, d):
    return splits.hash_sample(st.table(spark, d, "orders").select("o_orderkey", "o_custkey"), 0.1, "sample", "o_custkey")


@query(
    "random_split",
    f"""SELECT person_id, CASE WHEN u * 1.4::DOUBLE < 0.7 THEN 'train' WHEN u * 1.4::DOUBLE < 1.2 THEN 'test' ELSE 'valid' END AS split
        FROM (SELECT person_id, {U('rs', 'person_id')} AS u FROM classed)""",
)
def random_split(spark, d):
    return splits.random_split(st.classed(spark, d), 0.2, "rs").select("person_id", "split")


@query(
    "split_with_prior",
    f"""WITH f AS (SELECT person_id, person_id IN (SELECT c_custkey FROM customer WHERE {PRIOR}) AS in_prior, {U('sp', 'person_id')} AS u FROM classed),
         s AS (SELECT sum(in_prior::INT) / count(*) AS share FROM f)
       SELECT person_id, in_prior, CASE WHEN in_prior OR u * (1.0 - share) < 0.7 - share THEN 'train'
         WHEN u * (1.0 - share) < 0.85 - share THEN 'valid' ELSE 'test' END AS split FROM f, s""",
)
def split_with_prior(spark, d):
    prior = st.table(spark, d, "customer").filter(PRIOR).select(F.col("c_custkey").alias("person_id"))
    return splits.split_with_prior(st.classed(spark, d), prior, "sp").select("person_id", "in_prior", "split")


@query(
    "proportional_mix",
    f"""WITH s AS (SELECT label, count(*) AS n FROM classed GROUP BY 1),
         r AS (SELECT person_id, label, row_number() OVER (PARTITION BY label ORDER BY {H('mix-row', 'person_id')}, person_id) - 1 AS slot FROM classed),
         draws AS (SELECT i AS draw, {U('mix-draw', 'i')} * 6.0::DOUBLE AS u FROM range((SELECT floor(min(n) * 6)::BIGINT FROM s)) t(i)),
         l AS (SELECT draw, CASE WHEN u < 1 THEN 0 WHEN u < 3 THEN 1 ELSE 2 END AS label FROM draws),
         k AS (SELECT draw, label, row_number() OVER (PARTITION BY label ORDER BY draw) - 1 AS k FROM l)
       SELECT draw, k.label, person_id FROM k JOIN s USING (label) JOIN r ON r.label = k.label AND r.slot = k.k % s.n""",
)
def proportional_mix(spark, d):
    mixed = splits.proportional_mix(st.classed(spark, d), {0: 1.0, 1: 2.0, 2: 3.0}, "mix")
    return mixed.select("draw", "label", "person_id")


@query(
    "seeded_shuffle",
    f"""SELECT o_orderkey, row_number() OVER (ORDER BY {H('sh', 'o_orderkey')}, o_orderkey) AS rank FROM orders""",
)
def seeded_shuffle(spark, d):
    from medstrand.operators.scale import hash_rank

    orders = st.table(spark, d, "orders").select("o_orderkey")
    shuffled = splits.seeded_shuffle(orders, "sh", ["o_orderkey"])
    ranked = hash_rank(shuffled.withColumn("h", keyed_hash("sh", "o_orderkey")), "h", ["o_orderkey"])
    return ranked.select("o_orderkey", "rank")


@query(
    "top_n_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r
       FROM orders) WHERE r <= 3""",
)
def top_n_per_group(spark, d):
    orders = st.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return labels.top_n_per_group(orders, ["o_custkey"], "o_totalprice", 3, ties=["o_orderkey"])


CAPPED_SQL = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY token, person_id ORDER BY {h} DESC, {ties}) AS rk FROM {rows}),
  c AS (SELECT token, rk, count(*) AS n FROM r GROUP BY 1, 2),
  s AS (SELECT token, rk, sum(n) OVER (PARTITION BY token ORDER BY rk) AS kept, sum(n) OVER (PARTITION BY token) AS total FROM c),
  k AS (SELECT token, max(total) > {t} AS capped, coalesce(min(rk) FILTER (WHERE kept > {t} AND rk <= 99), 99) AS cap FROM s GROUP BY 1)
SELECT person_id, o_orderkey, r.token AS general_event_token FROM r JOIN k USING (token) WHERE NOT capped OR rk <= cap"""


@query(
    "capped_sample",
    CAPPED_SQL.format(
        h=H("cap", "o_orderkey"), ties="o_orderkey", t=500,
        rows="(SELECT o_custkey AS person_id, o_orderkey, 'LABEL:' || left(o_orderpriority, 1) AS token FROM orders)",
    ),
)
def capped_sample(spark, d):
    rows = st.table(spark, d, "orders").select(
        F.col("o_custkey").alias("person_id"), "o_orderkey",
        F.concat(F.lit("LABEL:"), F.substring("o_orderpriority", 1, 1)).alias("general_event_token"),
    )
    return labels.capped_sample(rows, "cap", ["o_orderkey"], threshold=500)


@query("token_counts", "SELECT token, n FROM wordcounts")
def token_counts(spark, d):
    return vocab.token_counts(st.documents(spark, d))


@query(
    "token_counts_split",
    """SELECT array_to_string(string_split(token, ':')[1:2], ':') AS token, count(*) AS n FROM bseqrows GROUP BY 1""",
)
def token_counts_split(spark, d):
    from medstrand.operators.timeline import parallel_arrays

    return vocab.token_counts(parallel_arrays(st.banded_sequences(spark, d)), split_percentile_tokens=True)


@query(
    "token_cumfrac",
    """SELECT token, n, sum(n) OVER (ORDER BY n DESC, token)::BIGINT AS cum_count,
         round(sum(n) OVER (ORDER BY n DESC, token) / sum(n) OVER (), 9) AS cum_count_frac FROM wordcounts""",
)
def token_cumfrac(spark, d):
    counts = materialise(vocab.token_counts(st.documents(spark, d)), "token-counts")
    out = vocab.cumulative_fractions(counts)
    return out.withColumn("cum_count_frac", F.round("cum_count_frac", 9))


VOCAB_SIZE = 400
VOCAB_SQL = f"""SELECT token, row_number() OVER (ORDER BY g, i, n DESC, token) - 1 AS id FROM (
  SELECT 0 AS g, 0 AS i, * FROM (SELECT token, count(*) AS n FROM {{rows}} GROUP BY 1 ORDER BY n DESC, token LIMIT {VOCAB_SIZE}) {{where}}
  UNION ALL SELECT 1, i, t, 0 FROM (VALUES {{tail}}) v(i, t))"""


@query("vocabulary", VOCAB_SQL.format(rows="words", where="", tail="(0, '[MASK]'), (1, '[CLS]'), (2, '[UNK]')"))
def vocabulary(spark, d):
    out = vocab.vocabulary(vocab.token_counts(st.documents(spark, d)), VOCAB_SIZE)
    return out.withColumn("id", big("id"))


@query(
    "vocabulary_single_age",
    VOCAB_SQL.format(rows="seqrows", where="WHERE token NOT LIKE 'AGE:%'", tail="(0, 'AGE'), (3, '[UNK]')"),
)
def vocabulary_single_age(spark, d):
    from medstrand.operators.timeline import parallel_arrays

    counts = vocab.token_counts(parallel_arrays(st.sequences(spark, d)))
    out = vocab.vocabulary(counts, VOCAB_SIZE, single_age_token=True, skip_special_tokens=True)
    return out.withColumn("id", big("id"))


@query(
    "label_event_count",
    "SELECT count(*) AS n_labels FROM lseqrows WHERE token = 'LABEL:1'",
)
def label_event_count(spark, d):
    return sequence.label_event_count(st.labelled_sequences(spark, d), label=1)


@query(
    "label_index",
    """SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY pos) - 1 AS label_count, split_part(token, ':', 2)::BIGINT AS label, pos AS label_position
       FROM lseqrows WHERE token LIKE 'LABEL%'""",
)
def label_index(spark, d):
    out = sequence.label_index(st.labelled_sequences(spark, d))
    return out.select("person_id", *[big(c).alias(c) for c in ("label_count", "label", "label_position")])
