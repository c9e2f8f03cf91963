"""Sequence trims, label samples, encoding, batches, masking."""

from pyspark.sql import functions as F

from checks import sql_steps as q
from checks import standins as st
from checks.q_labels import VOCAB_SIZE, VOCAB_SQL
from checks.q_labs import LIMITS
from checks.registry import CTES, big, list_text, query, seq_text
from medstrand.operators import labs, sequence, timeline, vocab
from medstrand.plans import rows as plans
from medstrand.sources.sinks import materialise

L, P, KEYS = 20, 1825, "person_id, label_count"
SPECIAL = "(0, '[MASK]'), (1, '[CLS]'), (2, '[UNK]')"
CTES["voc"] = VOCAB_SQL.format(rows="seqrows", where="", tail=SPECIAL)
CTES["bparts"] = "SELECT array_to_string(string_split(token, ':')[1:2], ':') AS token FROM bseqrows"
CTES["bvoc"] = VOCAB_SQL.format(rows="bparts", where="", tail=SPECIAL)
FIRST = "SELECT * FROM seqrows"


def vocabulary(spark, d, sequences=st.sequences, split=False):
    """Stored, as a job's vocabulary is: its size is then known when the tokens meet it."""
    counts = vocab.token_counts(timeline.parallel_arrays(sequences(spark, d)), split)
    return materialise(vocab.vocabulary(counts, VOCAB_SIZE), "vocabulary")


def shown(df, *keys):
    return df.select(*keys, seq_text().alias("seq"))


def encoded_shown(df, *keys):
    arrays = [c for c in sequence.ENCODED + ("labels",) if c in df.columns and dict(df.dtypes)[c].startswith("array")]
    return df.select(*keys, *[list_text(c).alias(c) for c in arrays])


@query("baseline_first", q.text(FIRST))
def baseline_first(spark, d):
    turned = st.sequences(spark, d).withColumn("seq", F.reverse("seq"))
    # Reverse, move the baseline to the front, and put each half back in order.
    moved = sequence.baseline_first(turned)
    size = F.size(F.filter("seq", lambda x: x["day"] == 0))
    both = F.concat(F.reverse(F.slice("seq", 1, size)), F.reverse(F.slice("seq", size + 1, F.size("seq") - size)))
    return shown(moved.withColumn("seq", both), "person_id")


@query("trim_length", q.text(q.trim_length(FIRST, L)))
def trim_length(spark, d):
    return shown(sequence.trim_length(st.sequences(spark, d), L), "person_id")


@query("trim_position", q.text(q.trim_position(FIRST, P)))
def trim_position(spark, d):
    return shown(sequence.trim_position(st.sequences(spark, d), P), "person_id")


@query("random_window", q.text(q.random_window(FIRST, L, P, "rw")))
def random_window(spark, d):
    return shown(sequence.random_window(st.sequences(spark, d), L, P, "rw"), "person_id")


@query("correct_age", q.text(q.age("SELECT * FROM seqrows WHERE day <> 1")))
def correct_age(spark, d):
    later = st.sequences(spark, d).withColumn("seq", F.filter("seq", lambda x: x["day"] != 1))
    return shown(sequence.correct_age(later), "person_id")


@query("dedupe_consecutive", q.text(q.no_repeats(FIRST, "person_id")))
def dedupe_consecutive(spark, d):
    return shown(sequence.dedupe_consecutive(st.sequences(spark, d)), "person_id")


LSAMPLES = q.samples("SELECT * FROM lseqrows")


@query("label_samples", q.text(LSAMPLES, KEYS + ", label"))
def label_samples(spark, d):
    out = sequence.label_samples(st.labelled_sequences(spark, d))
    return shown(out, "person_id", big("label_count").alias("label_count"), big("label").alias("label"))


@query(
    "recent_events",
    """SELECT person_id, token AS general_event_token, day AS days_since_begin FROM (
         SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY date DESC, day DESC, token DESC) AS r FROM aligned) WHERE r <= 5
       UNION ALL SELECT person_id, token, day FROM base""",
)
def recent_events(spark, d):
    aligned = timeline.align_to_first_date(st.tokens(spark, d))
    kept = sequence.recent_events(timeline.add_baseline(aligned, st.patient(spark, d)), 5)
    return kept.select("person_id", "general_event_token", big("days_since_begin").alias("days_since_begin"))


def recent_samples_sql(keep):
    ranked = f"""SELECT *, row_number() OVER (PARTITION BY {KEYS}, day <> 0 ORDER BY pos DESC) AS back FROM ({q.no_repeats(LSAMPLES, KEYS)})"""
    return q.text(f"SELECT * FROM ({ranked}) WHERE day = 0 OR back <= {keep}", KEYS + ", label")


@query("label_samples_from_events", recent_samples_sql(6))
def label_samples_from_events(spark, d):
    rows = st.tokens(spark, d).union(st.label_marks(spark, d))
    long = timeline.add_baseline(timeline.align_to_first_date(rows), st.patient(spark, d))
    out = sequence.label_samples_from_events(long, 6, drop_repeats=True, save=materialise)
    return shown(out, "person_id", "label_count", big("label").alias("label"))


@query("window_events", q.text(q.random_window(FIRST, L, P, "rw")))
def window_events(spark, d):
    long = timeline.add_baseline(timeline.align_to_first_date(st.tokens(spark, d)), st.patient(spark, d))
    kept = timeline.consolidate(sequence.window_events(long, L, "rw", materialise), ["person_id", "windowed"])
    return shown(sequence.settle_window(kept, P), "person_id")


@query(
    "percentile_type_ids",
    """SELECT person_id, string_agg(day || '@' || array_to_string(string_split(token, ':')[1:2], ':'), '|' ORDER BY pos) AS seq,
         string_agg(CASE WHEN len(string_split(token, ':')) > 2 THEN split_part(string_split(token, ':')[-1], '-', 2)::INT // 10 ELSE 0 END, ',' ORDER BY pos)
           AS token_type_ids FROM bseqrows GROUP BY 1""",
)
def percentile_type_ids(spark, d):
    out = sequence.percentile_type_ids(st.banded_sequences(spark, d), 10)
    return out.select("person_id", seq_text().alias("seq"), list_text("token_type_ids").alias("token_type_ids"))


@query(
    "encode_sequences",
    q.encoded_text(q.encoded("SELECT * FROM bseqrows", "bvoc", 32, step=10), types=True),
)
def encode_sequences(spark, d):
    rows = st.banded_sequences(spark, d)
    words = vocabulary(spark, d, st.banded_sequences, split=True)
    return encoded_shown(sequence.encode(rows, words, 32, percentile_step=10), "person_id")


PRE = q.age(q.trim_position(q.trim_length(q.random_window(FIRST, L, P, "pre"), L), P))


@query("pretrain_rows", q.encoded_text(q.encoded(PRE, "voc", L)))
def pretrain_rows(spark, d):
    out = plans.pretrain_rows(st.aligned(spark, d, st.tokens(spark, d)), vocabulary(spark, d), L, P, window_seed="pre")
    return encoded_shown(out, "person_id")


@query(
    "labelled_rows",
    f"""SELECT e.*, (person_id % 3)::BIGINT AS labels FROM ({q.encoded_text(q.encoded(FIRST, "voc", L))}) e""",
)
def labelled_rows(spark, d):
    people = st.patient(spark, d).select("person_id", (F.col("person_id") % 3).alias("label"))
    out = plans.labelled_rows(st.aligned(spark, d, st.tokens(spark, d)), people, vocabulary(spark, d), L)
    return encoded_shown(out, "person_id", big("labels").alias("labels"))


def multilabel_sql(src, voc, step=None):
    distinct = q.no_repeats(q.samples(src), KEYS)
    trimmed = q.trim_position(q.trim_length(distinct, L, KEYS + ", label"), P, KEYS + ", label")
    text = q.encoded_text(q.encoded(trimmed, voc, L, KEYS + ", label", step), KEYS + ", label", types=step is not None)
    return f"SELECT * EXCLUDE (label), label AS labels FROM ({text})"


@query("multilabel_rows", multilabel_sql("SELECT * FROM lseqrows", "voc"))
def multilabel_rows(spark, d):
    out = plans.multilabel_rows(st.labelled_events(spark, d), vocabulary(spark, d), L, P)
    return encoded_shown(out, "person_id", big("label_count").alias("label_count"), big("labels").alias("labels"))


def value_label_events(spark, d):
    """Diagnosis, label and lab tokens; lab tokens carry value and unit."""
    lab = st.lab(spark, d)
    token = F.concat_ws(":", F.lit("LOINC"), "lx_lab_code", "lx_result_val", "lx_result_unit")
    marked = lab.select("person_id", "date", token.alias("general_event_token"))
    rows = st.coded(spark, d, "diagnosis").union(marked).union(st.label_marks(spark, d))
    return st.aligned(spark, d, rows)


CTES["vlev"] = """
SELECT person_id, date, token, token AS new FROM dx_tok UNION ALL SELECT person_id, date, token, token FROM lab_marks
UNION ALL
SELECT l.person_id, l.date, 'LOINC:' || l.lx_lab_code || ':' || l.lx_result_val || ':' || l.lx_result_unit,
  CASE WHEN b.b IS NOT NULL AND v IS NOT NULL THEN
    'LOINC:' || l.lx_lab_code || ':' || (len(list_filter(b.b, lambda x: x <= v)) * 10) || '-' || (len(list_filter(b.b, lambda x: x <= v)) * 10 + 10) END
FROM (SELECT lab.*, TRY_CAST(lab.lx_result_val AS DOUBLE) * round(c.conversion_factor, 9) AS v FROM lab LEFT JOIN conversion c
      ON c.lx_lab_code = lab.lx_lab_code AND c.lx_result_other_unit = lab.lx_result_unit) l
LEFT JOIN bounds b ON b.lx_lab_code = l.lx_lab_code"""
CTES["vlrows"] = """
SELECT person_id, date, day, new AS token, row_number() OVER (PARTITION BY person_id ORDER BY date NULLS FIRST, day, token) - 1 AS pos FROM (
  SELECT e.person_id, e.date, date_diff('day', f, e.date) + 1 AS day, token, new FROM vlev e
  JOIN (SELECT person_id, min(date) AS f FROM vlev GROUP BY 1) USING (person_id)
  UNION ALL
  SELECT person_id, px_birth_date, 0, t, t FROM (SELECT person_id, px_birth_date, unnest(list_filter([
    'AGE:' || CAST(floor(date_diff('day', px_birth_date, f) / 365) AS BIGINT), 'ETHNICITY:' || px_ethnicity,
    'GENDER:' || px_gender, 'RACE:' || px_race, 'REGION:' || px_region], lambda x: x IS NOT NULL)) AS t
    FROM patient JOIN (SELECT person_id, min(date) AS f FROM vlev GROUP BY 1) USING (person_id))) WHERE new IS NOT NULL"""


@query("multilabel_lab_rows", multilabel_sql("SELECT * FROM vlrows", "bvoc", 10))
def multilabel_lab_rows(spark, d):
    conversions, table = labs.fit(st.lab(spark, d), *LIMITS, accuracy=st.ACCURACY, save=materialise)
    words = vocabulary(spark, d, st.banded_sequences, split=True)
    out = plans.multilabel_lab_rows(value_label_events(spark, d), words, conversions, table, L, P)
    return encoded_shown(out, "person_id", big("label_count").alias("label_count"), big("labels").alias("labels"))


@query(
    "pad_batches",
    f"""WITH e AS ({q.encoded_text(q.encoded(FIRST, "voc", L))}),
         r AS (SELECT *, (row_number() OVER (ORDER BY {st.sql_hash('pb', 'person_id')}, person_id) - 1) // 8 AS batch_id, len(string_split(input_ids, ',')) AS n FROM e),
         m AS (SELECT *, max(n) OVER (PARTITION BY batch_id) - n AS gap FROM r)
       SELECT person_id, batch_id, input_ids || repeat(',0', gap) AS input_ids, position_ids || repeat(',0', gap) AS position_ids,
         attention_mask || repeat(',0', gap) AS attention_mask FROM m""",
)
def pad_batches(spark, d):
    rows = sequence.encode(st.sequences(spark, d), vocabulary(spark, d), L)
    return encoded_shown(sequence.pad_batches(rows, 8, "pb"), "person_id", "batch_id")


def _draw(kind):
    return st.sql_uniform(f"mlm-{kind}", "person_id", "i")


@query(
    "mlm_rows",
    f"""WITH e AS ({q.encoded(FIRST, "voc", L)}),
         pool AS (SELECT list(id ORDER BY id) AS ids FROM voc WHERE token NOT LIKE '[%' AND token NOT LIKE '%]'),
         m AS (SELECT person_id, i, day, id, {_draw('pick')} < 0.15 AS chosen, {_draw('kind')} AS u, {_draw('word')} AS w FROM e),
         c AS (SELECT person_id, i, day, CASE WHEN NOT chosen THEN id WHEN u <= 0.8 THEN (SELECT max(id) FROM voc WHERE token = '[MASK]')
             WHEN u < 0.9 THEN ids[1 + floor(w * len(ids))::INT] ELSE id END AS x, CASE WHEN chosen THEN id ELSE -100 END AS y FROM m, pool)
       SELECT person_id, string_agg(x, ',' ORDER BY i) || repeat(',0', 24 - count(*)) AS input_ids, string_agg(y, ',' ORDER BY i) || repeat(',-100', 24 - count(*)) AS labels,
         string_agg(day, ',' ORDER BY i) || repeat(',0', 24 - count(*)) AS position_ids, string_agg('1', ',') || repeat(',0', 24 - count(*)) AS attention_mask
       FROM c GROUP BY 1""",
)
def mlm_rows(spark, d):
    words = vocabulary(spark, d)
    rows = sequence.encode(st.sequences(spark, d), words, L)
    return encoded_shown(sequence.mask_tokens(rows, words, 24, "mlm"), "person_id")
