"""Nested event format and metrics."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql_steps as q
from checks import standins as st
from checks.registry import CTES, big, query
from medstrand.functions import scores as sc
from medstrand.operators import meds, metrics
from medstrand.plans import rows as plans

NUMBER = r"'[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?'"


def nested_text(df, *keys):
    """``time[code=number~text;...]|...`` so that a nested history compares as one value."""
    def one(m):
        value = F.coalesce(m["numeric_value"].cast("string"), F.concat(F.lit("~"), m["text_value"]), F.lit(""))
        return F.concat(m["code"], F.lit("="), value)

    def event(e):
        when = F.coalesce(F.date_format(e["time"], "yyyy-MM-dd HH:mm:ss"), F.lit("-"))
        return F.concat(when, F.lit("["), F.array_join(F.transform(e["measurements"], one), ";"), F.lit("]"))

    return df.select(*keys, F.array_join(F.transform("events", event), "|").alias("events"))


def measured(src, keys):
    return f"""SELECT {keys}, d, code, val, min(pos) AS pos, min(first) AS first FROM (
  SELECT {keys}, CAST(date AS DATE) AS d, split_part(token, ':', 1) AS code, pos, min(date) OVER (PARTITION BY {keys}, CAST(date AS DATE)) AS first, token,
    CASE WHEN strpos(token, ':') = 0 THEN '' WHEN regexp_full_match(substr(token, strpos(token, ':') + 1), {NUMBER})
      THEN CAST(CAST(substr(token, strpos(token, ':') + 1) AS DOUBLE) AS VARCHAR) ELSE '~' || substr(token, strpos(token, ':') + 1) END AS val
  FROM ({src})) GROUP BY {keys}, d, code, val, token"""


def nested_sql(items, keys):
    """``items`` has keys, first (time), pos, code, val."""
    return f"""SELECT {keys}, string_agg(strftime(first, '%Y-%m-%d %H:%M:%S') || '[' || m || ']', '|' ORDER BY first) AS events FROM (
  SELECT {keys}, first, string_agg(code || '=' || val, ';' ORDER BY pos) AS m FROM ({items}) GROUP BY ALL) GROUP BY ALL"""


def trimmed(items, keys, k):
    """No sequence here has a birth code: demographics and the latest others stay, demographics first at equal times."""
    return f"""SELECT * EXCLUDE (pos), CASE WHEN demo THEN pos ELSE pos + 1000000000 END AS pos FROM (SELECT *, regexp_matches(lower(code), 'gender|ethnicity|race|region') AS demo,
    count(*) FILTER (WHERE regexp_matches(lower(code), 'gender|ethnicity|race|region')) OVER (PARTITION BY {keys}) AS nd,
    row_number() OVER (PARTITION BY {keys}, regexp_matches(lower(code), 'gender|ethnicity|race|region') ORDER BY pos DESC) AS back FROM ({items}))
  WHERE demo OR back <= greatest({k - 1} - nd, 0)"""


ITEMS = measured("SELECT * FROM seqrows", "person_id")


@query("meds_events", nested_sql(ITEMS, "person_id"))
def meds_events(spark, d):
    return nested_text(meds.to_meds(st.sequences(spark, d)), "person_id")


@query("meds_trim", nested_sql(trimmed(ITEMS, "person_id", 12), "person_id"))
def meds_trim(spark, d):
    return nested_text(meds.trim_meds(meds.to_meds(st.sequences(spark, d)), 12), "person_id")


SAMPLE_KEYS = "person_id, label_count, label"
SAMPLE_ITEMS = measured(q.samples("SELECT * FROM lseqrows"), SAMPLE_KEYS)


@query("meds_label_samples", nested_sql(trimmed(SAMPLE_ITEMS, SAMPLE_KEYS, 12), SAMPLE_KEYS))
def meds_label_samples(spark, d):
    out = plans.meds_samples(st.labelled_events(spark, d), 12)
    return nested_text(out, "person_id", big("label_count").alias("label_count"), big("label").alias("label"))


@query(
    "softmax_argmax",
    """SELECT person_id, label, prediction::BIGINT AS prediction, round(prob[1], 9) AS p0, round(list_sum(prob), 6) AS total FROM scored""",
)
def softmax_argmax(spark, d):
    out = metrics.score_rows(st.predictions(spark, d))
    return out.select(
        "person_id", "label", big("prediction").alias("prediction"), F.round(F.col("probabilities")[0], 9).alias("p0"),
        F.round(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query(
    "roc_auc_ovr",
    """WITH x AS (SELECT label, unnest(range(10)) AS class, unnest(prob) AS score FROM scored),
         y AS (SELECT class, score, (label = class)::INT AS pos FROM x WHERE class IN (SELECT label FROM preds)),
         r AS (SELECT class, pos, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS rk FROM y),
         a AS (SELECT class, (sum(rk) FILTER (WHERE pos = 1) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (count(*) - sum(pos))) AS auc FROM r GROUP BY 1)
       SELECT 'eval_roc_auc_' || class || '_vs_rest' AS metric, round(auc, 6) AS value FROM a
       UNION ALL SELECT 'eval_roc_auc_average', round(avg(auc), 6) FROM a""",
)
def roc_auc_ovr(spark, d):
    auc = metrics.roc_auc(metrics.score_rows(st.predictions(spark, d)))
    return metrics.roc_report(auc).withColumn("value", F.round("value", 6))


@query(
    "classification_report",
    """WITH c AS (SELECT DISTINCT label AS class FROM preds UNION SELECT DISTINCT prediction FROM scored),
         s AS (SELECT class, (SELECT count(*) FROM scored WHERE label = class) AS support, (SELECT count(*) FROM scored WHERE prediction = class) AS predicted,
                 (SELECT count(*) FROM scored WHERE prediction = class AND label = class) AS hits FROM c),
         m AS (SELECT class, support, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS p, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r,
                 CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END AS f FROM s),
         o AS (SELECT class::VARCHAR AS name, p, r, f, support::DOUBLE AS support FROM m
               UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM m
               UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM m)
       SELECT 'eval_' || name || '_' || k AS metric, round(v, 9) AS value FROM (
         SELECT name, unnest(['precision', 'recall', 'f1-score', 'support']) AS k, unnest([p, r, f, support]) AS v FROM o)
       UNION ALL SELECT 'eval_accuracy', round(avg((label = prediction)::INT), 9) FROM scored""",
)
def classification_report(spark, d):
    out = metrics.classification_report(metrics.score_rows(st.predictions(spark, d)))
    return out.withColumn("value", F.round("value", 9))


CTES["worddocs"] = r"""
SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '') AS w FROM documents"""


@query(
    "masked_accuracy",
    """WITH x AS (SELECT len(w) AS a, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM worddocs),
         y AS (SELECT CASE WHEN i % 4 = 0 THEN -100 ELSE len(t) % 5 END AS l, (len(t) + i) % 5 AS p FROM x)
       SELECT count(*) AS n, count(*) FILTER (WHERE l = p) AS hits, round(count(*) FILTER (WHERE l = p) / count(*), 9) AS accuracy FROM y WHERE l > -50""",
)
def masked_accuracy(spark, d):
    docs = st.documents(spark, d).select(
        F.transform("sorted_event_tokens", lambda t, i: F.when((i + 1) % 4 == 0, -100).otherwise(F.length(t) % 5)).alias("labels"),
        F.transform("sorted_event_tokens", lambda t, i: (F.length(t) + i + 1) % 5).alias("predictions"),
    )
    return metrics.masked_accuracy(docs).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "best_run",
    " UNION ALL ".join(
        f"SELECT {i} AS run, avg((label = list_position(embedding[{8 * i + 1}:{8 * i + 8}], list_max(embedding[{8 * i + 1}:{8 * i + 8}])) - 1)::INT) AS accuracy FROM embeddings"
        for i in range(8)
    ).join(["WITH runs AS (", ") SELECT 'run_' || run AS config, round(accuracy, 9) AS accuracy FROM runs ORDER BY accuracy DESC, run LIMIT 1"]),
)
def best_run(spark, d):
    rows = st.table(spark, d, "embeddings")
    runs = reduce(
        DataFrame.union,
        [
            rows.select(
                F.lit(i).alias("run"),
                (F.col("label") == sc.argmax(F.slice("embedding", 8 * i + 1, 8))).cast("int").alias("hit"),
            )
            for i in range(8)
        ],
    )
    table = runs.groupBy("run").agg(F.avg("hit").alias("accuracy"))
    table = table.withColumn("config", F.concat(F.lit("run_"), F.col("run").cast("string")))
    return metrics.best_run(table, "config", "accuracy", "run").withColumn("accuracy", F.round("accuracy", 9))
