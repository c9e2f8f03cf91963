"""Histories in blocks: layout, trims, windows and the nested export."""

from pyspark.sql import functions as F

from checks import q_pipelines as pl
from checks import sql_steps as q
from checks import standins as st
from checks.q_meds import ITEMS, nested_text
from checks.registry import big, query, seq_text
from medstrand.operators import blocks as bl
from medstrand.operators import sequence
from medstrand.plans.base import prepare
from medstrand.sources.sinks import materialise

SIZE, L, P = 16, 20, 1825
FIRST = "SELECT * FROM seqrows"


def blocks_sql(src, size):
    """Rows ``person_id, date, day, token, pos`` as blocks, with what each block knows."""
    return f"""SELECT person_id, pos // {size} AS block, min(pos) AS first, min(seen) AS events_before, count(*) FILTER (WHERE day <> 0) AS events,
  any_value(total) AS total, any_value(events_total) AS events_total, any_value(last_day) AS last_day, string_agg(day || '@' || token, '|' ORDER BY pos) AS seq
FROM (SELECT *, count(*) FILTER (WHERE day <> 0) OVER (PARTITION BY person_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
  count(*) OVER p AS total, count(*) FILTER (WHERE day <> 0) OVER p AS events_total, max(day) OVER p AS last_day
  FROM ({src}) WINDOW p AS (PARTITION BY person_id)) GROUP BY person_id, pos // {size}"""


BLOCK_COLUMNS = ["block", "first", "events_before", "events", "total", "events_total", "last_day"]


def shown(blocks):
    return blocks.select("person_id", *[big(c).alias(c) for c in BLOCK_COLUMNS], seq_text().alias("seq"))


def blocks_of(spark, d):
    return bl.build_blocks(st.tokens(spark, d), st.patient(spark, d), size=SIZE)


@query("person_blocks", blocks_sql(FIRST, SIZE))
def person_blocks(spark, d):
    return shown(blocks_of(spark, d))


FULL = """SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY date NULLS FIRST, day, token) - 1 AS pos FROM (
  SELECT person_id, date, day, token FROM full_unique UNION ALL
  SELECT person_id, date, day, token FROM full_base WHERE person_id IN (SELECT person_id FROM full_unique))"""


@query("person_blocks_full", blocks_sql(FULL, 64))
def person_blocks_full(spark, d):
    return shown(prepare(pl.CONFIG, pl.tables(spark, d), accuracy=st.ACCURACY).blocks(64))


@query("trim_length_blocks", q.text(q.trim_length(FIRST, L)))
def trim_length_blocks(spark, d):
    return bl.trim_length(materialise(blocks_of(spark, d), "blocks"), L).select("person_id", seq_text().alias("seq"))


@query("random_window_blocks", q.text(q.random_window(FIRST, L, P, "rw")))
def random_window_blocks(spark, d):
    out = bl.random_window(materialise(blocks_of(spark, d), "blocks"), L, P, "rw")
    return out.select("person_id", seq_text().alias("seq"))


@query("trim_position_blocks", q.text(q.trim_position(FIRST, P)))
def trim_position_blocks(spark, d):
    out = bl.one_row(bl.trim_position(blocks_of(spark, d), P))
    return sequence.baseline_first(out).select("person_id", seq_text().alias("seq"))


@query(
    "meds_blocks",
    f"""SELECT person_id, block, block * {SIZE} AS first, continued, string_agg(strftime(first, '%Y-%m-%d %H:%M:%S') || '[' || m || ']', '|' ORDER BY first) AS events
FROM (SELECT person_id, block, first, bool_or(later) OVER (PARTITION BY person_id, block) AS continued, m FROM (
  SELECT person_id, block, first, bool_or(place = block * {SIZE} AND place > start) AS later, string_agg(code || '=' || val, ';' ORDER BY place) AS m FROM (
    SELECT *, place // {SIZE} AS block, min(place) OVER (PARTITION BY person_id, d) AS start FROM (
      SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY pos) - 1 AS place FROM ({ITEMS}))) GROUP BY person_id, block, first)) GROUP BY person_id, block, continued""",
)
def meds_blocks(spark, d):
    numbered = bl.numbered_events(st.tokens(spark, d), st.patient(spark, d))
    out = nested_text(bl.meds_blocks(numbered, SIZE), "person_id", "block", "first", F.col("continued"))
    return out.withColumn("block", big("block")).withColumn("first", big("first"))
