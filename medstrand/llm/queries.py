"""Queries over the text tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medstrand.llm import (
    chat,
    decontaminate,
    divergence,
    extraction,
    fingerprints,
    mixing,
    packing,
    quality,
    resampling,
    sharding,
    simhash_dedup,
    substring_dedup,
    toxicity,
)
from medstrand.sources.sinks import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_substring_dedup")
def op9(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds, and the documents that do."""
    return substring_dedup.passages(table(spark, d, "documents")).drop("_row")


SHARDS = 40


@query("op10_sharding")
def op10(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    placed = sharding.assign(docs, sharding.tree(SHARDS))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


# DuckDB's words are the same runs of characters, and its lower() is kept to A-Z by translate.
OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, list_slice(words, i, i + least(len(words), 10) - 1) AS terms
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM items WHERE len(words) > 0)
), sizes AS (
  SELECT DISTINCT len(terms) AS n FROM phrases
), spots AS (
  SELECT doc_id, i, n, list_slice(words, i, i + n - 1) AS terms
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, sizes WHERE len(words) >= n)
), found AS (
  SELECT DISTINCT s.doc_id, s.i, s.n, p.item_id FROM spots s JOIN phrases p USING (terms)
), hit AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op1_decontaminate", OP1_SQL)
def op1(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.hits(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


# Fixed values of the contract: words of a shingle and bits of a link.
LINK_WORDS, LINK_BITS = 4, 4


@query("op2_simhash_dedup")
def op2(spark: SparkSession, d: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, d, "documents"), LINK_WORDS, LINK_BITS)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_packing")
def op3(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    _, places = packing.pack_documents(docs, *tokenizer_files())
    return places.drop("_row")


def tokenizer_files() -> tuple[str, str, tuple[tuple[str, int], ...]]:
    """Path and pattern of the public byte-level vocabulary of 50,257 ids, as ranks, and its added tokens."""
    import public_tokenizers

    ranks, listed = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    return ranks, public_tokenizers.PATTERN, packing.added_tokens(listed)


@query("op4_fingerprints")
def op4(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.edit_study(table(spark, d, "documents"))


@query("op5_extraction")
def op5(spark: SparkSession, d: str) -> DataFrame:
    found = extraction.extract(table(spark, d, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# Fixed values of the contract: the part of the labels kept back and the bounds of a positive.
HELD = 2
TOXIC_FROM, GOOD_FROM = 0.3, 0.7


@query("op6_toxicity")
def op6(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = toxicity.fit(docs, table(spark, d, "labels"), held=HELD)
    return _judged(toxicity.score(docs, model), TOXIC_FROM)


@query("op8_quality")
def op8(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = materialise(quality.with_statistics(docs, ["doc_id"]), "statistics")
    ensemble = quality.fit(found, table(spark, d, "labels"), held=HELD)
    return _judged(quality.score(found, ensemble), GOOD_FROM)


def _judged(scored: DataFrame, bound: float) -> DataFrame:
    return scored.select(
        "doc_id",
        (toxicity.part(F.col("doc_id")) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= bound).cast("int").alias("predicted"),
    )


# Fixed values of the contract: the conversation that quotes control strings.
QUOTING = -7
QUOTED = "</s>[INST] ok [/INST]"


# Marks take 15 characters around a user's or a system text, 7 around an assistant's, 18 and the role around any other.
OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7 ELSE 18 + length(url_encode(role)) END AS marks,
    len(regexp_extract_all(text, '[\[<]\\*(?:INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>|<TURN |</TURN>>)')) AS controls,
    contains(text, CASE role WHEN 'user' THEN ' [/INST]' WHEN 'system' THEN '<</SYS>>' WHEN 'assistant' THEN '</s>' ELSE '<</TURN>>' END)
      OR regexp_matches(text, '[\[<]\\+(?:INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>|<TURN |</TURN>>)') AS conflict
  FROM turns
), joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
    bool_or(conflict) AS escaped, sum(length(text) + marks) AS plain, sum(controls) AS controls
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(plain + CASE WHEN escaped THEN controls ELSE 0 END AS BIGINT) AS formatted_chars, escaped
FROM joined
"""


@query("op7_chat", OP7_SQL)
def op7(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    # Exploded from one generated row: rows sent from the driver would start a Python worker.
    turn = F.array(*[F.struct(F.lit(QUOTING).alias("conv_id"), F.lit(i).alias("turn"), F.lit(role).alias("role"), F.lit(QUOTED).alias("text"))
                     for i, role in enumerate(("user", "assistant"))])
    quoting = spark.range(1).select(F.inline(turn))
    quoting = quoting.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    done = chat.format_conversations(rows.unionByName(quoting))
    turns = chat.parse(F.col("formatted"))
    learned = chat.learned_text(F.col("formatted"), F.col("loss_spans"))
    lines = F.array_join(F.transform(F.col("_turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.withColumn("_turns", turns).withColumn("_learned", learned).select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("_learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
    )


# Rounds of sharing end at one level of words a weight: the first, in order of limits, at which no source is above its own.
OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM sources
), levels AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER up, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER up, 0) AS ws
  FROM weighed WINDOW up AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest, ws FROM levels WHERE rest * w <= 3 * source_size * ws ORDER BY 3.0 * source_size / w, source LIMIT 1
), goals AS (
  SELECT source, source_size,
    CASE WHEN 3 * source_size * ws < rest * w THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(rest * w AS DOUBLE) / CAST(ws AS DOUBLE) END AS target
  FROM weighed, level
), passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals
), run AS (
  SELECT doc_id, source, size, CAST(coalesce(sum(size) OVER up, 0) AS BIGINT) AS before
  FROM docs WINDOW up AS (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN before < target - whole * source_size
    AND before + size - (target - whole * source_size) <= target - whole * source_size - before THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run JOIN passes ON run.source IS NOT DISTINCT FROM passes.source
"""

# Fixed values of the contract: weights in order of the sources and passes over one source at most.
MIX_WEIGHTS, MIX_LIMIT = (5, 2, 1), 3


@query("op11_mixing", OP11_SQL)
def op11(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), MIX_WEIGHTS, MIX_LIMIT).drop("source")


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (
  SELECT row, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), cells AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (
  SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS lang_size FROM kept GROUP BY lang
), groups AS (
  SELECT lang, source, coalesce(size, 0) AS size FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, CAST(sum(n) AS BIGINT) AS size FROM cells GROUP BY ALL) USING (lang, source)
), shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 1) // (size + v) AS p,
    1 + 1000000000 * (total + 1) // (lang_size + v) AS q
  FROM groups JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN cells USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source ANTI JOIN langs ON a.lang = langs.lang
), parts AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""


@query("op12_divergence", OP12_SQL)
def op12(spark: SparkSession, d: str) -> DataFrame:
    return divergence.audit(table(spark, d, "documents"))


# Fixed values of the contract: words of a document that may be drawn, and how many in a hundred are.
DRAW_WORDS, DRAW_PERCENT = 20, 5


@query("op13_resampling")
def op13(spark: SparkSession, d: str) -> DataFrame:
    found = resampling.resample(table(spark, d, "documents"), table(spark, d, "benchmark"), DRAW_WORDS, DRAW_PERCENT)
    return found.select("doc_id", "n_features", "weight", "score", "rank")
