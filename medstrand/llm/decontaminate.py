"""Benchmark decontamination with a positional inverted index of the training texts.

The benchmark gives phrases: every run of ``size`` words of an item, or the whole of a shorter one.
A first pass over the corpus counts the terms that occur in phrases. Each phrase then has a rarest
term and a second rarest; a phrase with a term the corpus lacks cannot occur. The second pass makes
the index: where a rarest term stands and the second rarest stands at its offset from it, a posting
is stored with the term, the position and the terms around it. Joining postings with phrases on the
rarest term and comparing the terms around leaves the occurrences, word by word.

Which terms and pairs are wanted is told to the tasks by bit tables of FILTER_BITS bits, whatever
the benchmark's size; a wrongly set bit costs a posting and no more, since the join decides. Terms
are 64-bit hashes of lower-cased words.

Nulls: a null text has no words, a null item id counts as an empty one, a null document id is
carried along. Repeated documents get a row each, repeated items count once. With an empty
benchmark no word is hit; an empty corpus gives no rows. Other columns are left out by ``hits`` and
kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medstrand.llm import text as tx
from medstrand.sources.sinks import materialise

SIZE = 10
FILTER_BITS = 1 << 22
_SHIFT = 64 - 22

PHRASES = "item_id string, terms binary"
INDEX = "_row long, doc_id long, n_words long, postings array<struct<term: long, pos: long, around: binary>>"


def phrases(items: DataFrame, size: int = SIZE, key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct phrases of each item: ``item_id`` and ``terms``, the words' hashes of 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            owner, terms = [], []
            for row, _, words in tx.words(batch.column(1), tx.WORD_BYTES):
                for i, n in enumerate(words.count.tolist()):
                    first = words.first[i]
                    for at in range(n - min(n, size) + 1 if n else 0):
                        owner.append(ids[row + i])
                        terms.append(words.hash[first + at : first + min(n, at + size)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.string()), pa.array(terms, pa.binary())], ["item_id", "terms"])

    named = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item_id"), text)
    return named.mapInArrow(run, PHRASES).distinct()


def bit_table(hashes: DataFrame, column: str) -> np.ndarray:
    """FILTER_BITS bits as booleans, set for the values' highest bits; the driver gets one number per 64 bits at most."""
    slot = F.shiftrightunsigned(F.col(column), _SHIFT)
    words = hashes.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot % 64 as int))")).alias("_bits")).collect()
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for row in rows:
        out[row["_word"]] = np.uint64(row["_bits"] & (1 << 64) - 1)
    return np.packbits(np.unpackbits(out.view(np.uint8), bitorder="little"))


def _holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return table[(hashes >> np.uint64(_SHIFT)).astype(np.int64)]


def term_counts(docs: DataFrame, table: np.ndarray, text: str = "text") -> DataFrame:
    """``term`` and ``count`` over the whole corpus for all terms the bit table holds."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            for _, _, words in tx.words(batch.column(0), tx.WORD_BYTES):
                terms, counts = np.unique(words.hash[_holds(wanted, words.hash)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], ["term", "count"])

    return docs.select(text).mapInArrow(run, "term long, count long").groupBy("term").agg(F.sum("count").alias("count"))


def _pair(anchor: np.ndarray, partner: np.ndarray, step: int) -> np.ndarray:
    return tx.mix(anchor * np.uint64(0x9E3779B97F4A7C15) + partner + np.uint64(step + (1 << 32)))


ANCHORED = "item_id string, terms binary, n long, offset long, term long, pair long"


def anchored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Phrases with their rarest ``term``, its ``offset``, and a number for it and the second rarest.

    Phrases of which a term never occurs are left out.
    """

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_pylist()
            listed = [np.frombuffer(x, dtype=np.int64).tolist() for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(listed, pa.list_(pa.int64()))], ["terms", "listed"]
            )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, partner = (batch.column(i).to_numpy().view(np.uint64) for i in (4, 5))
            step = batch.column(6).to_numpy().tolist()
            made = [_pair(a[None], b[None], s)[0] for a, b, s in zip(term, partner, step, strict=True)]
            pair = pa.array(np.array(made, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + [pair], [c.split()[0] for c in ANCHORED.split(", ")])

    unique = found.select("terms").distinct().mapInArrow(terms, "terms binary, listed array<long>")
    placed = unique.select("terms", F.posexplode("listed").alias("offset", "term"))
    ranked = (
        placed.join(counts, "term", "left")
        .groupBy("terms")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "term", "offset"))).alias("_by"))
        .filter(F.col("_by")[0]["count"] > 0)
    )
    rarest = F.col("_by")[0]
    second = F.coalesce(F.get("_by", F.lit(1)), rarest)
    chosen = ranked.select(
        "terms",
        F.size("_by").cast("long").alias("n"),
        rarest["offset"].cast("long").alias("offset"),
        rarest["term"].alias("term"),
        second["term"].alias("_partner"),
        (second["offset"] - rarest["offset"]).cast("long").alias("_step"),
    )
    full = found.join(chosen, "terms").select("item_id", "terms", "n", "offset", "term", "_partner", "_step")
    return full.mapInArrow(pairs, ANCHORED)


def index(docs: DataFrame, anchors: np.ndarray, pairs: np.ndarray, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``_row``, ``doc_id``, ``n_words`` and the ``postings`` of its wanted pairs.

    ``around`` holds the hashes of the ``size - 1`` words before and after, zero beyond the text.
    """
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((anchors, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, paired = (np.unpackbits(x).astype(bool) for x in sent.value)
        reach = np.arange(1 - size, size)
        for batch in batches:
            for row, stop, words in tx.words(batch.column(2), tx.WORD_BYTES):
                hashes = words.hash
                at = np.flatnonzero(_holds(wanted, hashes))
                near = at[:, None] + reach
                owner = words.text[at]
                inside = (near >= words.first[owner][:, None]) & (near < words.first[owner + 1][:, None])
                around = np.where(inside, hashes[np.clip(near, 0, max(len(hashes) - 1, 0))], np.uint64(0)) if len(at) else near.astype(np.uint64)
                keep = np.zeros(len(at), dtype=bool)
                for i, step in enumerate(reach.tolist()):
                    keep |= inside[:, i] & _holds(paired, _pair(hashes[at], around[:, i], step))
                at, around, owner = at[keep], np.ascontiguousarray(around[keep]), owner[keep]
                width = 8 * len(reach)
                offsets = np.arange(len(at) + 1, dtype=np.int32) * width
                texts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(around.tobytes())])
                postings = pa.StructArray.from_arrays(
                    [pa.array(hashes[at].view(np.int64)), pa.array(words.place[at].astype(np.int64)), texts], ["term", "pos", "around"]
                )
                bounds = np.searchsorted(owner, np.arange(stop - row + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, stop - row),
                        batch.column(1).slice(row, stop - row),
                        pa.array(words.count.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds), postings),
                    ],
                    ["_row", "doc_id", "n_words", "postings"],
                )

    wanted = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).cast("long").alias("doc_id"), text)
    return wanted.mapInArrow(run, INDEX)


def occurrences(stored: DataFrame, found: DataFrame, size: int = SIZE) -> DataFrame:
    """``_row``, ``item_id``, ``start`` and ``n`` of every place where a phrase stands word by word."""
    postings = stored.select("_row", F.explode("postings").alias("_p")).select("_row", "_p.*")
    skip = F.lit(size - 1) - F.col("offset")
    same = F.expr("substring(around, cast(8 * _skip as int) + 1, cast(8 * n as int))") == F.col("terms")
    return (
        postings.join(found, "term")
        .withColumn("_skip", skip)
        .filter(same)
        .select("_row", "item_id", (F.col("pos") - F.col("offset")).alias("start"), "n")
    )


def build(docs: DataFrame, items: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """The stored index of ``docs`` for the phrases of ``items``, and those phrases with their anchors."""
    found = materialise(phrases(items, size), "phrases")
    listed = found.mapInArrow(_listed, "term long").distinct()
    counts = materialise(term_counts(docs, bit_table(listed, "term")), "term-counts")
    chosen = materialise(anchored(found, counts), "anchors")
    stored = materialise(index(docs, bit_table(chosen, "term"), bit_table(chosen, "pair"), size), "postings")
    return stored, chosen


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(terms))], ["term"])


def hits(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit`` (words in some occurrence), and ``items`` (sorted ids) of every document."""
    stored, chosen = build(docs, items, size)
    places = materialise(occurrences(stored, chosen, size), "occurrences")
    before = Window.partitionBy("_row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    covered = (
        places.select("_row", "start", "n")
        .distinct()
        .withColumn("_reached", F.coalesce(F.max(end).over(before), F.lit(0)))
        .groupBy("_row")
        .agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "_reached"))).alias("n_hit"))
    )
    named = places.select("_row", "item_id").distinct().groupBy("_row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    return (
        stored.select("_row", "doc_id", "n_words")
        .join(covered.join(named, "_row"), "_row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, share: float = 0.0, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` without a hit, or with at most ``share`` of their words hit.

    Rows are told apart by ``key`` and a checksum of their text, so a null or repeated key is safe.
    """
    own = F.md5(F.coalesce(F.col("text"), F.lit("")))
    marked = docs.withColumn("__own", own)
    narrow = marked.select(F.xxhash64(F.col(key), F.col("__own")).alias("doc_id"), "text")
    bad = hits(narrow, items, size).filter(F.col("n_hit") > F.lit(share) * F.col("n_words"))
    # Stored: its size then tells the planner whether it can be broadcast.
    bad = materialise(bad.select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    here = F.xxhash64(F.col(key), F.col("__own")) == F.col("__bad")
    return marked.join(bad, here, "left_anti").drop("__own")


def proximity(docs: DataFrame, items: DataFrame, size: int = SIZE, slack: int = 5) -> DataFrame:
    """``_row``, ``doc_id``, ``item_id``, ``start`` and ``span`` of places near a phrase.

    All of a phrase's distinct terms stand, in any order, within ``size + slack`` words around its
    rarest term. Postings keep that many words around; no pair is asked for, as order is free.
    """
    found = materialise(phrases(items, size), "phrases")
    listed = found.mapInArrow(_listed, "term long").distinct()
    counts = materialise(term_counts(docs, bit_table(listed, "term")), "term-counts")
    chosen = materialise(anchored(found, counts), "anchors")
    wide = size + slack
    every = np.full(FILTER_BITS // 8, 255, dtype=np.uint8)
    stored = materialise(index(docs, bit_table(chosen, "term"), every, wide), "postings")
    near = stored.select("_row", "doc_id", F.explode("postings").alias("_p")).select("_row", "doc_id", "_p.*")
    paired = near.join(chosen.select("item_id", "terms", "term"), "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, doc, pos, around, item, terms in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                words = np.frombuffer(around, dtype=np.uint64)
                wanted = set(np.frombuffer(terms, dtype=np.uint64).tolist())
                places = [(i, w) for i, w in enumerate(words.tolist()) if w in wanted]
                have: dict[int, int] = {}
                best = None
                for i, w in places:  # the last place of each term so far
                    have[w] = i
                    if len(have) == len(wanted):
                        start = min(have.values())
                        if i - start < wide and (best is None or i - start < best[1]):
                            best = (start, i - start)
                if best is not None:
                    out.append((row, doc, item, pos + best[0] - (wide - 1), best[1] + 1))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["_row", "doc_id", "item_id", "start", "span"]
            )

    columns = ["_row", "doc_id", "pos", "around", "item_id", "terms"]
    return paired.select(*columns).mapInArrow(run, "_row long, doc_id long, item_id string, start long, span long").distinct()
