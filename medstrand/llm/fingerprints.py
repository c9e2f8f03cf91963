"""SimHash document fingerprints and their search by permuted block tables.

Terms are runs of three words (all words of a shorter text), lower-cased over ASCII, and weigh
``1 + ln(count)``. Each term's hash votes with its weight on every bit, for it where the bit is
set and against it elsewhere; a bit of the fingerprint is set where the vote is positive. Two
fingerprints at ``h`` of ``bits`` differing bits stand at an angle of ``pi * h / bits``, whose cosine,
not below 0, is their likeness.

``pairs_within`` finds all pairs at ``radius`` or fewer bits: the bits are cut into ``blocks`` and a
table is kept for each choice of ``blocks - radius`` blocks, which two such fingerprints must share
for one choice at least.

Nulls: a null text is empty. A text without words has the fingerprint zero. Repeated rows are
fingerprinted each. An empty table gives no rows. Columns not named are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medstrand.llm import text as tx

BITS = 128
TERM_WORDS = 3
# Ranges of neighbouring keys that a task walks in order, at least; twice the shuffle partitions if those are more.
RANGES = 256


def _votes(terms: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints, ``n`` rows of BITS / 64 words, of terms each with the number of its text."""
    order = np.lexsort((terms, owner))
    terms, owner = terms[order], owner[order]
    new = np.ones(len(terms), dtype=bool)
    new[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(terms)))
    terms, owner = terms[at], owner[at]
    # Whole numbers, so that sums do not depend on their order.
    weight = np.rint(16 * (1 + np.log(count))).astype(np.float32)
    out = np.zeros((n, BITS // 64), dtype=np.uint64)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for word in range(BITS // 64):
        value = tx.mix(terms + np.uint64((word + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for i in range(n):
            a, b = bounds[i], bounds[i + 1]
            if a == b:
                continue
            total = np.zeros(64)
            for c in range(a, b, 65_536):
                d = min(b, c + 65_536)
                bits = np.unpackbits(value[c:d].astype(">u8").view(np.uint8)).reshape(-1, 64)
                total += weight[c:d] @ bits
            set_bits = np.packbits(2 * total > weight[a:b].sum(dtype=np.float64))
            out[i, word] = set_bits.view(">u8")[0]
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Fingerprint words of each text of an Arrow array."""
    parts = [np.empty((0, BITS // 64), dtype=np.uint64)]
    for _, _, words in tx.words(texts, tx.WORD_BYTES):
        terms, first = tx.windows(words, TERM_WORDS)
        parts.append(_votes(terms, words.text[first] if len(first) else first, len(words.count)))
    return np.concatenate(parts)


def as_hex(prints: np.ndarray) -> list[str]:
    raw = prints.astype(">u8").tobytes().hex()
    width = BITS // 4
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = np.bitwise_count(a ^ b).sum(axis=1)
    return np.maximum(0.0, np.cos(np.pi * apart / BITS))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fingerprint`` (hexadecimal) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = as_hex(fingerprints(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], [key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint string")


def _edited(texts: list[str], following: list[str]) -> list[str]:
    out = []
    for own, other in zip(texts, following, strict=True):
        cut = len(own) // 3
        out.append(own[: len(own) - cut] + other[:cut])
    return out


def with_next(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows in ranges of ``key``, each range with a copy of the row that follows its last one.

    Adds ``_range`` and ``_copy``. The order is descending by ``key`` (nulls last, equal keys by their
    text); after the last row comes the first. Range bounds come from the keys alone; only the first
    row of each range is sent twice.
    """
    n = docs.select(F.count(key)).first()[0]
    if n:
        ranges = max(RANGES, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        steps = [i / ranges for i in range(1, ranges)]
        found = docs.select(F.percentile_approx(key, steps, 10_000)).first()[0]
        bounds = sorted(set(found), reverse=True)
    else:
        bounds = []
    # Range 0 holds the largest keys; a null key comes after all others.
    place = F.size(F.filter(F.lit(bounds), lambda b: b >= F.col(key))) if bounds else F.lit(0)
    ranged = docs.withColumn("_range", F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(place))
    top = ranged.groupBy("_range").agg(F.max(key).alias("_top"))
    tops = sorted(top.collect())  # one row a range
    if not tops:
        return ranged.withColumn("_copy", F.lit(False))
    before = {tops[i]["_range"]: tops[i - 1]["_range"] for i in range(len(tops))}
    # Rows of a range's largest key; the first of them in order goes to the range before as well.
    leaders = F.create_map(*[F.lit(x) for r in tops for x in (r["_range"], r["_top"])])
    target = F.create_map(*[F.lit(x) for a, b in before.items() for x in (a, b)])
    leading = ranged.filter(F.col(key).eqNullSafe(F.element_at(leaders, F.col("_range"))))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("text")))
    copies = (
        leading.withColumn("_rank", rank)
        .filter("_rank = 1")
        .drop("_rank")
        .withColumn("_range", F.element_at(target, F.col("_range")))
    )
    return ranged.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True)))


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edit_study(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text ends in the beginning of the next document's text. One shuffle of the texts, by
    range of ``doc_id``; a task walks its rows in order and holds two batches.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the row whose next one is still to come

        def results(rows: list[tuple]) -> pa.RecordBatch | None:
            """Of all rows but the last, which waits; copies only follow."""
            ready = [
                (own, other)
                for own, other in zip(rows, rows[1:], strict=False)
                if not own[2] and own[0] == other[0]
            ]
            if not ready:
                return None
            edited = _edited([own[3] for own, _ in ready], [other[3] for _, other in ready])
            prints = fingerprints(pa.array([row[3] for row in rows], pa.large_string()))
            changed = fingerprints(pa.array(edited, pa.large_string()))
            at = [i for i in range(len(rows) - 1) if not rows[i][2] and rows[i][0] == rows[i + 1][0]]
            own, other = prints[at], prints[[i + 1 for i in at]]
            columns = [
                pa.array([row[1] for row, _ in ready], pa.int64()),
                pa.array([len(row[3]) for row, _ in ready], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]),
                pa.array(as_hex(own)),
                pa.array(as_hex(changed)),
                pa.array(likeness(own, changed)),
                pa.array(likeness(own, other)),
            ]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in EDITED.split(", ")])

        for batch in batches:
            size = 0
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append((*row[:3], row[3] or ""))
                size += len(held[-1][3])
                if size > tx.SLICE_BYTES:
                    made = results(held)
                    held, size = held[-1:], 0
                    if made is not None:
                        yield made
        made = results(held)
        if made is not None:
            yield made

    wanted = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    columns = ["_range", "doc_id", "_copy", "text"]
    order = ["_range", "_copy", F.col("doc_id").desc_nulls_last(), F.col("text")]
    return wanted.select(*columns).repartition("_range").sortWithinPartitions(*order).mapInArrow(run, EDITED)


def pairs_within(prints: DataFrame, radius: int, blocks: int, key: str = "doc_id") -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints at ``radius`` or fewer bits, with ``apart``.

    ``prints`` holds ``fingerprint``; rows with equal fingerprints are one member, of which the
    smallest ``key`` speaks. Each table's key is its blocks' bits, as text.
    """
    if not radius < blocks <= BITS // 4:
        raise ValueError("there must be more blocks than differing bits, of four bits at least")
    digits = BITS // 4
    edges = [digits * i // blocks for i in range(blocks + 1)]
    members = prints.groupBy("fingerprint").agg(F.min(key).alias(key))

    def table_key(number: int, chosen: tuple[int, ...]) -> Column:
        parts = [F.substring("fingerprint", edges[b] + 1, edges[b + 1] - edges[b]) for b in chosen]
        return F.concat_ws("/", F.lit(number), *parts)

    keys = [table_key(i, c) for i, c in enumerate(combinations(range(blocks), blocks - radius))]
    tables = members.withColumn("_key", F.explode(F.array(*keys)))
    left = tables.select("_key", F.col("fingerprint").alias("a"), F.col(key).alias("a_key"))
    right = tables.select("_key", F.col("fingerprint").alias("b"), F.col(key).alias("b_key"))
    words = [
        F.bit_count(
            F.conv(F.substring("a", i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("b", i, 8), 16, 10).cast("long"))
        )
        for i in range(1, digits + 1, 8)
    ]
    apart = sum(words[1:], words[0])
    return (
        left.join(right, "_key")
        .filter("a < b")
        .withColumn("apart", apart)
        .filter(F.col("apart") <= radius)
        .select("a", "a_key", "b", "b_key", "apart")
        .distinct()
    )
