"""Target-distribution importance resampling of documents.

Features are all runs of one to three words, hashed to buckets. How often each bucket is met in the
corpus and in the target texts gives a gain a bucket, an array that every task holds, and a document
weighs the sum of its features' gains. A Gumbel number drawn from a hash of its id is added, so the
highest scores are a draw without replacement, in proportion to the weights.

The cutoff is found without a sort. In each round every partition gives its median key among those
still open, the weighted median of these medians, weighted by how many keys each stands for, is the
pivot, and one pass counts the keys before it; at least a quarter of the open keys falls away, until
the pivot is the last key drawn. Only the drawn documents are sorted.

Keys order by score, highest first, then by id, null first, then by the row in the stored table, so
ties and repeated rows have one defined order. Nulls: a null text has no words, a null id is hashed as
an empty one. Very long texts are read in blocks of whole words. Empty texts weigh 0. An empty table
gives no rows; without target texts the gains still have their defined values. Other columns are not
carried along, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medstrand.llm.text import LOWER, WORD_BYTES
from medstrand.operators.scale import ranged, running_total
from medstrand.sources.sinks import materialise

BUCKETS = 10_000
# Bytes of a text whose words are held at once.
BLOCK_BYTES = 1 << 20
# Open keys are stored anew when so small a part of those stored before is left.
SHRINK = 8
LEAST_ID = -(1 << 63)

# A-Z in lower case; every byte outside words is a space.
_CLEAN = bytes(int(LOWER[b]) if WORD_BYTES[b] else 32 for b in range(256))


def word_blocks(text: str, block: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about ``block`` bytes."""
    clean = text.encode().translate(_CLEAN)
    at = 0
    while at < len(clean):
        stop = len(clean) if at + block >= len(clean) else clean.find(b" ", at + block)
        stop = len(clean) if stop < 0 else stop
        found = clean[at:stop].split()
        if found:
            yield found
        at = stop


def features(text: str, block: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """For each block, its number of words and the checksums of the runs of one to three words that end in it."""
    tail: list[bytes] = []
    for found in word_blocks(text, block):
        n, have = len(found), len(tail)
        joined = tail + found
        spaced = [b" " + w for w in joined[1:]]
        one = list(map(crc32, joined))
        # The checksum goes on from that of the words before.
        two = list(map(crc32, spaced, one))
        three = list(map(crc32, spaced[1:], two))
        runs = one[have:] + two[max(have - 1, 0) :] + three[max(have - 2, 0) :]
        yield n, np.array(runs, dtype=np.uint32)
        tail = joined[-2:]


def bucket_counts(docs: DataFrame, out: str, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and how often its features are met; summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            held, n = [], 0
            for content in batch.column(0):
                for _, sums in features(content.as_py() or ""):
                    held.append(sums)
                    n += len(sums)
                    if n > 1 << 20:
                        total += np.bincount(np.concatenate(held) % buckets, minlength=buckets)
                        held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held) % buckets, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    rows = docs.select(text).mapInArrow(count, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias(out))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths: log of its share in the target over its share in the corpus, both with one added."""
    both = bucket_counts(docs, "s", text, buckets).join(bucket_counts(target, "t", text, buckets), "bucket", "full")
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in both.collect():  # at most one row a bucket
        s[r["bucket"]], t[r["bucket"]] = r["s"] or 0, r["t"] or 0
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, _row, n_words, n_features, weight`` of every row."""
    buckets = len(gain)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, runs, weights = [], [], []
            for content in batch.column(2):
                n = m = w = 0
                for found, sums in features(content.as_py() or ""):
                    n, m, w = n + found, m + len(sums), w + int(gain[sums % buckets].sum())
                words.append(n)
                runs.append(m)
                weights.append(w)
            columns = [*batch.columns[:2], *[pa.array(c, pa.int64()) for c in (words, runs, weights)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_row", "n_words", "n_features", "weight"])

    wanted = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), text)
    return wanted.mapInArrow(add, "doc_id long, _row long, n_words long, n_features long, weight long")


def with_score(weighed: DataFrame, seed: int = 42) -> DataFrame:
    """Adds ``score``: the weight and a Gumbel number in thousandths, drawn from a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + gumbel)


Key = tuple[int, int, int]
_NO_KEY: Key | None = None


def _round(keys: DataFrame, low: Key | None, high: Key | None, pivot: Key | None) -> list:
    """One row a partition: of its keys between ``low`` and ``high``, how many come before ``pivot``, after it, and the medians of both parts.

    Without a pivot all keys come after it.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[], [], []]
        for batch in batches:
            for column, values in zip(held, batch.columns, strict=True):
                column.append(values.to_numpy(zero_copy_only=False))
        a, b, c = [np.concatenate(x) if x else np.empty(0, np.int64) for x in held]

        def before(bound: Key) -> np.ndarray:
            x, y, z = bound
            return (a < x) | ((a == x) & ((b < y) | ((b == y) & (c < z))))

        open_ = np.ones(len(a), bool)
        if low is not None:  # low itself is out
            open_ &= ~(before(low) | ((a == low[0]) & (b == low[1]) & (c == low[2])))
        if high is not None:
            open_ &= before(high)
        first = before(pivot) if pivot is not None else np.zeros(len(a), bool)
        last = ~first
        if pivot is not None:
            last &= ~((a == pivot[0]) & (b == pivot[1]) & (c == pivot[2]))
        out = []
        for side in (open_ & first, open_ & last):
            x, y, z = a[side], b[side], c[side]
            n = len(x)
            if n:
                middle = np.lexsort((z, y, x))[(n - 1) // 2]
                out += [n, int(x[middle]), int(y[middle]), int(z[middle])]
            else:
                out += [0, 0, 0, 0]
        if out[0] or out[4]:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in out], names)

    names = [f"{side}{column}" for side in ("before", "after") for column in ("", "_a", "_b", "_c")]
    return keys.mapInArrow(part, ", ".join(f"{n} long" for n in names)).collect()  # one row a partition


def _weighted_median(medians: list[tuple[Key, int]]) -> Key:
    half, seen = sum(n for _, n in medians), 0
    for key, n in sorted(medians):
        seen += n
        if 2 * seen >= half:
            return key
    raise ValueError("no medians")


def cutoff(keys: DataFrame, wanted: int) -> Key | None:
    """The ``wanted``-th smallest key of a stored table of unique ``a, b, c``; None where nothing is wanted.

    Where there are fewer keys, the largest.
    """
    if wanted <= 0:
        return None
    found = _round(keys, None, None, None)
    open_ = stored = sum(r["after"] for r in found)
    if not open_:
        return None
    rank, low, high = min(wanted, open_), None, None
    medians = [((r["after_a"], r["after_b"], r["after_c"]), r["after"]) for r in found]
    while True:
        pivot = _weighted_median(medians)
        found = _round(keys, low, high, pivot)
        before = sum(r["before"] for r in found)
        if rank == before + 1:
            return pivot
        side = "before" if rank <= before else "after"
        if side == "before":
            high, open_ = pivot, before
        else:
            low, rank, open_ = pivot, rank - before - 1, open_ - before - 1
        medians = [((r[f"{side}_a"], r[f"{side}_b"], r[f"{side}_c"]), r[side]) for r in found if r[side]]
        if open_ * SHRINK <= stored:
            keys = materialise(_between(keys, low, high), "keys")
            stored = open_


def _literal(key: Key):
    return F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("abc", key, strict=True)])


def _between(keys: DataFrame, low: Key | None, high: Key | None) -> DataFrame:
    own = F.struct("a", "b", "c")
    if low is not None:
        keys = keys.filter(own > _literal(low))
    if high is not None:
        keys = keys.filter(own < _literal(high))
    return keys


def resample(
    docs: DataFrame,
    target: DataFrame,
    least_words: int = 20,
    percent: int = 5,
    key: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    seed: int = 42,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row; ``rank`` is null where a row is not drawn.

    Of the rows with ``least_words`` words, ``percent`` in a hundred are drawn, rounded down.
    """
    gain = gains(docs, target, text, buckets)
    order = [(-F.col("score")).alias("a"), F.coalesce("doc_id", F.lit(LEAST_ID)).alias("b"), F.col("_row").alias("c")]
    scored = materialise(with_score(weigh(docs, gain, key, text), seed), "scores")
    fit = F.col("n_words") >= least_words
    wanted = percent * scored.filter(fit).count() // 100
    last = cutoff(scored.filter(fit).select(*order), wanted)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = fit & (F.struct(*order) <= _literal(last))
    winners = scored.filter(drawn).select(*columns, *order)
    by = [("a", True), ("b", True), ("c", True)]
    winners = running_total(ranged(winners, by, materialise), by, [("_range", F.col("_range"), True)], out="rank")
    return scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(
        winners.select(*columns, "rank")
    )
