"""Packing of tokenized documents into windows by minimum bin slack.

Every document is tokenized once and cut into full windows and a rest. What is left to pack is then
a multiset of rests, of which only the counts by length matter: at most ``window - 1`` numbers,
whatever the corpus. From those the plan is made: again and again the longest length left is put in
a window, a subset-sum over bitsets finds the multiset of other lengths that comes closest to
filling it, backtracking gives its counts, and the window is repeated as often as the counts allow.
If no multiset fills it, the longest length left is cut to fill the gap, so a window is never padded.
What is left at the end, less than one window, goes to sequences whose lengths are powers of two.

The plan speaks of ranks within a length, never of documents: rows of one length are ranked in
parts, and each rank looks its place up in the plan, a table bounded by the window alone.

Nulls: a null text is empty and gives the closing token alone; a null key is carried along. Repeated
rows are packed each. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medstrand.sources.sinks import materialise

WINDOW = 1024
# Chunks whose ids a task keeps at hand.
KEPT_CHUNKS = 100_000

PIECES = "doc_id long, _row long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"

# Two white spaces in a row, or one at an end: then a chunk's ids could depend on its neighbour.
_TANGLED = re.compile(r"\s\s|^\s|\s\Z")


class ChunkEncoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit integers.

    The vocabulary's pattern always starts a new token at a single space between two other
    characters, so a text is encoded chunk by chunk between such spaces and chunks are remembered.
    ``added`` are the tokens that the vocabulary's own file lists beside the learned ones; a text is
    cut at them first, the leftmost and longest, and each stands for its own id.
    """

    def __init__(self, path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._kept: dict[str, bytes] = {}
        self._added = {token: np.array([number], dtype="<u4").tobytes() for token, number in added}
        longest = sorted(self._added, key=len, reverse=True)
        self._cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def _ids(self, text: str) -> bytes:
        return np.array(self._encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self._cut is None or self._cut.search(text) is None:
            return self._between(text)
        parts = self._cut.split(text)
        return b"".join(self._added[x] if i % 2 else self._between(x) for i, x in enumerate(parts))

    def _between(self, text: str) -> bytes:
        if not text:
            return b""
        if _TANGLED.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        if len(self._kept) > KEPT_CHUNKS:
            self._kept.clear()
        kept = self._kept
        out = [self._ids(first)]
        for chunk in rest:
            ids = kept.get(chunk)
            if ids is None:
                ids = kept[chunk] = self._ids(" " + chunk)
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str, added: tuple[tuple[str, int], ...]) -> ChunkEncoder:
    return ChunkEncoder(path, pattern, added)


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """Tokens with their ids that a vocabulary's JSON file adds to the learned ones.

    Only tokens found anywhere and as they stand are understood; one that strips spaces or wants a
    whole word is an error.
    """
    with open(path, encoding="utf-8") as file:
        listed = json.load(file).get("added_tokens", [])
    for token in listed:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token with rules of its own: {token}")
    return tuple((token["content"], token["id"]) for token in listed)


def tokenize(
    docs: DataFrame,
    path: str,
    pattern: str,
    added: tuple[tuple[str, int], ...] = (),
    window: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Full windows and rests of all documents with their ids, one row each.

    ``path`` is a file of ranks of a public byte-level vocabulary on every executor, ``added`` its
    added tokens.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern, added)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            size = 0
            # One text at a time: a batch's texts are in memory once already.
            for doc_id, row, content in zip(*batch.columns, strict=True):
                doc_id, row = doc_id.as_py(), row.as_py()
                ids = encoder.encode(content.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    values = (doc_id, row, start, len(piece) // 4, zlib.crc32(piece), n, piece)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                size += len(ids)
                if size > 1 << 22:
                    yield _record(out)
                    out, size = [[] for _ in range(7)], 0
            yield _record(out)

    wanted = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), text)
    return wanted.mapInArrow(cut, PIECES)


def _record(columns: list[list]) -> pa.RecordBatch:
    names = ["doc_id", "_row", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Multiset of available lengths with the largest sum up to ``capacity``.

    One bitset holds the sums reachable with the lengths seen so far, longest first; counts are
    split in powers of two. Backtracking takes as few of the short lengths as it can.
    """
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if 0 < x <= capacity and counts[x] > 0), reverse=True):
        left, size = min(counts[length], capacity // length), 1
        while left:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, size = left - take, size * 2
        if reach >> capacity & 1:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            target -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


class _Pool:
    """Pieces left, as runs of ranks: length -> list of [source length, first rank, ranks, cut from]."""

    def __init__(self, counts: dict[int, int]):
        self.runs = {n: [[n, 0, c, 0]] for n, c in counts.items() if c > 0}
        self.counts = {n: c for n, c in counts.items() if c > 0}

    def add(self, length: int, run: list[int]) -> None:
        self.runs.setdefault(length, []).append(run)
        self.counts[length] = self.counts.get(length, 0) + run[2]

    def take(self, length: int, ranks: int) -> list[list[int]]:
        self.counts[length] -= ranks
        if not self.counts[length]:
            del self.counts[length]
        out, runs = [], self.runs[length]
        while ranks:
            source, first, have, cut = runs[-1]
            use = min(have, ranks)
            out.append([source, first + have - use, use, cut])
            ranks -= use
            if use == have:
                runs.pop()
            else:
                runs[-1][2] -= use
        return out


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows ``(source, first_rank, last_rank, cut_from, length, sequence, offset)``.

    Rank ``r`` of rests of ``source`` tokens sends ``length`` ids from ``cut_from`` to sequence
    ``sequence + r - first_rank`` at ``offset``. Work and rows depend on ``window``, not on counts.
    """
    pool, rows, sequence = _Pool({n: c for n, c in counts.items() if n < window}), [], 0
    whole = counts.get(window, 0)
    if whole:
        rows.append((window, 0, whole - 1, 0, window, 0, 0))
        sequence = whole

    def put(length: int, ranks: int, offset: int) -> None:
        at = sequence
        for source, first, have, cut in pool.take(length, ranks):
            rows.append((source, first, first + have - 1, cut, length, at, offset))
            at += have

    left = sum(n * c for n, c in pool.counts.items())
    while left >= window:
        longest = max(pool.counts)
        pool.counts[longest] -= 1
        chosen = fill(pool.counts, window - longest)
        pool.counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        gap = window - sum(n * c for n, c in chosen.items())
        times = min(pool.counts[n] // c for n, c in chosen.items())
        donor = None
        if gap:
            rest = {n: c - chosen.get(n, 0) for n, c in pool.counts.items()}
            donor = max(n for n, c in rest.items() if c > 0)
            # The donor may also be one of the chosen lengths.
            need = {**chosen, donor: chosen.get(donor, 0) + 1}
            times = min(pool.counts[n] // c for n, c in need.items())
        offset = 0
        for length in sorted(chosen, reverse=True):
            for _ in range(chosen[length]):
                put(length, times, offset)
                offset += length
        if donor is not None:
            at = sequence
            for source, first, have, cut in pool.take(donor, times):
                rows.append((source, first, first + have - 1, cut, gap, at, offset))
                pool.add(donor - gap, [source, first, have, cut + gap])
                at += have
        sequence += times
        left -= window * times

    offset, room = 0, 0
    while left:
        if not room:
            offset, room = 0, 1 << (left.bit_length() - 1)
            sequence += 1
        length = max(pool.counts)
        ((source, first, _, cut),) = pool.take(length, 1)
        use = min(length, room)
        rows.append((source, first, first, cut, use, sequence - 1, offset))
        if use < length:
            pool.add(length - use, [source, first, 1, cut + use])
        offset, room, left = offset + use, room - use, left - use
    return rows


def _ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Ranks pieces of one length from 0, without a gap, in parts.

    Most pieces have the window's length, so a length has as many parts as the root of its count: then
    neither the rows of a part nor the parts of a length, which are summed in one task, grow as the count does.
    """
    spark = pieces.sparkSession
    parts = [(length, 1 + isqrt(n)) for length, n in counts.items()]  # at most window rows
    parts = F.broadcast(spark.createDataFrame(parts or [(0, 1)], "length long, _parts long"))
    parted = pieces.join(parts, "length").withColumn("_part", F.pmod(F.xxhash64("_row", "start"), F.col("_parts"))).drop("_parts")
    sizes = parted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_row", "start")) - 1
    return (
        parted.withColumn("_inside", inside)
        .join(offsets, ["length", "_part"])
        .withColumn("_rank", F.col("_before") + F.col("_inside"))
        .drop("_part", "_before", "_inside")
    )


def pack(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Places of all pieces: ``doc_id, _row, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokens`` is a stored table of ``tokenize``. Its ids are read only for the few pieces that are
    cut once more; join on ``_row`` and ``start`` for the others.
    """
    spark: SparkSession = tokens.sparkSession
    counts = {r["length"]: r["count"] for r in tokens.groupBy("length").count().collect()}  # at most window rows
    rows = plan(counts, window)
    places = spark.createDataFrame(
        rows or [(0, 0, -1, 0, 0, 0, 0)],
        "_source long, _first long, _last long, _cut long, _size long, _sequence long, offset long",
    )
    narrow = tokens.select("doc_id", "_row", "start", "length", "ids_crc32", "doc_tokens")
    # The plan's size depends on the window alone.
    ranked = _ranked(narrow, counts)
    here = (ranked["length"] == places["_source"]) & ranked["_rank"].between(places["_first"], places["_last"])
    placed = ranked.join(F.broadcast(places), here)
    placed = placed.withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_first"))
    whole = placed.filter("_size = length")
    part = F.expr("substring(ids, cast(4 * _cut as int) + 1, cast(4 * _size as int))")
    # Stored first: then the join knows how few they are.
    cut = (
        materialise(placed.filter("_size < length"), "cuts")
        .join(tokens.select("_row", "start", "ids"), ["_row", "start"])
        .withColumn("ids_crc32", F.crc32(part))
    )
    columns = [
        "doc_id",
        "_row",
        (F.col("start") + F.col("_cut")).alias("start"),
        F.col("_size").alias("length"),
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        "offset",
    ]
    return whole.select(*columns).unionByName(cut.select(*columns))


def pack_documents(
    docs: DataFrame, path: str, pattern: str, added: tuple[tuple[str, int], ...] = (), window: int = WINDOW
) -> tuple[DataFrame, DataFrame]:
    """Tokenizes, stores and packs; gives the stored pieces with their ids, and the places."""
    tokens = materialise(tokenize(docs, path, pattern, added, window), "tokens")
    return tokens, pack(tokens, window)
