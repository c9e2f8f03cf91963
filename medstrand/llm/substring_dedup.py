"""Passages that repeat across documents, found by collinear chaining of shared word seeds.

1. Seeds: in every window of SPREAD runs of SEED_WORDS words the run with the smallest hash. Equal
   passages of ``SEED_WORDS + SPREAD - 1`` words or more share a seed wherever they stand.
2. Each seed links a document to the first document (smallest id) that holds it: one link for each
   place, however many documents share it, so no pairs are formed.
3. Links of two documents are chained in order in both: a tree of maxima over places in the first
   document keeps the best chain that ends near before a place, and gaps cost by their length.
   Matches that are too far back are taken out of the tree.
4. Chains are aligned word by word between their seeds and beyond their ends, which finds where
   fuzzy passages begin and end, and parts chains where too much differs.
5. Where shared seeds may make a passage that the chains have not, all runs of MIN_WORDS words are
   compared whole: each links to the first document that holds all of it. So a passage whose seeds
   others held first is found, word by word.
6. Parts that go on in the same earlier document as they do here are joined to runs. Runs of MIN_WORDS
   words or more, whichever document they were found in, are united to passages. The first document
   keeps its own.

Words are runs of letters and digits (every character outside ASCII counts), lower-cased over ASCII.
A document is its id and text: rows that repeat both are one document, and stay or are cut alike.
Nulls: a null text is empty; a null id comes after all others. Texts shorter than a seed have no
passages. An empty table gives no rows. ``cut`` keeps all other columns.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medstrand.llm import text as tx
from medstrand.sources.sinks import materialise

SEED_WORDS = 8
SPREAD = 20
MIN_WORDS = 50
# Largest gap between two seeds of a chain, and words of a gap that may differ.
MAX_GAP = 48
MAX_EDITS = 8
GAP_COST = 0.1
# Words around a chain in which its passage may go on without a seed.
PAD = SEED_WORDS + SPREAD
# Words between two parts of a document that still make one passage.
BRIDGE = 2
# Parts in which the wanted stretches of one document are gathered.
PARTS = 4


def document(key: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))


def _select(words: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first words, unnumbered hashes and numbers of the chosen seeds of some texts."""
    grams, first = tx.windows(words, SEED_WORDS)
    whole = words.count[words.text[first]] >= SEED_WORDS if len(first) else np.zeros(0, dtype=bool)
    grams, first = grams[whole], first[whole]
    owner = words.text[first]
    n = len(grams)
    if not n:
        return grams, first, grams, np.zeros(0, dtype=np.int64)
    padded = np.concatenate((grams, np.full(SPREAD - 1, ~np.uint64(0))))
    # Runs of a text are next to each other, so a window stays inside it or is cut at its end.
    ends = np.searchsorted(owner, owner, side="right")
    view = np.lib.stride_tricks.sliding_window_view(padded, SPREAD)
    least = np.empty(n, dtype=np.int64)
    for at in range(0, n, 32_768):
        least[at : at + 32_768] = view[at : at + 32_768].argmin(axis=1)
    # A window that reaches over the end of its text serves only where the text has no whole one.
    place = np.arange(n)
    starts = np.searchsorted(owner, owner, side="left")
    short = ends - starts < SPREAD
    chosen = np.unique((place + least)[place + SPREAD <= ends])
    extra = []
    for a in np.unique(starts[short]):
        b = ends[a]
        extra.append(a + int(grams[a:b].argmin()))
    chosen = np.concatenate((chosen, np.array(extra, dtype=np.int64))) if extra else chosen
    grams, first, owner = grams[chosen], first[chosen], owner[chosen]
    # A seed that comes again within a window of itself, and so on, is a stretch that repeats itself. It
    # stays at its first place, and from there every SPREAD words as a seed of its own, numbered from
    # the first, so that it links to the first document whose stretch goes on as far.
    order = np.lexsort((first, grams, owner))
    grams, first, owner = grams[order], first[order], owner[order]
    keep = np.ones(len(grams), dtype=bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(first) > SPREAD)
    at = np.flatnonzero(keep)
    more = (first[np.append(at[1:], len(first)) - 1] - first[at]) // SPREAD
    number = np.arange(len(at) + more.sum()) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    grams, first = np.repeat(grams[at], more + 1), np.repeat(first[at], more + 1)
    numbered = tx.mix(grams + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(number > 0, numbered, grams), first + SPREAD * number, grams, number


def seeds(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``seed``, ``doc_id``, ``_row`` and ``pos`` (word number) of every chosen seed.

    A numbered seed also has ``stretch``, the seed at which the stretch that repeats itself begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, words in tx.words(batch.column(2), tx.WORD_BYTES):
                grams, first, begun, number = _select(words)
                at = pa.array(row + words.text[first]) if len(first) else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams.view(np.int64)),
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(words.place[first].astype(np.int32)),
                        pa.array(begun.view(np.int64), mask=number == 0),
                    ],
                    ["seed", "doc_id", "_row", "pos", "stretch"],
                )

    wanted = docs.select(F.col(key).cast("long").alias("doc_id"), document(key, text).alias("_row"), text)
    return wanted.mapInArrow(run, "seed long, doc_id long, _row long, pos int, stretch long")


def links(found: DataFrame) -> DataFrame:
    """Places of seeds that another document held first: ``seed, _row, doc_id, pos, f_row, f_doc, f_pos``.

    ``found`` is the stored table of ``seeds``. First places are minima with map-side combine; the
    join is an ordinary one whose hot seeds can be split.
    """
    place = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_row", "pos")
    shared = (
        found.groupBy("seed")
        .agg(F.min(place).alias("_first"), F.min("_row").alias("_low"), F.max("_row").alias("_high"))
        .filter("_low <> _high")
        .select(
            "seed",
            F.col("_first.doc_id").alias("f_doc"),
            F.col("_first._row").alias("f_row"),
            F.col("_first.pos").alias("f_pos"),
        )
    )
    shared = materialise(shared, "shared-seeds")
    return found.join(shared, "seed").filter("_row <> f_row").select("seed", "_row", "doc_id", "pos", "f_row", "f_doc", "f_pos")


class _Maxima:
    """Largest value, and its number, in a range of keys; values can be taken out again."""

    def __init__(self, size: int):
        self.size = size
        self.best = [(-1e18, -1)] * (2 * size)
        self.held: list[list[tuple[float, int]]] = [[] for _ in range(size)]

    def _lift(self, key: int) -> None:
        at = key + self.size
        self.best[at] = max(self.held[key], default=(-1e18, -1))
        while at > 1:
            at >>= 1
            self.best[at] = max(self.best[2 * at], self.best[2 * at + 1])

    def put(self, key: int, value: float, number: int) -> None:
        self.held[key].append((value, number))
        self._lift(key)

    def take(self, key: int, value: float, number: int) -> None:
        self.held[key].remove((value, number))
        self._lift(key)

    def between(self, low: int, high: int) -> tuple[float, int]:
        """Of the keys from ``low`` on and below ``high``."""
        out = (-1e18, -1)
        low, high = low + self.size, high + self.size
        while low < high:
            if low & 1:
                out = max(out, self.best[low])
                low += 1
            if high & 1:
                high -= 1
                out = max(out, self.best[high])
            low, high = low >> 1, high >> 1
        return out


def chain(xs: list[int], ys: list[int]) -> list[list[int]]:
    """Numbers of the matches of each chain; ``xs`` ascend, both coordinates grow along a chain."""
    n = len(xs)
    if n == 1:
        return [[0]]
    if all(0 < xs[i] - xs[i - 1] <= MAX_GAP and ys[i] - ys[i - 1] == xs[i] - xs[i - 1] for i in range(1, n)):
        return [list(range(n))]
    heights = sorted(set(ys))
    rank = {y: i for i, y in enumerate(heights)}
    tree = _Maxima(len(heights))
    worth, score, before = [0.0] * n, [0.0] * n, [-1] * n
    i = gone = 0
    while i < n:
        while xs[i] - xs[gone] > MAX_GAP:  # too far for this match and all later ones
            tree.take(rank[ys[gone]], worth[gone], gone)
            gone += 1
        stop = i
        while stop < n and xs[stop] == xs[i]:  # equal places do not follow each other
            at = GAP_COST * (xs[stop] + ys[stop])
            value, j = tree.between(bisect_left(heights, ys[stop] - 2 * MAX_GAP), rank[ys[stop]])
            score[stop] = SEED_WORDS
            if j >= 0 and value - at > 0:
                score[stop], before[stop] = SEED_WORDS + value - at, j
            stop += 1
        for k in range(i, stop):
            worth[k] = score[k] + GAP_COST * (xs[k] + ys[k])
            tree.put(rank[ys[k]], worth[k], k)
        i = stop
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda k: -score[k]):
        part = []
        while end >= 0 and not used[end]:
            used[end] = True
            part.append(end)
            end = before[end]
        if part:
            out.append(part[::-1])
    return out


CHAINS = "_row long, doc_id long, f_row long, f_doc long, xs array<int>, ys array<int>"


def chains(linked: DataFrame) -> DataFrame:
    """Chains of the links of each two documents; a document's links, as many as its seeds at most, meet in a task.

    A stretch of a document with one link alone cannot be a passage and is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        for batch in batches:
            rows = [c.to_pylist() for c in batch.columns]
            out: list[list] = [[] for _ in range(6)]
            for i, row in enumerate(rows[0]):
                if held[0] and held[0][0] != row:
                    _chain_document(held, out)
                    held = [[] for _ in range(6)]
                for column, values in zip(held, rows, strict=True):
                    column.append(values[i])
            yield _chain_record(out)
        out = [[] for _ in range(6)]
        if held[0]:
            _chain_document(held, out)
        yield _chain_record(out)

    columns = ["_row", "doc_id", "f_row", "f_doc", "pos", "f_pos"]
    dealt = linked.select(*columns).repartition("_row").sortWithinPartitions("_row", "f_row", "pos", "f_pos")
    return dealt.mapInArrow(run, CHAINS)


def _chain_record(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 2
    names = ["_row", "doc_id", "f_row", "f_doc", "xs", "ys"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _chain_document(held: list[list], out: list[list]) -> None:
    row, doc, f_rows, f_docs, xs, ys = held
    # Links with another within reach.
    places = sorted(xs)
    reach = MAX_GAP
    alone = {
        x
        for i, x in enumerate(places)
        if (i == 0 or x - places[i - 1] > reach) and (i + 1 == len(places) or places[i + 1] - x > reach)
    }
    at = 0
    while at < len(xs):
        stop = at
        while stop < len(xs) and f_rows[stop] == f_rows[at]:
            stop += 1
        use = [i for i in range(at, stop) if xs[i] not in alone]
        if use:
            for part in chain([xs[i] for i in use], [ys[i] for i in use]):
                out[0].append(row[0])
                out[1].append(doc[0])
                out[2].append(f_rows[at])
                out[3].append(f_docs[at])
                out[4].append([xs[use[k]] for k in part])
                out[5].append([ys[use[k]] for k in part])
        at = stop


def stretches(docs: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row``, ``lo``, ``hi`` and ``words`` (32 bits of each word's hash) of the wanted stretches of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, asked = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for start, _, words in tx.words(batch.column(1), tx.WORD_BYTES):
                short = (words.hash >> np.uint64(32)).astype(np.uint32)
                out: list[list] = [[], [], [], []]
                for i in range(len(words.count)):
                    a, b = words.first[i], words.first[i + 1]
                    for want in asked[start + i]:
                        lo, hi = want["lo"], want["hi"]
                        cut = short[a + max(lo, 0) : min(a + hi, b)].tobytes()
                        for column, value in zip(out, (rows[start + i], lo, hi, cut), strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["_row", "lo", "hi", "words"]
                )

    part = F.pmod(F.xxhash64("lo", "hi"), F.lit(PARTS))
    gathered = wanted.groupBy("_row", part.alias("_part")).agg(F.collect_list(F.struct("lo", "hi")).alias("_asked"))
    own = docs.select(document(key, text).alias("_own"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    joined = gathered.join(own, F.col("_row") == F.col("_own")).select("_row", "_text", "_asked")
    # Rows that repeat a document give its stretches again; one of each is enough.
    return joined.mapInArrow(run, "_row long, lo int, hi int, words binary").dropDuplicates(["_row", "lo", "hi"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short stretches."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for word in a:
        met = row[:-1] + (b == word)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], met))
    return int(row[-1])


def _go_on(a: np.ndarray, b: np.ndarray) -> int:
    """Words by which two stretches agree from their start; one word may differ if three equal ones follow."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    at = 0
    while at < n:
        wrong = np.flatnonzero(~same[at:])
        if not len(wrong):
            return n
        at += int(wrong[0])
        if at + 4 <= n and same[at + 1 : at + 4].all():
            at += 4
        else:
            return at
    return at


def align(a: np.ndarray, b: np.ndarray, xs: list[int], ys: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Parts of a chain that hold together: ``(from, to, matched words, from in b, to in b)``.

    ``a`` and ``b`` are the two stretches, ``xs`` and ``ys`` the seeds' places in them.
    """
    parts: list[list[int]] = []
    for x, y in zip(xs, ys, strict=True):
        if not np.array_equal(a[x : x + SEED_WORDS], b[y : y + SEED_WORDS]):
            continue
        if parts:
            last = parts[-1]
            skip = max(0, last[1] - x, last[4] - y)  # seeds may overlap
            gap_a, gap_b = a[last[1] : x + skip], b[last[4] : y + skip]
            if len(gap_a) == len(gap_b) and (gap_a == gap_b).all():
                met = len(gap_a)
            else:
                met = _common(gap_a, gap_b)
            if max(len(gap_a), len(gap_b)) - met <= MAX_EDITS:
                last[2] += met + max(0, SEED_WORDS - skip)
                last[1], last[4] = max(last[1], x + SEED_WORDS), max(last[4], y + SEED_WORDS)
                continue
        parts.append([x, x + SEED_WORDS, SEED_WORDS, y, y + SEED_WORDS])
    out = []
    for number, (x, stop, met, y, y_stop) in enumerate(parts):
        room = x - (parts[number - 1][1] if number else 0)
        back = _go_on(a[max(0, x - room) : x][::-1], b[:y][::-1])
        room = (parts[number + 1][0] if number + 1 < len(parts) else len(a)) - stop
        on = _go_on(a[stop : stop + max(0, room)], b[y_stop:])
        out.append((x - back, stop + on, met + back + on, y - back, y_stop + on))
    return out


ALIGNED = "_row long, doc_id long, f_row long, f_doc long, start int, stop int, matched int, f_start int, f_stop int"


def aligned(docs: DataFrame, chained: DataFrame) -> DataFrame:
    """Parts of documents that another document held first, with their words and matched words."""
    last = F.lit(SEED_WORDS + PAD)
    bounded = chained.select(
        "*",
        (F.col("xs")[0] - PAD).alias("lo"),
        (F.element_at("xs", -1) + last).alias("hi"),
        (F.col("ys")[0] - PAD).alias("f_lo"),
        (F.element_at("ys", -1) + last).alias("f_hi"),
    )
    asked = bounded.select("_row", "lo", "hi").unionByName(
        bounded.select(F.col("f_row").alias("_row"), F.col("f_lo").alias("lo"), F.col("f_hi").alias("hi"))
    )
    found = materialise(stretches(docs, asked.distinct()), "stretches")
    theirs = found.select(F.col("_row").alias("f_row"), F.col("lo").alias("f_lo"), F.col("hi").alias("f_hi"), F.col("words").alias("f_words"))
    paired = bounded.join(found, ["_row", "lo", "hi"]).join(theirs, ["f_row", "f_lo", "f_hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for row, doc, f_row, f_doc, xs, ys, lo, f_lo, words, f_words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(words, dtype=np.uint32), np.frombuffer(f_words, dtype=np.uint32)
                x0, y0 = max(lo, 0), max(f_lo, 0)
                for start, stop, met, f_start, f_stop in align(a, b, [x - x0 for x in xs], [y - y0 for y in ys]):
                    part = (row, doc, f_row, f_doc, start + x0, stop + x0, met, f_start + y0, f_stop + y0)
                    for column, value in zip(out, part, strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 4 + [pa.int32()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [c.split()[0] for c in ALIGNED.split(", ")]
            )

    columns = ["_row", "doc_id", "f_row", "f_doc", "xs", "ys", "lo", "f_lo", "words", "f_words"]
    return paired.select(*columns).mapInArrow(run, ALIGNED)


def _by_document(rows: DataFrame, order: list[str], work: Callable[[list[list]], list[tuple]], schema: str) -> DataFrame:
    """What ``work`` makes of the columns of each ``_row``, the first column, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in columns]
        fields = [(name, kinds[of]) for name, of in (x.split(" ", 1) for x in schema.split(", "))]

        def record(made: list[tuple]) -> pa.RecordBatch:
            values = zip(*made, strict=True) if made else [()] * len(fields)
            arrays = [pa.array(v, kind) for v, (_, kind) in zip(values, fields, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])

        for batch in batches:
            made: list[tuple] = []
            rows = [c.to_pylist() for c in batch.columns]
            for i, row in enumerate(rows[0]):
                if held[0] and held[0][0] != row:
                    made += work(held)
                    held = [[] for _ in columns]
                for column, values in zip(held, rows, strict=True):
                    column.append(values[i])
            yield record(made)
        yield record(work(held) if held[0] else [])

    columns = rows.columns
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    return rows.repartition("_row").sortWithinPartitions("_row", *order).mapInArrow(run, schema)


# Words by which a passage may reach over its first and over its last seed's place.
BEFORE, AFTER = SPREAD - 1, SEED_WORDS + SPREAD - 1


def _spans(places: list[int], least: int) -> list[tuple[int, int]]:
    """Stretches of ``least`` words or more in which all seeds may be among the ascending places."""
    out, first = [], 0
    for i in range(1, len(places) + 1):
        # Twice as far as chosen seeds lie apart, as those of a stretch that repeats itself are numbered anew.
        if i == len(places) or places[i] - places[i - 1] > 2 * SPREAD:
            lo, hi = max(0, places[first] - BEFORE), places[i - 1] + AFTER
            if hi - lo >= least:
                out.append((lo, hi))
            first = i
    return out


def longer_stretches(found: DataFrame, linked: DataFrame) -> DataFrame:
    """``_row, seed, pos`` of all numbered seeds of stretches whose first seed is linked, under that first seed.

    A stretch that repeats itself may be longer than where it was first held: the seeds of the rest
    are held by no earlier document, although every run of the rest is.
    """
    begun = linked.select("_row", F.col("seed").alias("stretch")).distinct()
    repeated = found.filter("stretch is not null").join(begun, ["_row", "stretch"])
    return repeated.select("_row", F.col("stretch").alias("seed"), _to_the_end().alias("pos"))


def _to_the_end() -> Column:
    """A numbered seed's place, and the last one before the next number, to which its stretch may go on."""
    return F.explode(F.array("pos", F.col("pos") + F.lit(SPREAD - 1)))


def open_seeds(linked: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Distinct ``seed`` of links from which a passage with a word outside the known ones may be made."""

    def work(held: list[list]) -> list[tuple]:
        _, seeds, starts, stops = held
        covered: list[list[int]] = []
        for seed, a, b in zip(seeds, starts, stops, strict=True):
            if seed is None:
                if covered and a <= covered[-1][1]:
                    covered[-1][1] = max(covered[-1][1], b)
                else:
                    covered.append([a, b])
        places = [(a, seed) for seed, a in zip(seeds, starts, strict=True) if seed is not None]
        begins, found, at = [a for a, _ in covered], [], 0
        for lo, hi in _spans([a for a, _ in places], least):
            while at < len(places) and places[at][0] < lo:
                at += 1
            while at < len(places) and places[at][0] < hi:
                # All windows of ``least`` words that hold the seed.
                a, b = max(lo, places[at][0] + SEED_WORDS - least), min(hi, places[at][0] + least)
                i = bisect_right(begins, a) - 1
                if i < 0 or covered[i][1] < b:
                    found.append((places[at][1],))
                at += 1
        return found

    none = F.lit(None).cast("long")
    both = linked.select("_row", "seed", F.col("pos").alias("start"), F.col("pos").alias("stop")).unionByName(
        known.select("_row", none.alias("seed"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
    )
    return _by_document(both, ["start", "stop"], work, "seed long").distinct()


def whole_parts(docs: DataFrame, found: DataFrame, wanted: DataFrame, least: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of ``least`` words that an earlier document holds word by word, as ``aligned`` gives parts.

    ``wanted`` are the seeds in question; every document's stretches whose seeds, or the first seeds of
    whose repetitions, are among them are looked at. A run links to the first document that holds all of it, so nothing is lost where
    its seeds were first held by others.
    """

    def work(held: list[list]) -> list[tuple]:
        spans = _spans(held[1], least)
        return [(held[0][0], [lo for lo, _ in spans], [hi for _, hi in spans])] if spans else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for start, stop, words in tx.words(batch.column(2), tx.WORD_BYTES):
                grams, first = tx.windows(words, least)
                use = np.zeros(len(first), dtype=bool)
                begins = np.searchsorted(first, words.first)
                for i in np.flatnonzero(words.count >= least).tolist():
                    own = use[begins[i] : begins[i + 1]]
                    for lo, hi in zip(lows[start + i], highs[start + i], strict=True):
                        own[lo : hi - least + 1] = True
                grams, first = grams[use], first[use]
                at = pa.array(start + words.text[first]) if len(first) else pa.array([], pa.int64())
                columns = [pa.array(grams.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(words.place[first].astype(np.int32))], ["gram", "_row", "doc_id", "pos"]
                )

    repeated = found.filter("stretch is not null").join(wanted.withColumnRenamed("seed", "stretch"), "stretch")
    places = found.join(wanted, "seed").select("_row", "pos").unionByName(repeated.select("_row", _to_the_end().alias("pos")))
    spans = _by_document(places, ["pos"], work, "_row long, lows array<int>, highs array<int>").withColumnRenamed("_row", "_asked")
    own = docs.select(document(key, text).alias("_row"), F.col(key).cast("long").alias("doc_id"), text)
    asked = own.join(spans, F.col("_row") == F.col("_asked")).select("_row", "doc_id", text, "lows", "highs")
    grams = materialise(asked.mapInArrow(run, "gram long, _row long, doc_id long, pos int"), "grams")
    place = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_row", "pos")
    first = grams.groupBy("gram").agg(F.min(place).alias("_first"), F.min("_row").alias("_low"), F.max("_row").alias("_high"))
    first = first.filter("_low <> _high").select("gram", "_first")
    return (
        grams.join(first, "gram")
        .filter("_row <> _first._row")
        .select(
            "_row", "doc_id", F.col("_first._row").alias("f_row"), F.col("_first.doc_id").alias("f_doc"),
            F.col("pos").alias("start"), (F.col("pos") + least).alias("stop"), F.lit(least).alias("matched"),
            F.col("_first.pos").alias("f_start"), (F.col("_first.pos") + least).alias("f_stop"),
        )
    )


def runs(parts: DataFrame, least: int) -> DataFrame:
    """Parts that go on in one earlier document as they do here, joined; those of ``least`` words or more."""

    def work(held: list[list]) -> list[tuple]:
        done: list[list] = []
        reaching: list[list] = []  # runs of the same earlier document that a part may still carry on
        for part in zip(*held, strict=True):
            _, _, f_row, _, start, stop, matched, f_start, f_stop = part
            reaching = [r for r in reaching if r[2] == f_row and r[5] + BRIDGE >= start]
            for r in reaching:
                if abs(f_start - start - (r[8] - r[5])) <= BRIDGE and f_start <= r[8] + BRIDGE:
                    r[6] += max(0, matched - max(0, min(stop, r[5]) - start))
                    if stop > r[5]:
                        r[5], r[8] = stop, f_stop
                    break
            else:
                done.append(list(part))
                reaching.append(done[-1])
        return [tuple(r) for r in done if r[5] - r[4] >= least]

    columns = [c.split()[0] for c in ALIGNED.split(", ")]
    return _by_document(parts.select(*columns), ["f_row", "start", "stop", "f_start"], work, ALIGNED)


def united(parts: DataFrame, least: int) -> DataFrame:
    """Parts of a document that touch, whichever document they were found in, as one: ``start``, ``stop`` and more."""
    order = Window.partitionBy("_row").orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = parts.withColumn("_new", (F.col("start") > F.coalesce(reached, F.lit(-1 - BRIDGE)) + BRIDGE).cast("int"))
    islands = islands.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        islands.groupBy("_row", "doc_id", "_island")
        .agg(
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            F.least(F.sum("matched"), F.max("stop") - F.min("start")).cast("long").alias("matched_words"),
            F.sort_array(F.collect_set("f_doc")).alias("first_docs"),
        )
        .filter(F.col("stop") - F.col("start") >= least)
    )


def passages(docs: DataFrame, least: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages of documents that earlier ones hold: ``_row, doc_id, start, n_words, matched_words, first_docs``.

    ``start`` counts words from 0; ``first_docs`` are the ids of the documents that held parts first.
    """
    found = materialise(seeds(docs, key, text), "seeds")
    linked = materialise(links(found), "seed-links")
    chained = materialise(chains(linked), "chains")
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = materialise(aligned(named, chained), "aligned")
    places = linked.select("_row", "seed", "pos").unionByName(longer_stretches(found, linked))
    asked = materialise(open_seeds(places, runs(parts, least), least), "open-seeds")
    whole = materialise(whole_parts(named, found, asked, least), "whole-parts")
    return united(runs(parts.unionByName(whole), least), least).select(
        "_row",
        "doc_id",
        F.col("start").cast("long").alias("start"),
        (F.col("stop") - F.col("start")).cast("long").alias("n_words"),
        "matched_words",
        "first_docs",
    )


def cut(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without their passages; documents of which no word is left go.

    A passage is cut from its first word to the word after it, or to the end of the text.
    """
    gathered = F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("__spans")
    spans = found.groupBy(F.col("_row").alias("__cut")).agg(gathered)
    columns = docs.columns
    marked = docs.withColumn("__row", document(key, text))
    joined = marked.join(spans, F.col("__row") == F.col("__cut"), "left")
    whole = joined.filter(F.col("__spans").isNull()).select(*columns)
    parted = joined.filter(F.col("__spans").isNotNull()).select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__own"), F.col(text).alias("__text"), "__spans"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, texts, keep = batch.column(2).to_pylist(), [], []
            for row, stop, data, bounds in tx.slices(batch.column(1)):
                words = tx.Words(data, bounds, tx.WORD_BYTES)
                for i in range(stop - row):
                    first, end = words.first[i], bounds[i + 1]
                    n, at, left, out = words.count[i], bounds[i], words.count[i], []
                    for span in asked[row + i]:
                        a, b = span["start"], min(span["start"] + span["n_words"], n)
                        out.append(data[at : words.start[first + a]].tobytes())
                        at = words.start[first + b] if b < n else end
                        left -= b - a
                    out.append(data[at:end].tobytes())
                    texts.append(b"".join(out).decode("utf-8"))
                    keep.append(left > 0)
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["__own", "__text"])
            yield made.filter(pa.array(keep, pa.bool_()))

    kind = parted.schema["__own"].dataType.simpleString()
    done = parted.mapInArrow(run, f"__own {kind}, __text string")
    return whole.unionByName(
        done.select(*[(F.col("__text") if c == text else F.col("__own")[c]).alias(c) for c in columns])
    )
