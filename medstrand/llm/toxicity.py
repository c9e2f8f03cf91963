"""Toxicity by gradient-boosted trees over dense text features, calibrated by isotonic regression.

1. Lexicon. From labelled texts, at most LEXICON_TEXTS of each class and half, and equal texts once, the log
   odds of every word and of every beginning of a word of 3 to 8 letters. The LEXICON_TERMS
   strongest stay; a text's lexicon features are densities of words by the log odds they carry.
2. Features. Lexicon densities, nearness of lexicon words to second-person words, rates of capitals
   and punctuation, of masked and repeated letters, and lexicon words found only after digits and
   signs are read as letters. No label, language, source or id is among them.
3. Boosted trees on TREE_TEXTS labelled rows at most, then isotonic regression of the label on the
   trees' probability. Steps of equal
   calibrated value keep the trees' order by a hundredth of their probability. Trees see the rows
   of each half of the labels through the other half's lexicon, so no row through its own.

``part`` splits the rows for learning: rows of ``held`` are never learned from.

Nulls: a null text is empty and has all features 0; a null label or id is not learned from. Repeated
rows are scored each. With labels of one class only, or none, every score is that class's share. An
empty table gives no rows; other columns are left out by ``score`` and kept by ``reject``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medstrand.sources.sinks import materialise

# Bounds of each half's sample for the lexicon, for a class, and of the lexicon.
LEXICON_TEXTS = 4_000
# Bound of the sample the trees and the calibration are learned from.
TREE_TEXTS = 24_000
LEXICON_TERMS = 3_000
LEAST_TEXTS = 3
LEAST_ODDS = 1.5
PREFIXES = range(3, 9)
TREES, DEPTH = 20, 3
THRESHOLD = 0.3
# Words between a lexicon word and a second-person word that count as near.
NEAR = 5

_WORD = re.compile(r"[^\W_]+")
# Signs and digits between letters.
_MASK = re.compile(r"(?<=[^\W\d_])[@$!*#0-9]+(?=[^\W\d_])")
# Classes of UTF-8 bytes: capital, small letter, digit, sign, first byte of another character, all else.
_CLASS = np.full(256, 5, dtype=np.uint8)
_CLASS[33:127] = 3
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[192:256] = 2, 0, 1, 4
_READ = str.maketrans("013457@$!", "oieastasi")
_YOU = frozenset("you your yours yourself u ur tu te toi vous votre vos du dich dir ihr euch dein tú ti usted ustedes vosotros".split())
_KEPT_WORDS = 100_000
# Rows sent back from a worker at once.
SLICE = 256

FEATURES = (
    "strong", "medium", "weak", "total_odds", "highest", "second_highest", "distinct_strong", "near_you", "you",
    "unmasked", "masked", "again", "capitals", "shouted", "exclaimed", "asked", "punctuation", "digits", "n_words_log", "mean_word",
)


def part(key: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4))


def _terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    out = {f"{w}$" for w in words}
    for size in PREFIXES:
        out.update(w[:size] for w in words if len(w) > size)
    return out


def lexicon(learned: DataFrame, terms: int = LEXICON_TERMS) -> dict[str, float]:
    """Log odds by term from ``text`` and ``label``; the driver gets ``terms`` rows."""
    sides = {r["label"]: r["count"] for r in learned.groupBy("label").count().collect()}
    toxic, clean = sides.get(1, 0), sides.get(0, 0)
    if not toxic or not clean:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[label].update(_terms(text or ""))
            for label in (0, 1):
                names = list(found[label])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.string()),
                        pa.array([label] * len(names), pa.int64()),
                        pa.array(list(found[label].values()), pa.int64()),
                    ],
                    ["term", "label", "texts"],
                )

    counted = (
        learned.select("text", "label")
        .mapInArrow(count, "term string, label long, texts long")
        .groupBy("term")
        .agg(
            F.sum(F.when(F.col("label") == 1, F.col("texts")).otherwise(0)).alias("p"),
            F.sum(F.when(F.col("label") == 0, F.col("texts")).otherwise(0)).alias("n"),
        )
        .filter(F.col("p") >= LEAST_TEXTS)
    )
    odds = F.log((F.col("p") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (clean + 1))
    best = (
        counted.withColumn("odds", odds)
        .filter(F.col("odds") >= LEAST_ODDS)
        .orderBy((F.col("odds") * F.sqrt("p")).desc(), "term")
        .limit(terms)
    )
    return {r["term"]: r["odds"] for r in best.collect()}


class _Reader:
    """Features of texts for one lexicon."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds
        self.kept: dict[str, float] = {}

    def value(self, word: str) -> float:
        found = self.kept.get(word)
        if found is None:
            if len(self.kept) > _KEPT_WORDS:
                self.kept.clear()
            get = self.odds.get
            found = max(get(f"{word}$", 0.0), *(get(word[:n], 0.0) for n in PREFIXES if n < len(word)), 0.0)
            self.kept[word] = found
        return found

    def features(self, text: str) -> list[float]:
        lower = text.lower()
        words = _WORD.findall(lower)
        n, chars = len(words), len(text)
        if not chars:
            return [0.0] * len(FEATURES)
        values = np.fromiter(map(self.value, words), dtype=np.float64, count=n)
        hit = np.flatnonzero(values >= 2.5)
        you = [i for i, w in enumerate(words) if w in _YOU]
        near = 0
        if len(hit) and you:
            places = np.array(you)
            at = np.searchsorted(places, hit)
            left = np.abs(hit - places[np.maximum(at - 1, 0)])
            right = np.abs(hit - places[np.minimum(at, len(places) - 1)])
            near = int((np.minimum(left, right) <= NEAR).sum())
        masked = {lower.rfind(" ", 0, m.start()) + 1: m for m in _MASK.finditer(lower)}
        unmasked = 0
        for start in masked:
            word = lower[start:].split(None, 1)[0] if start < len(lower) else ""
            read = _WORD.findall(word.translate(_READ).replace("*", "").replace("#", ""))
            unmasked += any(self.value(w) >= 2.5 for w in read)
        per = 1.0 / max(n, 1)
        top = np.sort(values)[-2:] if n else np.zeros(0)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        kinds = _CLASS[raw]
        capital, small, digit, sign, other, _ = np.bincount(kinds, minlength=6).tolist()
        upper = kinds == 0
        shouts = int((upper[1:] & upper[:-1]).sum() - (upper[2:] & upper[1:-1] & upper[:-2]).sum()) if len(raw) > 2 else 0
        thrice = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (kinds[2:] < 2)
        return [
            len(hit) * per,
            float(((values >= 2.0) & (values < 2.5)).sum()) * per,
            float(((values > 0) & (values < 2.0)).sum()) * per,
            float(values.sum()) * per,
            float(top[-1]) if len(top) else 0.0,
            float(top[0]) if len(top) > 1 else 0.0,
            float(len({words[i] for i in hit.tolist()})),
            near * per,
            len(you) * per,
            unmasked * per,
            len(masked) * per,
            float(thrice.sum()) * per,
            capital / chars,
            shouts * per,
            text.count("!") * per,
            text.count("?") * per,
            sign / chars,
            digit / chars,
            math.log1p(n),
            (capital + small + other) * per,
        ]


def features(docs: DataFrame, odds: dict[str, float], columns: Sequence[str], within: str | None = None) -> DataFrame:
    """``columns`` and the array ``features`` of every row, in the order of FEATURES.

    The text is the column ``text``, or that field of ``within``, one of ``columns``, so that it goes to
    Python once. Texts are read one at a time and rows leave in slices of SLICE.
    """
    sent = docs.sparkSession.sparkContext.broadcast(odds)  # LEXICON_TERMS entries at most
    at = len(columns) if within is None else list(columns).index(within)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(sent.value)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                texts = batch.column(at) if within is None else pc.struct_field(batch.column(at), "text")
                made = [reader.features(x.as_py() or "") for x in texts]
                arrays = [batch.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(made, pa.list_(pa.float64()))], [*columns, "features"])

    wanted = docs.select(*columns, *(["text"] if within is None else []))
    kinds = [f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in columns]
    return wanted.mapInArrow(run, ", ".join([*kinds, "features array<double>"]))


class Model:
    """A fitted lexicon, trees and calibration; without both classes, one score for all."""

    def __init__(self, odds: dict[str, float], trees=None, calibration=None, share: float = 0.0):
        self.odds, self.trees, self.calibration, self.share = odds, trees, calibration, share

    def apply(self, featured: DataFrame) -> DataFrame:
        """Adds ``score`` to rows with ``features``."""
        if self.trees is None:
            return featured.withColumn("score", F.lit(float(self.share)))
        found = self.trees.transform(featured.withColumn("_vector", array_to_vector("features")))
        found = found.withColumn("_raw", vector_to_array("probability")[1])
        found = self.calibration.transform(found)
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("_even") + 0.01 * F.col("_raw")))
        return found.withColumn("score", score).drop("_vector", "rawPrediction", "probability", "prediction", "_raw", "_even")


def _dice(name: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(name), "_id"), F.lit(1 << 20)) / float(1 << 20)


def _sample(known: DataFrame) -> DataFrame:
    """Labelled ids for the lexicon and the trees: about LEXICON_TEXTS of each class and half, and TREE_TEXTS of all."""
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, 2 * LEXICON_TEXTS / n))).otherwise(share)
    trees = min(1.0, TREE_TEXTS / max(1, sum(counts.values())))
    chosen = known.withColumns({"_words": _dice("words") < share, "_trees": _dice("trees") < trees})
    return chosen.filter("_words or _trees")


def fit(docs: DataFrame, labels: DataFrame, held: int | None = 2, key: str = "doc_id", label: str = "toxic") -> Model:
    """Learns from the labelled rows whose part is not ``held``, at most about 4 x LEXICON_TEXTS + TREE_TEXTS of them.

    Those ids, a bounded number, are broadcast to the texts, so no text is shuffled to be found.
    """
    known = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("label")).dropna().dropDuplicates(["_id"])
    if held is not None:
        known = known.filter(part(F.col("_id")) != held)
    known = known.withColumn("_half", F.pmod(F.xxhash64(F.lit("half"), "_id"), F.lit(2)))
    chosen = F.broadcast(materialise(_sample(known), "toxic-ids"))
    labelled = materialise(docs.select(F.col(key).alias("_id"), "text").join(chosen, "_id"), "toxic-texts")
    sample = labelled.filter("_words").dropDuplicates(["text", "label"])
    halves = [lexicon(sample.filter(F.col("_half") == half)) for half in (0, 1)]
    odds = lexicon(sample)
    seen = [
        features(labelled.filter((F.col("_half") == half) & F.col("_trees")), halves[1 - half], ["_id", "label"])
        for half in (0, 1)
    ]
    rows = materialise(seen[0].unionByName(seen[1]), "toxic-features")
    sides = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(sides.values())
    if len(sides) < 2:
        return Model(odds, share=sides.get(1, 0) / total if total else 0.0)
    vectors = rows.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("_vector"))
    trees = GBTClassifier(
        labelCol="label", featuresCol="_vector", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7,
        minInstancesPerNode=max(4, min(20, total // 100)),
    ).fit(vectors)
    raw = trees.transform(vectors).select("label", vector_to_array("probability")[1].alias("_raw"))
    # One weighted row a distinct probability: most rows share a few, which would meet in one task.
    counted = raw.groupBy("_raw").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("_n"))
    even = IsotonicRegression(labelCol="label", featuresCol="_raw", weightCol="_n", predictionCol="_even").fit(counted)
    return Model(odds, trees, even)


def score(docs: DataFrame, model: Model, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``columns`` and ``score`` (0 to 1) of every row, from its whole text."""
    return model.apply(features(docs, model.odds, list(columns))).select(*columns, "score")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, that score below ``threshold``."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own"))
    kept = model.apply(features(own, model.odds, ["__own"], "__own")).filter(F.col("score") < threshold)
    return kept.select("__own.*")
