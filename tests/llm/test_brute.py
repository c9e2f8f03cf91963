"""Sharding and the two classifiers against their methods in plain Python."""

import math
import re
import struct
from bisect import bisect_right

import pytest
import xxhash
from pyspark.sql import functions as F

from medstrand.llm import quality, queries, sharding, substring_dedup, toxicity
from tests.llm.conftest import WORDS, prose


def drawn(node, key):
    """The shard that a descent by the largest weighted draw reaches, or None below a node without weight."""

    def weight(x):
        return sum(map(weight, x.values())) if isinstance(x, dict) else float(x)

    name = ""
    while isinstance(node, dict):
        best = None
        for child, below in node.items():
            if weight(below) <= 0:
                continue
            path = f"{name}/{child}"
            h = xxhash.xxh64_intdigest(path.encode(), seed=42)
            if key is not None:
                h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=h)
            draw = math.log(((h >> 11) + 1) / 2.0**53) / weight(below)
            best = max(best or (-math.inf, ""), (draw, path, below), key=lambda x: x[:2])
        name, node = best[1], best[2]
    return int(name.rsplit("/", 1)[1])


UNEVEN = {"a": {"x": {0: 1.0, 1: 0.0, 2: 2.5}, "y": {3: 0.0}}, "b": {"z": {4: 0.5, 5: 4.0}}, "c": {"w": {6: 0.0}}}


@pytest.mark.parametrize("layout", [sharding.tree(40), sharding.grow(sharding.tree(40)), sharding.tree(5, 3, 2), UNEVEN])
def test_shards_are_where_a_descent_ends(spark, layout):
    keys = spark.range(400).select(F.when(F.col("id") > 0, (F.col("id") - 200) * 1_000_003).alias("k"))
    for r in keys.select("k", sharding.shard_of(F.col("k"), layout).alias("s")).collect():
        assert r["s"] == drawn(layout, r["k"]), r["k"]


def test_op10(spark, sf):
    layout = sharding.tree(queries.SHARDS)
    for r in queries.op10(spark, sf).collect():
        assert (r["shard"], r["grown_shard"]) == (drawn(layout, r["doc_id"]), drawn(sharding.grow(layout), r["doc_id"]))


def labelled_docs(make, spark, bad):
    """Texts of two kinds, some empty or very long, and labels of most of them."""
    texts = [(i, prose(i % 40, 20 + i % 50) + (f" {bad} {i % 7} !!! {bad}" if i % 3 == 0 else ".")) for i in range(300)]
    odd = [(300, None), (301, ""), (302, prose(9, 40_000)), (303, f"{bad} " * 5000), (304, "é"), (304, "é"), (None, f"you {bad}")]
    labels = [(i, int(i % 3 == 0), int(i % 3 != 0)) for i in range(290)] + [(302, 0, 1), (303, 1, 0), (999, 1, 0), (None, 1, 1), (5, 0, 1)]
    return make(texts + odd), dict(texts + odd), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_quality_scores_are_the_rules_sum(spark, make):
    docs, _, labels = labelled_docs(make, spark, "spam|x")
    found = quality.with_statistics(docs, ["doc_id", "text"])
    ensemble = quality.fit(found, labels)
    assert ensemble.rules and quality.score(found.limit(0), ensemble).count() == 0
    for r in quality.score(found, ensemble, ["doc_id", "text"]).collect():
        values = quality.statistics(r["text"])
        total = ensemble.intercept + sum(values[i] * w for i, w in ensemble.linear)
        for rule, weight in ensemble.rules:
            if all(values[i] <= x if below else values[i] > x for i, below, x in rule):
                total += weight
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def leaf(tree, values):
    """The prediction a printed tree gives: the first line of each depth whose test holds."""
    depth = None
    for line in tree:
        m = re.match(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        p = re.match(r"^( *)Predict: (\S+)", line)
        at = len((m or p)[1])
        if depth is not None and at > depth:
            continue
        if p:
            return float(p[2])
        i, bound = int(m[3]), float(m[5])
        holds = values[i] <= bound if m[4] == "<=" else values[i] > bound
        depth = None if holds else at


def test_toxicity_scores_are_the_trees_sum(spark, make):
    docs, _, labels = labelled_docs(make, spark, "you stupidword1")
    model = toxicity.fit(docs, labels)
    seen = toxicity.features(docs, model.odds, ["doc_id"])
    assert model.trees is not None and toxicity.score(docs.limit(0), model).count() == 0
    parts = re.split(r"Tree \d+ \(weight ([\d.]+)\):\n", model.trees.toDebugString)[1:]
    trees = [(float(w), [x for x in t.split("\n") if "feature" in x or "Predict" in x]) for w, t in zip(parts[::2], parts[1::2], strict=True)]
    bounds = model.calibration.boundaries.toArray().tolist()
    levels = model.calibration.predictions.toArray().tolist()

    def even(x):
        at = bisect_right(bounds, x)
        if at == 0 or at == len(bounds):
            return levels[0 if at == 0 else -1]
        a, b = bounds[at - 1], bounds[at]
        return levels[at - 1] + (levels[at] - levels[at - 1]) * (x - a) / (b - a)

    for r in model.apply(seen).collect():
        margin = sum(w * leaf(t, r["features"]) for w, t in trees)
        raw = 1 / (1 + math.exp(-2 * margin))
        assert r["score"] == pytest.approx(min(1.0, max(0.0, 0.99 * even(raw) + 0.01 * raw)), abs=1e-9)


def test_calibration_on_counts_is_calibration_on_rows(spark):
    """Weighted rows of distinct probabilities give the steps that all rows give."""
    from pyspark.ml.regression import IsotonicRegression

    rows = spark.range(500).select(((F.col("id") * 7 % 10) / 10.0).alias("x"), ((F.col("id") % 10 * 7 + F.col("id") % 3) % 10 > 4).cast("double").alias("label"))
    counted = rows.groupBy("x").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("n"))
    plain = IsotonicRegression(labelCol="label", featuresCol="x").fit(rows)
    weighted = IsotonicRegression(labelCol="label", featuresCol="x", weightCol="n").fit(counted)
    shown = [m.transform(counted.select("x")).orderBy("x").collect() for m in (plain, weighted)]
    assert [r["prediction"] for r in shown[0]] == pytest.approx([r["prediction"] for r in shown[1]], abs=1e-9)


def held_before(texts, least=50):
    """Words of each text, in order of id, in runs of ``least`` words that an earlier text holds."""
    first, out = {}, {}
    for i, text in sorted(texts):
        words, hit = text.split(), set()
        for at in range(len(words) - least + 1):
            run = tuple(words[at : at + least])
            if first.setdefault(run, i) != i:
                hit.update(range(at, at + least))
        out[i] = hit
    return out


def repeating(seed):
    """A stretch that says one to three words over and over, longer or shorter by the seed."""
    x, n = seed * 48271 % 65_537, 1 + seed % 3
    said = [WORDS[(x + 7 * k) % 20] for k in range(n)]
    return " ".join((said * 100)[: 30 + x % 170])


def test_exact_runs_are_found_word_by_word(make):
    """Passages, frequent phrases that others held first, and stretches that repeat themselves, of many lengths."""
    frequent = [prose(900 + k, 9 + k) for k in range(6)]
    texts = []
    for i in range(160):
        parts = [prose(i, 30 + i % 40)]
        if i % 2:
            parts.append(prose(2000 + i % 11, 60 + 13 * (i % 5)))
        if i % 3 == 0:
            parts.append(" ".join(frequent[(i + k) % 6] for k in range(5)))
        if i % 4 < 2:
            parts.append(repeating(i % 24))
        if i % 5 == 0:
            parts.append(repeating(i % 16) + " " + repeating(i % 7))
        parts.append(prose(5000 + i, 20))
        texts.append((i, " ".join(parts)))
    want, got = held_before(texts), {}
    for r in substring_dedup.passages(make(texts)).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    missed = {i: sorted(hit - got.get(i, set())) for i, hit in want.items() if hit - got.get(i, set())}
    total = sum(map(len, want.values()))
    assert total > 5000 and sum(map(len, missed.values())) <= 0.001 * total, missed
