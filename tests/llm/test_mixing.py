"""Mixing, divergence and resampling against brute force and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import combinations_with_replacement

import pytest

from checks import run
from medstrand.llm import divergence, mixing, queries, resampling
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, step int, budget int, rank int, item string"


def build(spark, data):
    """Documents with columns that clash with names the operators use."""
    return spark.createDataFrame([(i, t, lang, s, 0, "x", 1, 2, 3, "y") for i, t, lang, s in data], DOCS)


def odd_rows():
    return [
        (1, prose(1, 50), "en", "b"), (1, prose(1, 50), "en", "b"), (2, None, "en", "b"), (3, "", None, None), (None, prose(3, 30), "en", None),
        (None, prose(3, 30), "en", None), (None, None, None, "a"), (4, " \n\t", "de", "a"), (5, prose(5, 30_000), "en", "c"),
        (6, "É é x A-b 7", "en", "Z"), (7, prose(7, 40).upper(), "en", "z"), (8, prose(1, 50), "de", "é"), (9, "one", "de", "\U0001F600"),
    ]


def mix_targets(sizes, weights, limit):
    """Exact targets by rounds of sharing."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done, left = {}, Fraction(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in done]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if share[s] > limit * sizes[s]]
        if not above:
            return {**done, **share}
        for s in above:
            done[s] = Fraction(limit * sizes[s])
            left -= done[s]


def mix_checked(data, out, weights=(5, 2, 1), limit=3):
    sizes = Counter()
    for _, t, _, s in data:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    goal = mix_targets(sizes, weights, limit)
    assert len(out) == len(data)
    taken, largest = Counter(), Counter()
    for r in out:
        s = r["source"]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(float(goal[s]), rel=1e-12)
        assert r["taken"] <= limit * r["size"] and r["taken"] % max(r["size"], 1) == 0
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= Fraction(largest[s], 2)
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == sorted(
        (str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, _ in data
    )


def test_mix_of_odd_rows(spark):
    data = odd_rows()
    mix_checked(data, mixing.mix(build(spark, data)).collect())
    assert mixing.mix(build(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(build(spark, [(1, None, "en", None), (2, "", "en", "a")])).collect()] == [0, 0]


def test_targets_of_many_words(spark):
    """Words times a weight are more than an int holds, though the words alone are not."""
    sizes = {"a": 700_000_000, "b": 60_000_000, "c": 500_000_000, None: 800_000_000}
    rows = [((s,), n) for s, n in sizes.items()]
    out = mixing.targets(spark.createDataFrame(rows, "_source struct<source string>, source_size long")).collect()
    want = mix_targets(sizes, (5, 2, 1), 3)
    assert {r["_source"]["source"]: r["target"] for r in out} == {s: float(x) for s, x in want.items()}


def test_mix_tells_copies_apart(spark):
    """A third of one source is taken although its rows agree in id and text."""
    data = [(7, "a b c", "en", "a")] * 300 + [(i, "a b", "en", "b") for i in range(600)] + [(None, f"x{i % 2} y", "en", None) for i in range(50)]
    out = mixing.mix(build(spark, data).repartition(5)).collect()
    mix_checked(data, out)
    again = mixing.mix(build(spark, data).repartition(2)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_larger_budgets_take_what_smaller_ones_take(spark):
    data = [(i, prose(i, 5 + i % 17), "en", "ab"[i % 3 == 0]) for i in range(400)]
    docs = build(spark, data)
    took = []
    for total in (500, 900, 1500, 3000):
        out = mixing.mix(docs, weights=(1,), total=total).collect()
        took.append({r["doc_id"] for r in out if r["taken"]})
        assert abs(sum(r["taken"] for r in out) - total) <= 22
    assert took[0] < took[1] < took[2] < took[3]


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_audit(data, ranks=200):
    langs = {}
    for _, text, lang, source in data:
        langs.setdefault(lang or "", []).append((source or "", Counter(terms_of(text))))
    out = []
    for lang, docs in langs.items():
        df = Counter(t for _, c in docs for t in c)
        kept = [t for t, n in df.items() if n >= 3]
        count = {s: Counter() for s, _ in docs}
        for s, c in docs:
            count[s].update({t: c[t] for t in kept if c[t]})
        whole = sum(count.values(), Counter())
        v = len(kept)

        def share(c, t):
            return 1 + (10**9 * (c[t] + 1)) // (sum(c.values()) + v)

        p = {s: {t: share(c, t) for t in kept} for s, c in count.items()}
        q = {t: share(whole, t) for t in kept}
        for s in count:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in count if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(found if part == "pair" else found[:ranks], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def audited(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def test_audit_matches_brute_force(spark, monkeypatch):
    data = odd_rows() + [(100 + i, prose(i % 9, 4 + i % 40) + f" w{i % 4}x", ["en", "de", None][i % 3], f"s{i % 7}") for i in range(150)]
    docs = build(spark, data)
    assert audited(divergence.audit(docs)) == brute_audit(data)
    assert audited(divergence.audit(docs, ranks=2)) == brute_audit(data, 2)
    assert divergence.audit(build(spark, [])).count() == 0
    lonely = [(i, t, "en", s) for i, (t, s) in enumerate([("a b", "x"), ("a", "y"), ("c", "z")])]
    assert audited(divergence.audit(build(spark, lonely))) == brute_audit(lonely)


def test_tree_shares_beginnings():
    """Equal paths make no new nodes, and corrections are the sums over all rows."""
    zero = {"a": 3, "b": 5, "c": 2}
    rows = [[("a", 10), ("b", 20)], [("a", 10), ("b", 20)], [("a", 10), ("c", 9)], [("b", 6), ("c", 10**9)], [("a", 10), ("b", 20), ("c", 4)]]
    tree, want = divergence.PatternTree(), Counter()
    for row in rows:
        tree.insert([(s, p, zero[s]) for s, p in row], 4)
        for a, pa in row:
            for b, pb in row:
                if a != b:
                    gap = lambda x, y: (x - y) ** 2 // y
                    want[a, b] += 4 * (gap(pa, pb) - gap(pa, zero[b]) - gap(zero[a], pb) + gap(zero[a], zero[b]))
    assert len(tree) == 6
    assert tree.corrections() == dict(want)


def test_small_tables_and_trees_change_nothing(spark, monkeypatch):
    data = [(i, prose(i % 9, 4 + i % 40), "en", f"s{i % 7}") for i in range(100)]
    rows = [[("a", i % 5 + 1, 1), ("b", i % 3 + 1, 1)] for i in range(50)]
    whole, parts = divergence.PatternTree(), Counter()
    for row in rows:
        whole.insert(row, 1)
        part = divergence.PatternTree()
        part.insert(row, 1)
        parts.update(part.corrections())
    assert whole.corrections() == dict(parts)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 7)
    assert all(divergence._terms(t) == Counter(x.encode() for x in terms_of(t)) for _, t, _, _ in data)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def runs_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(data, items, least=20, percent=5, buckets=10_000):
    def counts(texts):
        return Counter(zlib.crc32(x.encode()) % buckets for t in texts for x in runs_of(t))

    s, t = counts(x for _, x, _, _ in data), counts(items)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log(float(t[b] + 1) * (big_s + buckets) / (float(s[b] + 1) * (big_t + buckets)))) for b in range(buckets)
    }
    out = []
    for i, text, _, _ in data:
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in runs_of(text))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(runs_of(text)), weight, score, None, len(words_of(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def resampled(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def test_resample_matches_brute_force(spark, monkeypatch):
    data = odd_rows() + [(100 + i, prose(i % 40, 3 + i % 60), "en", "s") for i in range(400)]
    items = [prose(3, 30), None, "", "É x", prose(12, 9)]
    target = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, bucket int")
    docs = build(spark, data).repartition(7)
    assert resampled(resampling.resample(docs, target)) == brute_resample(data, items)
    assert resampled(resampling.resample(docs, target, 0, 50)) == brute_resample(data, items, 0, 50)
    assert resampled(resampling.resample(docs, target, 0, 100)) == brute_resample(data, items, 0, 100)
    assert resampled(resampling.resample(docs, target.limit(0), 20, 5)) == brute_resample(data, [])
    assert resampling.resample(build(spark, []), target).count() == 0
    few = resampling.resample(build(spark, data[:3]), target).collect()
    assert [r["rank"] for r in few] == [None] * 3


@pytest.mark.parametrize("block", [1, 5, 64])
def test_blocks_change_no_feature(block):
    for text in ("", "a", "a b", "Ab  cd-ef  gh i", prose(4, 200), "x" * 500 + " y z " + "é" * 300):
        got = Counter()
        for _, sums in resampling.features(text, block):
            got.update(sums.tolist())
        assert got == Counter(zlib.crc32(x.encode()) for x in runs_of(text))


@pytest.mark.parametrize("parts", [1, 6])
def test_cutoff_is_the_exact_key(spark, tmp_path, parts):
    keys = sorted((a * 37 % 11, b * 53 % 7, a * 100 + b) for a, b in combinations_with_replacement(range(25), 2))
    path = str(tmp_path / "keys")
    spark.createDataFrame(keys, "a long, b long, c long").repartition(parts).write.parquet(path)
    stored = spark.read.parquet(path)
    for wanted in (1, 2, 20, 163, len(keys) - 1, len(keys), len(keys) + 5):
        assert resampling.cutoff(stored, wanted) == keys[min(wanted, len(keys)) - 1]
    assert resampling.cutoff(stored, 0) is None
    assert resampling.cutoff(stored.limit(0), 3) is None


def test_queries(spark, sf):
    con = run.connect(sf)
    for name in ("op11_mixing", "op12_divergence"):
        text, _, fine = run.compare(spark, con, name, sf)
        assert fine, text
    data = [(r["doc_id"], r["text"], None, None) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert resampled(queries.op13(spark, sf)) == brute_resample(data, items)
