"""Decontamination, fingerprints, near-duplicates and passages against brute force."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from checks import run
from medstrand.llm import decontaminate, fingerprints, graph, queries, simhash_dedup, substring_dedup
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, _row int, terms string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(docs, items):
    out = []
    for key, text in docs:
        own, hit, found = words(text), set(), set()
        for item, phrase in items:
            listed = words(phrase)
            n = min(10, len(listed))
            for j in range(len(listed) - n + 1 if n else 0):
                for i in range(len(own) - n + 1):
                    if own[i : i + n] == listed[j : j + n]:
                        hit.update(range(i, i + n))
                        found.add("" if item is None else str(item))
        out.append((key, len(own), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


def test_hits_match_brute_force(spark, make):
    items = [(1, prose(50, 30)), (2, prose(51, 4)), (2, prose(51, 4)), (10, prose(50, 12)), (None, prose(52, 11)), (4, None), (5, ""), (6, "!!")]
    docs = [
        (1, prose(60, 20) + " " + prose(50, 30)), (2, prose(51, 4).upper()), (3, None), (4, ""), (None, "x " + prose(52, 11) + "."),
        (5, " ".join(prose(50, 30).split()[:9])), (6, (prose(51, 4) + ", ") * 40), (6, (prose(51, 4) + ", ") * 40),
        (7, "é" + prose(50, 30)), (8, prose(5, 20_000) + " " + prose(50, 15)),
    ]
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in items], ITEMS)
    got = decontaminate.hits(make(docs), df).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got), key=str) == brute_hits(docs, items)
    kept = decontaminate.decontaminate(make(docs), df)
    assert kept.columns == make(docs).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]


def test_decontamination_of_nothing(spark, none, odd):
    empty = spark.createDataFrame([], ITEMS)
    assert decontaminate.hits(none, empty).count() == 0
    assert decontaminate.decontaminate(odd, empty).count() == 12
    assert decontaminate.hits(none, spark.createDataFrame([(1, prose(1, 20), 1, "y")], ITEMS)).count() == 0


def test_proximity_is_order_free(spark, make):
    phrase = prose(70, 10)
    mixed = " ".join(reversed(phrase.split()))
    spread = phrase.replace(" ", " und ", 2)
    far = " ".join(phrase.split()[:5]) + " " + "und " * 60 + " ".join(phrase.split()[5:])
    items = spark.createDataFrame([(1, phrase, 1, "y")], ITEMS)
    found = decontaminate.proximity(make([(1, mixed), (2, spread), (3, far), (4, phrase)]), items, slack=4)
    assert {r["doc_id"] for r in found.collect()} == {1, 2, 4}


@pytest.mark.parametrize("name", ["op1_decontaminate", "op7_chat"])
def test_sql(spark, sf, name):
    text, _, fine = run.compare(spark, run.connect(sf), name, sf)
    assert fine, text


def brute_print(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(" ".join(own[j : j + 4]).encode(), seed=42) for j in range(max(1, len(own) - 3))] if own else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    least = {}
    prints = [p for _, p in pairs]
    parent = list(range(len(pairs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(pairs)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            parent[find(j)] = find(i)
    for i, (key, _) in enumerate(pairs):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [least.get(find(i)) for i in range(len(pairs))]


@pytest.fixture(params=[None, 4])
def most(request, monkeypatch):
    """Shards as they are, and all but the smallest of them divided."""
    if request.param:
        monkeypatch.setattr(simhash_dedup, "SHARD_MEMBERS", request.param)
        monkeypatch.setattr(simhash_dedup, "SHARD_TEXTS", request.param)


def test_divided_shards_let_any_two_members_meet(spark):
    rows = [(s, n, n // 60 if s else n % 3) for s, size in ((0, 40), (1, 75), (2, 5)) for n in range(size)]
    members = spark.createDataFrame(rows, "shard long, node long, root long")
    for found, all_pairs in ((simhash_dedup.divided(members, 10), True), (simhash_dedup.divided_by_group(members, 10), False)):
        shards = {}
        for r in found.collect():
            shards.setdefault(r["shard"], set()).add((r["node"], r["root"]))
        met = {pair for held in shards.values() for pair in combinations(sorted(held), 2)}
        assert max(map(len, shards.values())) < 30 and set(shards) >= {2}
        for size, root in ((40, lambda n: n % 3), (75, lambda n: n // 60)):
            for a, b in combinations(range(size), 2):
                assert ((a, root(a)), (b, root(b))) in met or not all_pairs and root(a) == root(b)


def test_components_match_brute_force(make, most):
    base = prose(3, 300).split()
    texts = [(i, " ".join(base[: 280 + i % 20])) for i in range(60)] + [(100 + i, prose(i + 10, 90)) for i in range(30)]
    texts += [(None, prose(3, 300)), (None, "lone"), (7, None), (8, ""), (9, "a b"), (9, "a b"), (11, "A\x0bB")]
    pairs = [(i, brute_print(t)) for i, t in texts]
    want = sorted(zip((i for i, _ in pairs), (f"{p:016x}" for _, p in pairs), brute_components(pairs), strict=True), key=str)
    got = simhash_dedup.near_duplicates(make(texts)).collect()
    assert sorted(((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got), key=str) == want


def test_tree_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    prints = [centre ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(60)]
    prints += [int(x) for x in rng.integers(0, 1 << 62, 60)]
    tree, edges = simhash_dedup.BKTree(), []
    for i, p in enumerate(prints):
        edges += [(i, j) for j in tree.link(p, 4, False)]
    assert len(edges) < len(prints) and all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in edges)
    roots = [tree.root_of(i) for i in range(len(prints))]
    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            assert roots[i] == roots[j]


def test_long_chain_of_edges_is_one_component(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").unionByName(spark.createDataFrame([(500, 501), (7, 7)], "a long, b long"))
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}
    assert graph.components(edges.limit(0)).count() == 0


def test_deduplicate_keeps_one_of_each_group(make):
    base = prose(3, 200).split()
    near = base[:100] + ["changed"] + base[101:]
    texts = [(3, " ".join(base)), (2, " ".join(near)), (9, " ".join(base)), (4, prose(4, 200)), (None, prose(4, 200)), (5, None), (6, "")]
    texts += [(7, prose(8, 50)), (7, prose(8, 50)), (None, "alone"), (8, " ".join(base[:100] + prose(99, 100).split()))]
    kept = simhash_dedup.deduplicate(make(texts))
    assert kept.columns == make(texts).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 4, 5, 7, 8, None]


def test_dedup_of_odd_tables(odd, none):
    assert simhash_dedup.near_duplicates(none).count() == 0 and simhash_dedup.deduplicate(none).count() == 0
    assert simhash_dedup.near_duplicates(odd).count() == 12
    assert sorted((r["doc_id"] for r in simhash_dedup.deduplicate(odd).collect()), key=str) == [1, 2, 4, 6, 7, 8, 8, None]


def test_edit_study_matches_brute_force(make):
    texts = [(i * 3, prose(i, i * 5)) for i in range(40)] + [(1, None), (2, "é" * 7)]
    got = {r["doc_id"]: r for r in fingerprints.edit_study(make(texts)).collect()}
    order = sorted(((i, t or "") for i, t in texts), reverse=True)
    for (key, own), (_, other) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(own) // 3
        edited = own[: len(own) - cut] + other[:cut]
        assert got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[key]["n_chars"] == len(own)
        prints = fingerprints.fingerprints(pa.array([own, edited, other]))
        assert fingerprints.as_hex(prints)[:2] == [got[key]["fingerprint"], got[key]["edited_fingerprint"]]
        assert got[key]["near_edited"] == pytest.approx(fingerprints.likeness(prints[:1], prints[1:2])[0])
        assert got[key]["near_next"] == pytest.approx(fingerprints.likeness(prints[:1], prints[2:])[0])


def test_fingerprints_of_odd_tables(odd, none):
    assert fingerprints.edit_study(none).count() == 0
    assert fingerprints.edit_study(odd).count() == 12
    by_text = {}
    for key, value in ((r["doc_id"], r["fingerprint"]) for r in fingerprints.fingerprint_documents(odd).collect()):
        by_text.setdefault(key, set()).add(value)
    assert by_text[1] == by_text[5] and by_text[2] == by_text[3] == by_text[4] == {"0" * 32}


def test_block_tables_find_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 20)]
    prints = [f"{x:016x}{x ^ sum(1 << int(b) for b in rng.choice(60, k, replace=False)):016x}" for x in base for k in range(6)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    got = {(r["a"], r["b"]) for r in fingerprints.pairs_within(df, 3, 6).collect()}
    want = {tuple(sorted((p, q))) for p, q in combinations(set(prints), 2) if (int(p, 16) ^ int(q, 16)).bit_count() <= 3}
    assert got == want and want


def test_passages_are_found_and_cut(make):
    shared, other = prose(200, 70), prose(201, 60)
    fuzzy = shared.split()
    fuzzy[35] = "changed"
    texts = [
        (1, prose(1, 40) + " " + shared + ". " + prose(2, 30)), (2, shared + "\n" + prose(3, 90)), (3, prose(4, 25) + " " + " ".join(fuzzy)),
        (4, prose(5, 100)), (5, other), (6, other), (6, other), (7, None), (8, ""), (9, prose(6, 40) + " " + " ".join(shared.split()[:30])),
    ]
    found = substring_dedup.passages(make(texts))
    got = {r["doc_id"]: (r["start"], r["n_words"], list(r["first_docs"])) for r in found.collect()}
    assert got[2] == (0, 70, [1]) and got[6] == (0, 60, [5])
    assert set(got) == {2, 3, 6} and got[3][0] == 25 and got[3][1] >= 69
    kept = substring_dedup.cut(make(texts), found)
    assert kept.columns == make(texts).columns
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(left) == {1, 2, 3, 4, 5, 7, 8, 9} and left[2] == prose(3, 90) and left[1] == texts[0][1] and left[7] is None


def test_passages_of_odd_tables(odd, none):
    assert substring_dedup.passages(none).count() == 0
    found = substring_dedup.passages(odd)
    assert {r["doc_id"] for r in found.collect()} == {5, 8}
    assert substring_dedup.cut(odd, found).count() == 10
    assert substring_dedup.cut(none, found).count() == 0


def test_chain_takes_matches_in_order():
    xs, ys = [0, 10, 20, 30, 40], [100, 110, 5, 131, 141]
    parts = substring_dedup.chain(xs, ys)
    assert parts[0] == [0, 1, 3, 4] and parts[1] == [2]
    assert substring_dedup.chain([0, 10, 500], [0, 10, 500]) in ([[0, 1], [2]], [[0, 1], [2]])


def shingles(text, n=5):
    listed = text.lower().split()
    return {" ".join(listed[i : i + n]) for i in range(max(1, len(listed) - n + 1))}


def like_components(texts):
    """Group of each text: all pairs at 0.8 or more are linked."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            parent[find(j)] = find(i)
    return [find(i) for i in range(len(texts))]


def test_families_around_the_likeness_match_brute_force(make, most):
    rng = np.random.default_rng(4)
    texts = []
    for family in range(4):
        base = prose(300 + family, 200).split()
        for _ in range(60):
            copy = list(base)
            for at in rng.choice(200, int(rng.integers(2, 9)), replace=False):
                copy[at] = f"edit{rng.integers(1 << 30)}"
            texts.append(" ".join(copy))
    docs = make(list(enumerate(texts)))
    narrow = docs.select("doc_id", "text", simhash_dedup.digest(docs["text"]).alias("digest"))
    got = {r["_least"]: bytes(r["root"]) for r in simhash_dedup.like_groups(narrow).collect()}
    want = like_components(texts)
    pairs = list(combinations(range(len(texts)), 2))
    assert [got[i] == got[j] for i, j in pairs] == [want[i] == want[j] for i, j in pairs]
    assert 4 < len(set(want)) < len(texts)


def test_repeated_lines_do_not_part_like_texts(make):
    texts = []
    for i in range(6):
        body, line = prose(400 + i, 400), f" line{i} " + prose(500 + i, 15)
        texts += [(10 * i, body + line), (10 * i + 1, body + line * 20), (10 * i + 2, body + line * 50)]
    kept = simhash_dedup.deduplicate(make(texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == [10 * i for i in range(6)]


def test_chain_finds_a_second_passage_after_a_long_one():
    first = list(range(0, 120, 8))
    second = [220, 231, 240, 252, 263, 271, 280]
    xs = first + second
    ys = [x + 1000 for x in first] + [x + 1030 + (x > 250) * 4 for x in second]
    parts = substring_dedup.chain(xs, ys)
    assert sorted(parts) == [list(range(15)), list(range(15, 22))]


def test_passages_whose_seeds_others_held_first(make):
    shared = prose(600, 56).split()
    # Every document before the holder has twenty words of the passage, none has fifty.
    texts = [(i, prose(610 + i, 30) + " " + " ".join(shared[at : at + 20]) + " " + prose(640 + i, 30)) for i, at in enumerate(range(0, 40, 4))]
    texts += [(50, prose(700, 40) + " " + " ".join(shared) + " " + prose(701, 40)), (60, prose(702, 33) + " " + " ".join(shared) + " " + prose(703, 30))]
    got = {r["doc_id"]: (r["start"], r["n_words"], list(r["first_docs"])) for r in substring_dedup.passages(make(texts)).collect()}
    assert 50 in got[60][2] and got[60][0] <= 33 and got[60][0] + got[60][1] >= 89


def test_lines_of_several_documents_are_no_passage(make):
    lines = [prose(800 + i, 30) for i in range(4)]
    texts = [(i, prose(810 + i, 40) + "\n" + line + "\n" + prose(820 + i, 40)) for i, line in enumerate(lines)]
    texts += [(10, "\n".join(lines)), (11, prose(830, 20) + "\n" + lines[2] + "\n" + lines[0]), (12, lines[1] + " " + lines[2])]
    got = {r["doc_id"]: (r["start"], r["n_words"], list(r["first_docs"])) for r in substring_dedup.passages(make(texts)).collect()}
    # Only 12 holds 60 words as an earlier document, 10, has them in a run.
    assert set(got) == {12} and got[12][:2] == (0, 60) and 10 in got[12][2]
