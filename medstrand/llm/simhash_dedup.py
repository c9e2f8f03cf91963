"""SimHash near-duplicates, searched through BK-trees of shards.

A fingerprint bit is set where more than half of the text's shingle hashes set it. Fingerprints are
dealt to shards, each shard's members are put in a BK-tree whose children are keyed by their
Hamming distance to the parent, and a search follows only the edges within the radius. Links found
in a shard are kept as a spanning forest: a member links to each component of its shard that it
touches, so the links of a group grow with its members, not their square, and connect the same.

Shards come in two kinds.

``block_shards``: the 64 bits are cut into ``radius + 2`` blocks, and there is a shard for the bits
of each two blocks. Fingerprints within the radius differ in ``radius`` blocks at most, so they
share a shard: the search is exact.

``band_shards``: for a radius at which blocks would be too short to part anything, a shard is a
band of three smallest shingle hashes; texts whose shingle sets are alike at 0.8 share one of 12
bands in 9,998 of 10,000 cases. The links are then checked against the shingles themselves. That
makes most groups at little cost. Shards whose members are then not all of one group are searched
again without fingerprints, at any distance of these: all their pairs of different groups that are alike are found through
each text's rarest shingles, of which one must be shared, so no pair that shares a band is lost.

The trees of all shards hold all fingerprints, which no broadcast may; each shard's tree is built
in the task its members are shuffled to. Shards with more than SHARD_MEMBERS members (SHARD_TEXTS where
shingles are compared) are divided: members are dealt to slices of half as many, and there is a shard for each two
slices, so that any two members still meet. Where shingles are compared the largest group has slices of its
own, which meet only those of the other groups: a great group of copies with some strays is copied once.
A very long text counts as one member; its shingles take eight bytes a word.

Nulls: a null text is empty, and has the fingerprint zero; to ``deduplicate``, texts without words
are alike only where they are equal. Equal texts and repeated rows share a
fingerprint and so a component. A component whose rows all lack an id has a null id. An empty
table gives no rows. Other columns are left out by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medstrand.llm.graph import components
from medstrand.sources.sinks import materialise

SEED = 42
BITS = 64
SHINGLE_WORDS = 5
LIKENESS = 0.8
# Bits by which texts of LIKENESS differ: about ten expected, eighteen at three deviations.
LIKE_RADIUS = 18
BANDS, BAND_ROWS = 12, 3
# Members and texts of one shard that a task holds at once, on average; more are divided.
SHARD_MEMBERS, SHARD_TEXTS = 1024, 512

_rng = np.random.default_rng(77)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; of all words where there are fewer."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))) + np.arange(len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(words, len(tokens))
    bounds = zip(starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in bounds), dtype=np.uint64, count=len(tokens) - size + 1)


def simhash(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        some = hashes[at : at + 65_536]
        total += np.unpackbits(some.astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(">i8")[0])


def bands(hashes: np.ndarray) -> list[int]:
    """One signed number for each band of smallest permuted hashes; none for a text without words."""
    if not len(hashes):
        return []
    least = np.empty(len(_FACTORS), dtype=np.uint64)
    for i, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS, strict=True)):
        least[i] = (hashes * factor + shift).min()
    joined = least.reshape(BANDS, BAND_ROWS)
    return [
        xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(joined)
    ]


def fingerprint(docs: DataFrame, words: int, columns: list[str], text: str = "text", with_bands: bool = False) -> DataFrame:
    """``columns`` and ``fp``, a signed 64-bit fingerprint; with bands also ``bands``, and of distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = (shingle_hashes(x, words) for x in batch.column(len(columns)).to_pylist())
            if with_bands:
                hashed = map(np.unique, hashed)
            found = [(simhash(h), bands(h) if with_bands else None) for h in hashed]
            out = [batch.column(i) for i in range(len(columns))]
            out.append(pa.array([f for f, _ in found], pa.int64()))
            if with_bands:
                out.append(pa.array([b for _, b in found], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, names)

    wanted = docs.select(*columns, text)
    names = [*columns, "fp"] + ["bands"] * with_bands
    kinds = [f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in columns]
    return wanted.mapInArrow(run, ", ".join([*kinds, "fp long"] + ["bands array<long>"] * with_bands))


class BKTree:
    """Fingerprints by Hamming distance, each with the component it belongs to so far."""

    def __init__(self) -> None:
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        self.parts = 0

    def root_of(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(self, fp: int, radius: int, nearest: bool) -> list[int]:
        """A member of each component within ``radius`` of ``fp``, which then joins them.

        With ``nearest`` it is the component's nearest member. Else the search ends as soon as all
        components are reached.
        """
        prints, children = self.prints, self.children
        best: dict[int, tuple[int, int]] = {}
        if prints:
            stack = [0]
            limit = radius
            while stack:
                at = stack.pop()
                apart = (fp ^ prints[at]).bit_count()
                if apart <= limit:
                    part = self.root_of(at)
                    if part not in best or apart < best[part][0]:
                        best[part] = (apart, at)
                    if len(best) == self.parts:
                        if not nearest:
                            break
                        if self.parts == 1:
                            limit = apart
                low, high = apart - limit, apart + limit
                stack.extend(child for edge, child in children[at].items() if low <= edge <= high)
        new = len(prints)
        self._insert(fp)
        links = [at for _, at in best.values()]
        for at in links:
            self.parent[self.root_of(at)] = new
        self.parts += 1 - len(links)
        return links

    def _insert(self, fp: int) -> None:
        new = len(self.prints)
        if new:
            at = 0
            while True:
                apart = (fp ^ self.prints[at]).bit_count()
                below = self.children[at].get(apart)
                if below is None:
                    self.children[at][apart] = new
                    break
                at = below
        self.prints.append(fp)
        self.children.append({})
        self.parent.append(new)


def block_shards(fp: Column, radius: int) -> Column:
    """Array of shard numbers: a hash of the bits of each two of ``radius + 2`` blocks."""
    count = radius + 2
    edges = [BITS * i // count for i in range(count + 1)]

    def block(i: int) -> Column:
        mask = (1 << (edges[i + 1] - edges[i])) - 1
        return F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit(mask).cast("long"))

    return F.array(*[F.xxhash64(F.lit(a), F.lit(b), block(a), block(b)) for a, b in combinations(range(count), 2)])


def divided(members: DataFrame, most: int) -> DataFrame:
    """``members`` with shards of more than ``most`` in their place divided, so that any two of one shard meet in one."""
    counts = members.groupBy("shard").count().filter(F.col("count") > most)
    hot = materialise(counts.select("shard", F.ceil(F.col("count") / (most / 2)).cast("int").alias("_of")), "hot_shards")
    own = F.pmod(F.xxhash64("node"), F.col("_of")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("_of") - 1), lambda i: i != own)
    meetings = F.transform(others, lambda i: F.xxhash64("shard", F.least(i, own), F.greatest(i, own)))
    shards = F.when(F.col("_of").isNull(), F.array("shard")).otherwise(meetings)
    kept = [c for c in members.columns if c != "shard"]
    return members.join(hot, "shard", "left").select(*kept, F.explode(shards).alias("shard"))


def divided_by_group(members: DataFrame, most: int) -> DataFrame:
    """The same for members that only meet those of another ``root``; the largest one's slices meet all others."""
    half = most / 2
    sizes = members.groupBy("shard", "root").count()
    totals = sizes.groupBy("shard").agg(
        F.sum("count").alias("_all"), F.max(F.struct("count", "root")).alias("_top")
    ).filter(F.col("_all") > most)
    hot = materialise(
        totals.select(
            "shard",
            F.col("_top.root").alias("_largest"),
            F.ceil(F.col("_top.count") / half).cast("int").alias("_large"),
            F.ceil((F.col("_all") - F.col("_top.count")) / half).cast("int").alias("_rest"),
        ),
        "hot_shards",
    )
    in_largest = F.col("root") == F.col("_largest")
    own = F.pmod(F.xxhash64("node"), F.when(in_largest, F.col("_large")).otherwise(F.col("_rest"))).cast("int")
    large, rest = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("_large", "_rest"))
    with_rest = F.transform(rest, lambda i: F.xxhash64("shard", F.lit("largest"), i, own))
    with_largest = F.transform(large, lambda i: F.xxhash64("shard", F.lit("largest"), own, i))
    others = F.transform(
        F.filter(rest, lambda i: i != own), lambda i: F.xxhash64("shard", F.lit("rest"), F.least(i, own), F.greatest(i, own))
    )
    shards = (
        F.when(F.col("_largest").isNull(), F.array("shard"))
        .when(in_largest, with_rest)
        .otherwise(F.concat(with_largest, others))
    )
    kept = [c for c in members.columns if c != "shard"]
    return members.join(hot, "shard", "left").select(*kept, F.explode(shards).alias("shard"))


def shard_links(members: DataFrame, radius: int, nearest: bool) -> DataFrame:
    """Distinct links ``a``, ``b`` between nodes of one shard.

    ``members`` has ``shard``, ``fp`` and ``node``. A shard's members come to one task in order and
    leave it as they pass; the task holds one shard's tree. Shards of one member cost nothing.
    """
    kind = members.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, tree, nodes = None, BKTree(), []
        waiting = None  # the first member of a shard, until a second one comes
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(0).to_numpy()
            fps = batch.column(1).cast(pa.int64()).to_numpy().view(np.uint64)
            node = batch.column(2)
            new = np.ones(len(shard), dtype=bool)
            new[1:] = shard[1:] != shard[:-1]
            new[0] = shard[0] != open_shard
            ends = np.append(new[1:], False)
            alone = new & ends
            a, b = [], []
            for i in np.flatnonzero(~alone).tolist():
                if new[i]:
                    tree, nodes, waiting = BKTree(), [], None
                elif waiting is not None:
                    tree.link(waiting[0], radius, nearest)
                    nodes.append(waiting[1])
                    waiting = None
                value, fp = node[i].as_py(), int(fps[i])
                if new[i]:
                    waiting = (fp, value)
                    continue
                for at in tree.link(fp, radius, nearest):
                    a.append(value)
                    b.append(nodes[at])
                nodes.append(value)
            open_shard = shard[-1]
            yield pa.RecordBatch.from_arrays([pa.array(a, node.type), pa.array(b, node.type)], ["a", "b"])

    dealt = members.select("shard", "fp", "node").repartition("shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, key: str = "doc_id") -> DataFrame:
    """``key``, ``fp`` and ``component_id`` of every row: all fingerprints within ``radius`` are linked."""
    prints = materialise(fingerprint(docs, words, [key]), "fingerprints")
    members = materialise(prints.groupBy("fp").agg(F.min(key).alias("_least")), "members")
    shards = members.select(F.col("fp").alias("node"), "fp", F.explode(block_shards(F.col("fp"), radius)).alias("shard"))
    roots = components(shard_links(divided(shards, SHARD_MEMBERS), radius, nearest=False)).withColumnRenamed("node", "fp")
    rooted = members.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(key, "fp", "component_id")


def _alike(pairs: DataFrame, words: int, likeness: float) -> DataFrame:
    """Pairs ``a``, ``b`` whose texts' distinct shingles have a Jaccard likeness of ``likeness`` or more."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.unique(shingle_hashes(one, words)), np.unique(shingle_hashes(other, words))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= likeness * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return pairs.select("a", "b", "a_text", "b_text").mapInArrow(run, f"a {kind}, b {kind}")


def digest(text: Column) -> Column:
    """Checksum by which equal texts are one; a null text is empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def alike_links(sets: list[np.ndarray], groups: list, likeness: float) -> list[tuple[int, int]]:
    """Pairs of a shard's members that, with ``groups``, connect all whose distinct shingles are alike.

    Sets of n shingles that are alike at ``likeness`` have ``likeness * n`` in common at least, so each
    has one of those among its ``n - likeness * n + 1`` rarest; only these are indexed. Members of the
    largest group are only searched for.
    """
    number: dict = {}
    own = np.array([number.setdefault(g, len(number)) for g in groups])
    largest = np.bincount(own).argmax()
    order = np.argsort(own != largest, kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    _, inverse, counts = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), dtype=np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ranked = rank[inverse]
    members = [np.sort(ranked[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    heads = [m[: len(m) - int(np.ceil(likeness * len(m) - 1e-9)) + 1] for m in members]
    keys = np.concatenate(heads)
    holders = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
    by_key = np.argsort(keys, kind="stable")
    keys, holders = keys[by_key], holders[by_key]
    parent = list(range(len(number)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    part = own[order].tolist()
    marks = np.zeros(len(counts), dtype=bool)
    out = []
    for x in range(int((own == largest).sum()), len(members)):
        low, high = np.searchsorted(keys, heads[x]), np.searchsorted(keys, heads[x], side="right")
        reach = high - low
        at = np.repeat(low - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
        others = np.unique(holders[at])
        others = others[(others < x) & (np.minimum(sizes[others], sizes[x]) >= likeness * np.maximum(sizes[others], sizes[x]) - 1e-9)]
        marks[members[x]] = True
        while len(others):
            mine = find(part[x])
            others = others[[find(part[y]) != mine for y in others.tolist()]]
            some, others = others[:256], others[256:]
            if not len(some):
                break
            starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            both = np.add.reduceat(marks[np.concatenate([members[y] for y in some])].astype(np.int64), starts)
            for y in some[both >= likeness * (sizes[x] + sizes[some] - both)].tolist():
                if find(part[x]) != find(part[y]):
                    parent[find(part[y])] = find(part[x])
                    out.append((int(order[x]), int(order[y])))
        marks[members[x]] = False
    return out


def mixed_links(members: DataFrame, words: int, likeness: float) -> DataFrame:
    """Links ``a``, ``b`` between members of a shard and of different groups that are alike.

    ``members`` has ``shard``, ``node``, its group's ``root`` and ``text``.
    """
    kind = members.schema["node"].dataType.simpleString()

    def linked(nodes: list, roots: list, sets: list[np.ndarray], like: pa.DataType) -> pa.RecordBatch:
        found = alike_links(sets, roots, likeness) if len(set(roots)) > 1 else []
        ends = [pa.array([nodes[pair[i]] for pair in found], like) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, held = None, ([], [], [])
        like = pa.binary()
        for batch in batches:
            like = batch.column(1).type
            for shard, node, root, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                if shard.as_py() != open_shard:
                    yield linked(*held, like)
                    open_shard, held = shard.as_py(), ([], [], [])
                held[0].append(node.as_py())
                held[1].append(root.as_py())
                held[2].append(np.unique(shingle_hashes(text.as_py(), words)))
        yield linked(*held, like)

    dealt = members.select("shard", "node", "root", "text").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _texts(docs: DataFrame, members: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``digest`` and ``text`` of the wanted digests, one row each."""
    wanted = wanted.join(members.select("digest", "_least"), "digest").withColumnRenamed("digest", "_wanted")
    same = (F.col("digest") == F.col("_wanted")) & F.col("_key").eqNullSafe(F.col("_least"))
    own = docs.select("digest", F.col(key).alias("_key"), "text")
    return own.join(wanted, same).select("digest", "text").dropDuplicates(["digest"])


def like_groups(
    docs: DataFrame, words: int = SHINGLE_WORDS, likeness: float = LIKENESS, radius: int = LIKE_RADIUS, key: str = "doc_id"
) -> DataFrame:
    """``digest``, its smallest ``key`` and its group's ``root`` digest, one row for each distinct text.

    ``docs`` must hold ``digest``, a checksum of the text. Exact copies are one member throughout.
    """
    columns = ["digest", key]
    prints = materialise(fingerprint(docs, words, columns, with_bands=True), "fingerprints")
    members = materialise(
        prints.groupBy("digest").agg(F.min(key).alias("_least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")),
        "members",
    )
    shards = members.select(F.col("digest").alias("node"), "fp", F.explode("bands").alias("shard"))
    links = materialise(shard_links(divided(shards, SHARD_MEMBERS), radius, nearest=True), "links")
    ends = links.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    # One row of each text that has a link.
    texts = materialise(_texts(docs, members, ends, key), "texts")
    paired = links.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("a_text")), "a").join(
        texts.select(F.col("digest").alias("b"), F.col("text").alias("b_text")), "b"
    )
    roots = components(_alike(paired, words, likeness).distinct()).withColumnRenamed("node", "digest")
    # Shards in which groups are left that may still be alike.
    rooted = members.select("digest", "bands").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    banded = materialise(rooted.select("digest", "root", F.explode("bands").alias("shard")), "banded")
    several = banded.groupBy("shard").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high")
    mixed = materialise(banded.join(several.select("shard"), "shard"), "mixed")
    texts = materialise(_texts(docs, members, mixed.select("digest").distinct(), key), "texts")
    dealt = divided_by_group(mixed.withColumnRenamed("digest", "node"), SHARD_TEXTS)
    rest = mixed_links(dealt.join(texts.withColumnRenamed("digest", "node"), "node"), words, likeness)
    joined = roots.select(F.col("digest").alias("a"), F.col("root").alias("b")).unionByName(rest)
    roots = components(joined).withColumnRenamed("node", "digest")
    return members.select("digest", "_least").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))


def deduplicate(docs: DataFrame, words: int = SHINGLE_WORDS, likeness: float = LIKENESS, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that stay: of each group of like texts the one with the smallest ``key``.

    A null key counts as larger than any other; of repeated rows with that key one stays.
    """
    narrow = docs.select(F.col(key), "text", digest(F.col("text")).alias("digest"))
    groups = materialise(like_groups(narrow, words, likeness, key=key), "groups")
    winners = groups.groupBy("root").agg(
        F.min(F.struct(F.col("_least").isNull(), F.col("_least"), F.col("digest"))).alias("_first")
    )
    winners = winners.select(F.col("_first.digest").alias("__digest"), F.col("_first._least").alias("__key"))
    marked = docs.withColumn("__own", digest(F.col("text")))
    here = (marked["__own"] == winners["__digest"]) & marked[key].eqNullSafe(winners["__key"])
    kept = marked.join(winners, here, "left_semi")
    # A digest and key in several rows: only then is another look at the kept rows needed.
    if not narrow.groupBy("digest", key).count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["__own"])
    return kept.drop("__own")
