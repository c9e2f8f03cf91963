"""How sources of one language differ in their words, pair by pair and term by term.

Each language keeps the terms of at least three of its documents. A group, a language and source,
gives each kept term a share in billionths, one added to every count; the divergence of two groups is
the sum over all kept terms of the squared difference of their shares over the other's share.

A term is a row: its counts other than zero, by source in order. Rows go into a frequent-pattern tree,
in which equal beginnings share their nodes and each node counts the rows that pass it. Were all counts
zero, the sum of a pair would be one number times the terms; so a count of one source alone corrects the
sum of its pairs, from how many terms have that count, and two counts of one row correct it once more,
from the tree: each node with each of its ancestors gives one correction, times the node's rows,
however many terms share that path.

Rows are made distinct and counted first, then dealt to tasks in ranges of their order, so most of a
shared beginning lies in one task and a beginning that many rows share is still split; corrections of a
node met in two tasks add up. A task's tree is emptied into corrections when it holds ``NODES`` nodes,
which changes no sum. A term's row has an entry a source, and the result has one a pair of sources.

Nulls in text, language and source are empty strings; a group without terms still has shares. Empty
texts have no terms; very long texts are read in blocks of whole words. Repeated rows count each. Ties
rank by the item's UTF-8 bytes. An empty table, or a language with one source, gives no pairs. Other
columns are not read, so none can clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medstrand.llm.text import LOWER
from medstrand.operators.scale import salted_join
from medstrand.sources.sinks import materialise

# Documents that must hold a kept term; the scale of a share; ranks of terms.
LEAST_DOCUMENTS, SCALE, TERM_RANKS = 3, 1_000_000_000, 200
# Nodes of a tree, and counts of a task's table, before they are handed on.
NODES, COUNTS = 400_000, 300_000
BLOCK_BYTES = 1 << 20

# A-Z in lower case; letters and bytes outside ASCII stay, the rest are spaces.
_CLEAN = bytes(int(LOWER[b]) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: str) -> Counter:
    clean, found, at = text.encode().translate(_CLEAN), Counter(), 0
    while at < len(clean):
        stop = len(clean) if at + BLOCK_BYTES >= len(clean) else clean.find(b" ", at + BLOCK_BYTES)
        stop = len(clean) if stop < 0 else stop
        found.update(clean[at:stop].split())
        at = stop
    return found


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, term, n, docs`` as summed by each task; a group's rows of one term still add up."""

    def flush(table: dict) -> Iterator[pa.RecordBatch]:
        for (where, group), counts in table.items():
            columns = [
                pa.array([where] * len(counts), pa.string()),
                pa.array([group] * len(counts), pa.string()),
                pa.array([term.decode() for term in counts], pa.string()),
                pa.array([c[0] for c in counts.values()], pa.int64()),
                pa.array([c[1] for c in counts.values()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = {}, 0
        for batch in batches:
            places = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for place, content in zip(places, batch.column(2), strict=True):
                counts = table.setdefault(place, {})
                before = len(counts)
                for term, n in _terms(content.as_py()).items():
                    have = counts.get(term)
                    if have is None:
                        counts[term] = [n, 1]
                    else:
                        have[0] += n
                        have[1] += 1
                held += len(counts) - before
                if held > COUNTS:
                    yield from flush(table)
                    table, held = {}, 0
        yield from flush(table)

    columns = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    return docs.select(*columns).mapInArrow(count, "lang string, source string, term string, n long, docs long")


def term_rows(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """One row a kept term of a language: ``lang, term, total`` and ``cells``, its counts by source in order."""
    # Dealt by term once; both groupings keep to it.
    cells = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cell = F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells")
    rows = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), cell)
    return rows.filter(F.col("docs") >= least).drop("docs")


def share(n: Column, all_n: Column, terms: Column, scale: int = SCALE) -> Column:
    """``1 + floor(scale * (n + 1) / (all_n + terms))`` in whole numbers of any size."""
    wide = F.lit(scale).cast("decimal(20,0)") * (n + 1).cast("decimal(18,0)")
    return (F.lit(1) + F.call_function("div", wide, (all_n + terms).cast("decimal(38,0)"))).cast("long")


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Every occurring group: ``lang, source, size, terms, lang_size`` and ``zero``, its share of a term that it lacks."""
    found = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    sizes = rows.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
    every = found.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    every = every.na.fill(0, ["size", "terms", "lang_size"])
    zero = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("size"), F.col("terms")))
    return every.withColumn("zero", zero)


class PatternTree:
    """Paths of ``(source, share, zero share)`` that share their beginnings, with how many rows pass each node."""

    def __init__(self):
        self.child: dict[tuple, int] = {}
        self.parent, self.item, self.rows = [], [], []

    def __len__(self) -> int:
        return len(self.parent)

    def insert(self, path: list[tuple], times: int) -> None:
        node = -1
        for item in path:
            at = self.child.setdefault((node, item), len(self.parent))
            if at == len(self.parent):
                self.parent.append(node)
                self.item.append(item)
                self.rows.append(0)
            self.rows[at] += times
            node = at

    def corrections(self) -> dict[tuple[str, str], int]:
        """``(group, other)`` -> what its pair's sum gains where a row has counts of both."""
        if not self.parent:
            return {}
        names = sorted({item[0] for item in self.item})
        number = {name: i for i, name in enumerate(names)}
        source = np.array([number[item[0]] for item in self.item])
        p = np.array([item[1] for item in self.item], np.int64)
        zero = np.array([item[2] for item in self.item], np.int64)
        rows, parent = np.array(self.rows, np.int64), np.array(self.parent)
        total: dict[tuple[str, str], int] = {}
        node, above = np.arange(len(parent)), parent
        while len(node):
            live = above >= 0
            node, above = node[live], above[live]
            for a, b in ((node, above), (above, node)):
                gain = _gap(p[a], p[b]) - _gap(p[a], zero[b]) - _gap(zero[a], p[b]) + _gap(zero[a], zero[b])
                # Sums of whole numbers of any size, in two parts that cannot overflow.
                pair = source[a] * len(names) + source[b]
                order = np.argsort(pair, kind="stable")
                pair, high, low = pair[order], (gain >> 31)[order], (gain & 0x7FFFFFFF)[order]
                first = np.flatnonzero(np.diff(pair, prepend=-1)) if len(pair) else np.empty(0, np.int64)
                times = rows[node][order]
                if len(first):
                    tops = np.add.reduceat(high.astype(object) * times, first)
                    lows = np.add.reduceat(low.astype(object) * times, first)
                    for code, top, rest in zip(pair[first].tolist(), tops, lows, strict=True):
                        key = names[code // len(names)], names[code % len(names)]
                        total[key] = total.get(key, 0) + (int(top) << 31) + int(rest)
            above = parent[above]
        return total


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def joint_corrections(paths: DataFrame) -> DataFrame:
    """``lang, source, item, value`` from distinct ``lang, path, times``, a tree a task and language."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, PatternTree] = {}
        for batch in batches:
            for lang, path, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = trees.setdefault(lang, PatternTree())
                tree.insert([(x["source"], x["p"], x["zero"]) for x in path], times)
                if len(tree) > NODES:
                    yield from emptied(lang, trees.pop(lang))
        for lang, tree in trees.items():
            yield from emptied(lang, tree)

    def emptied(lang: str, tree: PatternTree) -> Iterator[pa.RecordBatch]:
        found = tree.corrections()
        columns = [
            pa.array([lang] * len(found), pa.string()),
            pa.array([a for a, _ in found], pa.string()),
            pa.array([b for _, b in found], pa.string()),
            pa.array([str(v) for v in found.values()], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])

    dealt = paths.repartitionByRange("lang", "path").select("lang", "path", "times")
    found = dealt.mapInArrow(grow, "lang string, source string, item string, value string")
    return found.withColumn("value", F.col("value").cast("decimal(38,0)"))


def audit(
    docs: DataFrame,
    least: int = LEAST_DOCUMENTS,
    ranks: int = TERM_RANKS,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: each group's other sources, and its own terms up to ``ranks``.

    ``pair`` holds the other source's share as the divisor, ``term`` the language's.
    """
    rows = materialise(term_rows(term_counts(docs, lang, source, text), least), "term_rows")
    groups = materialise(groups_of(docs, rows, lang, source), "groups")
    cells = rows.select("lang", "term", "total", F.inline("cells"))
    cells = salted_join(cells, groups, ["lang", "source"])
    cells = cells.withColumn("p", share(F.col("n"), F.col("size"), F.col("terms")))
    cells = materialise(cells, "cells")

    # One part for all terms, one for a count alone, one for two counts of a row.
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("q0"), "terms")
    pairs = groups.select("lang", "source", "zero").join(other, "lang").filter("source <> item")
    level = F.when(F.col("terms") > 0, F.col("terms") * gap(F.col("zero"), F.col("q0"))).otherwise(0)
    base = pairs.select("lang", "source", "item", level.cast("decimal(38,0)").alias("value"))
    met = cells.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("times"))
    single = salted_join(met, other.drop("terms"), ["lang"]).filter("source <> item")
    p, q, p0, q0 = F.col("p"), F.col("q0"), F.col("zero"), F.col("q0")
    both = F.explode(F.array(
        F.struct("source", "item", (gap(p, q) - gap(p0, q0)).alias("gain")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (gap(q0, p) - gap(q0, p0)).alias("gain")),
    ))
    single = single.select("lang", "times", both.alias("x")).select("lang", "x.source", "x.item", "x.gain", "times")
    gain = F.col("gain").cast("decimal(20,0)") * F.col("times").cast("decimal(18,0)")
    single = single.groupBy("lang", "source", "item").agg(F.sum(gain).cast("decimal(38,0)").alias("value"))
    path = F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("path")
    paths = cells.groupBy("lang", "term").agg(path).filter(F.size("path") > 1)
    joint = joint_corrections(paths.groupBy("lang", "path").agg(F.count("*").alias("times")))
    value = base.unionByName(single).unionByName(joint).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    ordered = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = value.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(ordered))

    q = share(F.col("total"), F.col("lang_size"), F.col("terms"))
    own = cells.withColumn("q", q).filter("p > q").withColumn("value", gap(F.col("p"), F.col("q")))
    term = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    term = term.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= ranks)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(*columns).unionByName(term.select(*columns))
