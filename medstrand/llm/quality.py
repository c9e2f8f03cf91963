"""Quality classifier: a sparse ensemble of rules, compiled into column expressions.

Statistics of each text (shares of symbols, capitals, repeated words and lines, lengths and so on)
are read once. A forest of shallow trees on labelled rows gives rules: the path to each node below a
root is a conjunction of bounds on statistics. A logistic regression under an L1 penalty over the
rules and the scaled statistics leaves most weights at zero; what is left is one Spark column
expression over the statistics, and so is the score.

Nulls: a null text is empty; statistics of an empty text are 0. A null label or id is not learned
from. Repeated rows are scored each. With labels of one class only, or none, every score is that
class's share. An empty table gives no rows. Columns not asked for are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medstrand.llm.toxicity import part
from medstrand.sources.sinks import materialise

STATISTICS = (
    "words", "mean_word", "longest_word", "distinct_share", "top_share", "repeat_share", "letters", "digits", "capitals",
    "symbols", "marks", "bars", "exclaims", "stops", "short_words", "lines", "line_words", "repeated_lines", "ended_lines",
    "upper_words", "marked_words", "spread",
)
# Classes of UTF-8 bytes: capital, small letter, digit, mark, other sign, first byte of another character, all else.
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[33:127] = 4
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[192:256] = 2, 0, 1, 5
_CLASS[[ord(c) for c in ".,;:!?"]] = 3
_CLASS[[ord(c) for c in "'\"()|-_"]] = 6
TREES, DEPTH = 24, 4
PENALTY = 0.002
# A rule is one (statistic, is at most, bound) or more.
Rule = tuple[tuple[int, bool, float], ...]


def statistics(text: str | None) -> list[float]:
    """Values of STATISTICS of a whole text."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = Counter(words)
    rows = [line for line in text.split("\n") if line.strip()]
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)], minlength=7).tolist()
    capitals, small, digits, marks, signs, other = kinds[:6]
    letters = capitals + small + other
    entropy = math.log(n) - sum(c * math.log(c) for c in counts.values()) / n
    return [
        math.log1p(n),
        sum(map(len, words)) / n,
        math.log1p(max(map(len, words))),
        len(counts) / n,
        max(counts.values()) / n,
        repeated / n,
        letters / chars,
        digits / chars,
        capitals / max(letters, 1),
        signs / chars,
        marks / n,
        text.count("|") / n,
        text.count("!") / n,
        len(re.findall(r"[.!?](?:\s|\Z)", text)) / n,
        sum(len(w) <= 3 for w in words) / n,
        math.log1p(len(rows)),
        math.log1p(n / max(len(rows), 1)),
        1 - len(set(rows)) / max(len(rows), 1),
        sum(line.rstrip().endswith((".", "!", "?", '"', ")")) for line in rows) / max(len(rows), 1),
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        sum(not w[-1].isalnum() for w in words) / n,
        entropy / math.log(n) if n > 1 else 0.0,
    ]


def with_statistics(docs: DataFrame, columns: Sequence[str], text: str = "text") -> DataFrame:
    """``columns`` and the array ``statistics`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [statistics(x) for x in batch.column(len(columns)).to_pylist()]
            arrays = [batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(made, pa.list_(pa.float64()))], [*columns, "statistics"])

    wanted = docs.select(*columns, text)
    kinds = [f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in columns]
    return wanted.mapInArrow(run, ", ".join([*kinds, "statistics array<double>"]))


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def rules_of(forest: str) -> list[Rule]:
    """Distinct paths of a forest's printed trees; a path keeps one bound a statistic and side."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, tuple[int, bool, float]]] = []
    for line in forest.split("\n"):
        split = _SPLIT.match(line)
        if not split:
            if line.lstrip().startswith("Tree"):
                path = []
            continue
        depth = len(split[1])
        path = [(d, c) for d, c in path if d < depth]
        path.append((depth, (int(split[3]), split[4] == "<=", float(split[5]))))
        tight: dict[tuple[int, bool], float] = {}
        for _, (feature, below, bound) in path:
            at = (feature, below)
            tight[at] = bound if at not in tight else (min if below else max)(tight[at], bound)
        found[tuple(sorted((f, b, x) for (f, b), x in tight.items()))] = None
    return list(found)


def rule_column(rule: Rule, values: Column) -> Column:
    met = F.lit(True)
    for feature, below, bound in rule:
        value = values[feature]
        met = met & ((value <= bound) if below else (value > bound))
    return met


class Ensemble:
    """Intercept, weighted rules and weighted statistics; ``score`` is a column over the statistics."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]], linear: list[tuple[int, float]]):
        self.intercept, self.rules, self.linear = intercept, rules, linear

    def score(self, values: Column) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule, values), F.lit(float(weight))).otherwise(F.lit(0.0))
        for feature, weight in self.linear:
            total = total + values[feature] * F.lit(float(weight))
        return 1 / (1 + F.exp(-total))


def fit(found: DataFrame, labels: DataFrame, held: int | None = 2, key: str = "doc_id", label: str = "quality") -> Ensemble:
    """Learns rules and weights from all labelled rows whose part is not ``held``.

    ``found`` has ``key`` and ``statistics``, best stored: labels meet statistics, never texts.
    """
    known = labels.select(F.col(key).alias("_id"), F.col(label).cast("double").alias("label")).dropna().dropDuplicates(["_id"])
    if held is not None:
        known = known.filter(part(F.col("_id")) != held)
    labelled = found.select(F.col(key).alias("_id"), "statistics").join(known, "_id")
    rows = materialise(labelled.select("label", "statistics"), "quality-labelled")
    sides = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(sides.values())
    if len(sides) < 2:
        share = min(max(sides.get(1.0, 0) / total if total else 0.5, 1e-6), 1 - 1e-6)
        return Ensemble(math.log(share / (1 - share)), [], [])
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="_vector", numTrees=TREES, maxDepth=DEPTH, seed=11,
        featureSubsetStrategy="onethird", minInstancesPerNode=max(2, min(25, total // 200)),
    ).fit(rows.select("label", array_to_vector("statistics").alias("_vector")))
    rules = rules_of(forest.toDebugString)
    values = F.col("statistics")
    met = [F.when(rule_column(r, values), 1.0).otherwise(0.0) for r in rules]
    table = rows.select("label", array_to_vector(F.concat(F.array(*met), values)).alias("_vector"))
    table = materialise(table, "quality-rules")
    lasso = LogisticRegression(
        labelCol="label", featuresCol="_vector", elasticNetParam=1.0, regParam=PENALTY, maxIter=60, tol=1e-5
    ).fit(table)
    weights = lasso.coefficients.toArray().tolist()
    chosen = [(r, w) for r, w in zip(rules, weights, strict=False) if w]
    linear = [(i, w) for i, w in enumerate(weights[len(rules) :]) if w]
    return Ensemble(lasso.intercept, chosen, linear)


def score(found: DataFrame, ensemble: Ensemble, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``columns`` and ``score`` (0 to 1, higher is better) of every row of ``found``, which has ``statistics``."""
    return found.select(*columns, ensemble.score(F.col("statistics")).alias("score"))
