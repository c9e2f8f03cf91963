"""Mixing sources to target weights by hash-threshold histograms.

Sources share a budget of words by weight; a source's target ends at a multiple of its own size and
what it leaves is shared again among the others, by weight, until no target is above its limit. A
target of 2.3 sizes means two whole passes and a third that takes 0.3 of the source.

A part of a source is the documents whose key lies up to a threshold. Keys are hashes, so the words
of a source are summed by the first bits of the key; the bucket in which the running sum passes the
budget is refined by the next bits, alone, until it holds one document, which is taken if that comes
nearer to the budget. Nothing is sorted, and a larger budget takes all that a smaller one takes.

A key is a hash of the document's id, then one of its text, then its row in the stored table, so rows
that repeat an id are still told apart; among rows alike in all, which ones are taken makes no
difference. Nulls: a null text has no words, null sources are one source, the last in order, a null
id is hashed as an empty one. Empty texts count for nothing and are never in a threshold's way. Very
long texts are counted whole. A document larger than the rest of the budget is taken or left, whichever
is nearer. An empty table gives no rows. Other columns are not carried along, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from medstrand.llm.text import TOKEN_BYTES, slices
from medstrand.operators.scale import ranged, running_total, salted_join
from medstrand.sources.sinks import materialise

# A key is three numbers of 60 bits, read twelve bits at a time.
KEY = ("_id_hash", "_text_hash", "_row")
BITS, KEY_BITS = 12, 60
STEPS = KEY_BITS // BITS


def sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 42) -> DataFrame:
    """``doc_id, _source, size`` and the three parts of the key; ``_source`` is a struct, in which nulls are equal."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        F.struct(F.col(source).alias("source")).alias("_source"),
        F.conv(F.substring(F.md5(name), 1, KEY_BITS // 4), 16, 10).cast("long").alias("_id_hash"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(text)), 64 - KEY_BITS).alias("_text_hash"),
        F.monotonically_increasing_id().alias("_row"),
        F.col(text).alias("_text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for _, _, data, bounds in slices(batch.column(batch.num_columns - 1)):
                inside = TOKEN_BYTES[data]
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                edges = bounds[:-1][bounds[:-1] < len(data)]
                first[edges] = inside[edges]
                total = np.zeros(len(data) + 1, np.int64)
                np.cumsum(first, out=total[1:])
                found.append(np.diff(total[bounds]))
            columns = [*batch.columns[:-1], pa.array(np.concatenate(found))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "size"])

    schema = StructType([*narrow.drop("_text").schema.fields, StructField("size", LongType())])
    return narrow.mapInArrow(count, schema)


def _bits(step: int):
    """The ``step``-th twelve bits of the key."""
    part, inside = divmod(step, STEPS)
    return F.shiftright(F.col(KEY[part]), KEY_BITS - BITS * (inside + 1)).bitwiseAND((1 << BITS) - 1)


def _bucket_sums():
    weighty = F.col("size") > 0
    return [
        F.sum("size").alias("_words"),
        F.count_if(weighty).alias("_rows"),
        F.min(F.when(weighty, F.struct(*KEY))).alias("_key"),
    ]


def targets(
    sources: DataFrame, weights: Sequence[int] = (5, 2, 1), limit: int = 3, total: int | None = None
) -> DataFrame:
    """``target`` beside ``_source`` and ``source_size``, a stored table with one row a source.

    Sources in order of their code points, null last, weigh ``weights``, which repeat. ``total`` is all
    words where it is not given. The rounds end, for each adds a source to those at their limit; a
    round is one aggregate.
    """
    listed = sources.withColumn("_last", F.col("_source.source").isNull()).withColumn("_name", F.col("_source.source"))
    order = [("_last", True), ("_name", True)]
    listed = running_total(ranged(listed, order, materialise), order, [("_range", F.col("_range"), True)], out="_place")
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = listed.withColumn("_weight", F.get(cycle, ((F.col("_place") - 1) % len(weights)).cast("int")))
    weighed = materialise(weighed.select("_source", "source_size", "_weight"), "weights")
    most = F.col("source_size") * limit

    def wide(x):
        return x.cast("decimal(38,0)")

    row = weighed.agg(F.sum("source_size"), F.sum("_weight")).first()
    budget = (row[0] or 0) if total is None else total
    left, weight, full = budget, row[1] or 0, 0
    while weight:
        above = wide(most) * F.lit(weight) < wide(F.col("_weight")) * F.lit(left)
        row = weighed.agg(
            F.count_if(above), F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("_weight")))
        ).first()
        if row[0] == full:
            break
        full, left, weight = row[0], budget - (row[1] or 0), row[2] or 0
    if weight:
        above = wide(most) * F.lit(weight) < wide(F.col("_weight")) * F.lit(left)
        share = (wide(F.col("_weight")) * F.lit(left)).cast("double") / F.lit(float(weight))
        target = F.when(above, most.cast("double")).otherwise(share)
    else:
        target = most.cast("double")
    return weighed.select("_source", "source_size", target.alias("target"))


def thresholds(counted: DataFrame, histogram: DataFrame, budgets: DataFrame) -> DataFrame:
    """``_source, step, _key, _with``: the key up to which the words of a source come nearest to each budget.

    ``budgets`` has ``_source``, ``step`` and ``budget``, above 0 and below the source's words; ``_with``
    says whether the document at the key is in. ``counted`` and ``histogram``, the sums by source and
    first bits, are stored. Only the rows of boundary buckets are read again.
    """
    by_bits = Window.partitionBy("_source").orderBy("_bits").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_words").over(by_bits), F.lit(0))
    passed = (F.col("_before") < F.col("budget")) & (F.col("budget") <= F.col("_before") + F.col("_words"))
    bounds = histogram.withColumn("_before", before).join(budgets, "_source").filter(passed)
    columns = ["_source", "step", "budget", "_bits", "_before", "_words", "_rows", "_key"]
    bounds = materialise(bounds.select(*columns), "bounds")
    rows = counted.filter("size > 0")
    done = bounds.filter("_rows = 1")
    for step in range(1, len(KEY) * STEPS):
        if bounds.filter("_rows > 1").isEmpty():
            break
        # The rows of the boundary buckets alone, from the rows of those before.
        wanted = bounds.filter("_rows > 1").select("_source", "step", "budget", "_bits", "_before")
        on = ["_source", "_bits"] if step == 1 else ["_source", "_bits", "step"]
        rows = rows.withColumn("_bits", _bits(step - 1)).join(wanted, on)
        rows = materialise(rows.select("_source", "step", "budget", "_before", "size", *KEY), "boundary")
        sums = rows.groupBy("_source", "step", "budget", "_before", _bits(step).alias("_bits")).agg(*_bucket_sums())
        inside = Window.partitionBy("_source", "step").orderBy("_bits").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_words").over(inside), F.lit(0)))
        bounds = materialise(sums.filter(passed).select(*columns), "bounds")
        rows = rows.drop("budget", "_before")
        done = done.unionByName(bounds.filter("_rows = 1"))
    nearer = F.col("_before") + F.col("_words") - F.col("budget") <= F.col("budget") - F.col("_before")
    return done.select("_source", "step", "_key", nearer.alias("_with"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    limit: int = 3,
    total: int | None = None,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = 42,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row; ``taken`` counts words with their repeats.

    A document is taken once in each whole pass over its source and once more if its key is up to the
    threshold of the last, partial pass.
    """
    counted = materialise(sizes(docs, key, source, text, seed), "sizes")
    histogram = counted.groupBy("_source", _bits(0).alias("_bits")).agg(*_bucket_sums())
    histogram = materialise(histogram, "histogram")
    sources = materialise(histogram.groupBy("_source").agg(F.sum("_words").alias("source_size")), "sources")
    goals = targets(sources, weights, limit, total)
    step = F.explode(F.sequence(F.lit(0), F.lit(limit - 1)))
    passes = goals.withColumn("step", step).withColumn("budget", F.col("target") - F.col("step") * F.col("source_size"))
    partial = passes.filter("budget > 0 and budget < source_size").select("_source", "step", "budget")
    found = thresholds(counted, histogram, materialise(partial, "budgets"))
    found = found.groupBy("_source").agg(F.collect_list(F.struct("_key", "_with")).alias("_cuts"))  # at most limit a source
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = goals.withColumn("_whole", whole).join(found, "_source", "left")
    placed = salted_join(counted, materialise(plan, "thresholds"), ["_source"])
    own = F.struct(*KEY)
    hits = F.filter("_cuts", lambda c: (own < c["_key"]) | (c["_with"] & (own == c["_key"])))
    times = F.col("_whole") + F.coalesce(F.size(hits), F.lit(0))
    return placed.select(
        "doc_id",
        F.col("_source.source").alias("source"),
        "size",
        "source_size",
        "target",
        (F.col("size") * times).cast("long").alias("taken"),
    )
