"""Building blocks that keep a plan flat when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Copies of a lookup side in a salted join; a hot key is spread over this many tasks. A session may
# set ``spark.medstrand.salts``, a call its own number.
SALTS = 8
# Length of a block of consecutive numbers generated by one task.
BLOCK = 65_536
# A join of a large side, a lookup and their keys; a fourth argument may say how.
Join = Callable[..., DataFrame]


def salted_join(
    fact: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Equi-join of a large side with a lookup whose keys may be hot on the large side.

    Rows of ``fact`` with one key are spread over ``salts`` tasks by a hash of the whole row and
    each lookup row is repeated once per salt. ``how`` may be anything that keeps the left side
    whole or filters it (inner, left, left_semi, left_anti). No broadcast is forced: Spark still
    broadcasts the lookup when its measured size is under its own threshold.
    """
    on = list(on)
    if salts is None:
        salts = int(fact.sparkSession.conf.get("spark.medstrand.salts", str(SALTS)))
    hashable = [F.col(f"`{name}`") for name, kind in fact.dtypes if "map<" not in kind]
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, on=[*on, "_salt"], how=how).drop("_salt")


Level = tuple[str, Column, bool]


def running_total(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    levels: Sequence[Level],
    by: Sequence[str] = (),
    value: Column | None = None,
    out: str = "running",
) -> DataFrame:
    """Inclusive running sum of ``value`` (row number when omitted) without a one-task window."""
    amount = F.lit(1).cast("bigint") if value is None else value
    return running_totals(df, order, levels, {out: amount}, by)


def running_totals(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    levels: Sequence[Level],
    values: Mapping[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add an inclusive running sum for each entry of ``values``.

    ``levels`` are ``(name, expression, ascending)`` buckets, coarse to fine, each monotone in
    ``order`` (``(column, ascending)`` pairs that order rows fully). Totals are taken per bucket
    with map-side combine, summed level by level, and the row window only runs inside the finest
    bucket, so neither a hot ``by`` group nor an ungrouped frame lands in one task.
    """
    by = list(by)
    outs = list(values)
    names = [name for name, _, _ in levels]
    work = df.withColumns({name: expr for name, expr, _ in levels})
    work = work.withColumns({f"_amount_{o}": v for o, v in values.items()})
    # Null keys are equal inside a struct, so the window and the join below share one partitioning.
    work = work.withColumn("_key", F.struct(*by, *names))

    sums = [F.sum(f"_amount_{o}").alias(f"_total_{o}") for o in outs]
    totals = work.groupBy("_key").agg(*sums).select("_key.*", *[f"_total_{o}" for o in outs])
    offsets = totals.withColumns({f"_offset_{o}": F.lit(0) for o in outs})
    for depth, (name, _, ascending) in enumerate(levels):
        # Each level is summed from the bucket totals, not from the level before it.
        outer, here = by + names[:depth], by + names[: depth + 1]
        level = totals.groupBy(F.struct(*here).alias("_at")).agg(
            *[F.sum(f"_total_{o}").alias(f"_sum_{o}") for o in outs]
        )
        window = (
            Window.partitionBy(*[f"_at.{c}" for c in outer])
            .orderBy(F.col(f"_at.{name}").asc() if ascending else F.col(f"_at.{name}").desc())
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        before = level.select(
            "_at", *[F.coalesce(F.sum(f"_sum_{o}").over(window), F.lit(0)).alias(f"_before_{o}") for o in outs]
        )
        offsets = (
            offsets.withColumn("_at", F.struct(*here))
            .join(before, "_at")
            .withColumns({f"_offset_{o}": F.col(f"_offset_{o}") + F.col(f"_before_{o}") for o in outs})
            .drop("_at", *[f"_before_{o}" for o in outs])
        )
    offsets = offsets.select(F.struct(*by, *names).alias("_key"), *[f"_offset_{o}" for o in outs])

    inside = (
        Window.partitionBy("_key")
        .orderBy(*[F.col(c).asc() if asc else F.col(c).desc() for c, asc in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = work.withColumns({f"_inside_{o}": F.sum(f"_amount_{o}").over(inside) for o in outs})
    extra = [n for n in names if n not in df.columns]
    helpers = [f"_{kind}_{o}" for kind in ("amount", "inside", "offset") for o in outs]
    return (
        ranked.join(offsets, "_key")
        .withColumns({o: F.col(f"_offset_{o}") + F.col(f"_inside_{o}") for o in outs})
        .drop("_key", *helpers, *extra)
    )


def ranged(df: DataFrame, order: Sequence[tuple[str, bool]], save) -> DataFrame:
    """``df`` with ``_range``, a bucket number monotone in ``order``: even ranges found from the data.

    ``save`` must store its argument, because the bounds are sampled and a second run could choose others.
    """
    by = [F.col(c).asc() if ascending else F.col(c).desc() for c, ascending in order]
    return save(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranged")


def hash_rank(
    df: DataFrame, hash_column: str, ties: Sequence[str], by: Sequence[str] = (), out: str = "rank"
) -> DataFrame:
    """Rank (from 1) in keyed-hash order within ``by``; the hash itself gives even buckets."""
    order = [(hash_column, True)] + [(c, True) for c in ties]
    levels = [
        ("_bucket", F.shiftright(F.col(hash_column), 24), True),
        ("_bucket_in", F.shiftright(F.col(hash_column), 16), True),
    ]
    return running_total(df, order, levels, by=by, out=out)


def numbered_rows(counted: DataFrame, length: str, out: str = "i") -> DataFrame:
    """For each row, the numbers ``0 .. length - 1``, generated in blocks by many tasks."""
    blocks = counted.filter(F.col(length) > 0).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.floor((F.col(length) - 1) / BLOCK)))
    )
    spread = blocks.repartition(F.col("_block"))
    first = F.col("_block") * BLOCK
    last = F.least(first + BLOCK, F.col(length)) - 1
    return spread.withColumn(out, F.explode(F.sequence(first, last))).drop("_block")
