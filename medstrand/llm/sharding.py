"""Shards by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards; a node weighs what its leaves weigh. From the root down,
every child of the node reached draws ``log(u) / weight`` with ``u`` hashed from the row's key and
the child's name, and the largest draw wins. A draw depends on the key and that child alone, so
when weights change, rows move only into subtrees that gained and out of those that lost.

A shard added inside a rack makes its rack and region heavier, and what they win is dealt among
all their leaves. ``grow`` therefore adds a shard as a region of its own: then rows move only into
the new shard.

All of it is column expressions. Nulls: a null key is hashed as such, so those rows share a shard;
a null text is empty. Repeated rows are separate rows and get separate slots. An empty table gives
no rows. Columns beside the key and text are carried along unless they clash with a result's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medstrand.sources.sinks import materialise

Tree = dict[str, dict[str, dict[int, float]]]

REGIONS, RACKS = 4, 2
# Bytes a row takes beside its text.
ROW_BYTES = 16
# Rows of one shard are numbered in so many parts.
PARTS = 256


def tree(shards: int, regions: int = REGIONS, racks: int = RACKS) -> Tree:
    """Equal shards dealt evenly to ``regions`` times ``racks``."""
    out: Tree = {}
    for shard in range(shards):
        place = shard * regions * racks // shards
        rack = out.setdefault(f"region{place // racks}", {}).setdefault(f"rack{place}", {})
        rack[shard] = 1.0
    return out


def grow(old: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a region of its own."""
    number = 1 + max((s for racks in old.values() for leaves in racks.values() for s in leaves), default=-1)
    return {**old, f"added{number}": {f"added{number}": {number: weight}}}


def _children(layout: Tree) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level, the children of every node as (name, weight); those without weight are left out."""

    def weight(node) -> float:
        return sum(weight(x) for x in node.values()) if isinstance(node, dict) else float(node)

    levels, here = [], {"": layout}
    while here and all(isinstance(node, dict) for node in here.values()):
        levels.append({
            name: [(f"{name}/{child}", weight(x)) for child, x in node.items() if weight(x) > 0]
            for name, node in here.items()
        })
        here = {
            f"{name}/{child}": x for name, node in here.items() for child, x in node.items() if weight(x) > 0
        }
    if not here:
        raise ValueError("the tree has no weight")
    return levels


def shard_of(key: Column, layout: Tree) -> Column:
    """Shard of ``key``: a descent from the root, one weighted draw among a node's children a level."""

    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(child["name"], key), 11).cast("double")
        return F.struct((F.log((bits + 1) / F.lit(2.0**53)) / child["weight"]).alias("draw"), child["name"].alias("name"))

    node = F.lit("")
    for level in _children(layout):
        below = F.create_map(*[
            x
            for name, children in level.items()
            for x in (
                F.lit(name),
                F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight")) for c, w in children]),
            )
        ])
        node = F.array_max(F.transform(F.element_at(below, node), draw))["name"]
    return F.substring_index(node, "/", -1).cast("int")


def with_slots(df: DataFrame, shard: str = "shard", out: str = "slot") -> DataFrame:
    """Numbers each shard's rows from 0 without a gap; a shard is numbered in PARTS parts.

    ``df`` must hold a unique, stable ``_row``, as a materialised table does.
    """
    parted = df.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(PARTS)))
    counts = parted.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(shard, "_part").orderBy("_row")) - 1
    return (
        parted.withColumn("_inside", inside)
        .join(offsets, [shard, "_part"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_part", "_before", "_inside")
    )


def assign(docs: DataFrame, layout: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` of every row.

    The text is read once for its size and checksum and never shuffled.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(key),
        (F.octet_length(content) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), layout).alias("shard"),
        shard_of(F.col(key), grow(layout)).alias("grown_shard"),
    )
    return with_slots(materialise(narrow, "shards")).drop("_row")


def write_shards(docs: DataFrame, path: str, layout: Tree, key: str = "doc_id") -> None:
    """Writes the rows, all columns, to one directory a shard; no shuffle is needed."""
    placed = docs.withColumn("shard", shard_of(F.col(key), layout))
    placed.write.mode("overwrite").partitionBy("shard").parquet(path)
