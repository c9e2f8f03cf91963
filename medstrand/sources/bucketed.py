"""Tables that keep their rows by person: bucketed and sorted, so joins on the key need no shuffle.

Tables of one family have the same key and number of buckets; the number follows from the measured
bytes of the largest. Every bucket is written by the one task its rows are dealt to, so it is one file.
A layout is kept beside its table, and a later session opens the table with it, without a metastore.

A join of two tables of a family has no exchange as long as neither side is broadcast, which is then no
loss. Rows of one key share a bucket: a person with more rows than a bucket makes that file larger, and
such histories belong in blocks (``operators.blocks``), whose key spreads them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of files that one bucket should hold.
BUCKET_BYTES = 256 << 20
# Fixed value: the most buckets Spark makes by default.
MOST_BUCKETS = 100_000


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path, as its file system counts them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def plan_buckets(sizes: Sequence[int], bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of a family, a power of two, from its tables' bytes: the largest table decides."""
    wanted = max(1, -(-max(sizes, default=0) // bucket_bytes))
    return min(1 << (wanted - 1).bit_length(), MOST_BUCKETS)


def _layout_path(path: str) -> str:
    return f"{path.rstrip('/')}.layout"


def write_bucketed(
    df: DataFrame, path: str, name: str, buckets: int, key: str = "person_id", sort: Sequence[str] = ()
) -> DataFrame:
    """Writes ``df`` to ``path`` in ``buckets`` by ``key``, each sorted by key and ``sort``, and gives it as table ``name``."""
    spark = df.sparkSession
    _forget(spark, name)
    dealt = df.repartition(buckets, F.col(key))
    writer = dealt.write.format("parquet").mode("overwrite").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key, *sort).saveAsTable(name)
    layout = [(key, buckets, list(sort), df.schema.toDDL())]
    rows = spark.createDataFrame(layout, "key string, buckets int, sort array<string>, columns string")
    rows.coalesce(1).write.mode("overwrite").json(_layout_path(path))
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table that ``write_bucketed`` left at ``path``, known to this session as ``name`` with its buckets."""
    row = spark.read.schema("key string, buckets int, sort array<string>, columns string").json(_layout_path(path)).first()
    _forget(spark, name)
    order = ", ".join(f"`{c}`" for c in [row["key"], *row["sort"]])
    where = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({row['columns']}) USING parquet CLUSTERED BY (`{row['key']}`) SORTED BY ({order}) "
        f"INTO {row['buckets']} BUCKETS LOCATION '{where}'"
    )
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    """Drops the session's name for a table; the files stay, because the table names their place."""
    if re.fullmatch(r"\w+(\.\w+)?", name) is None:
        raise ValueError(f"not a table name: {name}")
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def write_family(
    tables: Mapping[str, DataFrame],
    base: str,
    prefix: str,
    key: str = "person_id",
    sort: Mapping[str, Sequence[str]] | None = None,
    bucket_bytes: int = BUCKET_BYTES,
) -> dict[str, DataFrame]:
    """Several tables under ``base`` with one number of buckets: each is stored plainly first and measured.

    The plain copies, ``<base>/plain/<table>``, are the input of the bucketed ones and may be deleted after.
    """
    spark = next(iter(tables.values())).sparkSession
    plain = {t: f"{base.rstrip('/')}/plain/{t}" for t in tables}
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(plain[t])
    buckets = plan_buckets([stored_bytes(spark, p) for p in plain.values()], bucket_bytes)
    return {
        t: write_bucketed(spark.read.parquet(p), f"{base.rstrip('/')}/{t}", f"{prefix}_{t}", buckets, key, (sort or {}).get(t, ()))
        for t, p in plain.items()
    }
