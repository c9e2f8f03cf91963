"""Reproducible randomness: a number that depends only on a seed and a row's own key.

``rand()`` changes when a lost executor's task is run again; a keyed hash does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def keyed_hash(seed: str | int, *key) -> Column:
    """Unsigned 32-bit hash of ``seed:key[:key...]`` as bigint."""
    parts = [F.lit(str(seed))] + [_as_column(k).cast("string") for k in key]
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def keyed_uniform(seed: str | int, *key) -> Column:
    """Uniform number in [0, 1) drawn from ``keyed_hash``."""
    return keyed_hash(seed, *key) / F.lit(4294967296.0)
