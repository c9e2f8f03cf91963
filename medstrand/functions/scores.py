"""Row-local score arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """Index of the first largest element, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, not again wherever ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(scores: Column) -> Column:
    """Softmax of an array; shifted by its maximum so large scores do not overflow.

    Maximum, powers and their sum are each bound once, so the work is linear in the classes.
    """

    def powers(top: Column) -> Column:
        return F.transform(scores, lambda x: F.exp(x - top))

    def shares(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x)
        return _with(total, lambda t: F.transform(found, lambda x: x / t))

    return _with(_with(F.array_max(scores), powers), shares)
