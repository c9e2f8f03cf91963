"""The unit grammar against Python's own reading of the same texts, and conversion of temperatures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from medstrand.functions.units import MAX_DEPTH, unit_terms
from medstrand.operators import labs

VALUES = {"g": 1e-3, "m": 1.0, "s": 1.0, "mol": 1.0, "L": 1e-3, "min": 60.0, "kg": 1.0}


def text(rng, depth):
    """A random text of the grammar that Python reads alike: ``*`` and ``/`` from left to right, powers first.

    Numbers are left out: after a symbol and ``*`` they are its power.
    """
    parts = []
    for _ in range(rng.randint(1, 4)):
        if depth and rng.random() < 0.4:
            part = f"({text(rng, depth - 1)})"
        else:
            part = rng.choice(list(VALUES))
        parts.append(part + rng.choice(["", "", f"**{rng.choice([-2, -1, 2, 3])}"]))
    out = parts[0]
    for part in parts[1:]:
        out += rng.choice("*/") + part
    return out


def test_random_texts(spark):
    rng = random.Random(7)
    texts = sorted({text(rng, 3) for _ in range(400)})
    frame = spark.createDataFrame([(t,) for t in texts], "u string")
    got = {r["u"]: r["factor"] for r in labs.unit_factors(frame, "u").collect()}
    assert got.keys() == set(texts)
    for t in texts:
        want = eval(t, {}, VALUES)  # noqa: S307, texts made above
        assert got[t] is not None and math.isclose(got[t], want, rel_tol=1e-9), t


@pytest.mark.parametrize(
    "unit, want",
    [
        ("mL/(min*kg)", [("mL", 1), ("min", -1), ("kg", -1)]),
        ("a/(b/(c/d)**2)**3", [("a", 1), ("b", -3), ("c", 6), ("d", -6)]),
        ("2mg", [("2", 1), ("mg", 1)]),
        ("mm*3/2", [("mm", 3), ("2", -1)]),
        ("( mg / dL )", [("mg", 1), ("dL", -1)]),
        ("(" * MAX_DEPTH + "m" + ")" * MAX_DEPTH, [("m", 1)]),
        ("(" * (MAX_DEPTH + 1) + "m" + ")" * (MAX_DEPTH + 1), None),
        ("", None), (" ", None), ("m*", None), ("*m", None), ("m**100", None), (")m(", None), ("m\n/\ts", [("m", 1), ("s", -1)]), (None, None),
    ],
)
def test_terms(spark, unit, want):
    frame = spark.createDataFrame([(unit,)], "u string").select(unit_terms(F.col("u")).alias("t"))
    got = frame.first()["t"]
    assert (None if got is None else [tuple(t) for t in got]) == want


def test_offsets(spark):
    frame = spark.createDataFrame([("degC", "degF"), ("degF", "degC"), ("K", "degC"), ("degC", "mg"), ("J/K", "J/degC"), ("degC", "degC")], "b string, o string")
    rows = {(r["b"], r["o"]): (r["conversion_factor"], r["conversion_offset"]) for r in labs.conversion_factors(frame, "b", "o").collect()}
    factor, offset = rows["degC", "degF"]
    assert math.isclose(98.6 * factor + offset, 37.0, abs_tol=1e-6)
    factor, offset = rows["degF", "degC"]
    assert math.isclose(37.0 * factor + offset, 98.6, abs_tol=1e-6)
    assert rows["K", "degC"] == (1.0, 273.15)
    assert rows["degC", "mg"] == (None, None)
    assert rows["J/K", "J/degC"] == (1.0, 0.0) and rows["degC", "degC"] == (1.0, 0.0)


def test_conversions_without_offsets(spark):
    """A table stored before offsets were kept still converts."""
    rows = spark.createDataFrame([("T", "c", 2.0, "g")], "lx_lab_code_type string, lx_lab_code string, lx_result_val double, lx_result_unit string")
    table = spark.createDataFrame([("c", "g", 1000.0, "mg")], "lx_lab_code string, lx_result_other_unit string, conversion_factor double, lx_result_unit string")
    out = labs.convert(rows, table)
    assert out.first()["lx_result_val_converted"] == 2000.0 and "_offset" not in out.columns
