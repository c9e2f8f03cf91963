"""Unit texts as terms: a grammar of products, quotients, groups and powers, read by one fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medstrand.functions import codes

SYMBOL = r"[A-Za-z%µμ°]+"
NUMBER = r"[0-9]+\.?[0-9]*"
_POWER = r"\*\*-?[0-9]{1,2}(?![0-9])"
# An operator, an open bracket, an operand or closed bracket with its power, or any other sign, which nothing reads.
_TOKEN = rf"[*/ (]|(?:\)|{SYMBOL}|{NUMBER})(?:{_POWER})?|."
# Groups within groups beyond this are not read, so that powers of powers stay whole numbers of 64 bits.
MAX_DEPTH = 6
_TERMS = "array<struct<symbol:string,power:bigint>>"
_STACK = "array<struct<sign:bigint,start:int>>"


def plain_text(unit: Column) -> Column:
    """One spelling of powers, divisions and white space: ``m ^ 2``, ``square m`` and ``m squared`` become ``m**2``."""
    text = F.regexp_replace(unit, r"\^", "**")
    text = F.regexp_replace(text, r"\s+", " ")
    for word, power in (("squared", 2), ("cubed", 3)):
        text = F.regexp_replace(text, rf"({SYMBOL}) {word}\b", f"$1**{power}")
    for word, power in (("square", 2), ("sq", 2), ("cubic", 3)):
        text = F.regexp_replace(text, rf"\b{word} ({SYMBOL})", f"$1**{power}")
    text = F.regexp_replace(text, r"\bper\b", "/")
    text = F.regexp_replace(text, r" ?(\*\*|\*|/) ?", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"\( ", "("), r" \)", ")")
    text = codes.clean_unit(F.trim(text))
    return F.regexp_replace(text, r"\b10\*(\d+)", "10**$1")


def unit_terms(unit: Column) -> Column:
    """``array<struct<symbol, power>>`` of a unit text; null when it is null or cannot be read.

    ``*``, a blank or nothing between operands multiplies and ``/`` divides, from left to right; a
    power binds first and may follow a group. A division may begin a text or a group (``/uL``). The
    fold keeps a stack of open groups, each with its sign and the place of its first term: closing
    one multiplies the powers from there on by the group's sign and power.
    """
    tokens = F.transform(
        F.regexp_extract_all(plain_text(unit), F.lit(f"({_TOKEN})"), F.lit(1)),
        lambda t: F.struct(
            F.regexp_replace(t, rf"(?<=.){_POWER}$", "").alias("body"),
            F.coalesce(F.regexp_extract(t, r"(?<=.)\*\*(-?[0-9]+)$", 1).try_cast("bigint"), F.lit(1).cast("bigint")).alias("power"),
        ),
    )
    state = F.struct(
        F.array().cast(_STACK).alias("stack"),
        F.lit(1).cast("bigint").alias("sign"),
        F.lit("start").alias("last"),
        F.array().cast(_TERMS).alias("terms"),
    )
    read = F.aggregate(tokens, state, _step, _finish)
    return F.when(unit.isNotNull(), read)


def _next(state: Column, stack: Column | None = None, sign: Column | None = None, last: str = "operand", terms: Column | None = None) -> Column:
    return F.struct(
        (state["stack"] if stack is None else stack).alias("stack"),
        (F.lit(1).cast("bigint") if sign is None else sign).alias("sign"),
        F.lit(last).alias("last"),
        (state["terms"] if terms is None else terms).alias("terms"),
    )


def _step(state: Column, token: Column) -> Column:
    body, power = token["body"], token["power"]
    after_operand = state["last"] == "operand"
    group = F.element_at(state["stack"], -1)
    closed = F.transform(
        state["terms"],
        lambda t, i: F.struct(
            t["symbol"].alias("symbol"),
            F.when(i >= group["start"], t["power"] * group["sign"] * power).otherwise(t["power"]).alias("power"),
        ),
    )
    opened = F.array_append(
        state["stack"], F.struct(state["sign"].alias("sign"), F.size(state["terms"]).alias("start"))
    )
    term = F.struct(body.alias("symbol"), (state["sign"] * power).alias("power"))
    return (
        F.when(state["last"] == "fault", state)
        .when(body.isin("*", " ") & after_operand, _next(state, last="operator"))
        .when((body == "/") & state["last"].isin("operand", "start"), _next(state, sign=F.lit(-1).cast("bigint"), last="operator"))
        .when((body == "(") & (F.size(state["stack"]) < MAX_DEPTH), _next(state, stack=opened, last="start"))
        .when(
            (body == ")") & after_operand & (F.size(state["stack"]) > 0),
            _next(state, stack=F.slice(state["stack"], 1, F.greatest(F.size(state["stack"]) - 1, F.lit(0))), terms=closed),
        )
        .when(body.rlike(rf"^(?:{SYMBOL}|{NUMBER})$"), _next(state, terms=F.array_append(state["terms"], term)))
        .otherwise(_next(state, last="fault"))
    )


def _finish(state: Column) -> Column:
    return F.when((state["last"] == "operand") & (F.size(state["stack"]) == 0), state["terms"])
