"""Column expressions for codes, tokens and unit text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: shape of a valid LOINC code.
LOINC_SHAPE = r"^\d{4,}-\d{1}$"
# LOINC placeholders that carry no meaning.
EMPTY_LOINC = ("0000-0", "00000-0")


def event_token(code_type: Column, code: Column) -> Column:
    """``TYPE:CODE``; null when either part is null."""
    return F.concat(code_type, F.lit(":"), code)


def lab_token(code_type: Column, code: Column, group: Column) -> Column:
    return F.concat(code_type, F.lit(":"), code, F.lit(":"), group)


def valid_lab_code(code_type: Column, code: Column) -> Column:
    """LOINC codes must have the LOINC shape; other types pass; placeholders and nulls fail."""
    shaped = code.rlike(LOINC_SHAPE) | (code_type != "LOINC")
    return shaped & code.isNotNull() & ~code.isin(*EMPTY_LOINC)


def clean_unit(unit: Column) -> Column:
    """Write exponents the way unit algebra reads them: ``mm3`` and ``mm*3`` become ``mm**3``."""
    powered = F.regexp_replace(unit, r"([a-zA-Z]+)(\d+)", "$1**$2")
    return F.regexp_replace(powered, r"([a-zA-Z]+)\*(\d+)", "$1**$2")


def ndc9(code: Column) -> Column:
    """Nine-digit drug code: hyphenated codes are padded 5+4, others keep their first nine characters."""
    part = F.split(code, "-")
    labeler = F.lpad(F.get(part, F.lit(0)), 5, "0")
    product = F.lpad(F.get(part, F.lit(1)), 4, "0")
    return F.when(code.contains("-"), F.concat(labeler, product)).otherwise(F.substring(code, 1, 9))


def code_part(text: Column, separator: str, index: int) -> Column:
    """Piece ``index`` of ``text``; null, not an error, when it is not there."""
    return F.get(F.split(text, separator), F.lit(index))


def contains_any(column: Column, keys: list[str]) -> Column:
    if not keys:
        raise ValueError("need at least one key")
    found = column.contains(keys[0])
    for key in keys[1:]:
        found = found | column.contains(key)
    return found


def percentile_group(value: Column, bounds: Column, step: int) -> Column:
    """``a-b`` text of the percentile band: a value equal to a boundary falls in the band above it."""
    below = F.size(F.filter(bounds, lambda b: b <= value))
    return F.concat((below * step).cast("string"), F.lit("-"), ((below + 1) * step).cast("string"))


def plain_number(text: Column) -> Column:
    """``text`` as double when it is written as a number; unlike a cast, ``1F`` and ``2d`` are not."""
    written = text.rlike(r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*$")
    return F.when(written, F.trim(text).try_cast("double"))


def is_label(token: Column) -> Column:
    return token.startswith("LABEL")
