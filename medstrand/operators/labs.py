"""Lab cleaning, unit conversion and percentile tokens."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medstrand.functions import codes
from medstrand.functions.units import unit_terms
from medstrand.operators.scale import Join, salted_join
from medstrand.schema import sequence_element
from medstrand.sources.sinks import materialise

# Decimal prefixes of unit symbols.
PREFIXES = {
    "": 1.0, "Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3,
    "h": 1e2, "da": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "µ": 1e-6, "μ": 1e-6,
    "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24,
}
# Prefixable units as factor and exponents of kg, m, s, mol, K, A, cd.
PREFIXED_UNITS = {
    "g": (1e-3, (1, 0, 0, 0, 0, 0, 0)),
    "m": (1.0, (0, 1, 0, 0, 0, 0, 0)),
    "s": (1.0, (0, 0, 1, 0, 0, 0, 0)),
    "mol": (1.0, (0, 0, 0, 1, 0, 0, 0)),
    "K": (1.0, (0, 0, 0, 0, 1, 0, 0)),
    "A": (1.0, (0, 0, 0, 0, 0, 1, 0)),
    "L": (1e-3, (0, 3, 0, 0, 0, 0, 0)),
    "l": (1e-3, (0, 3, 0, 0, 0, 0, 0)),
    "U": (1e-6 / 60, (0, 0, -1, 1, 0, 0, 0)),
    "kat": (1.0, (0, 0, -1, 1, 0, 0, 0)),
    "M": (1e3, (0, -3, 0, 1, 0, 0, 0)),
    "N": (1.0, (1, 1, -2, 0, 0, 0, 0)),
    "J": (1.0, (1, 2, -2, 0, 0, 0, 0)),
    "Pa": (1.0, (1, -1, -2, 0, 0, 0, 0)),
    "bar": (1e5, (1, -1, -2, 0, 0, 0, 0)),
    "cal": (4.184, (1, 2, -2, 0, 0, 0, 0)),
    "Hz": (1.0, (0, 0, -1, 0, 0, 0, 0)),
    "W": (1.0, (1, 2, -3, 0, 0, 0, 0)),
    "V": (1.0, (1, 2, -3, 0, 0, -1, 0)),
    "eq": (1.0, (0, 0, 0, 1, 0, 0, 0)),
}
# Units taken as they are.
PLAIN_UNITS = {
    "min": (60.0, (0, 0, 1, 0, 0, 0, 0)),
    "minute": (60.0, (0, 0, 1, 0, 0, 0, 0)),
    "h": (3600.0, (0, 0, 1, 0, 0, 0, 0)),
    "hr": (3600.0, (0, 0, 1, 0, 0, 0, 0)),
    "hour": (3600.0, (0, 0, 1, 0, 0, 0, 0)),
    "d": (86400.0, (0, 0, 1, 0, 0, 0, 0)),
    "day": (86400.0, (0, 0, 1, 0, 0, 0, 0)),
    "week": (604800.0, (0, 0, 1, 0, 0, 0, 0)),
    "year": (31557600.0, (0, 0, 1, 0, 0, 0, 0)),
    "sec": (1.0, (0, 0, 1, 0, 0, 0, 0)),
    "second": (1.0, (0, 0, 1, 0, 0, 0, 0)),
    "gram": (1e-3, (1, 0, 0, 0, 0, 0, 0)),
    "liter": (1e-3, (0, 3, 0, 0, 0, 0, 0)),
    "mole": (1.0, (0, 0, 0, 1, 0, 0, 0)),
    "lb": (0.45359237, (1, 0, 0, 0, 0, 0, 0)),
    "oz": (0.028349523125, (1, 0, 0, 0, 0, 0, 0)),
    "in": (0.0254, (0, 1, 0, 0, 0, 0, 0)),
    "inch": (0.0254, (0, 1, 0, 0, 0, 0, 0)),
    "ft": (0.3048, (0, 1, 0, 0, 0, 0, 0)),
    "mmHg": (133.322387415, (1, -1, -2, 0, 0, 0, 0)),
    "%": (0.01, (0, 0, 0, 0, 0, 0, 0)),
    "percent": (0.01, (0, 0, 0, 0, 0, 0, 0)),
}
# Long names of prefixes and of prefixable units; a plural ends in s.
PREFIX_NAMES = {
    "": "", "kilo": "k", "deci": "d", "centi": "c", "milli": "m", "micro": "u", "nano": "n", "pico": "p", "femto": "f",
}
UNIT_NAMES = {
    "gram": "g", "liter": "L", "litre": "L", "mole": "mol", "meter": "m", "metre": "m", "second": "s", "unit": "U",
    "joule": "J", "pascal": "Pa", "katal": "kat", "equivalent": "eq",
}
PLURALS = ("minute", "hour", "day", "week", "year")
DIMENSIONS = ("kg", "m", "s", "mol", "K", "A", "cd")
# Units with a zero of their own, as symbol, kelvins a degree, kelvins at zero.
OFFSET_UNITS = {
    "degC": (1.0, 273.15), "Cel": (1.0, 273.15), "°C": (1.0, 273.15), "celsius": (1.0, 273.15),
    "degF": (5 / 9, 459.67 * 5 / 9), "°F": (5 / 9, 459.67 * 5 / 9), "fahrenheit": (5 / 9, 459.67 * 5 / 9),
}


def unit_table(spark: SparkSession) -> DataFrame:
    """Symbol, factor to base units, base units at its zero, and dimension exponents; prefixed symbols come from a rule."""
    rows = {
        prefix + symbol: (factor * scale, dims)
        for symbol, (factor, dims) in PREFIXED_UNITS.items()
        for prefix, scale in PREFIXES.items()
    }
    for long, short in PREFIX_NAMES.items():
        for name, symbol in UNIT_NAMES.items():
            rows[long + name] = rows[long + name + "s"] = rows[short + symbol]
    rows.update({name + "s": PLAIN_UNITS[name] for name in PLURALS})
    rows.update(PLAIN_UNITS)  # an exact name wins over a prefixed reading, e.g. ``min``
    kelvin = PREFIXED_UNITS["K"][1]
    rows.update({symbol: (degree, kelvin) for symbol, (degree, _) in OFFSET_UNITS.items()})
    zero = {symbol: at for symbol, (_, at) in OFFSET_UNITS.items()}
    ddl = "symbol string, factor double, zero double, " + ", ".join(f"`{d}` int" for d in DIMENSIONS)
    return spark.createDataFrame([(s, f, zero.get(s, 0.0), *d) for s, (f, d) in rows.items()], ddl)


def unit_factors(units: DataFrame, column: str) -> DataFrame:
    """``column, factor, zero, dimension`` of each distinct unit text; all null when it cannot be read.

    Works on distinct texts: the terms of a text become rows, meet the unit table, and are multiplied
    back together. ``zero`` is what the unit's 0 is in base units; it counts where a temperature
    stands alone, while in a product or power a degree is a difference.
    """
    distinct = units.select(column).filter(F.col(column).isNotNull()).distinct()
    read = distinct.withColumn("_terms", unit_terms(F.col(column)))
    terms = read.select(column, F.size("_terms").alias("_size"), F.explode_outer("_terms").alias("_term")).select(
        column, "_size", F.col("_term.symbol").alias("symbol"), F.col("_term.power").alias("_power")
    )
    table = F.broadcast(unit_table(units.sparkSession))  # fixed size
    known = terms.join(table, "symbol", "left")
    base = F.coalesce(F.col("factor"), F.expr("try_cast(symbol as double)"))
    readable = F.min(base.isNotNull())
    alone = (F.col("_size") == 1) & (F.col("_power") == 1)
    dimension = F.concat_ws(
        ",",
        *[F.sum(F.coalesce(F.col(d), F.lit(0)) * F.col("_power")).cast("string") for d in DIMENSIONS],
    )
    return known.groupBy(column).agg(
        F.when(readable, F.product(F.pow(base, F.col("_power")))).alias("factor"),
        F.when(readable, F.max(F.when(alone, F.coalesce("zero", F.lit(0.0))).otherwise(0.0))).alias("zero"),
        F.when(readable, dimension).alias("dimension"),
    )


def _significant(x: Column, digits: int = 12) -> Column:
    """Drop float noise beyond ``digits`` significant digits."""
    return F.format_string(f"%.{digits - 1}e", x).try_cast("double")


def unit_counts(labs: DataFrame) -> DataFrame:
    return (
        labs.select("lx_lab_code_type", "lx_lab_code", "lx_result_unit")
        .dropna()
        .groupBy("lx_lab_code_type", "lx_lab_code", "lx_result_unit")
        .agg(F.count("*").alias("n"))
    )


def ranked_units(labs: DataFrame) -> DataFrame:
    """Units of each code by frequency, ties by cleaned text; ``rank`` 1 is the base unit."""
    counts = (
        unit_counts(labs)
        .groupBy("lx_lab_code", "lx_result_unit")
        .agg(F.sum("n").alias("n"))
        .withColumn("clean_unit", codes.clean_unit(F.col("lx_result_unit")))
    )
    window = Window.partitionBy("lx_lab_code").orderBy(
        F.desc("n"), F.asc("clean_unit"), F.asc("lx_result_unit")
    )
    return counts.withColumn("rank", F.row_number().over(window))


def base_units(labs: DataFrame) -> DataFrame:
    """The most frequent unit of each code, as one aggregate."""
    return ranked_units(labs).filter("rank = 1").select("lx_lab_code", "lx_result_unit", "n")


def conversion_factors(pairs: DataFrame, base: str, other: str) -> DataFrame:
    """Add ``conversion_factor`` and ``conversion_offset`` from unit ``other`` to unit ``base``.

    Equal text gives 1 and 0, incompatible units null. A value is converted as value * factor +
    offset; the offset is 0 but between temperatures with different zeros.
    """
    units = pairs.select(F.explode(F.array(base, other)).alias("_unit"))
    factors = unit_factors(units, "_unit")
    side = lambda p, c: factors.select(
        F.col("_unit").alias(c), *[F.col(x).alias(f"{p}_{x[0]}") for x in ("factor", "zero", "dimension")]
    )
    joined = pairs.join(side("_b", base), base, "left").join(side("_o", other), other, "left")
    same = codes.clean_unit(F.col(base)) == codes.clean_unit(F.col(other))
    alike = F.col("_b_d") == F.col("_o_d")
    ratio = F.when(alike, _significant(F.col("_o_f") / F.col("_b_f")))
    offset = F.when(alike, _significant((F.col("_o_z") - F.col("_b_z")) / F.col("_b_f")))
    return (
        joined.withColumn("conversion_factor", F.when(same, F.lit(1.0)).otherwise(ratio))
        .withColumn("conversion_offset", F.when(same, F.lit(0.0)).otherwise(offset))
        .drop("_b_f", "_b_z", "_b_d", "_o_f", "_o_z", "_o_d")
    )


def unit_conversions(labs: DataFrame) -> DataFrame:
    """``lx_lab_code, lx_result_unit`` (base), ``lx_result_other_unit, conversion_factor, conversion_offset``, a row a unit seen."""
    ranked = ranked_units(labs)
    base = F.max(F.when(F.col("rank") == 1, F.col("lx_result_unit"))).over(
        Window.partitionBy("lx_lab_code")
    )
    pairs = ranked.select(
        "lx_lab_code", F.col("lx_result_unit").alias("lx_result_other_unit"), base.alias("lx_result_unit")
    )
    return conversion_factors(pairs, "lx_result_unit", "lx_result_other_unit").select(
        "lx_lab_code", "lx_result_unit", "lx_result_other_unit", "conversion_factor", "conversion_offset"
    )


def clean_code() -> Column:
    return codes.valid_lab_code(F.col("lx_lab_code_type"), F.col("lx_lab_code"))


def clean_value() -> Column:
    """The result as a number; null where it does not read as one. Its one mention reads the text once."""
    return F.nanvl(F.expr("try_cast(lx_result_val as double)"), F.lit(None).cast("double"))


def filter_codes(labs: DataFrame) -> DataFrame:
    return labs.filter(clean_code())


def numeric_results(labs: DataFrame) -> DataFrame:
    """Rows with a unit and a value that reads as a number."""
    return labs.withColumn("lx_result_val", clean_value()).dropna(subset=["lx_result_unit", "lx_result_val"])


def clean(labs: DataFrame) -> DataFrame:
    return numeric_results(filter_codes(labs))


def convert(labs: DataFrame, conversions: DataFrame, join: Join = salted_join, also: Sequence[str] = ()) -> DataFrame:
    """Add ``lx_result_val_converted`` in the base unit; rows with no conversion drop out (``pass_rates`` counts them).

    ``join`` is how hot codes are met: ``scale.salted_join``, or ``skew.measured_join``. ``also`` names further
    columns of ``conversions`` to add.
    """
    # A stored table without offsets has none but 0.
    offset = F.col("conversion_offset") if "conversion_offset" in conversions.columns else F.lit(0.0)
    table = conversions.filter(F.col("conversion_factor").isNotNull()).select(
        "lx_lab_code", "lx_result_other_unit", "conversion_factor", offset.alias("_offset"), "lx_result_unit", *also
    )
    named = labs.withColumnRenamed("lx_result_unit", "lx_result_other_unit")
    joined = join(named, table, ["lx_lab_code", "lx_result_other_unit"])
    scaled = joined.withColumn(
        "lx_result_val_converted", F.col("lx_result_val") * F.col("conversion_factor") + F.col("_offset")
    ).drop("_offset")
    return scaled.filter(F.col("lx_result_val_converted").isNotNull())


def frequent_codes(converted: DataFrame, min_count: int, min_values: int) -> DataFrame:
    """Codes with more than ``min_count`` rows and more than ``min_values`` distinct values.

    Values are first counted per (code, value), so a hot code is combined before it is gathered.
    """
    per_value = converted.groupBy("lx_lab_code", "lx_result_val").agg(F.count("*").alias("_n"))
    return (
        per_value.groupBy("lx_lab_code")
        .agg(F.sum("_n").alias("n"), F.count("lx_result_val").alias("value_counts"))
        .filter((F.col("n") > min_count) & (F.col("value_counts") > min_values))
        .select("lx_lab_code", "value_counts")
    )


def filter_frequent(converted: DataFrame, min_count: int, min_values: int) -> DataFrame:
    return salted_join(converted, frequent_codes(converted, min_count, min_values), ["lx_lab_code"])


def _quantiles(step: int) -> list[float]:
    if 100 % step:
        raise ValueError("the percentile step must divide 100")
    return [i * step / 100 for i in range(1, 100 // step)]


def percentiles(converted: DataFrame, step: int = 10, accuracy: int = 10_000) -> DataFrame:
    """Boundaries per code, as an array and as ``percentile_<p>`` columns; sketches merge map-side."""
    quantiles = _quantiles(step)
    wanted = F.array(*[F.lit(q) for q in quantiles])
    bounds = converted.groupBy("lx_lab_code").agg(
        F.percentile_approx("lx_result_val_converted", wanted, accuracy).alias("percentile_boundaries")
    )
    named = [
        F.col("percentile_boundaries")[i].alias(f"percentile_{(i + 1) * step}")
        for i in range(len(quantiles))
    ]
    return bounds.select("lx_lab_code", "percentile_boundaries", *named)


def _check_step(step: int) -> None:
    if 100 // step < 3:
        raise ValueError("need at least three percentile groups")


def percentile_groups(
    converted: DataFrame, table: DataFrame, step: int = 10, join: Join = salted_join
) -> DataFrame:
    """Add ``percentile_group`` text; codes without boundaries drop out."""
    _check_step(step)
    return _grouped(join(converted, table.select("lx_lab_code", "percentile_boundaries"), ["lx_lab_code"]), step)


def _grouped(bounded: DataFrame, step: int) -> DataFrame:
    group = codes.percentile_group(
        F.col("lx_result_val_converted"), F.col("percentile_boundaries"), step
    )
    return bounded.withColumn("percentile_group", group).drop("percentile_boundaries")


def lab_tokens(grouped: DataFrame) -> DataFrame:
    token = codes.lab_token(F.col("lx_lab_code_type"), F.col("lx_lab_code"), F.col("percentile_group"))
    return grouped.select(token.alias("general_event_token"), "date", "person_id")


def _lazy(table: DataFrame, name: str) -> DataFrame:
    return table


Save = Callable[[DataFrame, str], DataFrame]


def _fit(usable, min_count, min_values, step, accuracy, save: Save, join: Join = salted_join) -> tuple[DataFrame, DataFrame]:
    """Conversions and boundaries of cleaned labs; the threshold test rides on the boundary table.

    Thresholds and boundaries need no more of a lab than code and value, so no more is converted.
    """
    conversions = save(unit_conversions(usable), "conversions")
    values = convert(usable.select("lx_lab_code", "lx_result_unit", "lx_result_val"), conversions, join)
    frequent = frequent_codes(values, min_count, min_values).select("lx_lab_code")
    bounds = percentiles(values, step, accuracy).join(frequent, "lx_lab_code", "left_semi")
    return conversions, save(bounds, "percentiles")


def fit(
    labs: DataFrame,
    min_count: int,
    min_values: int,
    step: int = 10,
    accuracy: int = 10_000,
    save: Save = _lazy,
) -> tuple[DataFrame, DataFrame]:
    """Learn ``(conversions, percentiles)`` from raw labs.

    ``save`` may store the cleaned labs and the two fitted tables, which later steps then read instead of
    making them again. By default everything stays one lazy plan.
    """
    usable = clean(labs).select("lx_lab_code_type", "lx_lab_code", "lx_result_unit", "lx_result_val")
    return _fit(save(usable, "labs"), min_count, min_values, step, accuracy, save)


def apply(
    labs: DataFrame,
    conversions: DataFrame,
    table: DataFrame,
    min_count: int,
    min_values: int,
    step: int = 10,
    save: Save = _lazy,
) -> DataFrame:
    """Raw labs to tokens with given tables; the frequency thresholds apply to these labs.

    Thresholds and tokens both read the converted labs, which ``save`` may store.
    """
    converted = save(convert(clean(labs), conversions), "converted")
    codes_in = frequent_codes(converted, min_count, min_values).select("lx_lab_code")
    usable = table.join(codes_in, "lx_lab_code", "left_semi")
    return lab_tokens(percentile_groups(converted, usable, step))


def fit_apply(
    labs: DataFrame,
    min_count: int,
    min_values: int,
    step: int = 10,
    accuracy: int = 10_000,
    save: Save = _lazy,
    join: Join = salted_join,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(tokens, conversions, percentiles)`` from raw labs, with ``save`` as in ``fit`` and ``join`` as in ``convert``."""
    return fit_apply_clean(save(clean(labs), "labs"), min_count, min_values, step, accuracy, save, join)


def fit_apply_clean(
    usable: DataFrame,
    min_count: int,
    min_values: int,
    step: int = 10,
    accuracy: int = 10_000,
    save: Save = _lazy,
    join: Join = salted_join,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``fit_apply`` of labs that ``clean`` has seen; they are read several times, so they should be stored.

    A lab meets its factor and its code's boundaries in one join, by code and unit; ``save`` may store that lookup,
    so that the join knows how small it is.
    """
    _check_step(step)
    conversions, table = _fit(usable, min_count, min_values, step, accuracy, save, join)
    bounded = save(conversions.join(table.select("lx_lab_code", "percentile_boundaries"), "lx_lab_code"), "bounded")
    converted = convert(usable, bounded, join, ["percentile_boundaries"])
    return lab_tokens(_grouped(converted, step)), conversions, table


def pass_rates(labs: DataFrame, conversions: DataFrame | None = None) -> DataFrame:
    """One row of percentages: labs passing the quality rules and, of those, passing unit conversion."""
    is_number = F.expr("try_cast(lx_result_val as double)")
    good = (
        codes.valid_lab_code(F.col("lx_lab_code_type"), F.col("lx_lab_code"))
        & F.col("lx_result_unit").isNotNull()
        & is_number.isNotNull()
        & ~F.isnan(is_number)
    )
    if conversions is None:
        conversions = unit_conversions(clean(labs))
    table = conversions.filter(F.col("conversion_factor").isNotNull()).select(
        "lx_lab_code", F.col("lx_result_other_unit").alias("lx_result_unit"), F.lit(1).alias("_ok")
    )
    # Counts per (code, unit) first, so the join sees distinct pairs and not every lab row.
    pairs = labs.groupBy("lx_lab_code", "lx_result_unit").agg(
        F.count("*").alias("_all"), F.sum(F.when(good, 1).otherwise(0)).alias("_good")
    )
    joined = pairs.join(table, ["lx_lab_code", "lx_result_unit"], "left")
    return joined.agg(
        F.sum("_all").alias("n_before"),
        F.sum("_good").alias("n_clean"),
        F.coalesce(F.sum(F.when(F.col("_ok") == 1, F.col("_good"))), F.lit(0)).alias("n_converted"),
    ).select(
        "n_before",
        "n_clean",
        "n_converted",
        F.coalesce(F.try_divide(F.col("n_clean") * 100.0, F.col("n_before")), F.lit(0.0)).alias("clean_percent"),
        F.coalesce(F.try_divide(F.col("n_converted") * 100.0, F.col("n_clean")), F.lit(0.0)).alias("converted_percent"),
    )


def _parsed(rows: DataFrame, token: Column) -> DataFrame:
    """``rows`` of lab tokens with ``lx_lab_code``, ``_unit`` and ``_value``, null where a token cannot be read."""
    part = F.split(token, ":")
    read = F.size(part) == 4
    return rows.withColumns(
        {
            "lx_lab_code": F.when(read, F.get(part, F.lit(1))),
            "_unit": F.when(read, F.get(part, F.lit(3))),
            "_value": F.when(read, codes.plain_number(F.get(part, F.lit(2)))),
        }
    )


def _rewritten(parsed: DataFrame, conversions: DataFrame, table: DataFrame, groups: int) -> DataFrame:
    """``parsed`` with ``_new``, the token with its percentile group; null where it cannot be converted.

    Tokens with values are nearly all different, so they are not looked up by themselves: factors and
    boundaries are found for the distinct pairs of code and unit, whose number does not grow with the
    values. Boundaries fitted for another number of groups stop the job.
    """
    step = 100 // groups
    pairs = parsed.filter(F.col("_value").isNotNull()).select("lx_lab_code", "_unit").distinct()
    base = conversions.select("lx_lab_code", F.col("lx_result_unit").alias("_base")).distinct()
    based = pairs.join(base, "lx_lab_code")
    factors = conversion_factors(based.select("_base", "_unit").distinct(), "_base", "_unit")
    bounds = F.col("percentile_boundaries")
    # Stored first: then the join knows how few they are, and the pairs are not sought again.
    found = materialise(
        based.join(factors, ["_base", "_unit"])
        .filter(F.col("conversion_factor").isNotNull())
        .join(table.select("lx_lab_code", "percentile_boundaries"), "lx_lab_code")
        .select("lx_lab_code", "_unit", "conversion_factor", "conversion_offset", "percentile_boundaries"),
        "rewrites",
    )
    other = F.raise_error(F.concat(F.lit(f"not a table of {groups} groups: "), F.size(bounds).cast("string"), F.lit(" boundaries")))
    group = F.when(
        F.size(bounds) + 1 == groups, codes.percentile_group(
            F.col("_value") * F.col("conversion_factor") + F.col("conversion_offset"), bounds, step
        )
    ).otherwise(other.cast("string"))
    new = F.concat(F.lit("LOINC:"), "lx_lab_code", F.lit(":"), group)
    known = F.col("_value").isNotNull() & bounds.isNotNull()
    return salted_join(parsed, found, ["lx_lab_code", "_unit"], "left").withColumn("_new", F.when(known, new))


def event_percentiles(events: DataFrame, conversions: DataFrame, table: DataFrame, groups: int = 10) -> DataFrame:
    """Long events with ``LOINC:code:value:unit`` tokens rewritten to ``LOINC:code:a-b``; those that cannot be drop.

    ``events`` are read twice, so they should be stored.
    """
    token = F.col("general_event_token")
    is_lab = F.coalesce(token.startswith("LOINC"), F.lit(False))
    labs = _rewritten(_parsed(events.filter(is_lab), token), conversions, table, groups).filter(F.col("_new").isNotNull())
    labs = labs.withColumn("general_event_token", F.col("_new")).select(*events.columns)
    return events.filter(~is_lab).unionByName(labs)


def token_percentiles(
    sequences: DataFrame,
    keys: Sequence[str],
    conversions: DataFrame,
    table: DataFrame,
    groups: int = 10,
) -> DataFrame:
    """Rewrite ``LOINC:code:value:unit`` elements of ``seq`` to ``LOINC:code:a-b``.

    Malformed or unconvertible ones are dropped. ``sequences`` are read twice, so they should be stored.
    """
    keys = list(keys)
    items = sequences.select(*keys, F.posexplode_outer("seq").alias("_pos", "_x"))
    is_lab = F.coalesce(F.col("_x.token").startswith("LOINC"), F.lit(False))
    labs = _rewritten(_parsed(items.filter(is_lab), F.col("_x.token")), conversions, table, groups)
    others = items.filter(~is_lab).withColumn("_new", F.col("_x.token"))
    joined = others.unionByName(labs.select(*keys, "_pos", "_x", "_new"))
    rebuilt = joined.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_new").isNotNull(), F.struct("_pos", "_x", F.col("_new").alias("_t"))))),
            lambda y: sequence_element(y["_x"]["date"], y["_x"]["day"], y["_t"]),
        ).alias("seq")
    )
    rest = [c for c in sequences.columns if c not in ("seq", *keys)]
    return rebuilt.join(sequences.select(*keys, *rest), keys) if rest else rebuilt
