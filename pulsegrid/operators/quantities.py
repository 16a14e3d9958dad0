"""Quantities recorded in different units, brought to one unit.

Numbers and unit expressions are parsed with the grammar of ``functions.units`` (Arrow batches, one parse per distinct
text and worker); which unit holds where none is written is decided with column expressions from the other evidence.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import units as U

#: Values of this size or more (in the target unit) don't fit the decimals and can't be read.
LIMIT = 10**28


@lru_cache(maxsize=65536)
def _converted(number: U.Fraction, unit: str, target: str) -> Decimal | None:
    value = U.convert(number, unit, target)
    if value is None or abs(value) >= LIMIT:
        return None
    return Decimal(value.numerator * 10**9 // value.denominator).scaleb(-9)


@lru_cache(maxsize=65536)
def _entries(text: str | None, noted: str | None, target: str, guesses: tuple[str, ...]) -> tuple:
    out = []
    for n, own in U.parse_quantities(text):
        unit = own or noted
        written = _converted(n, unit, target) if n is not None and unit else None
        out.append((None if n is None else float(n), unit, written, None if n is None else [_converted(n, g, target) for g in guesses]))
    return tuple(out)


def quantities(target: str, guesses: tuple[str, ...] = ()) -> Callable[[Column, Column], Column]:
    """An Arrow function (text, unit noted elsewhere) -> the text's entries, all that is parsed in one go.

    An entry has its number (``value``), its unit (its own, else the noted one), the number in ``target`` (``written``; null without a
    unit, for another dimension or an unreadable unit), and the number in ``target`` if it were in each of the ``guesses``.
    """
    exact = T.DecimalType(38, 9)
    entry = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("written", exact), T.StructField("guessed", T.ArrayType(exact))])

    @F.pandas_udf(T.ArrayType(entry))
    def parse(texts: pd.Series, noted: pd.Series) -> pd.Series:
        text = lambda t: None if pd.isna(t) else t
        return pd.Series([[dict(zip(("value", "unit", "written", "guessed"), e)) for e in _entries(text(t), text(u), target, guesses)] for t, u in zip(texts, noted)], dtype=object)

    return parse.asNondeterministic()  # evaluated once, however many columns come from it


def header_line(text: Column, key: str) -> Column:
    """The value on the line ``-key value`` of a raw header; null where there is none or it is blank."""
    value = F.trim(F.regexp_extract(text, rf"(?im)^\s*-?{key}[ \t]+(.*)$", 1))
    return F.when(value != "", value)


def header_note_unit(text: Column) -> Column:
    """A unit named in a comment line such as ``## values in microvolts``."""
    unit = F.regexp_extract(text, r"(?im)^\s*#.*\bin\s+((?:milli|micro|nano|pico)?volts?|[mnpuµμ]?V)\b", 1)
    return F.when(unit != "", unit)


def is_true(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "t", "yes", "y", "1", "on", "inverted"), F.lit(False))


def bit_volts(headers: DataFrame, typical_range_uv: float = 1200.0) -> DataFrame:
    """One row per readable sub-channel value: header_id, sub_channel, unit, pv_per_bit (decimal), native (in volts per bit).

    The list comes from ``adbitvolts``, or from the raw header where that has no digits. The unit is the one written with
    the value, else the units line, else a comment. Without any of these, and where the written unit contradicts the input
    range by more than a factor of 3, that unit holds which makes value x ADMaxValue nearest to the input range (or to
    ``typical_range_uv`` where no range is known; the units lie a factor of 1000 apart, the ranges of one device far less).
    Null or unreadable texts give no rows; an unreadable entry keeps its position. A null or empty InputInverted counts as
    not inverted. Repeated headers are rows of their own; other columns are ignored.
    """
    raw = F.col("headertext")
    digits = r"\d"
    own = F.when(F.col("adbitvolts").rlike(digits), F.col("adbitvolts"))
    base = headers.select(
        "header_id",
        F.coalesce(own, header_line(raw, "ADBitVolts")).alias("_text"),
        F.coalesce(header_line(raw, "ADBitVoltsUnits"), header_note_unit(raw)).alias("_noted"),
        F.coalesce(F.col("admaxvalue").cast("double"), F.expr("try_cast(regexp_extract(headertext, '(?im)^\\\\s*-ADMaxValue\\\\s+(\\\\d+)', 1) as double)")).alias("_max"),
        F.coalesce(F.when(F.col("inputrange").rlike(digits), F.col("inputrange")), header_line(raw, "InputRange")).alias("_ranges"),
        is_true(F.coalesce(F.when(F.trim("inputinverted") != "", F.col("inputinverted")), header_line(raw, "InputInverted"))).alias("_inverted"),
    ).filter(F.col("_text").rlike(digits))
    ranges = F.regexp_extract_all("_ranges", F.lit(r"(\d+(?:\.\d+)?)"), 1)
    entries = base.withColumn("_r", ranges).select("*", F.posexplode(quantities("pV/bit", ("V", "mV", "uV", "nV"))("_text", "_noted")).alias("sub_channel", "_e")).filter("_e.value is not null")
    span = F.coalesce(F.try_element_at("_r", F.col("sub_channel") + 1).cast("double"), F.when(F.size("_r") == 1, F.try_element_at("_r", F.lit(1)).cast("double")))
    entries = entries.select("*", F.col("_e.value").alias("_value"), F.col("_e.unit").alias("_written"), F.col("_e.written").alias("_written_pv"), span.alias("_span"))
    # log10 of (value in volts x ADMaxValue / range in volts), before any unit prefix
    known = (F.col("_value") != 0) & (F.col("_max") > 0)
    off = F.when(known, F.log10(F.abs("_value") * F.col("_max") / (F.coalesce("_span", F.lit(typical_range_uv)) * 1e-6)))
    thousands = F.coalesce(F.least(F.lit(3), F.greatest(F.lit(0), F.round(F.col("_off") / 3).cast("int"))), F.lit(0))
    entries = entries.withColumn("_off", off).withColumn("_prefix", thousands)
    wrong = F.abs(F.log10(F.abs(F.col("_written_pv").cast("double")) * 1e-12 * F.col("_max") / (F.col("_span") * 1e-6))) > 0.5
    readable = F.col("_written").isNull() | F.col("_written_pv").isNotNull()
    guess = F.col("_written").isNull() | F.coalesce((F.col("_written_pv") != 0) & known & wrong, F.lit(False))
    unit = F.when(guess, F.element_at(F.array(*[F.lit(u) for u in ("V", "mV", "uV", "nV")]), F.col("_prefix") + 1)).otherwise(F.col("_written"))
    value = F.when(guess, F.get("_e.guessed", F.col("_prefix"))).otherwise(F.col("_written_pv"))
    resolved = entries.filter(readable).withColumn("unit", unit).withColumn("_pv", value).filter("_pv is not null")
    native = F.col("_pv").cast("double") == F.round(F.col("_value") * 1e12).cast("double")
    return resolved.select(
        "header_id", F.col("sub_channel").cast("int").alias("sub_channel"), "unit",
        F.when(F.col("_inverted"), -F.col("_pv")).otherwise(F.col("_pv")).alias("pv_per_bit"), native.alias("native"),
    )
