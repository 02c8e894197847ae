"""Conversions between primitive types. A value that doesn't fit gives null, or raises with strict=True."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ranges of whole numbers.
RANGES = {"tinyint": (-128, 127), "smallint": (-32768, 32767), "int": (-2147483648, 2147483647), "bigint": (-9223372036854775808, 9223372036854775807)}


def _or_error(value: Column, source: Column, strict: bool, kind: str) -> Column:
    if not strict:
        return value
    return F.when(source.isNotNull() & value.isNull(), F.raise_error(F.lit(f"no {kind}"))).otherwise(value)


def narrow(value: Column, kind: str, strict: bool = False) -> Column:
    """A whole number to a smaller type, if it fits."""
    low, high = RANGES[kind]
    return _or_error(F.when(value.between(low, high), value.cast(kind)), value, strict, kind)


def to_whole(value: Column, kind: str, strict: bool = False) -> Column:
    """A float or double cut to a whole number; none for what isn't finite or doesn't fit."""
    low, high = RANGES[kind]
    v = value.cast("double")
    # 2^63 itself is a double, the largest long isn't
    below = v < float(high + 1) if kind == "bigint" else v < float(high) + 1
    above = v >= float(low) if kind == "bigint" else v > float(low) - 1
    return _or_error(F.when(~F.isnan(v) & above & below, v.cast(kind)), value, strict, kind)


def parse_whole(text: Column, kind: str, strict: bool = False) -> Column:
    """Digits with an optional sign, no blanks."""
    return _or_error(F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast(kind)), text, strict, kind)


def parse_double(text: Column, kind: str = "double", strict: bool = False) -> Column:
    """A decimal number with an optional exponent, no blanks; also NaN and Infinity."""
    number = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
    named = r"\A(?:NaN|[+-]?Infinity)\z"
    return _or_error(F.when(text.rlike(number) | text.rlike(named), text.try_cast(kind)), text, strict, kind)


def parse_boolean(text: Column, strict: bool = False) -> Column:
    """true or false, in any case."""
    low = F.lower(text)
    return _or_error(F.when(low == "true", True).when(low == "false", False), text, strict, "boolean")


def char_code(text: Column) -> Column:
    return F.ascii(text)


def code_char(code: Column) -> Column:
    """The character of a code below 65,536."""
    return F.when(code.between(0, 65535), F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE"))
