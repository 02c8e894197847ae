"""Validation rules as columns; each gives true or false, and null values pass unless the rule says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TIME = r"[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})"
#: Formats by name, as far as a pattern can tell.
FORMATS = {
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "time": _TIME,
    "date-time": r"[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt]" + _TIME,
    "email": r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "uri": r"[A-Za-z][A-Za-z0-9+.-]*:[^\s]+",
    "ipv4": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "hostname": r"[A-Za-z0-9.-]{1,253}",
    "json-pointer": r"(?:/(?:[^~/]|~[01])*)*",
}


def _ok(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(True))


def positive(c: Column) -> Column:
    return _ok(c > 0)


def negative(c: Column) -> Column:
    return _ok(c < 0)


def non_positive(c: Column) -> Column:
    return _ok(c <= 0)


def non_negative(c: Column) -> Column:
    return _ok(c >= 0)


def in_range(c: Column, low=None, high=None) -> Column:
    """Inclusive; a bound may be left out."""
    return _ok((F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high))


def in_set(c: Column, values: Sequence) -> Column:
    return _ok(c.isin(list(values)) if values else F.lit(False))


def empty(c: Column) -> Column:
    return _ok(c == "")


def non_empty(c: Column) -> Column:
    return _ok(c != "")


def blank(c: Column) -> Column:
    return _ok(~c.rlike(r"\S"))


def non_blank(c: Column) -> Column:
    return _ok(c.rlike(r"\S"))


def length(c: Column, low: int | None = None, high: int | None = None) -> Column:
    return in_range(F.length(c), low, high)


def pattern(c: Column, regex: str) -> Column:
    """The whole text matches."""
    return _ok(c.rlike(rf"\A(?:{regex})\z"))


def _real_date(c: Column) -> Column:
    """Whether the first ten characters name a day of the calendar."""
    part = lambda at, n: F.substring(c, at, n).cast("int")
    year, month, day = part(1, 4), part(6, 2), part(9, 2)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return month.between(1, 12) & day.between(1, last)


def _real_time(c: Column) -> Column:
    """Whether a text ends with a time of day and an offset of at most 18 hours."""
    found = lambda k: F.regexp_extract(c, r"([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.[0-9]+)?(?:[Zz]|[+-]([0-9]{2}):([0-9]{2}))\z", k)
    off, minutes = (F.coalesce(F.nullif(found(k), F.lit("")), F.lit("00")).cast("int") for k in (4, 5))
    clock = (found(1).cast("int") <= 23) & (found(2).cast("int") <= 59) & (found(3).cast("int") <= 59)
    return clock & (minutes <= 59) & (off * 60 + minutes <= 18 * 60)


def format_of(c: Column, name: str) -> Column:
    """A named format; unknown names are always valid."""
    if name not in FORMATS:
        return F.lit(True)
    ok = pattern(c, FORMATS[name])
    if name == "ipv4":
        # numbers up to 255 without leading zeros, which some readers take for octal
        part = lambda p: (p == p.cast("int").cast("string")) & (p.cast("int") <= 255)
        more = F.forall(F.split(c, r"\."), part)
    elif name == "hostname":
        # labels of 1 to 63 letters, digits and hyphens, no hyphen at either end
        more = F.forall(F.split(c, r"\."), lambda p: F.length(p).between(1, 63) & ~p.startswith("-") & ~p.endswith("-"))
    else:
        more = {"date": _real_date, "time": _real_time, "date-time": lambda x: _real_date(x) & _real_time(x)}.get(name, lambda x: F.lit(True))(c)
    # the second part is only asked where the first holds, so that its casts can't fail
    return F.when(ok & c.isNotNull(), _ok(more)).otherwise(ok)


def required(c: Column) -> Column:
    return c.isNotNull()


def check(df: DataFrame, rules: dict[str, Column], into: str = "errors") -> DataFrame:
    """Attach the names of the rules that a row breaks, in order."""
    return df.withColumn(into, F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull()))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with their errors."""
    checked = check(df, rules)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
