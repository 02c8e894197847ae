"""Scalar expressions with exact semantics.

Whole numbers wrap, so the session needs spark.sql.ansi.enabled=false (see `session`).
`strict=True` makes an operation raise where it has no value; else it gives null. Text
positions count from 0, in code points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WHOLE = {"tinyint", "smallint", "int", "bigint"}


def session(spark: SparkSession) -> SparkSession:
    """Set what these expressions rely on."""
    spark.conf.set("spark.sql.ansi.enabled", "false")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _guarded(bad: Column, value: Column, strict: bool, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)) if strict else F.lit(None)).otherwise(value)


def divide(a: Column, b: Column, kind: str, strict: bool = False) -> Column:
    """Division within one type; whole numbers truncate. A zero divisor is an error."""
    value = F.call_function("div", a, b).cast(kind) if kind in WHOLE else (a / b).cast(kind)
    return _guarded(b == 0, value, strict, "division by zero")


def modulo(a: Column, b: Column, kind: str, strict: bool = False) -> Column:
    """The remainder with the dividend's sign. A zero divisor is an error."""
    return _guarded(b == 0, (a % b).cast(kind), strict, "division by zero")


def power(a: Column, b: Column, kind: str) -> Column:
    """Powers of whole numbers go through double, then are cut."""
    return F.pow(a, b).cast(kind)


def equal(a: Column, b: Column) -> Column:
    """Nulls are equal, NaN isn't equal to itself."""
    nan = F.coalesce(F.isnan(a.cast("double")), F.lit(False))
    return a.eqNullSafe(b) & ~nan


def bit_op(op: str, a: Column, b: Column, kind: str = "int") -> Column:
    """and, or, xor, left, right or unsigned right, computed in 64 bits, then narrowed to kind."""
    x = a.cast("long")
    y = b.cast("long")
    value = {
        "and": lambda: x.bitwiseAND(y),
        "or": lambda: x.bitwiseOR(y),
        "xor": lambda: x.bitwiseXOR(y),
        "left": lambda: F.call_function("shiftleft", x, b.cast("int")),
        "right": lambda: F.call_function("shiftright", x, b.cast("int")),
        "unsigned": lambda: F.call_function("shiftrightunsigned", x, b.cast("int")),
    }[op]()
    return value.cast(kind)


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern matches the whole text."""
    return text.rlike(rf"\A(?:{pattern})\z")


def trim(text: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\A[\x00-\x20]+", ""), r"[\x00-\x20]+\z", "")


def substring(text: Column, start: Column, end: Column, strict: bool = False) -> Column:
    """Characters [start, end). Bounds outside the text are an error."""
    bad = (start < 0) | (end > F.length(text)) | (start > end)
    return _guarded(bad, F.substring(text, start + 1, end - start), strict, "substring out of range")


def index_of(text: Column, part: Column) -> Column:
    """The first position of part, -1 if absent."""
    return F.call_function("instr", text, part) - 1


def replace(text: Column, target: str, by: str) -> Column:
    """Replace every literal target; an empty one stands between all characters and at both ends."""
    if target:
        return F.replace(text, F.lit(target), F.lit(by))
    return F.concat(F.lit(by), F.regexp_replace(text, r"(?s)(.)", "$1" + by.replace("\\", "\\\\").replace("$", "\\$")))


def one_of(value: Column, values: Sequence) -> Column:
    """IN; false for an empty list."""
    return value.isin(list(values)) if values else F.lit(False)


def case_when(branches: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    out = F.when(*branches[0])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def cross(xs: Column, ys: Column, op) -> Column:
    """A binary operation on two multi-valued paths: every pair, left first."""
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: op(x, y))))
