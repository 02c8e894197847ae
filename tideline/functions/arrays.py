"""Functions on array columns, all of them inside the JVM. Positions count from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def drop(xs: Column, n: int) -> Column:
    return F.slice(xs, n + 1, F.size(xs)) if n > 0 else xs


def take(xs: Column, n: int) -> Column:
    return F.slice(xs, 1, max(0, n))


def drop_right(xs: Column, n: int) -> Column:
    return F.slice(xs, F.lit(1), F.greatest(F.lit(0), F.size(xs) - n)) if n > 0 else xs


def take_right(xs: Column, n: int) -> Column:
    return F.slice(xs, F.greatest(F.lit(1), F.size(xs) - n + 1), F.size(xs)) if n > 0 else F.slice(xs, 1, 0)


def between(xs: Column, start: int, until: int) -> Column:
    """Items at [start, until); bounds outside are cut."""
    start = max(0, start)
    return F.slice(xs, start + 1, max(0, until - start))


def index_where(xs: Column, p: Callable, start: int = 0) -> Column:
    """The first position from start on that matches, else -1."""
    hits = F.filter(F.transform(xs, lambda x, i: F.when(F.coalesce(p(x), F.lit(False)) & (i >= start), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(-1))


def _prefix(xs: Column, p: Callable) -> Column:
    """How many items come before the first that doesn't match."""
    at = index_where(xs, lambda x: ~F.coalesce(p(x), F.lit(False)))
    return F.when(at < 0, F.size(xs)).otherwise(at)


def take_while(xs: Column, p: Callable) -> Column:
    return F.slice(xs, F.lit(1), _prefix(xs, p))


def drop_while(xs: Column, p: Callable) -> Column:
    return F.slice(xs, _prefix(xs, p) + 1, F.size(xs) + 1)


def drop_until(xs: Column, p: Callable) -> Column:
    """What comes after the first match; nothing if there is none."""
    at = index_where(xs, p)
    return F.slice(xs, F.when(at < 0, F.size(xs) + 1).otherwise(at + 2), F.size(xs) + 1)


def span(xs: Column, p: Callable) -> Column:
    return F.struct(take_while(xs, p).alias("first"), drop_while(xs, p).alias("rest"))


def split_at(xs: Column, n: int) -> Column:
    return F.struct(take(xs, n).alias("first"), drop(xs, n).alias("rest"))


def split_where(xs: Column, p: Callable) -> Column:
    """Split before the first match."""
    return span(xs, lambda x: ~F.coalesce(p(x), F.lit(False)))


def split(xs: Column, n: int) -> Column:
    """n nearly equal parts, the first ones one longer; fewer if there are fewer items."""
    size, more = F.floor(F.size(xs) / n), F.size(xs) % n
    start = lambda i: i * size + F.least(i, more)
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(xs, (start(i) + 1).cast("int"), (start(i + 1) - start(i)).cast("int")))
    return F.filter(parts, lambda part: F.size(part) > 0)


def chunked(xs: Column, n: int) -> Column:
    """Neighbours in groups of n."""
    starts = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(xs, i + 1, F.lit(n)))


def sliding(xs: Column, n: int, step: int = 1) -> Column:
    """Windows of n items every step items; the last may be shorter, if it brings a new item."""
    last = F.greatest(F.lit(0), F.ceil((F.size(xs) - n) / step).cast("int")) * step
    # with gaps between windows the last start may lie beyond the items
    starts = F.when(F.size(xs) > 0, F.filter(F.sequence(F.lit(0), last, F.lit(step)), lambda i: i < F.size(xs))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(xs, i + 1, F.lit(n)))


def dedupe(xs: Column) -> Column:
    """Without items equal to the one before them."""
    return F.filter(xs, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(xs, i - 1)))


def scan(xs: Column, zero: Column, step: Callable) -> Column:
    """All states of a left fold, the first being zero."""
    return F.aggregate(xs, F.array(zero), lambda s, x: F.concat(s, F.array(step(F.element_at(s, -1), x))))


def fold_while(xs: Column, zero: Column, keep: Callable, step: Callable) -> Column:
    """A left fold that stops changing once the state doesn't satisfy keep."""
    return F.aggregate(xs, zero, lambda s, x: F.when(keep(s), step(s, x)).otherwise(s))


def collect_while(xs: Column, p: Callable, f: Callable) -> Column:
    return F.transform(take_while(xs, p), f)


def find(xs: Column, p: Callable) -> Column:
    return F.get(F.filter(xs, p), F.lit(0))


def corresponds(xs: Column, ys: Column, p: Callable) -> Column:
    """Equal sizes, and all pairs match."""
    return (F.size(xs) == F.size(ys)) & F.forall(F.zip_with(xs, ys, p), lambda b: F.coalesce(b, F.lit(False)))


def zip_short(xs: Column, ys: Column) -> Column:
    """Pairs, as many as the shorter array has."""
    n = F.least(F.size(xs), F.size(ys))
    return F.zip_with(F.slice(xs, F.lit(1), n), F.slice(ys, F.lit(1), n), lambda x, y: F.struct(x.alias("first"), y.alias("second")))


def zip_all(xs: Column, ys: Column) -> Column:
    """Pairs, the shorter array filled up with nulls."""
    return F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("first"), y.alias("second")))


def zip_with_index(xs: Column, start: int = 0) -> Column:
    return F.transform(xs, lambda x, i: F.struct(x.alias("item"), (i + start).alias("index")))


def updated(xs: Column, index: int, value: Column) -> Column:
    return F.transform(xs, lambda x, i: F.when(i == index, value).otherwise(x))


def partition(xs: Column, p: Callable) -> Column:
    """Items that match, and those that don't."""
    ok = lambda x: F.coalesce(p(x), F.lit(False))
    return F.struct(F.filter(xs, ok).alias("first"), F.filter(xs, lambda x: ~ok(x)).alias("second"))


def bit_and(xs: Column, ys: Column) -> Column:
    """Pairwise logic on boolean arrays, as long as the shorter one."""
    return F.transform(zip_short(xs, ys), lambda p: p["first"] & p["second"])


def bit_or(xs: Column, ys: Column) -> Column:
    return F.transform(zip_short(xs, ys), lambda p: p["first"] | p["second"])


def bit_xor(xs: Column, ys: Column) -> Column:
    return F.transform(zip_short(xs, ys), lambda p: p["first"] != p["second"])


def negate(xs: Column) -> Column:
    return F.transform(xs, lambda x: ~x)


def to_bits(xs: Column, width: int = 8) -> Column:
    """The bits of whole numbers, highest first."""
    shifts = F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1))
    return F.flatten(F.transform(xs, lambda x: F.transform(shifts, lambda s: F.getbit(x.cast("long"), s) == 1)))


def packed(bits: Column, width: int = 8) -> Column:
    """Whole numbers from bits, highest first; the last is filled up with false."""
    value = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, b: s * 2 + b.cast("int"))
    return F.transform(chunked(bits, width), lambda part: value(part) * F.pow(F.lit(2), F.lit(width) - F.size(part)).cast("long"))


def binary_string(bits: Column) -> Column:
    return F.array_join(F.transform(bits, lambda b: b.cast("int").cast("string")), "")


def iterate(start: Column, n: int, step: Callable) -> Column:
    """start, step(start), ..., n items."""
    if n <= 0:
        return F.slice(F.array(start), 1, 0)
    return scan(F.sequence(F.lit(1), F.lit(n - 1)), start, lambda s, _: step(s)) if n > 1 else F.array(start)
