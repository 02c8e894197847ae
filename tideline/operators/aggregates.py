"""Aggregations and metric points. All are algebraic, so Spark sums them map-side first."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default histogram boundaries.
BOUNDARIES = [0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000]


def exists(predicate: Column) -> Column:
    """Whether any row matches; false for none."""
    return F.coalesce(F.bool_or(predicate), F.lit(False))


def forall(predicate: Column) -> Column:
    """Whether all rows match; true for none."""
    return F.coalesce(F.bool_and(predicate), F.lit(True))


def head(value: Column, order: Column) -> Column:
    """The value of the first row, null if there is none."""
    return F.min_by(value, order)


def last(value: Column, order: Column) -> Column:
    return F.max_by(value, order)


def find(value: Column, predicate: Column, order: Column) -> Column:
    """The value of the first matching row."""
    return F.min_by(value, F.when(predicate, order))


def sum_int(value: Column) -> Column:
    """Sum of ints as a long."""
    return F.sum(value.cast("long"))


def sum_float(value: Column) -> Column:
    """Sum of floats as a double."""
    return F.sum(value.cast("double"))


def ordered_items(value: Column, order: Column) -> Column:
    """The values of a group as an array in order. The group must fit in a row."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def fold_left(items: Column, zero: Column, step: Callable) -> Column:
    """A left fold over an array."""
    return F.aggregate(items, zero, step)


def fold_right(items: Column, zero: Column, step: Callable) -> Column:
    """A right fold: step(item, state)."""
    return F.aggregate(F.reverse(items), zero, lambda s, x: step(x, s))


def group_values(df: DataFrame, key: Sequence[str], value: Column, order: Column) -> DataFrame:
    """Each key's values in order (groupBy, groupMap)."""
    return df.groupBy(*key).agg(ordered_items(value, order).alias("items"))


def having(df: DataFrame, key: Sequence[str], aggregates: Sequence[Column], condition: Column) -> DataFrame:
    return df.groupBy(*key).agg(*aggregates).filter(condition)


def counter(df: DataFrame, attributes: Sequence[str], value: str) -> DataFrame:
    """A monotonic counter's points: negative increments count nothing."""
    return df.groupBy(*attributes).agg(F.coalesce(F.sum(F.when(F.col(value) >= 0, F.col(value))), F.lit(0)).alias("sum"))


def up_down_counter(df: DataFrame, attributes: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*attributes).agg(F.sum(value).alias("sum"))


def gauge(df: DataFrame, attributes: Sequence[str], value: str, order: Column) -> DataFrame:
    """The last value of each attribute set."""
    return df.groupBy(*attributes).agg(F.max_by(value, order).alias("value"))


def histogram(df: DataFrame, attributes: Sequence[str], value: str, boundaries: Sequence[float] = BOUNDARIES) -> DataFrame:
    """count, sum, min, max and bucket counts; bucket i holds values up to boundary i, the last one the rest and NaN.

    NaN counts in the sum and the last bucket, not in min and max.
    """
    v = F.col(value).cast("double")
    edges = sorted(boundaries)
    low = [None, *edges]
    counts = []
    for a, b in zip(low, [*edges, None]):
        inside = F.lit(True) if b is None else v <= b
        if a is not None:
            inside = inside & (v > a)
        counts.append(F.count_if(inside & v.isNotNull()))
    real = F.when(~F.isnan(v), v)
    return df.groupBy(*attributes).agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(real).alias("min"), F.max(real).alias("max"), F.array(*counts).alias("buckets"))
