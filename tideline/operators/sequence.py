"""Ordered-sequence operators on DataFrames.

Rows have no order in Spark, so each operator takes the columns that give one; they should
be unique, else ties fall in an undetermined order. Positions are found without a window
over all rows: rows are range-partitioned by the order, numbered within their partition,
and the counts of partitions, as many as there are, are summed up. All operators that need
a position work on such an indexed table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.plans.scratch import written

INDEX = "index"


def _parts(df: DataFrame, order: list[str]) -> DataFrame:
    """df range-partitioned by order, with the partition's number; written, as a second sampling could deal differently."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered")


def with_index(df: DataFrame, order: list[str], start: int = 0, name: str = INDEX) -> DataFrame:
    """Attach each row's position in the order, from start on (zipWithIndex, zipWithIndexFrom).

    One shuffle: rows are sorted within their range and numbered there as they are written;
    numbers of a range begin at a multiple of 2^33.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    parts = parts.withColumn("_part", F.shiftright("_id", 33)).withColumn("_here", F.col("_id").bitwiseAND((1 << 33) - 1))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_here") + start).drop("_part", "_before", "_here", "_id")


def take(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows; a top-n, not a sort of all."""
    return df.orderBy(*order).limit(max(0, n))


def drop(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """All but the first n rows."""
    return with_index(df, order).filter(F.col(INDEX) >= n).drop(INDEX)


def slice_rows(df: DataFrame, order: list[str], start: int, until: int) -> DataFrame:
    """Rows at positions [start, until)."""
    return with_index(df, order).filter((F.col(INDEX) >= start) & (F.col(INDEX) < until)).drop(INDEX)


def _first_failing(df: DataFrame, order: list[str], predicate: Column) -> DataFrame:
    """One row: the least order key at which the predicate isn't true, or null."""
    failing = F.when(~F.coalesce(predicate, F.lit(False)), F.struct(*order))
    return df.agg(F.min(failing).alias("_stop"))


def take_while(df: DataFrame, order: list[str], predicate: Column) -> DataFrame:
    """The rows before the first at which the predicate isn't true: one aggregate, then a filter."""
    stop = _first_failing(df, order, predicate)
    return df.crossJoin(F.broadcast(stop)).filter(F.col("_stop").isNull() | (F.struct(*order) < F.col("_stop"))).drop("_stop")


def drop_while(df: DataFrame, order: list[str], predicate: Column) -> DataFrame:
    """The rows from the first on at which the predicate isn't true."""
    stop = _first_failing(df, order, predicate)
    return df.crossJoin(F.broadcast(stop)).filter(F.struct(*order) >= F.col("_stop")).drop("_stop")


def distinct_by(df: DataFrame, order: list[str], key: list[str]) -> DataFrame:
    """The first row of each key; a partial aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(first).select(*key, "_row.*").select(*df.columns)


def dedupe(df: DataFrame, order: list[str], key: list[str]) -> DataFrame:
    """Drop rows whose key equals that of the row just before (consecutive duplicates only)."""
    rows = _with_previous(df, order, F.struct(*key), "_prev")
    return rows.filter(F.col("_prev").isNull() | ~F.col("_prev").eqNullSafe(F.struct(*key))).drop("_prev")


def _with_previous(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """The value of the row before: within partitions by lag, at their starts from the last row of the nearest earlier one."""
    parts = _parts(df, order)
    w = Window.partitionBy("_part").orderBy(*order)
    parts = parts.withColumn("_v", value)
    ends = parts.groupBy("_part").agg(F.max_by("_v", F.struct(*order)).alias("_end"))
    last = Window.orderBy("_part").rowsBetween(-1, -1)
    ends = ends.select("_part", F.first("_end").over(last).alias("_carry"))
    return parts.withColumn("_lag", F.lag("_v").over(w)).withColumn("_rn", F.row_number().over(w)).join(F.broadcast(ends), "_part").withColumn(name, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))).drop("_part", "_v", "_lag", "_rn", "_carry")


def chunked(df: DataFrame, order: list[str], n: int, value: str) -> DataFrame:
    """Groups of n neighbours as arrays (chunk, items); the last may be shorter."""
    if n < 1:
        raise ValueError("chunks need at least one row")
    rows = with_index(df, order)
    items = F.transform(F.array_sort(F.collect_list(F.struct(INDEX, value))), lambda x: x[value])
    return rows.groupBy(F.floor(F.col(INDEX) / n).alias("chunk")).agg(items.alias("items"))


def sliding(df: DataFrame, order: list[str], n: int, step: int, value: str) -> DataFrame:
    """Windows of n rows, a new one each step rows (window, items).

    The last may be shorter, if it brings a row that no window before it had. A row is sent
    to each of its ceil(n / step) windows.
    """
    if n < 1 or step < 1:
        raise ValueError("windows need at least one row and step")
    rows = with_index(df, order)
    i = F.col(INDEX)
    first = F.greatest(F.lit(0), F.ceil((i - n + 1) / step))
    sent = rows.filter(i % step < n).withColumn("window", F.explode(F.sequence(first, F.floor(i / step))))
    items = F.transform(F.array_sort(F.collect_list(F.struct(INDEX, value))), lambda x: x[value])
    made = sent.groupBy("window").agg(items.alias("items"), F.max(INDEX).alias("_last"))
    # a window whose rows all came before, in the window before it, isn't emitted
    fresh = (F.col("window") == 0) | (F.col("_last") >= (F.col("window") - 1) * step + n)
    return made.filter(fresh).drop("_last")


def running(df: DataFrame, order: list[str], value: str, init: float | int = 0, name: str = "state") -> DataFrame:
    """The running sum from init (scan), with the seed as a first row of nulls, hence n + 1 rows.

    Sums of partitions are carried over, so no task sees all rows.
    """
    parts = _parts(df, order)
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carry"))
    here = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = parts.withColumn("_here", F.coalesce(here, F.lit(0))).join(F.broadcast(sums), "_part").withColumn(name, F.col("_carry") + F.col("_here") + F.lit(init)).drop("_part", "_here", "_carry")
    seed = df.sparkSession.range(1).select(F.lit(init).cast(rows.schema[name].dataType).alias(name))
    return rows.unionByName(seed, allowMissingColumns=True)


def running_by(df: DataFrame, order: list[str], value: str, fold: Callable, both: Callable, init, name: str = "state") -> DataFrame:
    """The running value of an aggregate, with the seed first, hence n + 1 rows.

    fold is an aggregate of Spark that may be taken over its own partial results (max, min,
    bool_and, bit_or, sum); both joins two of its values. Nulls leave the state as it is.
    Only the values of partitions are carried over, so no task sees all rows.
    """
    parts = _parts(df, order)
    ends = parts.groupBy("_part").agg(fold(value).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_part", fold("_s").over(before).alias("_carry"))
    here = fold(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    seed = F.lit(init).cast(ends.schema["_carry"].dataType)
    join = lambda a, b: F.when(b.isNull(), a).otherwise(both(a, b))
    rows = parts.withColumn("_here", here).join(F.broadcast(ends), "_part")
    rows = rows.withColumn(name, join(join(seed, F.col("_carry")), F.col("_here"))).drop("_part", "_here", "_carry")
    return rows.unionByName(df.sparkSession.range(1).select(seed.cast(rows.schema[name].dataType).alias(name)), allowMissingColumns=True)


def catch_all(df: DataFrame, order: list[str], error: Column, other: DataFrame) -> DataFrame:
    """The rows before the first that has an error, then, if one has, all rows of other (orElse, catchAll).

    error is null where a row is right. `source` (0, then 1) comes before the order columns
    in the new order; rows of other get that first error as `error`, which they may build on.
    """
    stop = df.agg(F.min(F.when(error.isNotNull(), F.struct(*order, error.alias("_error")))).alias("_stop"))
    first = F.struct(*(F.col("_stop")[c] for c in order))
    head = df.crossJoin(F.broadcast(stop)).filter(F.col("_stop").isNull() | (F.struct(*order) < first)).withColumn("source", F.lit(0)).withColumn("error", F.when(F.lit(False), F.col("_stop._error")))
    rest = other.crossJoin(F.broadcast(stop)).filter(F.col("_stop").isNotNull()).withColumn("source", F.lit(1)).withColumn("error", F.col("_stop._error"))
    return head.drop("_stop").unionByName(rest.drop("_stop"))


def intersperse(df: DataFrame, order: list[str], value: str, separator) -> DataFrame:
    """(position, value): the values with a separator between neighbours, 2n - 1 rows."""
    rows = with_index(df, order)
    pair = F.array(F.lit(separator).cast(df.schema[value].dataType), F.col(value))
    out = rows.select(F.col(INDEX), F.posexplode(pair).alias("_k", value))
    return out.select((F.col(INDEX) * 2 + F.col("_k") - 1).alias("position"), value).filter("position >= 0")


def concat(first: DataFrame, second: DataFrame, order: list[str]) -> DataFrame:
    """All rows of first, then all of second; `source` comes before the order columns in the new order."""
    return first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], how: str = "inner") -> DataFrame:
    """Pair rows by position: inner (the shorter side bounds) or full (zipAll)."""
    return with_index(left, left_order).join(with_index(right, right_order), INDEX, how)


def split(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Attach `part`: n nearly equal parts in order, the first len % n of them one row longer."""
    rows = with_index(df, order)
    total = df.agg(F.count("*").alias("_t"))
    rows = rows.crossJoin(F.broadcast(total))
    size, more = F.floor(F.col("_t") / n), F.col("_t") % n
    long_end = more * (size + 1)
    i = F.col(INDEX)
    part = F.when(i < long_end, F.floor(i / (size + 1))).otherwise(more + F.floor((i - long_end) / F.greatest(size, F.lit(1))))
    return rows.withColumn("part", part.cast("int")).drop("_t", INDEX)


def map_accumulate(df: DataFrame, key: list[str], order: list[str], value: str, init, step: Callable, output_type: str, name: str = "out") -> DataFrame:
    """A stateful map within each key: step(state, value) gives (state, output).

    For states that no window function expresses; rows of one key meet in a task.
    """

    def run(pdf):
        state, out = init, []
        for x in pdf.sort_values(order)[value]:
            state, y = step(state, x)
            out.append(y)
        pdf = pdf.sort_values(order)
        pdf[name] = out
        return pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {name} {output_type}"
    return df.groupBy(*key).applyInPandas(run, schema)
