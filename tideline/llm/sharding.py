"""Shards along a Hilbert curve over metadata; DataFrame functions only.

Language, source and length are quantised to 16 steps each. The cells of that cube are
ordered along a three-dimensional Hilbert curve, rows by cell, and the order is cut into
runs of equal row counts (the law `rows`: counts at most one apart). A shard then covers
few steps of each dimension, so a reader that filters on any of them skips most files.

No row order is computed in one task. Cells hold a bounded table of 4,096 counts; a cell
with many rows is dealt into sub-buckets by hashed id, and a row's place is the start of
its cell, plus the start of its sub-bucket, plus its number there.

Defined cases: null text has 8 bytes and checksum 0; null metadata falls in step 0; ties
and repeated rows get slots of their own in an undetermined order among themselves; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import stage, table

SHARDS = 24
BITS = 4
STEPS = 1 << BITS
CELLS = 1 << (3 * BITS)
#: Rows aimed at in a sub-bucket, and sub-buckets of a cell at most (larger cells get larger sub-buckets).
BUCKET_ROWS, MOST_BUCKETS = 256, 4096


def quantised(text: Column, lang: Column, source: Column) -> Column:
    """The cell of a row: 4 bits each of language, source and the logarithm of the length."""
    hashed = lambda c: F.when(c.isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit(STEPS)))
    size = F.coalesce(F.octet_length(text), F.lit(0))
    # a step for each doubling from 64 bytes on
    step = F.least(F.lit(STEPS - 1), F.length(F.bin(F.shiftright(size, 6))))
    step = F.when(size < 64, 0).otherwise(step)
    return (hashed(lang) * STEPS * STEPS + hashed(source) * STEPS + step).cast("int")


def curve(spark: SparkSession) -> DataFrame:
    """(cell, place): the place of each of the 4,096 cells on the Hilbert curve.

    The axes go through the usual transpose transform from the high bit down: exchange or
    invert the low bits by the axis that has the bit, then Gray-decode and interleave.
    """
    axes = [F.shiftright("cell", 2 * BITS), F.shiftright("cell", BITS).bitwiseAND(STEPS - 1), F.col("cell").bitwiseAND(STEPS - 1)]
    start = F.struct(*(a.cast("int").alias(n) for a, n in zip(axes, "xyz")))
    xor = lambda a, b: a.bitwiseXOR(b)
    names = ["x", "y", "z"]

    def undo(s: Column, step: Column) -> Column:
        """One (bit, axis) step; steps count down through bits, and axes x, y, z within each."""
        bit = F.pow(F.lit(2), F.lit(BITS - 1) - F.floor(step / 3)).cast("int")
        low, axis = bit - 1, step % 3
        chosen = F.when(axis == 0, s["x"]).when(axis == 1, s["y"]).otherwise(s["z"])
        has = chosen.bitwiseAND(bit) != 0
        swap = xor(s["x"], chosen).bitwiseAND(low)
        x = F.when(has, xor(s["x"], low)).otherwise(xor(s["x"], swap))
        rest = [F.when(~has & (axis == i), xor(s[n], swap)).otherwise(s[n]) for i, n in enumerate(names) if i]
        x = F.when(~has & (axis == 0), s["x"]).otherwise(x)
        return F.struct(x.cast("int").alias("x"), rest[0].cast("int").alias("y"), rest[1].cast("int").alias("z"))

    steps = F.sequence(F.lit(0), F.lit(3 * (BITS - 1) - 1))
    # the transform leaves out the lowest bit, so that three bits remain to be visited
    done = spark.range(CELLS).select(F.col("id").cast("int").alias("cell")).withColumn("s", F.aggregate(steps, start, undo))
    x = F.col("s.x")
    y = xor(F.col("s.y"), x)
    z = xor(F.col("s.z"), y)
    # t gathers, for each set bit q of the last axis, q - 1
    t = F.lit(0)
    for b in range(BITS - 1, 0, -1):
        t = F.when(z.bitwiseAND(1 << b) != 0, xor(t, F.lit((1 << b) - 1))).otherwise(t)
    done = done.select("cell", *(xor(c, t).alias(n) for c, n in zip((x, y, z), names)))
    place = F.lit(0)
    for b in range(BITS - 1, -1, -1):
        for n in names:
            place = place * 2 + F.shiftright(F.col(n), b).bitwiseAND(1)
    return done.select("cell", place.cast("int").alias("place"))


def shard(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """docs with key, text, lang, source. Returns key, size, text_crc32, cell, place, shard, slot."""
    spark = docs.sparkSession
    text = F.col("text")
    slim = stage(
        docs.select(
            F.col(key),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
            F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0).cast("long")).alias("text_crc32"),
            quantised(text, F.col("lang"), F.col("source")).alias("cell"),
        ),
        "slim",
    )
    # a bounded table: one row for each of at most CELLS cells
    cells = slim.groupBy("cell").agg(F.count("*").alias("n")).join(F.broadcast(curve(spark)), "cell")
    along = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cells = stage(
        cells.select(
            "cell",
            "place",
            F.coalesce(F.sum("n").over(along), F.lit(0)).alias("cell_start"),
            F.sum("n").over(everything).alias("total"),
            F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("n") / BUCKET_ROWS)).alias("n_sub"),
        ),
        "cells",
    )
    rows = slim.join(F.broadcast(cells), "cell").withColumn("sub", F.pmod(F.xxhash64(F.col(key)), F.col("n_sub")))
    counts = rows.groupBy("cell", "sub").agg(F.count("*").alias("n"))
    within = Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("cell", "sub", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("sub_start"))
    number = F.row_number().over(Window.partitionBy("cell", "sub").orderBy("text_crc32", key))
    placed = rows.withColumn("number", number).join(starts, ["cell", "sub"])
    at = F.col("cell_start") + F.col("sub_start") + F.col("number") - 1
    # the first total % shards shards have one row more
    size, more = F.floor(F.col("total") / shards), F.col("total") % shards
    long_end = more * (size + 1)
    in_long = F.floor(F.col("at") / (size + 1))
    in_rest = more + F.floor((F.col("at") - long_end) / F.greatest(size, F.lit(1)))
    placed = placed.withColumn("at", at).withColumn("shard", F.when(F.col("at") < long_end, in_long).otherwise(in_rest).cast("int"))
    first = F.col("shard") * size + F.least(F.col("shard"), more)
    return placed.select(key, "size", "text_crc32", "cell", "place", "shard", (F.col("at") - first).cast("long").alias("slot"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("place").alias("curve_index")
    )
