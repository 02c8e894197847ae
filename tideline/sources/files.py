"""Sources and sinks over Spark's own readers and writers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Element types of binary arrays by name (big-endian).
ELEMENTS = {"byte": (">i1", T.ByteType(), pa.int8()), "int": (">i4", T.IntegerType(), pa.int32()), "long": (">i8", T.LongType(), pa.int64()), "float": (">f4", T.FloatType(), pa.float32()), "double": (">f8", T.DoubleType(), pa.float64())}


def items(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """Rows from values in hand."""
    return spark.createDataFrame(values, schema)


def integers(spark: SparkSession, start: int, until: int, step: int = 1) -> DataFrame:
    """Whole numbers [start, until) as `value`."""
    return spark.range(start, until, step).select(F.col("id").cast("int").alias("value"))


def repeat(spark: SparkSession, value, n: int) -> DataFrame:
    """n rows of one value."""
    return spark.range(n).select(F.lit(value).alias("value"))


def cycle(df: DataFrame, times: int) -> DataFrame:
    """All rows, times over; `round` tells which time."""
    return df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.withColumn("round", F.lit(0)).limit(0)


def unfold(spark: SparkSession, start: int, step: str, until: str, most: int = 10_000) -> DataFrame:
    """States from start on, each by the SQL expression step of the one before it (`s`), while until holds."""
    return spark.sql(f"WITH RECURSIVE r(s) MAX RECURSION LEVEL {int(most)} AS (SELECT CAST({int(start)} AS BIGINT) UNION ALL SELECT CAST({step} AS BIGINT) FROM r WHERE {until}) SELECT s AS value FROM r WHERE {until}")


def csv(spark: SparkSession, path: str, schema: str, separator: str = ",", header: bool = True, null: str = "") -> DataFrame:
    """Quoted fields may hold separators, doubled quotes and line breaks."""
    return spark.read.schema(schema).options(sep=separator, header=header, nullValue=null, quote='"', escape='"', multiLine=True).csv(path)


def tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return csv(spark, path, schema, "\t", header)


def write_csv(df: DataFrame, path: str, separator: str = ",", header: bool = True) -> None:
    """Fields are quoted where they need it."""
    df.write.options(sep=separator, header=header, quote='"', escape='"').csv(path)


def characters(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, char) of text files, each read whole by one task."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.select("path", F.posexplode(F.split("value", "")).alias("position", "char"))


def numbers(spark: SparkSession, path: str, element: str) -> DataFrame:
    """(path, values): binary files as arrays of big-endian numbers; bytes left over at the end are dropped."""
    code, spark_type, arrow_type = ELEMENTS[element]
    width = np.dtype(code).itemsize

    @F.arrow_udf(T.ArrayType(spark_type))
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [np.frombuffer(b[: len(b) - len(b) % width], code).astype(code[1:]) for b in batch.to_pylist()]
            yield pa.array(rows, pa.list_(arrow_type))

    return spark.read.format("binaryFile").load(path).select("path", read("content").alias("values"))


def drain(df: DataFrame) -> None:
    """Run it all and keep nothing."""
    df.write.format("noop").mode("overwrite").save()
