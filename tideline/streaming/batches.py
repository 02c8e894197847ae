"""Structured Streaming counterparts: micro-batches, running metrics, rate limits by site."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def batched(stream: DataFrame, name: str, checkpoint: str, handle: Callable[[DataFrame, int], None], seconds: int = 5) -> StreamingQuery:
    """Hand each micro-batch to handle(batch, number); a batch that failed is handed over again after a restart."""
    return stream.writeStream.queryName(name).foreachBatch(handle).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).start()


def windowed_counts(stream: DataFrame, time: str, key: list[str], length: str, late: str) -> DataFrame:
    """Rows per window of time and key; rows later than `late` are left out, and state is dropped then."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("window"), *key).agg(F.count("*").alias("n"))


def distinct_within(stream: DataFrame, time: str, key: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def at_most(df: DataFrame, site: list[str], time: str, seconds: float, order: list[str] = ()) -> DataFrame:
    """Of each site, the first row and then each that comes `seconds` or more after the last one taken; on a static table.

    What is taken depends on what was, so a site's rows are streamed in order through one
    task, which holds no more than a batch of them. `order` breaks ties of time.
    """
    names = df.columns
    gap = int(seconds * 1_000_000)
    keyed = df.select(F.to_json(F.struct(*site)).alias("_site"), F.unix_micros(F.col(time).cast("timestamp")).alias("_at"), *names)

    def taken(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, 0
        for f in frames:
            keep = []
            for s, at in zip(f["_site"], f["_at"]):
                fresh = s != now or at - last >= gap
                keep.append(fresh)
                if fresh:
                    now, last = s, at
            yield f.loc[keep, names]

    return keyed.repartition("_site").sortWithinPartitions("_site", "_at", *order).mapInPandas(taken, df.schema)
