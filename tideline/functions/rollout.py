"""Deterministic percentage rollout and sampling by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the seed of the string hash.
SEED = 0xF7CA7FD2


def string_hash(text: str) -> int:
    """The public 32-bit Murmur3 over pairs of UTF-16 units, signed."""
    u = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).tolist()
    m = 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    scramble = lambda k: rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h = SEED
    for i in range(0, len(u) - 1, 2):
        h = (rot(h ^ scramble(((u[i] << 16) + u[i + 1]) & m), 13) * 5 + 0xE6546B64) & m
    if len(u) % 2:
        h ^= scramble(u[-1])
    h ^= len(u)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def bucket_of(text: str) -> int:
    """A bucket from 0 to 99: the remainder has the dividend's sign, then loses it."""
    return abs(string_hash(text)) % 100


@F.arrow_udf(T.IntegerType())
def bucket(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for t in texts:
        yield pa.array([None if x is None else bucket_of(x) for x in t.to_pylist()], pa.int32())


def rollout(key: Column, percent: int) -> Column:
    """Whether a key is among the first percent buckets."""
    return bucket(key) < percent


def every(df: DataFrame, site: list[str], order: list[str], k: int) -> DataFrame:
    """Each site's k-th row, its 2k-th and so on; none if k isn't positive."""
    if k <= 0:
        return df.limit(0)
    w = Window.partitionBy(*site).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") % k == 0).drop("_n")


def choices(expression: str) -> list[tuple[str, list[str] | None, int | None]]:
    """(value, path segments or None for all paths, percentage or None) of each choice in `value@path/NN%; value`.

    An expression that is empty or malformed is an error.
    """
    if not expression.strip():
        raise ValueError("empty rollout expression")
    parts = expression.strip().split(";")
    while len(parts) > 1 and not parts[-1]:  # a separator at the end ends the list
        parts.pop()
    out: list[tuple[str, list[str] | None, int | None]] = []
    for part in parts:
        value, at, selector = (x.strip() for x in part.partition("@"))
        if not value or (at and not selector):
            raise ValueError(f"not a choice: {part!r}")
        percent = None
        if selector.endswith("%"):
            selector, slash, share = selector[:-1].rpartition("/")
            if not slash or not selector.strip() or not (share := share.strip()).isdigit() or int(share) > 100:
                raise ValueError(f"not a percentage of a path: {part!r}")
            percent = int(share)
        out.append((value, [s.strip() for s in selector.split("/")] if at else None, percent))
    return out


def choose(expression: str, path: Column, key: Column) -> Column:
    """The value of the first choice that fits a path (segments, * for any) and the key's bucket; null if none does."""
    parts, at, out = F.split(path, "/"), bucket(key), F.lit(None).cast("string")
    for value, segments, percent in reversed(choices(expression)):
        fits = F.lit(True)
        if segments is not None:
            fits = (path != "") & (F.size(parts) == len(segments))
            for i, s in enumerate(segments):
                fits = fits & (F.lit(True) if s == "*" else F.get(parts, F.lit(i)) == s)
            if percent is not None and percent < 100:
                fits = fits & (at < percent)
        out = F.when(fits, F.lit(value)).otherwise(out)
    return out


def warnings(expression: str) -> list[str]:
    """What is odd about an expression: choices after one for all paths, and paths with over 100 percent."""
    found = choices(expression)
    out = [f"choices after number {i} are never reached" for i, (_, s, _) in enumerate(found) if s is None and i < len(found) - 1][:1]
    total: dict[str, int] = {}
    for _, segments, percent in found:
        if segments is not None:
            total["/".join(segments)] = total.get("/".join(segments), 0) + (percent or 0)
    return out + [f"{path} has {n} percent" for path, n in total.items() if n > 100]
