"""Helpers shared by the corpus operators: reading tables, scratch tables, hashing."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to words.
WORD_BREAKS = " \t\n\x0b\x0c\r"
#: Words in a shingle.
SHINGLE = 5
#: A key with more than 1/HOT of all rows is joined by broadcast in dealt_join.
HOT = 1000
#: Partitions that fewer() leaves: one for so many rows, but so many for each core at least.
FILE_ROWS, FILES_A_CORE = 4000, 2
#: Bytes of a word that are hashed from the table.
SHORT = 64
_RANDOM = np.random.default_rng(1).integers(0, 1 << 64, SHORT << 8, np.uint64)
_IN_WORD = np.array([chr(i) not in WORD_BREAKS for i in range(256)], np.int8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of very long texts must still fit beside the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    # Python workers import this package from where the driver did, if they have no other
    env, home = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, home])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only a local master may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.gettempdir() + "/checkpoints"
    return found.rstrip("/")


def fewer(df: DataFrame, rows: int | None) -> DataFrame:
    """df in no more partitions than one for each FILE_ROWS of so many rows, if known, however many a shuffle has.

    For tables without texts: each file costs Hadoop some calls (on a local disk, forks of the
    whole JVM for chmod). The number grows with the rows.
    """
    if rows is None:
        return df
    return df.coalesce(max(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a scratch table in the shared folder and read it again.

    This cuts the lineage: what comes after an executor loss starts from the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideline-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of left with right, whose keys are unique and whose weight is their rows in left, of total.

    The weights of hot keys add up to no more than total, so they are fewer than HOT rows.
    """
    hot, cold = right.filter(F.col(weight) * HOT > total), right.filter(F.col(weight) * HOT <= total)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold.drop(weight), on)
    return left.join(F.broadcast(hot.drop(weight)), on).unionByName(rest)


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8 bytes (null: none)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64 bits that scatters its input."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_ids(text: str) -> np.ndarray:
    """A 64-bit hash of every word: the sum of a random number for each byte and its place in the word.

    Words are as in split_words; those of more than SHORT bytes are hashed one by one.
    """
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    inner = np.zeros(len(b) + 2, np.int8)
    inner[1:-1] = _IN_WORD[b]
    step = np.diff(inner)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    length = end - start
    if not len(start):
        return np.zeros(0, np.uint64)
    # the letters of the words, one word after the other, and their places
    letters = b[inner[1:-1].view(bool)]
    begins = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(begins, length)
    long = length > SHORT
    if long.any():
        np.minimum(place, SHORT - 1, out=place)
    out = np.add.reduceat(_RANDOM[place << 8 | letters], begins)
    for k in np.flatnonzero(long).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]])
    return out


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """A hash of each run of k words in order; fewer than k words give one shorter run, none give none."""
    w = word_ids(text) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    k = min(k, len(w))
    n = len(w) - k + 1
    # words are random numbers already: a sum with odd factors, mixed at the end, tells orders apart
    out = np.full(n, np.uint64(k), np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
    return mix(out)


def occurrence_labels(h: np.ndarray) -> np.ndarray:
    """Hashes made distinct: each is mixed with how often it came before."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if new.all():
        return h
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(h)
    out[order] = np.where(nth == 0, s, mix(s + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return out
