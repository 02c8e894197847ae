"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are short and documents long, so their Jaccard similarity says little. Items are
therefore partitioned by size: class U holds items of U/2 < n <= U distinct shingles. For
each class a document is cut into windows of 2 U shingles that overlap by half, and every
window gets a MinHash signature; against a window of its class an item that is 80 %
contained has a similarity of 0.19 at least, so that of 64 functions one agrees in all but
a millionth of cases. Signatures of larger windows are minima of smaller ones, so shingles
are hashed once for all classes. Candidates are verified by exact containment: the share
of the item's distinct five-word shingles that the whole document has.

The index is a table of (class, function, value) and item. Documents meet it by shuffle: of
each text the values that may be in the index, by two bitmaps of fixed size, are joined to
it (texts without such values are passed over once and never shuffled), and the candidates (text, item) are dealt by text, PART items a task's portion, and
verified there. Nothing that grows with the benchmark is broadcast or collected. Equal texts
are looked up once. A value that many texts have is dealt over SALTS tasks.

Defined cases: null texts and texts without words contain nothing and match nothing; a
text of fewer than five words has one shorter shingle, so it matches only texts of the
same few words; equal items are each reported; repeated rows are each searched; null keys are
reported as null; empty tables give no rows. The result of `leaks` has the columns key,
item_id, shared and of, so the key can't be called like one of the others (an error).
`clean` carries all columns along; `_tl_` names are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import fewer, mix, shingles, stage, table, tune

FUNCTIONS = 64
#: Containment in hundredths.
LEAST = 80
#: Runs of shingles that are hashed at once.
CHUNK = 1 << 10
#: Bits of the bitmap of all index values, and of its parts that tasks make.
BITS, PART_BITS = 25, 15
#: Items that a text is held against at once, and tasks that a value's texts are dealt over.
PART, SALTS = 256, 16
#: Bits of the bitmap of texts that hold an item.
HELD_BITS = 24
_rng = np.random.default_rng(8)
_MUL = _rng.integers(0, 1 << 31, FUNCTIONS, np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, FUNCTIONS, np.uint32)
_SLOTS = np.uint32((1 << 18) - 1)


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """Per function (rows), the minimum over each run of `width` shingles; 32 bits of them are ranked."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    n = -(-len(x) // width)
    # a run that isn't full repeats its last shingle
    full = np.full(n * width, x[-1] if n else 0, np.uint32)
    full[: len(x)] = x
    x = full.reshape(n, width).T
    out = np.empty((FUNCTIONS, n), np.uint32)
    for at in range(0, n, CHUNK):
        least = None
        for row in x[:, at : at + CHUNK]:
            v = row[None, :] ^ _XOR[:, None]
            v *= _MUL[:, None]
            least = v if least is None else np.minimum(least, v, out=least)
        out[:, at : at + CHUNK] = least
    return out


def halved(m: np.ndarray) -> np.ndarray:
    """Minima over runs twice as long."""
    out, pairs = m[:, ::2].copy(), m.shape[1] // 2
    np.minimum(out[:, :pairs], m[:, 1::2], out=out[:, :pairs])
    return out


def numbered(f: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Values of different functions told apart."""
    return f.astype(np.uint64) << np.uint64(32) | v


def places(cls: int, v: np.ndarray) -> np.ndarray:
    """The bits of numbered values of a class in the bitmap."""
    salt = np.uint64(cls * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (mix(v ^ salt) >> np.uint64(64 - BITS)).astype(np.int64)


def class_of(n: int) -> int:
    """Items of 2^(c-1) < n <= 2^c distinct shingles are of class c."""
    return max(0, (n - 1).bit_length())


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(no, text) to (no, cls, v, bit, shingles): the signature of each item, its shingles once."""
    for b in batches:
        rows: list[tuple] = []
        for no, text in zip(b.column("no").to_pylist(), b.column("text")):
            s = np.unique(shingles(text.as_py()))
            if len(s):
                cls = class_of(len(s))
                v = numbered(np.arange(FUNCTIONS), minima(s, 1).min(axis=1))
                bits = places(cls, v)
                rows += [(no, cls, x, y, s.tobytes() if i == 0 else None) for i, (x, y) in enumerate(zip(v.view(np.int64).tolist(), bits.tolist()))]
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["no", "cls", "v", "bit", "shingles"])


def index(benchmark: DataFrame, item_key: str) -> tuple[DataFrame, DataFrame]:
    """(no, cls, v, bit, shingles) as a scratch table, and (no, item_id)."""
    # numbers of rows hold once they are written
    items = stage(benchmark.select(F.monotonically_increasing_id().alias("no"), F.col(item_key).alias("item_id"), F.col("text").alias("text")), "items")
    rows = items.select("no", "text").mapInArrow(_index, "no long, cls int, v long, bit int, shingles binary")
    return stage(rows, "index"), items.select("no", "item_id")


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted bits of whole parts to (part, bits)."""
    now, bits = None, np.zeros(1 << PART_BITS, bool)
    out: list[tuple[int, bytes]] = []
    for b in batches:
        x = b.column("bit").to_numpy(zero_copy_only=False)
        for part in np.unique(x >> PART_BITS).tolist():
            if part != now:
                if now is not None:
                    out.append((now, np.packbits(bits).tobytes()))
                now = part
                bits[:] = False
            bits[x[x >> PART_BITS == part] & ((1 << PART_BITS) - 1)] = True
    if now is not None:
        out.append((now, np.packbits(bits).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["part", "bits"])


class Filter:
    """Which values may be in the index: 2^BITS bits for all, and 2^18 for each class to ask first."""

    def __init__(self, parts: list[tuple[int, bytes]], classes: list[tuple[int, bytes]]):
        self.bits = np.zeros(1 << (BITS - 3), np.uint8)
        for part, bits in parts:
            at = part << (PART_BITS - 3)
            self.bits[at : at + len(bits)] = np.frombuffer(bits, np.uint8)
        self.classes = {cls: np.frombuffer(seen, bool) for cls, seen in classes}

    def values(self, text: str | None) -> list[tuple[int, int]]:
        """(class, numbered value) of the windows of a text that pass both."""
        h = shingles(text)
        out: list[tuple[int, int]] = []
        if not self.classes or not len(h):
            return out
        cls, top = min(self.classes), max(self.classes)
        m = minima(h, 1 << cls)
        while True:
            if cls in self.classes:
                w = np.minimum(m[:, :-1], m[:, 1:]) if m.shape[1] > 1 else m
                fs, at = np.nonzero(self.classes[cls].take(w & _SLOTS))
                v = numbered(fs, w[fs, at])
                bit = places(cls, v)
                v = np.unique(v[(self.bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0])
                out += [(cls, x) for x in v.view(np.int64).tolist()]
            if cls >= top:
                return out
            m, cls = halved(m), cls + 1


def filter_of(rows: DataFrame) -> Filter:
    """The bitmaps of an index; the driver gets 2^BITS bits and 2^18 a class, however large it is."""
    bits = rows.select("bit").distinct().withColumn("part", F.shiftright("bit", PART_BITS)).repartition("part").sortWithinPartitions("part")
    parts = [(r["part"], bytes(r["bits"])) for r in bits.select("bit").mapInArrow(_bitmap, "part int, bits binary").collect()]
    slot = F.col("v").bitwiseAND(int(_SLOTS)).cast("int")
    # of each class at most 2^18 slots
    slots = rows.select("cls", slot.alias("slot")).distinct().groupBy("cls").agg(F.collect_list("slot").alias("slots")).collect()
    classes = []
    for r in slots:
        seen = np.zeros(int(_SLOTS) + 1, bool)
        seen[r["slots"]] = True
        classes.append((r["cls"], seen.tobytes()))
    return Filter(parts, classes)


def name_of(text: Column) -> Column:
    """128 bits of hash, so that equal texts are one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (name, part, role, no, text, shingles): a text first, then the items it is held against."""
    here, has = None, None
    for b in batches:
        out: list[tuple] = []
        for name, part, role, no, text, want in zip(*(b.column(k) for k in ("name", "part", "role", "no", "text", "shingles"))):
            key = name.as_py(), part.as_py()
            if key != here:
                here, has = key, None
            if role.as_py() == 0:
                has = np.unique(shingles(text.as_py())) if has is None else has
            elif has is not None:
                s = np.frombuffer(want.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(has, s), len(has) - 1)
                shared = int((has[at] == s).sum())
                if shared * 100 >= LEAST * len(s):
                    out.append((key[0], no.as_py(), shared, len(s)))
        if out:
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["name", "no", "shared", "of"])


def contained(docs: DataFrame, benchmark: DataFrame, key: str, item_key: str) -> tuple[DataFrame, DataFrame]:
    """(key, name) of the rows that may hold an item, and (name, item_id, shared, of) of those that do; name: of the text."""
    spark = docs.sparkSession
    tune(spark)
    rows, ids = index(benchmark, item_key)
    known = spark.sparkContext.broadcast(filter_of(rows))  # 4 MB, and 256 kB a class

    @F.arrow_udf("array<struct<cls:int,v:bigint>>")
    def values(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("cls", pa.int32()), ("v", pa.int64())]))
        for texts in batches:
            yield pa.array([[{"cls": c, "v": v} for c, v in known.value.values(t.as_py())] for t in texts], kind)

    # else the filter below would be a second call, in a Python worker of its own
    values = values.asNondeterministic()
    text = F.col("text")
    # texts that may hold an item are kept with their values, so that the others are never shuffled
    met = docs.select(F.col(key).alias("key"), name_of(text).alias("name"), values(text).alias("values"), text.alias("text"))
    met = stage(met.filter(F.size("values") > 0), "values")
    n_texts = met.count()
    own = met.groupBy("name").agg(F.min("key").alias("home"), F.first("values").alias("values"))
    asked = own.select("name", F.explode("values").alias("x")).select("name", "x.*", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int").alias("salt"))
    salted = rows.select("no", "cls", "v", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = stage(fewer(asked.join(salted, ["cls", "v", "salt"]).select("name", "no").distinct(), n_texts), "candidates")
    # a text goes to its candidates in parts, so that none is held against all items at once
    parts = stage(fewer(pairs.groupBy("name").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), n_texts), "parts")
    wanted = parts.join(met.groupBy("name").agg(F.min("key").alias("home")), "name").withColumnRenamed("name", "_tl_name")
    texts = met.select("key", "name", "text").join(wanted, (F.col("name") == F.col("_tl_name")) & F.col("key").eqNullSafe(F.col("home")))
    none = lambda kind: F.lit(None).cast(kind)
    heads = texts.select("name", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), none("long").alias("no"), "text", none("binary").alias("shingles"))
    items = pairs.join(parts, "name").join(rows.filter("shingles IS NOT NULL").select("no", "shingles"), "no")
    items = items.select("name", F.pmod(F.xxhash64("no"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), "no", none("string").alias("text"), "shingles")
    dealt = heads.unionByName(items).repartition("name", "part").sortWithinPartitions("name", "part", "role")
    found = stage(dealt.mapInArrow(_verify, "name binary, no long, shared int, of int"), "contained")
    return met.select("key", "name"), found.join(ids, "no").select("name", "item_id", "shared", "of")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(key, item_id, shared, of): each document with each item that it contains."""
    if key in ("item_id", "shared", "of"):
        raise ValueError(f"the result has a column {key} of its own")
    met, found = contained(docs, benchmark, key, item_key)
    return met.join(found, "name").select(F.col("key").alias(key), "item_id", "shared", "of")


def placed(df: DataFrame, name: str) -> DataFrame:
    """With the place of a name in a bitmap of HELD_BITS: a word of 64 bits, and the bit in it."""
    slot = F.xxhash64(name).bitwiseAND((1 << HELD_BITS) - 1)
    return df.withColumn("_tl_word", F.shiftright(slot, 6)).withColumn("_tl_bit", slot.bitwiseAND(63).cast("int"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """The documents that contain no item, with all their columns; docs must give the same rows each time it is read."""
    columns = docs.columns
    found = contained(docs, benchmark, key, item_key)[1].select(F.col("name").alias("_tl_name")).distinct()
    # only texts that may be found, by a bitmap of fixed size, are shuffled to be sure
    mask = F.bit_or(F.expr("shiftleft(1L, _tl_bit)")).alias("_tl_mask")
    masks = F.broadcast(placed(found, "_tl_name").groupBy("_tl_word").agg(mask))
    known = placed(docs.withColumn("_tl_text", name_of(F.col("text"))), "_tl_text").join(masks, "_tl_word", "left")
    may = F.coalesce(F.getbit("_tl_mask", "_tl_bit") == 1, F.lit(False))
    left = known.filter(may).join(found, F.col("_tl_text") == F.col("_tl_name"), "left_anti").unionByName(known.filter(~may))
    return left.select(*(f"`{c}`" for c in columns))


def op8_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_GRAMS = r"""SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g, least(len(w), 5) AS k
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM
    (SELECT {key} AS id, [x FOR x IN string_split_regex(text, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) > 0)"""
OP8_SQL = f"""WITH d AS ({_GRAMS.format(key="doc_id", table="documents")}), q AS ({_GRAMS.format(key="item_id", table="benchmark")}),
n AS (SELECT id, count(*) AS of FROM q GROUP BY id)
SELECT d.id AS doc_id, q.id AS item_id, CAST(count(*) AS INTEGER) AS shared, CAST(any_value(n.of) AS INTEGER) AS of
FROM d JOIN q ON d.g = q.g AND d.k = q.k JOIN n ON q.id = n.id GROUP BY d.id, q.id HAVING count(*) * 100 >= {LEAST} * any_value(n.of)"""
