"""Removal of every byte that lies in a 200-byte string occurring elsewhere, by suffix arrays.

One suffix array over a corpus fits no machine, so equal strings are first brought
together. The least of the hashes of all 24-byte grams in a 200-byte window is its anchor;
equal windows have equal anchors at equal places, and one gram in about 90 is an anchor.
The windows that an anchor is the least gram of are its own; the bytes they cover, about
290, are its segment. So:

1. Anchors whose hash occurs once, most of them, need no more work.
2. Segments that are equal byte for byte (by hash, with the anchor at the same place) are
   repeated as a whole.
3. The other segments of a hash are cut into RANGES of window starts, by their distance to
   the anchor. All windows of a range share a core of 178 bytes. Ranges whose core is
   nobody else's hold no repeated string, and equal ranges are repeated as a whole. Those
   that are left, where a repeated string begins or ends, go into a suffix array, the core
   as one letter: 200 common bytes are STEP common letters then. It is sorted in two stages: suffixes smaller than their successors directly, all others by a
   scan over the buckets of first bytes, in which each sorted suffix places the one before
   it. Starts of neighbours with 200 common bytes and equal distance to the anchor are
   repeated.

The segments of one hash meet in a task, up to HOT of them. A hash with more (a line that
is everywhere, in ever new surroundings) is dealt by range and core; a core with more than
HOT different surroundings, at last, by its windows, STEP for each, whose hashes are counted.

Defined cases: null text is empty; texts under 200 bytes lose nothing; repeated rows are
copies of each other and lose everything from 200 bytes on; a document's own repetitions
count; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import dealt_join, stage, table, tune

#: Length of the strings, of the grams, and starts of grams in a window.
LENGTH, GRAM = 200, 24
STARTS = LENGTH - GRAM + 1
#: Segments that meet in a task at most, and ranges of window starts.
HOT, RANGES = 4096, 8
STEP = -(-STARTS // RANGES)
#: Stands for a core; no byte of UTF-8.
CORE = b"\xfe"
#: Bytes that one suffix array is made for, unless one group has more.
BLOCK = 1 << 18
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 22


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each place on: bytes are joined to 8, then 16, then 24."""
    h = b.astype(np.uint64)
    for j in (1, 2, 4):
        h = h[:-j] | (h[j:] << np.uint64(8 * j))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    out = h[:-16] * np.uint64(0xC2B2AE3D27D4EB4F)
    out += h[8:-8]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out += h[16:]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    return out


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over each w neighbours, by running it forth and back in blocks of w."""
    n = len(x)
    pad = -n % w
    y = np.pad(x, (0, pad), mode="edge").reshape(-1, w)
    forth = f.accumulate(y, axis=1).ravel()
    back = f.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - w + 1], forth[w - 1 : n])


def runs_of(places: list[int], hashes: list[int], start: list[int], end: list[int], least: list[int]) -> list[int]:
    """For each anchor in order, the run of equal minima that it is in."""
    k, out = 0, []
    for p, h in zip(places, hashes):
        while least[k] != h or end[k] + STARTS <= p or start[k] > p:
            k += 1
        out.append(k)
    return out


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, first, last) of the anchors of a text; all of several equal least grams.

    first and last: the starts of an anchor's own windows; those of equal grams may overlap.
    """
    out = []
    for at in range(0, len(b) - LENGTH + 1, CHUNK):
        # windows that start in this chunk
        h = gram_hashes(b[at : at + CHUNK + LENGTH - 1])
        least = sliding(h, STARTS, np.minimum)
        # a gram is an anchor if it is the least of some window with it, thus of the one with the largest minimum
        wide = np.pad(least, STARTS - 1, constant_values=0)
        p = np.flatnonzero(sliding(wide, STARTS, np.maximum)[: len(h)] == h)
        # windows with one minimum follow one another: as many runs as anchors, but for ties
        start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        end = np.append(start[1:], len(least)) - 1
        if len(start) != len(p) or not np.array_equal(least[start], h[p]):
            run = runs_of(p.tolist(), h[p].tolist(), start.tolist(), end.tolist(), least[start].tolist())
            start, end = np.maximum(start[run], p - STARTS + 1), np.minimum(end[run], p)
        out.append((p + at, h[p], start + at, end + at))
    if not out:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    return tuple(np.concatenate(c) for c in zip(*out))


_ANCHORS = T.StructType([T.StructField("h", T.ArrayType(T.LongType())), T.StructField("s", T.ArrayType(T.LongType())), T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("o", T.ArrayType(T.IntegerType()))])


@F.arrow_udf(_ANCHORS)
def anchors_udf(texts: pa.Array) -> pa.Array:
    """Of each anchor: its hash, its segment's hash (with the place of the anchor in it), where the segment
    starts, and as 256 times the one plus the other, the anchor's place in it and its windows less one."""
    hs, ss, xs, os_ = [], [], [], []
    for t in texts:
        raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
        p, h, x0, x1 = anchors(np.frombuffer(raw, np.uint8)) if len(raw) >= LENGTH else ([],) * 4
        if len(p):
            place = p - x0
            hash_ = xxhash.xxh3_64_intdigest
            ss.append(np.fromiter((hash_(raw[a : z + LENGTH], q) for a, z, q in zip(x0.tolist(), x1.tolist(), place.tolist())), np.uint64, len(p)).view(np.int64))
            hs.append(h.view(np.int64))
            xs.append(x0.astype(np.int32))
            os_.append((place * 256 + x1 - x0).astype(np.int32))
        else:
            for c in (hs, ss, xs, os_):
                c.append([])
    big, small = pa.list_(pa.int64()), pa.list_(pa.int32())
    return pa.StructArray.from_arrays([pa.array(hs, big), pa.array(ss, big), pa.array(xs, small), pa.array(os_, small)], ["h", "s", "x", "o"])


# -- the suffix array of a block ------------------------------------------------------------


def two_stage(t: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of t in order of their first depth letters; t ends with its least letter."""
    n = len(t)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    rise[-1] = 1
    # equal neighbours go the way of the next unequal ones
    at = np.where(rise != 0, np.arange(n), n)
    small = rise[np.minimum.accumulate(at[::-1])[::-1]] > 0
    # stage one: those smaller than their successors are sorted directly
    raw = t.tobytes()
    direct = np.array(sorted(np.flatnonzero(small).tolist(), key=lambda i: raw[i : i + depth]), np.int64)
    first = t[direct]
    # stage two: bucket by bucket, each suffix places its predecessor if that is larger
    placed: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.unique(t).tolist():
        level = np.concatenate(placed[c]) if placed[c] else np.zeros(0, np.int64)
        levels = [level]
        while len(level):
            before = level[level > 0] - 1
            level = before[t[before] == c]
            levels.append(level)
        lo, hi = np.searchsorted(first, [c, c + 1])
        bucket = np.concatenate([*levels, direct[lo:hi]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        ch = t[before]
        before, ch = before[ch > c], ch[ch > c]
        order = np.argsort(ch, kind="stable")
        before, ch = before[order], ch[order]
        cuts = np.flatnonzero(np.diff(ch)) + 1
        for part in np.split(before, cuts) if len(before) else ():
            placed[int(t[part[0]])].append(part)
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """Common letters of each suffix with the one before it in sa, up to depth (0 for the first)."""
    padded = np.concatenate([t, np.zeros(depth + 8, np.uint8)])
    w = padded.astype(np.uint64)
    for j in (1, 2, 4):  # the byte at a place is the highest of its eight
        w = (w[:-j] << np.uint64(8 * j)) | w[j:]
    lcp = np.zeros(len(sa), np.int64)
    left = np.arange(1, len(sa))
    for d in range(0, depth, 8):
        x = w[sa[left] + d] ^ w[sa[left - 1] + d]
        same = x == 0
        lcp[left[same]] += 8
        odd = x[~same]
        high = np.zeros(len(odd), np.int64)
        for j in range(1, 8):
            high += odd < np.uint64(1 << (64 - 8 * j))
        lcp[left[~same]] += high
        left = left[same]
    return np.minimum(lcp, depth)


class Block:
    """Texts of whole groups; each has the group's number, the anchor's place in it, and its letters.

    Strings of `length` letters are looked for.
    """

    def __init__(self, length: int):
        self.length = length
        self.rows: list[tuple] = []
        self.bytes: list[bytes] = []
        self.group: list[int] = []
        self.anchor: list[int] = []
        self.range: list[tuple[int, int]] = []
        self.size = 0

    def add(self, row: tuple, group: int, data: bytes, anchor: int, starts: tuple[int, int]) -> None:
        """starts: distances before the anchor at which windows are judged, [from, to)."""
        self.rows.append(row)
        self.bytes.append(data)
        self.group.append(group)
        self.anchor.append(anchor)
        self.range.append(starts)
        self.size += len(data)

    def repeated(self) -> Iterator[tuple[tuple, int, int]]:
        """(row, first, last): starts of strings in the row's text, for each run of neighbouring repeated ones."""
        if len(self.rows) < 2:
            return
        lengths = np.array([len(x) for x in self.bytes])
        t = np.concatenate([np.append(np.frombuffer(x, np.uint8) + np.uint8(1), np.uint8(0)) for x in self.bytes])
        sa = two_stage(t, self.length)
        cls = np.cumsum(common_prefixes(t, sa, self.length) < self.length)
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        seg = np.searchsorted(begins, sa, "right") - 1
        start = sa - begins[seg]
        distance = np.array(self.anchor)[seg] - start
        lo, hi = np.array(self.range)[seg].T
        ok = (start + self.length <= lengths[seg]) & (distance >= lo) & (distance < hi)
        cls, seg, start, distance = cls[ok], seg[ok], start[ok], distance[ok]
        key = np.stack([cls, np.array(self.group)[seg], distance])
        order = np.lexsort(key)
        key = key[:, order]
        same = np.all(key[:, 1:] == key[:, :-1], axis=0)
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hits = order[twice]
        hits = hits[np.lexsort([start[hits], seg[hits]])]
        s, x = seg[hits], start[hits]
        cut = np.flatnonzero((np.diff(s) != 0) | (np.diff(x) > self.length)) + 1
        for part in np.split(np.arange(len(hits)), cut) if len(hits) else ():
            yield self.rows[s[part[0]]], int(x[part[0]]), int(x[part[-1]])


_SEGMENT = "h long, n long, doc_id long, v long, x int, a int, data binary"
_SEGMENT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_SEGMENT_NAMES = ["h", "n", "doc_id", "v", "x", "a", "data"]
_SPAN = pa.schema([("doc_id", pa.int64()), ("v", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _SEGMENT_KINDS)], _SEGMENT_NAMES)


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, v, text, want) to one row for each wanted segment: x its start, a the anchor's place in it."""
    for b in batches:
        out: list[tuple] = []
        size = 0
        for doc, v, text, want in zip(b.column("doc_id").to_pylist(), b.column("v").to_pylist(), b.column("text"), b.column("want")):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for w in want.as_py():
                a, more = divmod(w["o"], 256)
                data = raw[w["x"] : w["x"] + more + LENGTH]
                out.append((w["h"], w["n"], doc, v, w["x"], a, data))
                size += len(data)
            if size > 4_000_000:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)


def ranges(a: int, data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(g, least, most, core) of each range in a segment: the distances to the anchor of its windows, and the bytes all share."""
    low, high = a - (len(data) - LENGTH), a
    for g in range(max(0, low) // STEP, high // STEP + 1):
        core = data[a - g * STEP : a + LENGTH - (g + 1) * STEP + 1]
        yield g, max(low, g * STEP), min(high, (g + 1) * STEP - 1), core


class Comparison:
    """Gathers the segments of a group, resolves what hashes can, and gives the rest to blocks."""

    def __init__(self):
        self.block, self.number = Block(STEP), 0
        self.spans: list[tuple[int, int, int, int]] = []

    def group(self, rows: list[tuple], only: int = -1) -> None:
        """rows: (n, doc_id, v, x, a, data) of one hash; only: the one range to look at."""
        if len(rows) < 2:
            return
        by_core: dict[tuple, dict[tuple, list[tuple]]] = {}
        for n, doc, v, x, a, data in rows:
            for g, least, most, core in ranges(a, data):
                if only in (-1, g):
                    zone = data[a - most : a - least + LENGTH]
                    by_core.setdefault((g, core), {}).setdefault((least, most, zone), []).append((n, doc, v, x + a - most))
        for (g, core), zones in by_core.items():
            if len(zones) == 1 and sum(map(len, zones.values())) == 1:
                continue
            self.number += 1
            for (least, most, zone), members in zones.items():
                if len(members) > 1:
                    # equal ranges are repeated as a whole; one of them serves the others
                    self.spans += [(doc, v, at, at + len(zone)) for n, doc, v, at in members if n == 1]
                if len(zones) > 1:
                    n, doc, v, at = members[0]
                    before = most - g * STEP
                    # the core, which all have at the same distance, is one letter; each window has STEP of them then
                    short = zone[:before] + CORE + zone[before + len(core) :]
                    self.block.add((n if len(members) == 1 else 2, doc, v, at), self.number, short, most, (least, most + 1))
            if self.block.size > BLOCK:
                self.flush()

    def flush(self) -> None:
        # segments that occur twice are repeated as a whole already; here they only serve the others
        self.spans += [(doc, v, at + a, at + z + LENGTH) for (n, doc, v, at), a, z in self.block.repeated() if n == 1]
        self.block = Block(STEP)

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.spans:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.spans), _SPAN)], schema=_SPAN)
            self.spans = []


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by (h, g, core) to repeated spans; a group holds no more than HOT segments."""
    c, here, rows = Comparison(), None, []
    for b in batches:
        for h, n, doc, v, x, a, data, g, core in zip(*(b.column(k).to_pylist() for k in (*_SEGMENT_NAMES, "g", "core"))):
            if (h, g, core) != here:
                if rows:
                    c.group(rows, here[1])
                here, rows = (h, g, core), []
            rows.append((n, doc, v, x, a, data))
        yield from c.taken()
    if rows:
        c.group(rows, here[1])
    c.flush()
    yield from c.taken()


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("g", T.IntegerType()), T.StructField("core", T.LongType())])))
def cores_udf(data: pa.Array, a: pa.Array) -> pa.Array:
    """The ranges of a segment and the hashes of their cores."""
    kind = pa.list_(pa.struct([("g", pa.int32()), ("core", pa.int64())]))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return pa.array([[{"g": g, "core": signed(xxhash.xxh3_64_intdigest(core, g))} for g, _, _, core in ranges(q, d)] for q, d in zip(a.to_pylist(), data.to_pylist())], kind)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("d", T.IntegerType()), T.StructField("w", T.LongType())])))
def windows_udf(data: pa.Array, a: pa.Array, g: pa.Array) -> pa.Array:
    """The windows of one range of a segment: distance to the anchor and hash."""
    kind = pa.list_(pa.struct([("d", pa.int32()), ("w", pa.int64())]))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for d, q, k in zip(data.to_pylist(), a.to_pylist(), g.to_pylist()):
        low, high = max(q - (len(d) - LENGTH), k * STEP), min(q, (k + 1) * STEP - 1)
        out.append([{"d": m, "w": signed(xxhash.xxh3_64_intdigest(d[q - m : q - m + LENGTH], m))} for m in range(low, high + 1)])
    return pa.array(out, kind)


def compared(segments: DataFrame) -> DataFrame:
    """Spans of the segments that occur once, by hash, or where that has too many, by core, or by window."""
    columns = segments.columns
    size = stage(segments.groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > HOT).select("h"), "hot")
    few = segments.join(size, "h", "left_anti").select("*", F.lit(-1).alias("g"), F.lit(0).cast("long").alias("core"))
    many = segments.join(size, "h", "left_semi").select("*", F.explode(cores_udf("data", "a")).alias("c")).select(*columns, "c.*")
    many = stage(many, "cores")
    key = ["h", "g", "core"]
    counts = stage(many.groupBy(*key).agg(F.count("*").alias("k")).filter("k > 1"), "twice")
    met = many.join(counts, key)
    dealt = few.unionByName(met.filter(F.col("k") <= HOT).drop("k")).repartition(*key).sortWithinPartitions(*key)
    spans = dealt.mapInArrow(_compare, "doc_id long, v long, start int, end int")
    single = met.filter(F.col("k") > HOT).select(*key, "n", "doc_id", "v", "x", "a", F.explode(windows_udf("data", "a", "g")).alias("y")).select(*key, "n", "doc_id", "v", "x", "a", "y.*")
    single = stage(single, "windows")
    again = stage(single.groupBy(*key, "d", "w").agg(F.count("*").alias("k")).filter("k > 1").drop("k"), "again")
    start = (F.col("x") + F.col("a") - F.col("d")).cast("int")
    hot = single.filter("n = 1").join(again, [*key, "d", "w"]).select("doc_id", "v", start.alias("start"), (start + LENGTH).cast("int").alias("end"))
    return spans.unionByName(hot)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null: a key of its own), a hash of the text, and the text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("text").alias("v"), "text")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, v, spans): repeated byte ranges of each text that has any; v is a hash of the text. Spans may overlap."""
    tune(docs.sparkSession)
    texts = keyed(docs)
    found = stage(texts.select("doc_id", "v", anchors_udf("text").alias("a")), "anchors")
    occ = found.select("doc_id", "v", F.explode(F.arrays_zip("a.h", "a.s", "a.x", "a.o")).alias("o")).select("doc_id", "v", "o.*")
    twice = occ.groupBy("h").agg(F.count("*").alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi")).filter("c > 1")
    twice = stage(twice.select("h", (F.col("lo") != F.col("hi")).alias("many")), "twice")
    met = stage(occ.join(twice, "h"), "met")
    # of hashes with several segments: each distinct segment, how often, and where it is
    where = F.min(F.struct("doc_id", "v", "x", "o")).alias("w")
    distinct = stage(met.filter("many").groupBy("h", "s").agg(F.count("*").alias("n"), where).select("h", "s", "n", "w.*"), "segments")
    place = ["doc_id", "v", "x", "o"]
    # a segment that a third of all texts have must not meet in one task
    again = dealt_join(met.filter("many"), distinct.filter("n > 1").select("h", "s", "n"), ["h", "s"], "n", met.count())
    whole = met.filter("NOT many").select(*place).unionByName(again.select(*place))
    whole = whole.select("doc_id", "v", F.col("x").alias("start"), (F.col("x") + F.col("o") % 256 + LENGTH).cast("int").alias("end"))
    want = distinct.groupBy("doc_id", "v").agg(F.collect_list(F.struct("h", "n", "x", "o")).alias("want"))
    # repeated rows give a segment twice, but then one that is repeated as a whole
    cut = texts.join(want.hint("shuffle_hash"), ["doc_id", "v"]).mapInArrow(_cut_segments, _SEGMENT)
    partly = compared(stage(cut, "bytes"))
    return whole.unionByName(partly).groupBy("doc_id", "v").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


_RESULT = T.StructType([T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType()))])


def cut_out(raw: bytes, spans: list[dict] | None) -> tuple[int, int, int, bytes]:
    """(bytes, removed bytes, maximal removed runs, the remaining bytes)."""
    runs: list[list[int]] = []
    for a, z in sorted((s["start"], s["end"]) for s in spans or ()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z)
        else:
            runs.append([a, z])
    at, kept = 0, []
    for a, z in runs:
        kept.append(raw[at:a])
        at = z
    kept.append(raw[at:])
    rest = b"".join(kept)
    return len(raw), len(raw) - len(rest), len(runs), rest


@F.arrow_udf(_RESULT)
def cut_udf(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = [cut_out((t.as_py() or "").encode("utf-8", "surrogatepass"), s.as_py()) for t, s in zip(texts, spans)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.name for f in _RESULT])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; cuts may fall within a character)."""
    spans = stage(repeats(docs), "spans")
    joined = keyed(docs).join(spans.hint("shuffle_hash"), ["doc_id", "v"], "left")
    shown = F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id")
    return joined.select(shown, cut_udf("text", "spans").alias("r")).select("doc_id", "r.*")


def op3_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """The same by a table of all strings, for tests: (bytes, removed, runs, sha256)."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - LENGTH + 1):
            seen[r[i : i + LENGTH]] = seen.get(r[i : i + LENGTH], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - LENGTH + 1):
            if seen[r[i : i + LENGTH]] > 1:
                gone[i] += 1
                gone[i + LENGTH] -= 1
        mask = np.cumsum(gone)[: len(r)] > 0
        runs = int(np.sum(mask[1:] & ~mask[:-1]) + (len(mask) > 0 and mask[0]))
        rest = np.frombuffer(r, np.uint8)[~mask].tobytes()
        out.append((len(r), int(mask.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out
