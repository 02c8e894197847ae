"""Secrets in texts: fixed patterns, and a battery of randomness tests on long tokens.

A token with letters is taken for a string over the smallest encoding that fits: hex,
letters of one case, base32, base36, base62 or base64. An equals sign ends a token; those
at its very end are its padding. Four tests look for structure: chi-squared for a uniform
alphabet (over as many bins as its length allows), runs of digits, lower-case and upper-case
letters, serial correlation of neighbours, and neighbouring pairs that are likelier in
ordinary words than in random strings of that encoding. Pairs of ordinary words are counted
over the short words of all texts, a table of 28 x 28 counts, and mixed with those of PRIOR_TEXT.

The weighted sum of the tests' normal scores is a token's structure. The null hypothesis is
that the token is an ordinary one: words of the corpus's pairs and numbers strung together
in the usual ways. Its distribution of structure is simulated for each class of lengths,
two classes to a doubling, with an exponential tail. The chance that an ordinary token has so
little structure is the token's p-value, and in each class the Benjamini-Hochberg step-up
over all tokens of the corpus decides which are discovered to be secrets; RATE bounds the
share of ordinary tokens among those. A discovery must also be compatible with randomness:
the battery's own p-value, combined by the Cauchy rule, which holds for dependent tests, is
LEAST_RANDOM at least. Discoveries outside pattern spans are reported as `random`.

The counts that the step-up needs form a bounded table: classes times steps of structure.

Defined cases: null text is empty; empty texts have no spans; tokens without a letter, which
can't be told from numbers, are no candidates; overlapping spans of different kinds are all
reported; repeated rows are each scanned; an empty table gives no rows. `redact` carries all
columns along; names that start with `_tl_` are reserved.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import stage, table, tune

#: The kinds and their patterns; letters of the first group match in either case.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A text without any of these (in lower case) has no assignment.
ASSIGN_WORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
LEAST_VALUE, LEAST_ACCESS = 8, 16

#: Tokens for the battery.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{14,}(?:=+(?![A-Za-z0-9+/_=-]))?")
#: Characters of a token, with its padding.
LEAST_TOKEN = 16
DIGITS, LOWER, CAPS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets from the smallest to the largest.
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": CAPS,
    "base32": CAPS + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + CAPS,
    "base62": CAPS + LOWER + DIGITS,
    "base64": CAPS + LOWER + DIGITS + "+/",
    "base64url": CAPS + LOWER + DIGITS + "-_",
}
_INDEX = {name: {c: i for i, c in enumerate(a)} for name, a in ENCODINGS.items()}
#: Symbols of the pair table: letters without case, any digit, any other character of a token.
SYMBOLS = 28
_SYMBOL = {c: i for i, c in enumerate(LOWER)} | {c: i for i, c in enumerate(CAPS)} | dict.fromkeys(DIGITS, 26) | dict.fromkeys("+/_-", 27)
_SYMBOL_OF_BYTE = np.array([_SYMBOL.get(chr(i), -1) for i in range(256)], np.int16)
#: Words that the pairs are counted in have no more characters.
MOST_WORD = 15
#: Pairs of this text have a share of PRIOR_SHARE beside those of the corpus: identifiers are often English words.
PRIOR_SHARE = 0.3
PRIOR_TEXT = """the report on water and energy for the coming year shows that people in small towns would rather travel by train than
drive and that most of them think about the price before they choose where to go when winter comes many houses need repair while
others stand empty because owners have moved away we should have known better than to leave such an important question to a single
person with no experience of working under pressure every version of this document must be checked before it is sent to anyone
else final draft user account number first last name address street value index table server client system key page file data"""
#: Weights of the tests' scores, and the range of each.
WEIGHTS, LEAST_Z, MOST_Z = (1.0, 1.0, 0.5, 2.0), -3.0, 9.0
#: P-value of the battery that a secret has at least, and the rate of ordinary tokens among those reported.
LEAST_RANDOM, RATE = 0.001, 0.05
#: Steps of structure (20 to one), from -10 on.
STEPS, LEAST_STRUCTURE = 20, -10
#: Simulated ordinary tokens of each class, and the share whose tail is taken for exponential.
SIMULATED, TAIL = 2000, 0.02


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity(u: list[int], size: int) -> float:
    """Chi-squared over bins of the alphabet, five expected letters a bin at least, as a normal score (Wilson-Hilferty)."""
    k = max(2, min(size, len(u) // 5))
    # bins of unequal width take their share of the alphabet
    width = [0] * k
    for i in range(size):
        width[i * k // size] += 1
    seen = [0] * k
    for i in u:
        seen[i * k // size] += 1
    x = sum((o - len(u) * w / size) ** 2 / (len(u) * w / size) for o, w in zip(seen, width))
    v = 2 / (9 * (k - 1))
    return ((x / (k - 1)) ** (1 / 3) - (1 - v)) / math.sqrt(v)


def character_class(c: str) -> int:
    return 0 if c in DIGITS else 1 if c in LOWER else 2 if c in CAPS else 3


def class_runs(body: str, u: list[int], name: str) -> float:
    """Too few runs of character classes for random letters; in an encoding of one class, of its two halves."""
    alphabet = ENCODINGS[name]
    kinds = [character_class(c) for c in body]
    share = [0.0] * 4
    for c in alphabet:
        share[character_class(c)] += 1 / len(alphabet)
    if max(share) > 0.99:
        kinds, share = [i * 2 // len(alphabet) for i in u], [0.5, 0.5]
    n = len(kinds)
    s2, s3 = sum(p * p for p in share), sum(p**3 for p in share)
    # changes between neighbours: each has the chance 1 - s2, two that share a letter depend on each other
    change = 1 - s2
    var = (n - 1) * change * s2 + 2 * (n - 2) * (s3 - s2 * s2)
    seen = sum(x != y for x, y in zip(kinds, kinds[1:]))
    return ((n - 1) * change - seen) / math.sqrt(var)


def serial(u: list[int]) -> float:
    """Correlation of neighbours, two-sided; under randomness its mean is -1/n and its variance about 1/n. The score of |r|."""
    n = len(u)
    mean = sum(u) / n
    var = sum((x - mean) ** 2 for x in u)
    if not var:
        return MOST_Z
    r = sum((x - mean) * (y - mean) for x, y in zip(u, u[1:])) / var
    return _score(2 * normal_tail(abs(r + 1 / n) * math.sqrt(n)))


def _score(p: float) -> float:
    return -NormalDist().inv_cdf(min(max(p, 1e-16), 1 - 1e-16))


class Pairs:
    """How likely pairs of neighbours are in ordinary words; counts: SYMBOLS x SYMBOLS numbers."""

    def __init__(self, counts: list[int]):
        c = np.array(counts, np.float64).reshape(SYMBOLS, SYMBOLS) + 0.5
        prior = prior_counts().reshape(SYMBOLS, SYMBOLS) + 0.5
        p = (1 - PRIOR_SHARE) * c / c.sum(axis=1, keepdims=True) + PRIOR_SHARE * prior / prior.sum(axis=1, keepdims=True)
        # running sums of the letters that begin words and follow others
        self.begin = np.cumsum(c[:26].sum(axis=1)).tolist()
        self.follow = np.cumsum(p[:26, :26], axis=1).tolist()
        log = np.log(p)
        self.log = [list(map(float, row)) for row in log]
        #: For each encoding, the mean, variance and covariance of neighbouring pairs in random strings.
        self.random = {}
        for name, alphabet in ENCODINGS.items():
            share = np.bincount([_SYMBOL[x] for x in alphabet], minlength=SYMBOLS) / len(alphabet)
            mean = share @ log @ share
            var = share @ (log * log) @ share - mean * mean
            cov = (share @ log) * (log @ share) @ share - mean * mean
            self.random[name] = float(mean), float(var), float(cov)

    def score(self, body: str, name: str) -> float:
        s = [_SYMBOL[c] for c in body]
        mean, var, cov = self.random[name]
        n = len(s) - 1
        total = sum(self.log[a][b] for a, b in zip(s, s[1:]))
        return (total - n * mean) / math.sqrt(max(n * var + 2 * (n - 1) * cov, 1e-9))

    def word(self, rng: random.Random, n: int) -> str:
        """An ordinary word of n letters."""
        sums, out = self.begin, ""
        for _ in range(n):
            at = bisect_right(sums, rng.random() * sums[-1], 0, 25)
            out += LOWER[at]
            sums = self.follow[at]
        return out


def pair_counts(text: str | None) -> np.ndarray:
    """Pairs of neighbours in the words of 2 to MOST_WORD characters of tokens."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    s = np.concatenate([[-1], _SYMBOL_OF_BYTE[b], [-1]])
    step = np.diff((s >= 0).astype(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = s[1:-1]
    long = end - start > MOST_WORD
    if long.any():
        edge = np.zeros(len(inner) + 1, np.int32)
        np.add.at(edge, start[long], 1)
        np.add.at(edge, end[long], -1)
        inner = np.where(np.cumsum(edge[:-1]) > 0, -1, inner)
    a, z = inner[:-1], inner[1:]
    both = (a >= 0) & (z >= 0)
    return np.bincount(a[both].astype(np.int64) * SYMBOLS + z[both], minlength=SYMBOLS * SYMBOLS)


def prior_counts() -> np.ndarray:
    return pair_counts(PRIOR_TEXT)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each pair seen in a partition."""
    total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for b in batches:
        for t in b.column(0):
            total += pair_counts(t.as_py())
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["pair", "n"])


def fit_pairs(docs: DataFrame) -> list[int]:
    """The pair table of all texts: SYMBOLS x SYMBOLS numbers on the driver."""
    rows = docs.select("text").mapInArrow(_count_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for r in rows:
        out[r["pair"]] += r["n"]
    return out.tolist()


@lru_cache(maxsize=4)
def table_of(counts: tuple[int, ...]) -> Pairs:
    """One table a worker and corpus."""
    return Pairs(list(counts))


def battery(token: str, pairs: Pairs) -> tuple[float, float] | None:
    """(p-value that token is random over its encoding, structure); None if it isn't a candidate."""
    body = token.rstrip("=")
    if len(body) < LEAST_TOKEN - 2 or not any(c.isalpha() for c in body):
        return None
    name = next((n for n, index in _INDEX.items() if all(c in index for c in body)), None)
    if name is None:
        return None
    u = [_INDEX[name][c] for c in body]
    z = (uniformity(u, len(ENCODINGS[name])), class_runs(body, u, name), serial(u), pairs.score(body, name))
    ps = [max(1e-15, normal_tail(x)) for x in z]
    # a p-value near one must not outweigh a small one
    cauchy = sum(math.tan((0.5 - min(p, 0.95)) * math.pi) for p in ps) / len(ps)
    structure = sum(w * min(max(x, LEAST_Z), MOST_Z) for w, x in zip(WEIGHTS, z)) / math.sqrt(sum(w * w for w in WEIGHTS))
    return 0.5 - math.atan(cauchy) / math.pi, structure


def ordinary(pairs: Pairs, rng: random.Random, n: int) -> str:
    """An ordinary token of n characters: words and numbers, in one of the usual styles."""
    style, case, digits = rng.choice(["", "", "-", "_", "/"]), rng.choice(["lower", "camel", "upper"]), rng.choice([0.0, 0.2, 0.5, 0.8])
    out = ""
    while len(out) < n:
        if out and rng.random() < digits:
            out += "".join(rng.choice(DIGITS) for _ in range(rng.randrange(1, 5)))
        else:
            w = pairs.word(rng, rng.randrange(3, 10))
            out += w.upper() if case == "upper" else w.capitalize() if case == "camel" else w
        out += style
    return out[:n]


class Null:
    """The structure of ordinary tokens of a class of lengths."""

    def __init__(self, pairs: Pairs, cls: int):
        rng = random.Random(cls)
        low, high = math.ceil(2 ** (cls / 2)), math.ceil(2 ** ((cls + 1) / 2))
        found = (battery(ordinary(pairs, rng, rng.randrange(low, high)), pairs) for _ in range(SIMULATED))
        self.seen = sorted(x[1] for x in found if x)
        k = max(2, int(len(self.seen) * TAIL))
        self.edge = self.seen[k]
        self.scale = max(0.05, self.edge - sum(self.seen[:k]) / k)
        self.share = (k + 1) / (len(self.seen) + 1)

    def p(self, structure: float) -> float:
        """The chance of no more structure."""
        if structure < self.edge:
            return self.share * math.exp((structure - self.edge) / self.scale)
        return (1 + bisect_right(self.seen, structure)) / (len(self.seen) + 1)


#: The class of 128 characters and more, where structure is beyond doubt.
MOST_CLASS = 14


def class_of(n: int) -> int:
    """The length class of n characters: 8 for 16 to 22, two to a doubling."""
    return min(MOST_CLASS, (n * n).bit_length() - 1)


def find(text: str | None, pairs: Pairs) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, length class, step of structure) of each span; the last two only for tokens of the battery.

    A token that isn't compatible with randomness has the class, but the highest step.
    """
    if not text:
        return []
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), 0, 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if b"akia" in low:
        out += [(m.start(), 1, m.end(), 0, 0) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), 0, 0) for m in HEX.finditer(text)]
    base = list(out)
    for m in TOKEN.finditer(text):
        got = battery(m[0], pairs) if len(m[0]) >= LEAST_TOKEN else None
        if got and not any(s <= m.start() and m.end() <= e for s, _, e, _, _ in base):
            step = int((got[1] - LEAST_STRUCTURE) * STEPS) if got[0] >= LEAST_RANDOM else 1 << 20
            out.append((m.start(), 3, m.end(), class_of(len(m[0])), max(0, step)))
    return sorted(out)


FIELDS = ["start", "kind", "end", "cls", "step"]


def finder(counts: list[int]):
    """A function of a text column that gives find() by a pair table."""
    fixed = tuple(counts)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(f, T.IntegerType()) for f in FIELDS])))
    def run(texts: pa.Array) -> pa.Array:
        pairs = table_of(fixed)
        kind = pa.list_(pa.struct([(f, pa.int32()) for f in FIELDS]))
        return pa.array([[dict(zip(FIELDS, s)) for s in find(t.as_py(), pairs)] for t in texts], kind)

    return run


def step_up(steps: dict[int, int], null: Null) -> int:
    """The highest step that is a discovery (-1: none), from the number of tokens of each step."""
    total, upto, most = sum(steps.values()), 0, -1
    for s in sorted(steps):
        upto += steps[s]
        # all tokens of a step have less structure than its end
        if null.p((s + 1) / STEPS + LEAST_STRUCTURE) <= RATE * upto / total:
            most = s
    return most


def limits(found: DataFrame, counts: list[int]) -> dict[int, int]:
    """By length class, the highest step of structure that is a discovery.

    The driver gets one row for each class and step, some 3,000 rows at most.
    """
    each = found.select(F.explode("_tl_found").alias("s")).filter("s.kind = 3").groupBy("s.cls", "s.step").count()
    by: dict[int, dict[int, int]] = {}
    for r in each.collect():
        by.setdefault(r["cls"], {})[r["step"]] = r["count"]
    pairs = Pairs(counts)
    return {cls: step_up(steps, Null(pairs, cls)) for cls, steps in by.items()}


def decided(found: Column, limit: dict[int, int]) -> Column:
    """The spans that stay: patterns, and tokens up to their class's limit."""

    def stays(s: Column) -> Column:
        at = F.lit(-1)
        for cls, b in limit.items():
            at = F.when(s["cls"] == cls, b).otherwise(at)
        return (s["kind"] < 3) | (s["step"] <= at)

    return F.filter(found, stays)


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and spans: array of (start, kind, end, cls, step), sorted. Texts are read twice: for the pairs and for the tokens."""
    tune(docs.sparkSession)
    counts = fit_pairs(docs)
    found = stage(docs.select(F.col(key), finder(counts)(F.col("text")).alias("_tl_found")), "found")
    return found.select(key, decided(F.col("_tl_found"), limits(found, counts)).alias("spans"))


def cut(text: str | None, spans, mask: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        a, b = s["start"], s["end"]
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """All columns of docs, with every span of the text replaced by mask, and n_chars (if there) counted anew."""
    tune(docs.sparkSession)
    columns = docs.columns
    counts = fit_pairs(docs)
    found = stage(docs.withColumn("_tl_found", finder(counts)(F.col("text"))), "found")

    @F.arrow_udf("string")
    def masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([cut(t.as_py(), s.as_py(), mask) for t, s in zip(texts, spans)], pa.string())

    # as most texts hold no span, only the others go through Python
    spans = decided(F.col("_tl_found"), limits(found, counts))
    out = found.withColumn("_tl_spans", spans)
    out = out.withColumn("text", F.when(F.size("_tl_spans") > 0, masked(F.col("text"), F.col("_tl_spans"))).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("_tl_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in columns))


def op4_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return s.select("doc_id", count(0), count(1), count(2), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), count(3))
