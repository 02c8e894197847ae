"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Each document gets counts and, from them, five integer measures. A sketch of a measure is a
table of bucket counts: exact below 64, then 32 buckets for each doubling, so that a value
is known to within 1/32. Sketches merge by adding counts. Those of (language, source) merge
into one per language and one of everything; a group of fewer than LEAST_DOCS documents
uses the finest of these that is large enough. The fences lie SPREADS spreads outside the
quartiles. A spread is the quartile distance, but no less than what a single event (one
symbol, two capitals, one repeated line, one repeated run, one very long word) makes in the
document itself or in the group's median document, whichever is smaller; so groups whose
documents are all without an event, and short documents, are judged by what chance gives.
The medians come from sketches, too: no threshold is a constant. Quartiles and medians are
joined to the documents and decide.

Defined cases: null text has no words and fails the base rule; null language or source
are groups of their own; texts without words give measures of 0; repeated rows are each
judged; an empty table gives no rows. `keep` carries any further columns along, whatever
their names; only names that start with `_tl_` are reserved.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import SHINGLE, WORD_BREAKS, split_words, stage, table, tune

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Base rule: words at least, and repeated words per hundred at most.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Documents that a group needs for fences of its own.
LEAST_DOCS = 50
#: Spreads between a quartile and its fence.
SPREADS = 4
#: Measure: a count's share of a size, in so many parts; what an event adds to the count; and whether small values are odd too.
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 1000, 1, False),
    "capitals": ("n_capitals", "word_chars", 1000, 2, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 1, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 2 * SHINGLE, False),
    "word_length": ("word_chars", "n_words", 100, 10, True),
}
SIZES = ["word_chars", "n_lines", "n_words"]
#: Rows of fences up to which they are broadcast; beyond that they are joined by shuffle.
BROADCAST_ROWS = 100_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words"]


def counts_of(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    words = split_words(text)
    chars = len(text) - sum(text.count(c) for c in WORD_BREAKS)
    lines = [x for x in text.split("\n") if x.strip(WORD_BREAKS)]
    repeated = 0
    windows = list(zip(*(words[i:] for i in range(SHINGLE))))
    times = Counter(windows)
    if len(times) < len(windows):
        reach = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + SHINGLE - max(reach, i)
                reach = i + SHINGLE
    raw = text.encode("utf-8", "surrogatepass")
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), capitals, len(lines), len(lines) - len(set(lines)), repeated


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def count_udf(texts: pa.Array) -> pa.Array:
    rows = [counts_of(t.as_py()) for t in texts]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))], COUNTS)


def measures(c) -> dict[str, Column]:
    """The measures, as whole numbers, from the counts c(name)."""
    return {m: F.floor(c(top) * times / F.greatest(c(low), F.lit(1))).cast("long") for m, (top, low, times, _, _) in MEASURES.items()}


def bucket(v: Column) -> Column:
    e = F.greatest(F.lit(0), F.length(F.bin(v)) - 6)
    return e * 32 + F.floor(v / F.pow(F.lit(2), e))


def bucket_top(b: Column) -> Column:
    """The largest value of a bucket."""
    e = F.greatest(F.lit(0), F.floor(b / 32) - 1)
    return ((b - 32 * e + 1) * F.pow(F.lit(2), e) - 1).cast("long")


def sketches(stats: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bucket, n) from rows of lang, source, the measures and the sizes.

    The sums run map-side first, so a hot source sends no more rows than it has buckets.
    """
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in (*MEASURES, *SIZES)))).alias("e")
    fine = stats.select("lang", "source", each).groupBy("lang", "source", "e.measure", "e.bucket").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    by_lang = fine.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")).withColumn("source", none)
    whole = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n")).withColumn("source", none).withColumn("lang", none)
    parts = [x.withColumn("level", F.lit(i)) for i, x in enumerate((fine, by_lang, whole))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fences(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, n, the quartiles q1_ and q3_ of each measure, and the median mid_ of each size).

    Windows span the buckets of one sketch only.
    """
    of = ["level", "lang", "source", "measure"]
    before = Window.partitionBy(*of).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy(*of)
    run = sketch.withColumn("upto", F.sum("n").over(before)).withColumn("total", F.sum("n").over(all_of))
    quarter = lambda k: bucket_top(F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket"))))
    q = run.groupBy(*of).agg(F.max("total").alias("n"), *(quarter(k).alias(f"q{k}") for k in (1, 2, 3)))
    of_ = lambda m, k: F.max(F.when(F.col("measure") == m, F.col(k)))
    wide = [of_(m, k).alias(f"{k}_{m}") for m in MEASURES for k in ("q1", "q3")] + [of_(m, "q2").alias(f"mid_{m}") for m in SIZES]
    return q.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *wide)


def fences_for(stats: DataFrame) -> DataFrame:
    """One row of fences for each (lang, source), from the finest sketch with LEAST_DOCS documents."""
    f = stage(fences(sketches(stats)), "fences")
    bounds = [c for c in f.columns if c.startswith(("q1_", "q3_", "mid_"))]
    packed = f.select("level", "lang", "source", "n", F.struct(*bounds).alias("b"))
    fine = packed.filter("level = 0").select(F.col("lang"), F.col("source"), F.col("n").alias("n0"), F.col("b").alias("b0"))
    by_lang = packed.filter("level = 1").select(F.col("lang").alias("lang1"), F.col("n").alias("n1"), F.col("b").alias("b1"))
    whole = packed.filter("level = 2").select(F.col("b").alias("b2"))
    best = F.when(F.col("n0") >= LEAST_DOCS, F.col("b0")).when(F.col("n1") >= LEAST_DOCS, F.col("b1")).otherwise(F.col("b2"))
    # whole is one row by construction
    joined = fine.join(by_lang, fine["lang"].eqNullSafe(by_lang["lang1"])).crossJoin(F.broadcast(whole))
    return joined.select(F.col("lang").alias("_tl_lang"), F.col("source").alias("_tl_source"), best.alias("_tl_bounds"))


def with_fences(docs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Join the fences; documents of a group without any (all failed the base rule) get nulls."""
    bounds = stage(bounds, "bounds")
    if bounds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        bounds = F.broadcast(bounds)
    return docs.join(bounds, docs["lang"].eqNullSafe(bounds["_tl_lang"]) & docs["source"].eqNullSafe(bounds["_tl_source"]), "left").drop("_tl_lang", "_tl_source")


def base_failed(c) -> Column:
    return (c("n_words") < LEAST_WORDS) | (c("n_repeat_words") * 100 > c("n_words") * MOST_REPEATED)


def within(measure: dict[str, Column], c) -> Column:
    """Whether all measures lie within the fences of a document with the counts c(name)."""
    out = F.lit(True)
    for m, (_, low, times, event, two_sided) in MEASURES.items():
        at = lambda k: F.col(f"_tl_bounds.{k}")
        one = F.floor(F.lit(times * event) / F.greatest(F.least(c(low), at(f"mid_{low}")), F.lit(1))).cast("long")
        spread = F.greatest(at(f"q3_{m}") - at(f"q1_{m}"), one) * SPREADS
        out = out & (measure[m] <= at(f"q3_{m}") + spread)
        if two_sided:
            out = out & (measure[m] >= at(f"q1_{m}") - spread)
    return F.coalesce(out, F.lit(True))


def rate(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lang, source, the counts, the measures, base_failed and kept; texts are read once."""
    tune(docs.sparkSession)
    counted = docs.select(F.col(key), F.col("lang"), F.col("source"), count_udf(F.col("text")).alias("c")).select(key, "lang", "source", "c.*")
    counted = stage(counted.select("*", *(v.alias(m) for m, v in measures(F.col).items())), "counts")
    failed = base_failed(F.col)
    out = with_fences(counted, fences_for(counted.filter(~failed)))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & within({m: F.col(m) for m in MEASURES}, F.col))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns and nothing else."""
    tune(docs.sparkSession)
    columns = docs.columns
    counted = stage(docs.withColumn("_tl_counts", count_udf(F.col("text"))), "counted")
    c = lambda name: F.col(f"_tl_counts.{name}")
    passed = counted.filter(~base_failed(c))
    values = measures(c)
    out = with_fences(passed, fences_for(passed.select("lang", "source", *(v.alias(m) for m, v in values.items()), *(c(x).alias(x) for x in SIZES))))
    return out.filter(within(values, c)).select(*(f"`{x}`" for x in columns))


def op1_quality_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES
    )


def _sql() -> str:
    values = ", ".join(f"{a} * {t} // greatest({b}, 1) AS {m}" for m, (a, b, t, _, _) in MEASURES.items())
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM m WHERE NOT base_failed" for m in (*MEASURES, *SIZES))
    of = lambda m, k: f"max(CASE WHEN measure = '{m}' THEN {k} END)"
    bounds = ", ".join([f"{of(m, k)} AS {k}_{m}" for m in MEASURES for k in ("q1", "q3")] + [f"{of(m, 'q2')} AS mid_{m}" for m in SIZES])
    names = [f"{k}_{m}" for m in MEASURES for k in ("q1", "q3")] + [f"mid_{m}" for m in SIZES]
    pick = ", ".join(f"CASE WHEN f.n >= {LEAST_DOCS} THEN f.{c} WHEN g.n >= {LEAST_DOCS} THEN g.{c} ELSE h.{c} END AS {c}" for c in names)
    checks = []
    for m, (_, size, times, event, two_sided) in MEASURES.items():
        spread = f"{SPREADS} * greatest(q3_{m} - q1_{m}, {times * event} // greatest(least({size}, mid_{size}), 1))"
        checks.append(f"{m} <= q3_{m} + {spread}" + (f" AND {m} >= q1_{m} - {spread}" if two_sided else ""))
    ok = " AND ".join(checks)
    return rf"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, source, text, [x FOR x IN string_split_regex(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words,
  [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM t),
g5 AS (SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g5) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(5) r(j) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
  len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
m AS (SELECT *, {values}, n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED} AS base_failed FROM c),
v AS ({long}),
b AS (SELECT *, greatest(0, length(bin(v)) - 6) AS e FROM v),
bb AS (SELECT lang, source, measure, ((v >> e) + 1) * (1 << e) - 1 AS top FROM b),
q AS (SELECT grouping(lang) + grouping(source) AS level, lang, source, measure, count(*) AS n,
  quantile_disc(top, 0.25) AS q1, quantile_disc(top, 0.5) AS q2, quantile_disc(top, 0.75) AS q3
  FROM bb GROUP BY GROUPING SETS ((lang, source, measure), (lang, measure), (measure))),
f AS (SELECT level, lang, source, max(n) AS n, {bounds} FROM q GROUP BY level, lang, source),
j AS (SELECT m.*, {pick} FROM m LEFT JOIN f ON f.level = 0 AND m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
LEFT JOIN f g ON g.level = 1 AND m.lang IS NOT DISTINCT FROM g.lang LEFT JOIN f h ON h.level = 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({ok}, true) AS kept, {', '.join(f'CAST({x} AS BIGINT) AS {x}' for x in MEASURES)} FROM j"""


OP1_SQL = _sql()
