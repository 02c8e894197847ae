"""Queries that exercise the library on the test tables, each with the SQL that says the same.

Arrays are shown as comma-joined text, so that any engine prints them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import arrays, conversions, documents, expressions, json_trees, json_values, rollout
from tideline.operators import aggregates, sequence
from tideline.plans import migration, repository, scratch, validation
from tideline.streaming import batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ORDER = ["ts", "event_id"]


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shown(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


_IDX = "WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events)"


# -- ordered sequences ----------------------------------------------------------------------


@query(f"{_IDX} SELECT event_id, i AS index FROM e")
def seq_zip_with_index(spark, sf):
    return sequence.with_index(read(spark, sf, "events").select(*ORDER), ORDER).select("event_id", F.col("index").cast("long").alias("index"))


@query("SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 250")
def seq_take(spark, sf):
    return sequence.take(read(spark, sf, "events"), ORDER, 250).select("event_id", "value")


@query(f"{_IDX} SELECT event_id, value FROM e WHERE i >= 250")
def seq_drop(spark, sf):
    return sequence.drop(read(spark, sf, "events").select(*ORDER, "value"), ORDER, 250).select("event_id", "value")


@query(f"{_IDX} SELECT event_id FROM e WHERE i >= 100 AND i < 900")
def seq_slice(spark, sf):
    return sequence.slice_rows(read(spark, sf, "events").select(*ORDER), ORDER, 100, 900).select("event_id")


@query(f"{_IDX} SELECT event_id FROM e WHERE i < coalesce((SELECT min(i) FROM e WHERE NOT value < 150), 1000000000)")
def seq_take_while(spark, sf):
    return sequence.take_while(read(spark, sf, "events"), ORDER, F.col("value") < 150).select("event_id")


@query(f"{_IDX} SELECT event_id FROM e WHERE i >= (SELECT min(i) FROM e WHERE NOT value < 150)")
def seq_drop_while(spark, sf):
    return sequence.drop_while(read(spark, sf, "events"), ORDER, F.col("value") < 150).select("event_id")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def seq_distinct_by(spark, sf):
    return sequence.distinct_by(read(spark, sf, "events"), ORDER, ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def seq_dedupe(spark, sf):
    return sequence.dedupe(read(spark, sf, "events").select(*ORDER, "event_type"), ORDER, ["event_type"]).select("event_id", "event_type")


@query(f"{_IDX} SELECT i // 7 AS chunk, string_agg(event_id, ',' ORDER BY i) AS items FROM e GROUP BY 1")
def seq_chunked(spark, sf):
    return sequence.chunked(read(spark, sf, "events").select(*ORDER), ORDER, 7, "event_id").select(F.col("chunk").cast("long").alias("chunk"), shown(F.col("items")).alias("items"))


@query(f"""{_IDX}, n AS (SELECT count(*) AS n FROM e), w AS (SELECT unnest(range(0, n, 3)) AS s FROM n)
SELECT s // 3 AS "window", string_agg(event_id, ',' ORDER BY i) AS items FROM w, e, n
WHERE i >= s AND i < s + 5 AND (s = 0 OR least(s + 5, n) > s - 3 + 5) GROUP BY s""")
def seq_sliding(spark, sf):
    return sequence.sliding(read(spark, sf, "events").select(*ORDER), ORDER, 5, 3, "event_id").select(F.col("window").cast("long").alias("window"), shown(F.col("items")).alias("items"))


@query("""SELECT event_id, CAST(10 + sum(user_id) OVER (ORDER BY ts, event_id) AS BIGINT) AS state FROM events
UNION ALL SELECT NULL, 10""")
def seq_scan(spark, sf):
    return sequence.running(read(spark, sf, "events").select(*ORDER, "user_id"), ORDER, "user_id", 10).select("event_id", F.col("state").cast("long").alias("state"))


@query("""SELECT event_id, greatest(40, max(user_id) OVER (ORDER BY ts, event_id)) AS state FROM events
UNION ALL SELECT NULL, 40""")
def seq_running_max(spark, sf):
    e = read(spark, sf, "events").select(*ORDER, "user_id")
    return sequence.running_by(e, ORDER, "user_id", F.max, F.greatest, 40).select("event_id", F.col("state").cast("long").alias("state"))


@query("""WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events), s AS (SELECT min(i) AS i FROM e WHERE value > 200)
SELECT event_id AS id, 0 AS source, NULL AS error FROM e, s WHERE s.i IS NULL OR e.i < s.i
UNION ALL SELECT c_custkey, 1, 'too large: ' || e.event_id FROM customer, s JOIN e ON e.i = s.i""")
def seq_catch_all(spark, sf):
    e = read(spark, sf, "events").select("ts", "event_id", "value", F.col("event_id").alias("id"))
    error = F.when(F.col("value") > 200, F.concat(F.lit("too large: "), F.col("event_id")))
    other = read(spark, sf, "customer").select(F.lit(None).cast(e.schema["ts"].dataType).alias("ts"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("value"), F.col("c_custkey").alias("id"))
    return sequence.catch_all(e, ORDER, error, other).select("id", "source", "error")


@query(f"{_IDX} SELECT 2 * i AS position, event_type FROM e UNION ALL SELECT 2 * i - 1, '|' FROM e WHERE i > 0")
def seq_intersperse(spark, sf):
    out = sequence.intersperse(read(spark, sf, "events").select(*ORDER, "event_type"), ORDER, "event_type", "|")
    return out.select(F.col("position").cast("long").alias("position"), "event_type")


@query(f"""{_IDX}, c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT event_id, c_custkey FROM e JOIN c USING (i)""")
def seq_zip(spark, sf):
    return sequence.zip_rows(read(spark, sf, "events").select(*ORDER), read(spark, sf, "customer").select("c_custkey"), ORDER, ["c_custkey"]).select("event_id", "c_custkey")


@query(f"""{_IDX}, c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT event_id, c_custkey FROM e FULL JOIN c USING (i)""")
def seq_zip_all(spark, sf):
    return sequence.zip_rows(read(spark, sf, "events").select(*ORDER), read(spark, sf, "customer").select("c_custkey"), ORDER, ["c_custkey"], "full").select("event_id", "c_custkey")


@query("SELECT event_id, CAST(ntile(7) OVER (ORDER BY ts, event_id) - 1 AS INTEGER) AS part FROM events")
def seq_split(spark, sf):
    return sequence.split(read(spark, sf, "events").select(*ORDER), ORDER, 7).select("event_id", "part")


@query("SELECT c_custkey AS k, 0 AS source FROM customer UNION ALL SELECT s_suppkey, 1 FROM supplier")
def seq_concat(spark, sf):
    a = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    b = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    return sequence.concat(a, b, ["k"])


@query("""WITH e AS (SELECT *, CAST(value * 100 AS BIGINT) AS cents FROM events)
SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS balance FROM e""")
def seq_map_accumulate(spark, sf):
    e = read(spark, sf, "events").select(*ORDER, "user_id", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("d"))
    return sequence.map_accumulate(e, ["user_id"], ORDER, "d", 0, lambda s, x: (s + x, int(s + x)), "long", "balance").select("event_id", "balance")


# -- aggregations ---------------------------------------------------------------------------


@query("""SELECT event_type, count(*) AS n, bool_or(value > 300) AS any_large, bool_and(value > 0.02) AS all_large,
  arg_min(event_id, (ts, event_id)) AS head, arg_max(event_id, (ts, event_id)) AS last,
  arg_min(event_id, (ts, event_id)) FILTER (value > 100) AS found, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY event_type""")
def agg_sinks(spark, sf):
    order = F.struct(*ORDER)
    return read(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"),
        aggregates.exists(F.col("value") > 300).alias("any_large"),
        aggregates.forall(F.col("value") > 0.02).alias("all_large"),
        aggregates.head(F.col("event_id"), order).alias("head"),
        aggregates.last(F.col("event_id"), order).alias("last"),
        aggregates.find(F.col("event_id"), F.col("value") > 100, order).alias("found"),
        aggregates.sum_int(F.col("user_id")).alias("users"),
    )


@query("SELECT event_type, CAST(coalesce(sum(CAST(value * 100 AS BIGINT) - 500) FILTER (CAST(value * 100 AS BIGINT) >= 500), 0) AS BIGINT) AS sum FROM events GROUP BY event_type")
def agg_counter(spark, sf):
    e = read(spark, sf, "events").withColumn("d", F.round(F.col("value") * 100).cast("long") - 500)
    return aggregates.counter(e, ["event_type"], "d")


@query("SELECT event_type, CAST(sum(CAST(value * 100 AS BIGINT) - 500) AS BIGINT) AS sum FROM events GROUP BY event_type")
def agg_up_down_counter(spark, sf):
    e = read(spark, sf, "events").withColumn("d", F.round(F.col("value") * 100).cast("long") - 500)
    return aggregates.up_down_counter(e, ["event_type"], "d")


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def agg_gauge(spark, sf):
    return aggregates.gauge(read(spark, sf, "events"), ["user_id"], "value", F.struct(*ORDER))


_B = aggregates.BOUNDARIES
_BUCKETS = " || ',' || ".join(["count(*) FILTER (l_quantity <= 0)"] + [f"count(*) FILTER (l_quantity > {a} AND l_quantity <= {b})" for a, b in zip(_B, _B[1:])] + [f"count(*) FILTER (l_quantity > {_B[-1]})"])


@query(f"SELECT l_returnflag, count(*) AS count, sum(l_quantity) AS sum, min(l_quantity) AS min, max(l_quantity) AS max, {_BUCKETS} AS buckets FROM lineitem GROUP BY l_returnflag")
def agg_histogram(spark, sf):
    return aggregates.histogram(read(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity").withColumn("buckets", shown(F.col("buckets")))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def agg_having(spark, sf):
    return aggregates.having(read(spark, sf, "orders"), ["o_custkey"], [F.count("*").alias("n")], F.col("n") > 12)


@query("SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS items FROM lineitem GROUP BY l_orderkey")
def agg_group_map(spark, sf):
    out = aggregates.group_values(read(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_partkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return out.select("l_orderkey", shown(F.col("items")).alias("items"))


@query("""SELECT l_orderkey, CAST(list_reduce(list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), lambda a, b: (a * 31 + b) % 1000003, 7::BIGINT) AS BIGINT) AS folded FROM lineitem GROUP BY l_orderkey""")
def agg_fold_left(spark, sf):
    items = aggregates.group_values(read(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_quantity").cast("long"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return items.select("l_orderkey", aggregates.fold_left(F.col("items"), F.lit(7).cast("long"), lambda s, x: (s * 31 + x) % 1000003).alias("folded"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n, round(avg(l_discount), 6) AS avg_disc, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def agg_sql_functions(spark, sf):
    rows = read(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


# -- arrays ---------------------------------------------------------------------------------


def _lines(spark, sf) -> DataFrame:
    return aggregates.group_values(read(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_quantity").cast("int"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


_XS = "WITH x AS (SELECT l_orderkey, list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS xs FROM lineitem GROUP BY l_orderkey)"


@query(f"""{_XS} SELECT l_orderkey, array_to_string(xs[3:], ',') AS dropped, array_to_string(xs[:2], ',') AS taken,
  array_to_string(xs[:greatest(len(xs) - 2, 0)], ',') AS dropped_right, array_to_string(xs[greatest(len(xs) - 1, 1):], ',') AS taken_right,
  array_to_string(xs[2:4], ',') AS between, array_to_string(list_reverse(xs), ',') AS reversed, array_to_string(list_sort(xs), ',') AS sorted,
  array_to_string([y + 1 FOR y IN xs], ',') AS mapped, array_to_string([y FOR y IN xs IF y % 2 = 0], ',') AS even FROM x""")
def arr_slices(spark, sf):
    xs = F.col("items")
    return _lines(spark, sf).select(
        "l_orderkey",
        shown(arrays.drop(xs, 2)).alias("dropped"),
        shown(arrays.take(xs, 2)).alias("taken"),
        shown(arrays.drop_right(xs, 2)).alias("dropped_right"),
        shown(arrays.take_right(xs, 2)).alias("taken_right"),
        shown(arrays.between(xs, 1, 4)).alias("between"),
        shown(F.reverse(xs)).alias("reversed"),
        shown(F.array_sort(xs)).alias("sorted"),
        shown(F.transform(xs, lambda x: x + 1)).alias("mapped"),
        shown(F.filter(xs, lambda x: x % 2 == 0)).alias("even"),
    )


@query(f"""{_XS}, p AS (SELECT l_orderkey, xs, coalesce(list_position([y > 10 FOR y IN xs], false), len(xs) + 1) AS k,
  coalesce(list_position([y > 40 FOR y IN xs], true), 0) AS h FROM x)
SELECT l_orderkey, array_to_string(xs[:k - 1], ',') AS taken, array_to_string(xs[k:], ',') AS dropped,
  CAST(h - 1 AS INTEGER) AS large_at, CASE WHEN h > 0 THEN array_to_string(xs[h + 1:], ',') ELSE '' END AS after_large,
  CASE WHEN h > 0 THEN xs[h] END AS found FROM p""")
def arr_prefixes(spark, sf):
    xs = F.col("items")
    return _lines(spark, sf).select(
        "l_orderkey",
        shown(arrays.take_while(xs, lambda x: x > 10)).alias("taken"),
        shown(arrays.drop_while(xs, lambda x: x > 10)).alias("dropped"),
        arrays.index_where(xs, lambda x: x > 40).cast("int").alias("large_at"),
        shown(arrays.drop_until(xs, lambda x: x > 40)).alias("after_large"),
        arrays.find(xs, lambda x: x > 40).alias("found"),
    )


@query(f"""{_XS} SELECT l_orderkey, array_to_string([list_sum(xs[:i]) FOR i IN range(0, len(xs) + 1)], ',') AS states FROM (SELECT l_orderkey, [0] || xs AS xs FROM x) WHERE false
UNION ALL SELECT l_orderkey, array_to_string([CAST(coalesce(list_sum(xs[:i]), 0) AS INTEGER) FOR i IN range(0, len(xs) + 1)], ',') FROM x""")
def arr_scan(spark, sf):
    return _lines(spark, sf).select("l_orderkey", shown(arrays.scan(F.col("items"), F.lit(0), lambda s, x: s + x)).alias("states"))


@query(f"""{_XS} SELECT l_orderkey, array_to_string([array_to_string(xs[i:i + 1], '-') FOR i IN range(1, len(xs) + 1, 2)], ',') AS chunks,
  array_to_string([y FOR y, i IN xs IF i = 1 OR y <> xs[i - 1]], ',') AS deduped,
  array_to_string([CAST(y AS VARCHAR) || ':' || (i + 9) FOR y, i IN xs], ',') AS indexed FROM x""")
def arr_shapes(spark, sf):
    xs = F.col("items")
    return _lines(spark, sf).select(
        "l_orderkey",
        F.array_join(F.transform(arrays.chunked(xs, 2), lambda p: F.array_join(p.cast("array<string>"), "-")), ",").alias("chunks"),
        shown(arrays.dedupe(xs)).alias("deduped"),
        F.array_join(F.transform(arrays.zip_with_index(xs, 10), lambda p: F.concat_ws(":", p["item"], p["index"])), ",").alias("indexed"),
    )


# -- expressions ----------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_partkey // (l_suppkey % 7) END AS quotient,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_partkey % (l_suppkey % 7) END AS remainder,
  CAST(pow(l_linenumber, 3) AS INTEGER) AS cube, l_quantity * l_extendedprice AS product FROM lineitem""")
def expr_arithmetic(spark, sf):
    d = F.col("l_suppkey") % 7
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        expressions.divide(F.col("l_partkey"), d, "bigint").alias("quotient"),
        expressions.modulo(F.col("l_partkey"), d, "bigint").alias("remainder"),
        expressions.power(F.col("l_linenumber"), F.lit(3), "int").alias("cube"),
        (F.col("l_quantity") * F.col("l_extendedprice")).alias("product"),
    )


@query("""SELECT p_partkey, p_partkey & 12 AS and_, p_partkey | 12 AS or_, xor(p_partkey, 12) AS xor_, p_partkey << 3 AS left_, p_partkey >> 2 AS right_ FROM part""")
def expr_bits(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(
        "p_partkey",
        expressions.bit_op("and", k, F.lit(12), "bigint").alias("and_"),
        expressions.bit_op("or", k, F.lit(12), "bigint").alias("or_"),
        expressions.bit_op("xor", k, F.lit(12), "bigint").alias("xor_"),
        expressions.bit_op("left", k, F.lit(3), "bigint").alias("left_"),
        expressions.bit_op("right", k, F.lit(2), "bigint").alias("right_"),
    )


@query(r"""SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, upper(p_name) AS up, substr(p_name, 2, 3) AS part, CAST(instr(p_name, 'e') - 1 AS INTEGER) AS e_at,
  replace(p_name, 'e', 'EE') AS replaced, starts_with(p_name, 'red') AS red, ends_with(p_name, 't') AS t, contains(p_name, ' b') AS b,
  regexp_full_match(p_name, '[a-m].*') AS early, p_name || '/' || p_brand AS joined, trim('  ' || p_type || ' ') AS trimmed FROM part""")
def expr_text(spark, sf):
    n = F.col("p_name")
    return read(spark, sf, "part").select(
        "p_partkey",
        F.length(n).alias("n"),
        F.upper(n).alias("up"),
        expressions.substring(n, F.lit(1), F.lit(4)).alias("part"),
        expressions.index_of(n, F.lit("e")).alias("e_at"),
        expressions.replace(n, "e", "EE").alias("replaced"),
        n.startswith("red").alias("red"),
        n.endswith("t").alias("t"),
        n.contains(" b").alias("b"),
        expressions.matches(n, "[a-m].*").alias("early"),
        F.concat(n, F.lit("/"), F.col("p_brand")).alias("joined"),
        expressions.trim(F.concat(F.lit("  "), F.col("p_type"), F.lit(" "))).alias("trimmed"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'medium' ELSE 'large' END AS size_class
FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_name LIKE '%o%' AND p_type IS NOT NULL AND NOT (p_size = 7)""")
def expr_predicates(spark, sf):
    size = F.col("p_size")
    rows = read(spark, sf, "part").filter(expressions.one_of(F.col("p_brand"), ["Brand#1", "Brand#2", "Brand#3"]) & F.col("p_name").like("%o%") & F.col("p_type").isNotNull() & ~expressions.equal(size, F.lit(7)))
    return rows.select("p_partkey", expressions.case_when([(size < 10, F.lit("small")), (size.between(10, 30), F.lit("medium"))], F.lit("large")).alias("size_class"))


@query(r"""SELECT l_orderkey, l_linenumber, l_partkey, TRY_CAST(l_partkey AS TINYINT) AS tiny, CAST(trunc(l_extendedprice) AS INTEGER) AS whole,
  CASE WHEN l_extendedprice < 32768 THEN CAST(trunc(l_extendedprice) AS SMALLINT) END AS small, TRY_CAST(l_linenumber || '' AS INTEGER) AS parsed FROM lineitem""")
def conv_numbers(spark, sf):
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        conversions.narrow(F.col("l_partkey"), "tinyint").alias("tiny"),
        conversions.to_whole(F.col("l_extendedprice"), "int").alias("whole"),
        conversions.to_whole(F.col("l_extendedprice"), "smallint").alias("small"),
        conversions.parse_whole(F.col("l_linenumber").cast("string"), "int").alias("parsed"),
    )


# -- JSON, validation, migration, SQL -------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'object' AS kind, json_extract_string(props, '$.absent') AS absent FROM events")
def json_get(spark, sf):
    p = F.col("props")
    return read(spark, sf, "events").select("event_id", json_values.get(p, ["k"]).alias("k"), json_values.json_type(p).alias("kind"), json_values.get(p, ["absent"]).alias("absent"))


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"t\":[1]}' AS merged, '{}' AS deleted, '{\"k\":0}' AS replaced FROM events")
def json_rebuild(spark, sf):
    p = F.col("props")
    return read(spark, sf, "events").select(
        "event_id",
        json_values.merge(p, F.lit('{"t":[1]}')).alias("merged"),
        json_values.delete(p, ["k"]).alias("deleted"),
        json_values.set_value(p, ["k"], 0).alias("replaced"),
    )


@query("""SELECT c_custkey, array_to_string([x FOR x IN [CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment' END,
  CASE WHEN c_nationkey < 2 OR c_nationkey > 20 THEN 'nation' END, CASE WHEN NOT regexp_full_match(c_name, 'Customer#[0-9]*[02468]') THEN 'name' END] IF x IS NOT NULL], ',') AS errors FROM customer""")
def validate_rows(spark, sf):
    rules = {
        "balance": validation.non_negative(F.col("c_acctbal")),
        "segment": validation.in_set(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]),
        "nation": validation.in_range(F.col("c_nationkey"), 2, 20),
        "name": validation.pattern(F.col("c_name"), "Customer#[0-9]*[02468]"),
    }
    return validation.check(read(spark, sf, "customer"), rules).select("c_custkey", F.array_join("errors", ",").alias("errors"))


@query("""SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS c_mktsegment, CAST(trunc(c_acctbal) AS INTEGER) AS c_acctbal, c_nationkey, 'c' || c_custkey AS tag FROM customer""")
def migrate(spark, sf):
    m = migration.Migration(
        (
            migration.AddField("tag", F.concat(F.lit("c"), F.col("c_custkey"))),
            migration.RenameField("c_custkey", "id"),
            migration.DropField("c_name"),
            migration.RenameCase("c_mktsegment", "BUILDING", "HOUSING"),
            migration.ChangeFieldType("c_acctbal", "int"),
            migration.MandateField("c_nationkey", F.lit(-1)),
        )
    )
    return m.apply(read(spark, sf, "customer"))


@query("""SELECT c_custkey, lower(c_name) AS label, c_nationkey + 100 AS nation, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def migrate_nested(spark, sf):
    inner = migration.Migration((migration.RenameField("c_name", "label"), migration.TransformField("label", F.lower), migration.AddField("nation", F.col("c_nationkey") + 100), migration.DropField("c_nationkey")))
    zero = migration.Migration((migration.TransformField("c_acctbal", lambda c: F.lit(0.0)),))
    m = migration.Migration((migration.MigrateField("who", inner), migration.TransformCase("c_mktsegment", "BUILDING", zero)))
    rows = read(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.struct("c_name", "c_nationkey").alias("who"))
    return m.apply(rows).select("c_custkey", "who.label", "who.nation", "c_acctbal")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10 AND (p_brand = 'Brand#7' OR p_retailprice < 950) ORDER BY p_size DESC, p_partkey LIMIT 40")
def sql_select(spark, sf):
    s = repository.Select("part").project("p_partkey", "p_name", "p_size").where("p_size > ?", 10).where("p_brand = ? OR p_retailprice < ?", "Brand#7", 950.0).order_by("p_size", True).order_by("p_partkey").limit(40)
    return s.render().query(spark, part=read(spark, sf, "part"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(id, label)")
def sql_values(spark, sf):
    return (repository.Fragment("SELECT id, label FROM (") + repository.values([(1, "a"), (2, "b")]) + repository.Fragment(") v(id, label)")).query(spark)


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 3")
def sql_repository(spark, sf):
    import uuid

    customers = read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    repo = repository.Repository(spark, f"{scratch.home(spark)}/repository-{uuid.uuid4().hex}", customers.schema, "c_custkey").create()
    repo.insert_from(customers)
    repo.update_where(F.col("c_mktsegment") == "BUILDING", {"c_acctbal": F.lit(0.0)})
    repo.delete_where(F.col("c_nationkey") == 3)
    return repo.all().select("c_custkey", "c_acctbal")


@query("SELECT n.* FROM nation n WHERE n_nationkey IN (1, 5, 9)")
def sql_find_all(spark, sf):
    path = f"{sf}/nation.parquet"
    return repository.Repository(spark, path, spark.read.parquet(path).schema, "n_nationkey").find_all([1, 5, 9])


@query("""WITH RECURSIVE t AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL SELECT t.user_id, min(e.ts) FROM t JOIN events e ON e.user_id = t.user_id AND e.ts >= t.ts + INTERVAL 1 DAY GROUP BY t.user_id)
SELECT user_id, min(event_id) AS event_id FROM t JOIN events USING (user_id, ts) GROUP BY user_id, ts""")
def rate_at_most(spark, sf):
    return batches.at_most(read(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", 86400, ["event_id"]).select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k % 3 = 0")
def rate_every(spark, sf):
    return rollout.every(read(spark, sf, "events"), ["user_id"], ORDER, 3).select("user_id", "event_id")


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'canary' WHEN user_id % 2 = 0 THEN 'even' ELSE 'rest' END AS choice FROM events""")
def rollout_choices(spark, sf):
    path = F.concat(F.col("event_type"), F.lit("/"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    expression = "never@*/even/0%; canary@click/*; even@*/even/100%; rest"
    return read(spark, sf, "events").select("event_id", rollout.choose(expression, path, F.col("user_id").cast("string")).alias("choice"))


@query("""SELECT event_id, true AS restored, true AS unchanged, CAST(json_extract_string(props, '$.k') AS BIGINT) <> 7 AS changes FROM events""")
def json_diff_patch(spark, sf):
    steps = {
        "target": (lambda v: json_values.replaced(v, ["k"], 7), "props"),
        "ops": (json_values.difference, "props", "target"),
        "back": (json_values.patched, "props", "ops"),
        "none": (json_values.difference, "props", "props"),
        "got": (json_values.sorted_keys, "back"),
        "want": (json_values.sorted_keys, "target"),
    }
    e = read(spark, sf, "events").select("event_id", json_values.chain({"props": F.col("props")}, steps).alias("json"))
    return e.select("event_id", (F.col("json.got") == F.col("json.want")).alias("restored"), (F.col("json.none") == "[]").alias("unchanged"), (F.col("json.ops") != "[]").alias("changes"))


@query("""SELECT o_orderkey, true AS date_ok, false AS time_ok, NOT (o_orderkey % 300 > 255) AS ipv4_ok, o_orderkey % 3 <> 0 AS host_ok FROM orders""")
def validate_formats(spark, sf):
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    ip = F.concat(F.lit("10.0.0."), (key % 300).cast("string"))
    host = F.concat(F.when(key % 3 == 0, "-").otherwise("h"), key.cast("string"), F.lit(".example.org"))
    checks = [("date_ok", day, "date"), ("time_ok", F.lit("25:00:00Z"), "time"), ("ipv4_ok", ip, "ipv4"), ("host_ok", host, "hostname")]
    return read(spark, sf, "orders").select("o_orderkey", *(validation.format_of(c, f).alias(n) for n, c, f in checks))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return agg_sinks(spark, sf)


# -- documents ------------------------------------------------------------------------------


@query("SELECT page_id, CAST((length(html) - length(replace(html, '<li>', ''))) // 4 AS INTEGER) AS items, CAST((length(html) - length(replace(html, '<a href=', ''))) // 8 AS INTEGER) AS links, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) AS lang FROM pages")
def html_select(spark, sf):
    nodes = F.col("nodes")
    parsed = read(spark, sf, "pages").select("page_id", documents.parse_html("html").alias("nodes"))
    return parsed.select(
        "page_id",
        F.size(documents.select(nodes, documents.tag("li"))).alias("items"),
        F.size(documents.select(nodes, documents.both(documents.tag("a"), documents.has_attribute("href")))).alias("links"),
        F.get(documents.attributes(documents.select(nodes, documents.tag("html")), "lang"), F.lit(0)).alias("lang"),
    )


@query("SELECT event_id, '{\"k\":' || (CAST(json_extract_string(props, '$.k') AS BIGINT) + 5) || ',\"n\":[1]}' AS merged FROM events")
def json_merge_by(spark, sf):
    p = F.col("props")
    return read(spark, sf, "events").select("event_id", json_values.merge_by(p, F.lit('{"k":5,"n":[1]}'), lambda path, a, b: a + b).alias("merged"))


@query("SELECT event_id, '.k' AS path, 'number' AS kind, json_extract_string(props, '$.k') AS value FROM events")
def json_leaves(spark, sf):
    kv = F.explode(json_trees.leaves("props")).alias("e")
    return read(spark, sf, "events").select("event_id", kv).select("event_id", "e.path", "e.kind", "e.value")


@query("SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 THEN '.k: maximum' END AS error FROM events")
def json_schema_check(spark, sf):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 49}}}
    return read(spark, sf, "events").select("event_id", json_trees.check(F.col("props"), schema).alias("error"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') <> '13' GROUP BY event_type")
def json_query(spark, sf):
    e = read(spark, sf, "events").withColumn("s", json_trees.of_kind(json_trees.select(F.col("props"), ["k"]), "number"))
    e = e.withColumn("k", json_trees.one(F.col("s")).cast("long")).filter("k <> 13")
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("*").alias("n"))
