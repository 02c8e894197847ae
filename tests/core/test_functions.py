"""Edge cases of functions that the queries don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from tideline.functions import arrays, conversions, expressions, json_trees, json_values, rollout
from tideline.operators import aggregates, sequence
from tideline.plans import migration, queries, repository, validation
from tideline.sources import files
from tideline.streaming import batches


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_arrays(spark):
    xs = F.array(*map(F.lit, [3, 1, 1, 2, 2, 5]))
    none = F.array().cast("array<int>")
    r = one(
        spark,
        arrays.sliding(xs, 4, 2), arrays.sliding(none, 2), arrays.sliding(xs, 2, 4), arrays.split(xs, 4), arrays.split(none, 3),
        arrays.fold_while(xs, F.lit(0), lambda s: s < 5, lambda s, x: s + x), arrays.to_bits(F.array(F.lit(5)), 4), arrays.packed(F.array(*map(F.lit, [True, False, True])), 8),
        arrays.zip_short(xs, F.array(F.lit("a"))), arrays.updated(xs, 1, F.lit(9)), arrays.partition(xs, lambda x: x > 1), arrays.iterate(F.lit(1), 4, lambda x: x * 2),
        arrays.corresponds(xs, xs, lambda a, b: a == b), arrays.split_where(xs, lambda x: x == 2), arrays.chunked(none, 3), arrays.binary_string(F.array(F.lit(True), F.lit(False))),
    )
    assert r[0] == [[3, 1, 1, 2], [1, 2, 2, 5]] and r[1] == [] and r[2] == [[3, 1], [2, 5]]
    assert r[3] == [[3, 1], [1, 2], [2], [5]] and r[4] == []
    assert r[5] == 5 and r[6] == [False, True, False, True] and r[7] == [160]
    assert len(r[8]) == 1 and r[9] == [3, 9, 1, 2, 2, 5] and r[10]["second"] == [1, 1] and r[11] == [1, 2, 4, 8]
    assert r[12] is True and r[13]["first"] == [3, 1, 1] and r[14] == [] and r[15] == "10"


def test_expressions(spark):
    expressions.session(spark)
    r = one(
        spark,
        expressions.divide(F.lit(-7), F.lit(2), "int"), expressions.divide(F.lit(1), F.lit(0), "int"), F.lit(2147483647) + F.lit(1), expressions.bit_op("unsigned", F.lit(-1), F.lit(28), "bigint"),
        expressions.trim(F.lit("\t a \n")), expressions.matches(F.lit("xaby"), "ab"), expressions.index_of(F.lit("abc"), F.lit("z")), expressions.replace(F.lit("ab"), "", "-"),
        expressions.substring(F.lit("abc"), F.lit(1), F.lit(9)), expressions.one_of(F.lit(1), []), expressions.equal(F.lit(float("nan")), F.lit(float("nan"))),
        expressions.cross(F.array(F.lit(1), F.lit(2)), F.array(F.lit(10), F.lit(20)), lambda a, b: a + b),
    )
    assert r[:] == (-3, None, -2147483648, 68719476735, "a", False, -1, "-a-b-", None, False, False, [11, 21, 12, 22])
    with pytest.raises(Exception, match="division by zero"):
        one(spark, expressions.divide(F.col("id"), F.col("id"), "bigint", strict=True))


def test_conversions(spark):
    r = one(
        spark,
        conversions.narrow(F.lit(300), "tinyint"), conversions.to_whole(F.lit(float("nan")), "int"), conversions.to_whole(F.lit(2147483647.9), "int"), conversions.to_whole(F.lit(9.3e18), "bigint"),
        conversions.parse_whole(F.lit(" 12 "), "int"), conversions.parse_whole(F.lit("+12"), "int"), conversions.parse_double(F.lit("1e3")), conversions.parse_double(F.lit("1f")),
        conversions.parse_boolean(F.lit("TRUE")), conversions.parse_boolean(F.lit("yes")), conversions.code_char(F.lit(233)), conversions.char_code(F.lit("A")),
    )
    assert r[:] == (None, None, 2147483647, None, None, 12, 1000.0, None, True, None, "é", 65)
    with pytest.raises(Exception, match="no tinyint"):
        one(spark, conversions.narrow(F.col("id").cast("int") + 300, "tinyint", strict=True))


def test_json(spark):
    doc = F.lit('{"a":[{"b":1},{"b":null}],"c":{},"d":"x"}')
    r = one(
        spark,
        json_values.get(doc, ["a", 0, "b"]), json_values.set_value(doc, ["a", json_values.ANY, "b"], 7), json_values.delete(doc, ["a", 0]), json_values.insert(doc, ["a", 1], 0),
        json_values.insert(doc, ["d"], 1), json_values.normalize(doc), json_values.set_value(F.lit("{bad"), ["a"], 1), json_values.json_type(F.lit("[1]")), json_values.json_type(F.lit("2.5")),
        json_values.set_value(doc, ["zz"], 1),
    )
    load = lambda x: x and json.loads(x)
    assert r[0] == "1" and load(r[1])["a"] == [{"b": 7}, {"b": 7}] and load(r[2])["a"] == [{"b": None}] and load(r[3])["a"] == [{"b": 1}, 0, {"b": None}]
    assert load(r[4])["d"] == "x" and r[5] == '{"a":[{"b":1}],"d":"x"}' and r[6] is None and r[7:9] == ("array", "number") and "zz" not in r[9]


@pytest.mark.parametrize("strategy,want", [("auto", {"a": [9, 2], "o": {"x": 1, "y": 2}, "b": 2}), ("replace", {"a": [9], "o": {"y": 2}, "b": 2}), ("left", {"a": [1, 2], "o": {"x": 1, "y": 2}, "b": 1}), ("concat", {"a": [1, 2, 9], "o": {"x": 1, "y": 2}, "b": 2}), ("shallow", {"a": [9], "o": {"y": 2}, "b": 2})])
def test_merge(strategy, want):
    assert json_values.merged({"a": [1, 2], "o": {"x": 1}, "b": 1}, {"a": [9], "o": {"y": 2}, "b": 2}, strategy) == want


@pytest.mark.parametrize("a,b", [({"a": 1}, {"a": 3, "b": [1]}), ([1, 2, 3], [1, 5]), ({"x": {"y": [1, {"z": "q"}]}}, {"x": {"y": [1, {"z": "r"}, 2]}}), (1, "x"), ({}, {}), ([], [[]]), (True, 1)])
def test_diff_then_patch(a, b):
    assert json_values.patched(a, json_values.difference(a, b)) == b
    assert json_values.difference(b, b) == []


def test_patch_modes(spark):
    add = [{"op": "add", "path": ["a"], "value": 2}]
    with pytest.raises(KeyError):
        json_values.patched({"a": 1}, add)
    assert json_values.patched({"a": 1}, add, "lenient") == {"a": 1}
    assert json_values.patched({"a": 1}, add, "clobber") == {"a": 2}
    r = one(spark, json_values.patch(F.lit('{"a":1}'), F.lit(json.dumps(add))), json_values.patch(F.lit('{"a":1}'), F.lit(json.dumps(add)), "clobber"), json_values.diff(F.lit("[1]"), F.lit("[1,2]")))
    assert r[0] is None and r[1] == '{"a":2}' and json.loads(r[2]) == [{"op": "append", "path": [], "values": [2]}]


def test_chain_is_a_column_a_step(spark):
    texts = [None, "", "{", "[]", '{"k":1}', '{"b":{"k":[1,2]},"k":"x","a":null}', '{"k":1.50,"a":12345678901234567890.5}', '{"k":NaN}', "7", '{"k":[{}]}', "[" * 3000 + "]" * 3000]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 40)], "i long, d string").repartition(3)
    p, target = F.col("d"), json_values.set_value(F.col("d"), ["k"], [1, None])
    ops = json_values.diff(p, target)
    columns = {"target": target, "ops": ops, "back": json_values.patch(p, ops), "got": json_values.sort_keys(json_values.patch(p, ops)), "other": json_values.merge(target, F.lit('{"z":1}'))}
    steps = {
        "target": (lambda v: json_values.replaced(v, ["k"], [1, None]), "d"),
        "ops": (json_values.difference, "d", "target"),
        "back": (json_values.patched, "d", "ops"),
        "got": (json_values.sorted_keys, "back"),
        "other": (json_values.merged, "target", "z"),
    }
    r = d.select("i", F.struct(*(c.alias(k) for k, c in columns.items())).alias("want"), json_values.chain({"d": p, "z": F.lit('{"z":1}')}, steps).alias("got")).collect()
    assert len(r) == len(texts) * 40 and all(x["got"] == x["want"] for x in r)
    assert {x["i"] for x in r if x["got"]["back"] is None} == {i for i in range(len(texts) * 40) if i % 11 in (0, 1, 2, 7, 10)}


def test_json_diff_patch_takes_one_worker_a_task(spark):
    plan = queries.QUERIES["json_diff_patch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_rollout(spark):
    rows = spark.range(3000).select(F.concat(F.lit("user"), "id").alias("k")).select(rollout.bucket("k").alias("b"), rollout.rollout(F.col("k"), 30).alias("in"))
    r = rows.agg(F.min("b"), F.max("b"), F.avg(F.col("in").cast("int"))).first()
    assert r[0] == 0 and r[1] == 99 and abs(r[2] - 0.3) < 0.05
    df = spark.range(10).select((F.col("id") % 2).alias("s"), "id")
    assert sorted(x["id"] for x in rollout.every(df, ["s"], ["id"], 2).collect()) == [2, 3, 6, 7]
    assert rollout.every(df, ["s"], ["id"], 0).count() == 0


def test_sequence_laws(spark):
    df = spark.range(0, 23).select("id", (F.col("id") % 3).alias("v"))
    empty = df.limit(0)
    assert sequence.take(df, ["id"], 5).count() == 5 and sequence.take(df, ["id"], 50).count() == 23
    assert sequence.drop(df, ["id"], 5).count() == 18 and sequence.with_index(empty, ["id"]).count() == 0
    assert [r["state"] for r in sequence.running(empty, ["id"], "v").collect()] == [0]
    assert sequence.take_while(df, ["id"], F.col("id") < 4).count() == 4 and sequence.take_while(df, ["id"], F.lit(True)).count() == 23
    assert sequence.drop_while(df, ["id"], F.lit(True)).count() == 0
    assert [len(r["items"]) for r in sequence.sliding(df, ["id"], 4, 4, "id").orderBy("window").collect()] == [4, 4, 4, 4, 4, 3]
    assert sequence.intersperse(df, ["id"], "v", 9).count() == 45
    assert sequence.concat(empty, df, ["id"]).count() == 23
    assert [r["items"] for r in sequence.chunked(df, ["id"], 20, "id").orderBy("chunk").collect()][1] == [20, 21, 22]


def test_histogram_counts_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (1e9,)], "v double")
    r = aggregates.histogram(df, [], "v", [0, 2]).first()
    assert (r["count"], r["min"], r["max"], r["buckets"]) == (3, 1.0, 1e9, [0, 1, 2])


def test_migration_checks_and_reverses(spark):
    df = spark.range(3)
    m = migration.Migration((migration.AddField("x", F.col("id") * 2), migration.RenameField("id", "key")))
    assert m.apply(df).columns == ["key", "x"]
    assert m.reverse().apply(m.apply(df)).columns == ["id"]
    for bad in (migration.AddField("id", F.lit(1)), migration.DropField("no"), migration.RenameField("id", "id"), migration.DropField("id").reverse()):
        with pytest.raises(migration.MigrationError):
            bad.apply(df)


def test_nested_migrations(spark):
    rows = [("a", 1, (1, "x")), ("b", 2, None), (None, 3, (3, None))]
    df = spark.createDataFrame(rows, "tag string, n int, s struct<k: int, t: string>")
    add = migration.Migration((migration.AddField("twice", F.col("k") * 2), migration.RenameField("t", "u")))
    m = migration.Migration((migration.MigrateField("s", add), migration.TransformCase("tag", "b", migration.Migration((migration.TransformField("n", lambda c: c + 10, lambda c: c - 10),)))))
    out = m.apply(df)
    assert out.columns == df.columns and out.schema["s"].dataType.names == ["k", "u", "twice"]
    assert sorted(out.collect(), key=lambda r: r["n"]) == [("a", 1, (1, "x", 2)), (None, 3, (3, None, 6)), ("b", 12, None)]
    assert sorted(m.reverse().apply(out).collect(), key=lambda r: r["n"]) == rows
    for bad in (migration.MigrateField("n", add), migration.MigrateField("no", add), migration.TransformCase("tag", "a", migration.Migration((migration.DropField("n"),)))):
        with pytest.raises(migration.MigrationError):
            bad.apply(df)


def test_merge_by():
    pick = lambda path, a, b: [list(path), a, b]
    assert json_values.merged_by({"a": [1, 2], "o": {"x": 1}}, {"a": [9], "o": {"x": 2, "y": 3}}, pick) == {"a": [[["a", 0], 1, 9], 2], "o": {"x": [["o", "x"], 1, 2], "y": 3}}
    assert json_values.merged_by({"o": {"x": 1}}, {"o": {}}, pick, lambda path, v: not path) == {"o": [["o"], {"x": 1}, {}]}
    assert json_values.merged_by({}, [], pick) == [[], {}, []]


def test_running_by_and_catch_all(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 3, 1, None, 7, 2])], "id int, v int")
    states = lambda d: [r["state"] for r in sequence.running_by(d, ["id"], "v", F.max, F.greatest, 2).orderBy(F.col("id").asc_nulls_first()).collect()]
    assert states(df) == [2, 2, 3, 3, 3, 7, 7] and states(df.limit(0)) == [2]
    other = spark.createDataFrame([(100, 0), (101, None)], "id int, v int")
    caught = lambda e: sorted((r["source"], r["id"], r["error"]) for r in sequence.catch_all(df, ["id"], e, other).collect())
    assert caught(F.when(F.col("v") < 3, F.lit("small"))) == [(0, 0, None), (0, 1, None), (1, 100, "small"), (1, 101, "small")]
    assert [r[:2] for r in caught(F.when(F.col("v") > 9, F.lit("x")))] == [(0, i) for i in range(6)]
    assert caught(F.lit("all"))[0] == (1, 100, "all")


def test_validation_formats(spark):
    df = spark.createDataFrame([("1.2.3.4", "a@b.cd"), ("1.2.3.444", "ab"), (None, None)], "ip string, mail string")
    good, bad = validation.split_valid(df, {"ip": validation.format_of(F.col("ip"), "ipv4"), "mail": validation.format_of(F.col("mail"), "email")})
    assert good.count() == 2 and bad.first()["errors"] == ["ip", "mail"]


def test_repository(spark, tmp_path):
    schema = spark.createDataFrame([], "id int, name string").schema
    repo = repository.Repository(spark, str(tmp_path / "t"), schema).create()
    assert repo.count() == 0 and repo.insert([(1, "a"), (2, "b"), (3, None)]) == 3 and repo.insert([]) == 0
    assert repo.update(spark.createDataFrame([(2, "B"), (9, "z")], schema)) == 1
    assert sorted((r["id"], r["name"]) for r in repo.all().collect()) == [(1, "a"), (2, "B"), (3, None)]
    assert repo.exists(1) and not repo.exists(9) and repo.find_all([]).count() == 0 and repo.delete_all([]) == 0
    assert repo.delete_all([1, 7]) == 1 and repo.clear() == 2 and repo.count() == 0
    with pytest.raises(repository.SqlError):
        repository.Fragment("SELECT 'x").check()
    with pytest.raises(repository.SqlError):
        repository.identifier("a b")
    assert repository.snake_case("inStock") == "in_stock"


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb'), (2, "c,d")], "id int, t string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(files.csv(spark, str(tmp_path / "c"), "id int, t string").collect()) == sorted(df.collect())
    assert [r["value"] for r in files.unfold(spark, 1, "s * 2", "s < 40").collect()] == [1, 2, 4, 8, 16, 32]
    assert files.integers(spark, 0, 10, 3).count() == 4 and files.cycle(df, 3).count() == 6
    (tmp_path / "b.bin").write_bytes(b"\x00\x00\x00\x01\xff\xff\xff\xff\x00")
    assert files.numbers(spark, str(tmp_path / "b.bin"), "int").first()["values"] == [1, -1]
    (tmp_path / "x.txt").write_text("né\n")
    assert [r["char"] for r in files.characters(spark, str(tmp_path / "x.txt")).orderBy("position").collect()][:2] == ["n", "é"]
    files.drain(df)


def test_documents(spark):
    from tideline.functions import documents as d

    html = '<html><body><p class="a b">x<b>y</b></p><br><p id="q">z &amp; w</p><!--c--><script>var t="</p>";</script></body></html>'
    n = d.parse_html(F.lit(html))
    row = spark.range(1).select(n.alias("n")).select(
        d.texts(F.col("n"), d.select(F.col("n"), d.tag("p"))).alias("ps"),
        d.texts(F.col("n"), d.select(F.col("n"), d.css_class("b"))).alias("b"),
        F.size(d.children(F.col("n"), d.select(F.col("n"), d.tag("body")))).alias("kids"),
        F.transform(d.next_siblings(F.col("n"), d.select(F.col("n"), d.css_class("a"))), lambda x: x["tag"]).alias("next"),
        F.size(d.later_siblings(F.col("n"), d.select(F.col("n"), d.tag("br")))).alias("later"),
        d.attributes(d.elements(F.col("n")), "id").alias("ids"),
        F.size(d.comments(F.col("n"))).alias("comments"),
        F.size(d.descendants(F.col("n"), d.select(F.col("n"), d.css_class("a")))).alias("inside"),
    ).first()
    assert row["ps"] == ["xy", "z & w"] and row["b"] == ["xy"] and row["kids"] == 5 and row["next"] == ["br"] and row["later"] == 2
    assert row["ids"] == ["q"] and row["comments"] == 1 and row["inside"] == 3
    r = one(spark, d.parse_xml(F.lit("<a><b k='1'>t</b></a>")), d.parse_xml(F.lit("<a>")))
    assert [x["tag"] for x in r[0]] == ["a", "b", None] and r[1] is None


def test_json_trees(spark):
    from tideline.functions import json_trees as t

    doc = F.lit('{"a":[{"b":1},{"b":null}],"c":{},"d":"x"}')
    r = one(
        spark,
        t.select(doc, ["a", json_values.ANY, "b"]), t.of_kind(t.select(doc, [json_values.ANY]), "object"), t.from_leaves(t.leaves(doc)), t.search(doc, lambda p, v: v is None or v == "x"),
        t.prune(doc, lambda p, v: p[-1] == "b"), t.retain(doc, lambda p, v: v == 1), t.project(doc, [["a", json_values.ANY, "b"], ["d"]]), t.transform_up(doc, lambda p, v: v + 1 if v == 1 else v),
        t.transform_keys(doc, lambda p, k: k.upper()), F.size(t.entries(doc)), t.all_values(t.select(doc, ["a", json_values.ANY, "b"])), t.one(t.select(doc, ["d"])), t.transform_down(doc, lambda p, v: 0 if p == ("c",) else v),
        t.check(doc, {"properties": {"a": {"items": {"properties": {"b": {"type": "integer"}}}}}}), t.conforms(doc, {"anyOf": [{"type": "string"}, {"minProperties": 3}]}), t.check(F.lit("{"), True),
    )
    load = json.loads
    assert r[0] == ["1", "null"] and r[1] == ["{}"] and load(r[2]) == load('{"a":[{"b":1},{"b":null}],"c":{},"d":"x"}') and r[3] == ["null", '"x"']
    assert load(r[4])["a"] == [{}, {}] and load(r[5]) == {"a": [{"b": 1}]} and load(r[6]) == {"a": [{"b": 1}, {"b": None}], "d": "x"} and load(r[7])["a"][0] == {"b": 2}
    assert set(load(r[8])) == {"A", "C", "D"} and r[9] == 8 and r[10] == "[1,null]" and r[11] == '"x"' and load(r[12])["c"] == 0
    assert r[13] == ".a[1].b: not integer" and r[14] is True and r[15] == ".: not JSON"


def test_rollout_choices(spark):
    assert rollout.choices("canary@prod/50%; v2 @ api/*/x ;v1") == [("canary", ["prod"], 50), ("v2", ["api", "*", "x"], None), ("v1", None, None)]
    for bad in ("", " ", "@path", "value@", "v2@path/150%", "canary@prod50%", "canary@50%", "a;;b"):
        with pytest.raises(ValueError):
            rollout.choices(bad)
    paths = spark.createDataFrame([("api/users",), ("api",), ("",), ("web/users",)], "p string")
    pick = lambda e: [r[0] for r in paths.select(rollout.choose(e, F.col("p"), F.lit("k"))).collect()]
    b = rollout.bucket_of("k")
    assert pick("v@api/users") == ["v", None, None, None]
    assert pick("v@*/users; w") == ["v", "w", "w", "v"]
    assert pick(f"v@api/{b}%") == [None] * 4 and pick(f"v@api/{b + 1}%") == [None, "v", None, None]
    assert pick("v@api/0%") == [None] * 4 and pick("v@api/100%") == [None, "v", None, None]
    assert len(rollout.warnings("a; b@x")) == 1 and len(rollout.warnings("a@x/60%; b@x/50%")) == 1


def test_json_kinds_and_numbers(spark):
    assert json_values.difference({"x": 1}, {"x": True}) == [{"op": "set", "path": ["x"], "value": True}]
    assert json_values.difference([0, 1], [False, 1.0]) == [{"op": "set", "path": [0], "value": False}]
    assert json_trees.first_error(True, {"const": 1}) and json_trees.first_error(False, {"enum": [0]}) and not json_trees.first_error(1.0, {"const": 1})
    assert json_trees.first_error(0.3, {"multipleOf": 0.1}) is None and json_trees.first_error(0.35, {"multipleOf": 0.1})
    exact = '{"a":12345678901234567890.123456789,"b":[1E+400,0.1]}'
    r = one(spark, json_values.sort_keys(F.lit(exact)), json_values.sort_keys(F.lit('{"a":NaN}')), json_values.sort_keys(F.lit("[" * 3000 + "]" * 3000)), json_values.get(F.lit('{"it\'s":{"b":1}}'), ["it's", "b"]))
    assert list(r) == [exact, None, None, "1"]
    deep = "[" * 900 + "1" + "]" * 900
    assert len(one(spark, json_trees.entries(F.lit(deep)))[0]) == 901


def test_formats(spark):
    good = {"date": ["2024-02-29", "1999-12-31"], "time": ["23:59:59Z", "00:00:00.5+18:00"], "date-time": ["2024-02-29T10:00:00Z"], "ipv4": ["0.0.0.0", "255.1.2.3"], "hostname": ["a", "a-b.c1"], "email": ["a@b.co"], "uri": ["x:y"], "json-pointer": ["", "/a~1b/0"]}
    bad = {"date": ["2024-99-99", "2023-02-29", "24-1-1"], "time": ["25:61:61Z", "10:00:00", "10:00:00+19:00"], "date-time": ["2024-02-30T10:00:00Z", "2024-02-29T24:00:00Z"], "ipv4": ["01.1.1.1", "256.1.1.1", "1.1.1"], "hostname": ["-a", "a..b", "a" * 64, ""], "email": ["a@b.c", "a@b"], "uri": ["x:", "no"], "json-pointer": ["a", "/~2"]}
    for cases, want in ((good, True), (bad, False)):
        for name, texts in cases.items():
            for t in texts:
                assert one(spark, validation.format_of(F.lit(t), name))[0] is want, (name, t)
    assert one(spark, validation.format_of(F.lit(None).cast("string"), "date"))[0] is True


def test_at_most_waits_after_the_last_row_taken(spark):
    rows = [("a", 9, 1), ("a", 11, 2), ("a", 18, 3), ("a", 19, 4), ("b", 9, 5), ("b", 9, 6), (None, 1, 7)]
    df = spark.createDataFrame(rows, "s string, t long, id int").withColumn("t", F.timestamp_seconds("t"))
    assert sorted(r["id"] for r in batches.at_most(df, ["s"], "t", 10, ["id"]).collect()) == [1, 4, 5, 7]
