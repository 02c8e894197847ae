"""Near duplicates by Order MinHash, verified by banded alignment.

The k-mers of a text are its five-word shingles, each labelled with its occurrence number,
so that all are distinct. A sketch function ranks them; the LENGTH smallest, put back in
text order, are one value of the sketch. Texts that agree in one of the FUNCTIONS values
share a bucket. At a similarity of 0.8 one value of three k-mers agrees with a probability
of about a half, so that 16 miss one pair in 50,000.

Equal texts are one node. Every pair of a bucket is a candidate. It is verified by aligning
the two k-mer sequences: as k-mers are distinct, the best alignment is the longest
increasing run of matched places, within the band of diagonals that a similarity of 0.8
can reach. Similarity is aligned k-mers over all k-mers of both texts.

Verification runs in three rounds. Two link a bucket's members to its first and last
member: every text against the one of its lesser mates with which it shares most values, then
all such pairs that join two different components. Texts are sent to the groups of their
hubs, hubs of many are dealt into parts of PART candidates, and tasks stream over them.
The third searches all pairs of each bucket that still has members of different
components, as buckets of texts on one template do. Its members are grouped by length, as
like texts differ by a quarter at most, and dealt into blocks. The largest component of a
group needs no pairs within, so its blocks meet those of the other members only, and these
each other; rows sent grow with the square of the members outside the largest component over
BLOCK.

Links of the first round point to lesser nodes, one for each text, so that they are a forest
and doubled pointers find its roots. Later rounds name components, not texts, in their links;
those are joined by hooking every component to its least neighbour, doubling pointers and
going on with the links that are left between roots.

Defined cases: null text is empty; empty texts are equal, hence one class; texts of fewer
than five words have one shorter k-mer, so only texts of the same words are like them;
repeated rows each get a row; an empty table gives no rows. Null ids come after all others:
the id of a class is null only if all its rows' ids are. Ids may be repeated: classes go by
text, so that two texts of one id are told apart and may give two classes of that id.
`keep_one` carries all columns along and keeps one row of each class; `_tl_` names are
reserved.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import fewer, mix, occurrence_labels, shingles, stage, table, tune

FUNCTIONS, LENGTH = 16, 3
#: Similarity in hundredths.
LEAST = 80
#: Candidates of one hub that a task verifies together.
PART = 64
#: Members of an open bucket, and their k-mers, that make a block.
BLOCK, BLOCK_KMERS = 1024, 1 << 20
#: Columns of k-mers that are counted at once.
COLUMNS = 1 << 12
#: K-mers that are ranked at once, times FUNCTIONS.
CHUNK = 1 << 14
_SEEDS = np.random.default_rng(6).integers(0, 1 << 63, FUNCTIONS, np.uint64) * np.uint64(2) + np.uint64(1)


def kmers(text: str | None) -> np.ndarray:
    return occurrence_labels(shingles(text))


def sketch(h: np.ndarray) -> list[int]:
    """The Order MinHash values of a k-mer sequence; none for an empty one."""
    if not len(h):
        return []
    keep = min(LENGTH, len(h))
    best: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(h), CHUNK):
        x = h[at : at + CHUNK]
        v = (x[None, :] ^ _SEEDS[:, None]) * _SEEDS[::-1, None]
        v ^= v >> np.uint64(32)
        k = min(keep, len(x))
        i = np.argpartition(v, k - 1, axis=1)[:, :k]
        best.append((np.take_along_axis(v, i, axis=1), i + at))
    v = np.concatenate([b[0] for b in best], axis=1)
    i = np.concatenate([b[1] for b in best], axis=1)
    first = np.argsort(v, axis=1)[:, :keep]
    places = np.sort(np.take_along_axis(i, first, axis=1), axis=1)
    out = np.arange(FUNCTIONS, dtype=np.uint64)
    for j in range(keep):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[places[:, j]])
    return out.view(np.int64).tolist()


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """K-mers matched by the best alignment within the band."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) * 18 * 100 < (len(a) + len(b)) * 10 * LEAST:  # fewer common k-mers than the bound needs
        return 0
    band = (len(a) + len(b)) // 9 + 1
    near = np.abs(i - j) <= band
    order = np.argsort(i[near])
    j = j[near][order]
    if np.all(j[1:] > j[:-1]):
        return len(j)
    ends: list[int] = []
    for x in j.tolist():
        at = bisect_left(ends, x)
        if at == len(ends):
            ends.append(x)
        else:
            ends[at] = x
    return len(ends)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    n = aligned(a, b)
    return n * 100 >= LEAST * (len(a) + len(b) - n)


@F.arrow_udf(T.ArrayType(T.LongType()))
def sketch_udf(texts: pa.Array) -> pa.Array:
    return pa.array([sketch(kmers(t.as_py())) for t in texts], pa.list_(pa.int64()))


@F.arrow_udf(T.BinaryType())
def kmers_udf(texts: pa.Array) -> pa.Array:
    return pa.array([kmers(t.as_py()).tobytes() for t in texts], pa.binary())


def node(text: Column) -> Column:
    """The node of a text: 128 bits of hash, so that equal texts are one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (hub, part, role, x, y, text): a hub first, then its candidates, each with the link that it stands for."""
    here, hub = None, None
    for b in batches:
        a_out, b_out = [], []
        for h, part, role, x, y, text in zip(*(c.to_pylist() for c in b.columns)):
            if (h, part) != here:
                here, hub = (h, part), None
            if role == 0:
                if hub is None:
                    hub = kmers(text)
            elif hub is not None and alike(kmers(text), hub):
                a_out.append(x)
                b_out.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.binary()), pa.array(b_out, pa.binary())], ["a", "b"])


def verified(edges: DataFrame, docs: DataFrame, n_texts: int | None = None) -> DataFrame:
    """The links (x, y), as (a, b), of those edges (a, b, x, y) whose texts are alike; a and b have node and home, b is the hub."""
    degree = stage(fewer(edges.groupBy("b").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), n_texts), "degree")
    to_hub = edges.join(degree, "b").select("a.*", F.col("b.node").alias("hub"), F.pmod(F.xxhash64("a.node"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), "x", "y")
    none = F.lit(None).cast("binary")
    hubs = degree.select("b.*", F.col("b.node").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), none.alias("x"), none.alias("y"))
    texts = docs.select(F.col("doc_id").alias("home"), node(F.col("text")).alias("node"), "text")
    # texts are only streamed against the routes, not sorted
    routes = to_hub.unionByName(hubs).withColumnsRenamed({"node": "_tl_node", "home": "_tl_home"})
    same = (F.col("node") == F.col("_tl_node")) & F.col("home").eqNullSafe(F.col("_tl_home"))
    sent = texts.join(routes.hint("shuffle_hash"), same).select("hub", "part", "role", "x", "y", "text")
    dealt = sent.repartition("hub", "part").sortWithinPartitions("hub", "part", "role")
    return stage(fewer(dealt.mapInArrow(_verify, "a binary, b binary").distinct(), n_texts), "verified")


def common_counts(ks: list[np.ndarray]) -> np.ndarray:
    """Common k-mers of every two sequences."""
    n = len(ks)
    _, column, seen = np.unique(np.concatenate(ks), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(k) for k in ks])
    # k-mers of one sequence alone are in no pair
    twice = seen > 1
    there = twice[column]
    column, row = (np.cumsum(twice) - 1)[column[there]], row[there]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((n, n), np.int64)
    for at in range(0, int(twice.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((n, COLUMNS), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def linked(v: int, within: bool, blocks: list[int], upper: list[bool], parts: list[bytes], ks: list[np.ndarray], sketches: list[list[int]]) -> Iterator[tuple[int, int]]:
    """Pairs of a group that join its components: of one block if within, else of its two."""
    names = {c: i for i, c in enumerate(dict.fromkeys(parts))}
    part, up, block = np.array([names[c] for c in parts]), np.array(upper, bool), np.array(blocks)
    s, size = np.array(sketches, np.int64), np.array([len(k) for k in ks])
    i, j = np.triu_indices(len(ks), 1)
    ask = (part[i] != part[j]) & ~(up[i] & up[j])
    if not within:
        ask &= block[i] != block[j]
    i, j = i[ask], j[ask]
    # a pair of several buckets is asked for in the first of its values only
    same = s[i] == s[j]
    ask = s[i, np.argmax(same, axis=1)] == v
    i, j = i[ask], j[ask]
    if len(i) > 8:
        ask = common_counts(ks)[i, j] * 18 * 100 >= (size[i] + size[j]) * 10 * LEAST
        i, j = i[ask], j[ask]
    root = list(range(len(names)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        x, y = top(part[a]), top(part[b])
        if x != y and alike(ks[a], ks[b]):
            root[x] = y
            yield a, b


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (v, size class, two blocks, own block, upper, component, k-mers, sketch); links are between components."""
    here, rows = None, []

    def found(out: list[tuple[bytes, bytes]]) -> None:
        if len(rows) > 1:
            block, upper, part, ks, sketches = zip(*rows)
            pairs = linked(here[0], here[2] == here[3], block, upper, part, [np.frombuffer(k, np.uint64) for k in ks], sketches)
            out += [(part[a], part[b]) for a, b in pairs]

    def batch(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    for b in batches:
        out: list[tuple[bytes, bytes]] = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:4] != here:
                found(out)
                here, rows = row[:4], []
            rows.append(row[4:])
        yield batch(out)
    out = []
    found(out)
    yield batch(out)


def searched(members: DataFrame, nodes: DataFrame, docs: DataFrame, n_texts: int | None = None) -> DataFrame:
    """Links (a, b) of different components c with alike texts among members (v, node, c) of the same v."""
    mixed = members.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("v")
    rows = stage(fewer(members.join(mixed, "v"), n_texts), "open")
    wanted = rows.select("node").distinct().join(nodes, "node").withColumnsRenamed({"node": "_tl_node", "home": "_tl_home"})
    same = (F.col("node") == F.col("_tl_node")) & F.col("home").eqNullSafe(F.col("_tl_home"))
    texts = docs.select(F.col("doc_id").alias("home"), node(F.col("text")).alias("node"), "text")
    sent = texts.join(wanted.hint("shuffle_hash"), same).select("node", "sketch", kmers_udf("text").alias("k")).dropDuplicates(["node"])
    known = stage(sent.withColumn("size", F.expr("octet_length(k) div 8")), "kmers")
    # like texts are in the same size class or in two neighbours
    cls = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1.26))).cast("int")
    rows = rows.join(known.select("node", "size"), "node").withColumn("up", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("cls", cls - F.col("up").cast("int"))
    # the largest component of a group needs no pairs within: the others' blocks meet all blocks, its own only theirs
    parts = rows.groupBy("v", "cls", "c").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("up").alias("up"))
    parts = stage(fewer(parts, n_texts), "groups")
    whole = parts.groupBy("v", "cls").agg(F.max(F.struct("n", "size", "c")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("up").alias("none"), F.count("*").alias("k"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_KMERS)).cast("int")
    groups = whole.filter("not none and k > 1").select(
        "v", "cls", F.col("main.c").alias("_main"), blocks(F.col("main.n"), F.col("main.size")).alias("main_blocks"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("blocks")
    )
    dealt = rows.drop("size").join(groups, ["v", "cls"])
    main = F.col("c") == F.col("_main")
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    dealt = dealt.withColumn("block", F.when(main, F.col("blocks") + at("main_blocks")).otherwise(at("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(main, F.col("blocks") - 1).otherwise(F.col("blocks") + F.col("main_blocks") - 1))))
    dealt = dealt.select("v", "cls", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "up", "c", "node")
    key = ["v", "cls", "x", "y"]
    dealt = dealt.join(known, "node").select(*key, "block", "up", "c", "k", "sketch").repartition(*key).sortWithinPartitions(*key)
    return stage(fewer(dealt.mapInArrow(_search, "a binary, b binary").distinct(), n_texts), "searched")


def roots(up: DataFrame, n_texts: int | None = None) -> DataFrame:
    """(node, component): the root above each node of a forest (node, component), where all point to a lesser node."""
    while True:
        further = up.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = F.col("next").isNotNull()
        up = stage(fewer(up.join(further, "component", "left").select("node", F.coalesce("next", "component").alias("component"), moved.alias("moved")), n_texts), "roots")
        if up.filter("moved").isEmpty():
            return up.drop("moved")
        up = up.drop("moved")


def replaced(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """df with the component of each node of the column, where known (node, component) has one."""
    side = known.select(F.col("node").alias(column), F.col("component").alias("_root"))
    return df.join(side, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


def components(edges: DataFrame, n_texts: int | None = None) -> DataFrame:
    """(node, component): the least node of each connected component, for all its other nodes."""
    edges = edges.select("a", "b").filter(F.col("a") != F.col("b"))
    known = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).filter(F.col("component") < F.col("node"))
        found = roots(stage(fewer(least, n_texts), "least"), n_texts)
        known = stage(fewer(replaced(known, "component", found).unionByName(found), n_texts), "known")
        edges = replaced(replaced(edges, "a", found), "b", found).filter(F.col("a") != F.col("b"))
        edges = stage(fewer(edges.distinct(), n_texts), "edges")
    return known


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) for every row of docs, and (node, home, component) for every node; home is a document that has it."""
    tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    slim = stage(docs.select("doc_id", node(F.col("text")).alias("node"), sketch_udf(F.col("text")).alias("sketch")), "sketches")
    # all tables but those with texts or k-mers have some rows a text
    n_texts = slim.count()
    # equal texts have equal sketches
    nodes = stage(fewer(slim.groupBy("node").agg(F.min("doc_id").alias("home"), F.any_value("sketch").alias("sketch")), n_texts), "nodes")
    values = nodes.select(F.struct("node", "home").alias("a"), F.explode(F.array_distinct("sketch")).alias("v"))
    ends = stage(fewer(values.groupBy("v").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.count("*").alias("n")).filter(F.col("lo.node") < F.col("hi.node")), n_texts), "buckets")
    # the first member meets the last as its mate only
    hubs = F.when(F.col("a.node") > F.col("lo.node"), F.when(F.col("a.node") < F.col("hi.node"), F.array("lo", "hi")).otherwise(F.array("lo")))
    met = values.join(ends.drop("n"), "v").select("a", F.explode(hubs).alias("b"))
    # a text has two mates for each value at most
    shared = met.repartition("a").groupBy("a", "b").agg(F.count("*").alias("w"))
    lesser = F.col("b.node") < F.col("a.node")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(lesser.desc(), F.desc("w"), "b"))
    pairs = stage(fewer(shared.select("a", "b", ((rank == 1) & lesser).alias("best"), F.col("a.node").alias("x"), F.col("b.node").alias("y")), n_texts), "pairs")
    first = verified(pairs.filter("best"), docs, n_texts)
    known = roots(first.withColumnsRenamed({"a": "node", "b": "component"}), n_texts)
    # all other candidates between different components
    rest = replaced(replaced(pairs.filter("not best"), "x", known), "y", known)
    rest = stage(fewer(rest.filter(F.col("x") != F.col("y")), n_texts), "rest")
    second = components(verified(rest, docs, n_texts), n_texts)
    known = stage(fewer(replaced(known, "component", second).unionByName(second), n_texts), "second")
    # up to three members have all met by now
    many = values.join(ends.filter("n > 3").select("v"), "v").select("v", "a.node", F.col("a.node").alias("c"))
    many = stage(fewer(replaced(many, "c", known), n_texts), "members")
    third = components(searched(many, nodes, docs, n_texts), n_texts)
    label = nodes.select("node", "home", F.col("node").alias("component"))
    return slim.select("doc_id", "node"), stage(fewer(replaced(replaced(label, "component", known), "component", third), n_texts), "labels")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every row of docs: the least doc_id of its class."""
    rows, label = labelled(docs)
    n_texts = label.count()
    least = stage(fewer(label.groupBy("component").agg(F.min("home").alias("class_id")), n_texts), "classes")
    label = stage(fewer(label.join(least, "component").select("node", "class_id"), n_texts), "class_labels")
    return rows.join(label, "node").select("doc_id", "class_id")


def row_hash(docs: DataFrame) -> Column:
    """A hash of a row's columns; maps and variants go through their JSON."""
    plain = lambda f: not any(t in f.dataType.simpleString() for t in ("map<", "variant"))
    return F.xxhash64(*(F.col(f"`{f.name}`") if plain(f) else F.to_json(F.struct(f"`{f.name}`")) for f in docs.schema))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, of its least doc_id (null after all others), with all columns of docs.

    Of several texts of that doc_id the least by hash stays, and of several rows of that
    text the first by hash of the row.
    """
    label = labelled(docs)[1]
    n_texts = label.count()
    # nulls are the greatest in the first field
    order = F.struct(F.col("home").isNull().alias("none"), "home", "node")
    first = label.groupBy("component").agg(F.min(order).alias("x")).select("x.home", F.col("x.node").alias("_tl_node"))
    first = stage(fewer(first, n_texts), "first_nodes")
    rows = docs.withColumn("_tl_node", node(F.col("text"))).withColumn("_tl_row", row_hash(docs))
    own = rows.select("doc_id", "_tl_node", "_tl_row").join(first.withColumnRenamed("_tl_node", "_tl_first"), (F.col("_tl_node") == F.col("_tl_first")) & F.col("doc_id").eqNullSafe(F.col("home")))
    chosen = stage(fewer(own.groupBy("_tl_node").agg(F.min("_tl_row").alias("_tl_row")), n_texts), "chosen")
    kept = rows.join(chosen, ["_tl_node", "_tl_row"], "left_semi")
    return kept.dropDuplicates(["_tl_node", "_tl_row"]).select(*(f"`{c}`" for c in docs.columns))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
