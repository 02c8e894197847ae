"""Operators across documents against brute force."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.fixtures import TEXTS, empty, odd_docs
from tideline.llm import decontam, near_dup, sharding, url_filters
from tideline.llm.common import table

SF = "/root/testdata/sf0.001"


def test_shards(spark):
    docs = table(spark, SF, "documents").unionByName(odd_docs(spark, TEXTS).selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars"))
    rows = sharding.shard(docs).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert len(rows) == docs.count()
    slots = {}
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]]))
        slots.setdefault(r["shard"], []).append((r["slot"], r["place"]))
    counts = [len(slots.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    last = -1
    for s in range(24):
        own = sorted(slots[s])
        assert [a for a, _ in own] == list(range(len(own)))
        assert own[0][1] >= last and [p for _, p in own] == sorted(p for _, p in own)
        last = own[-1][1]
    assert sharding.shard(empty(docs)).count() == 0


def test_fewer_rows_than_shards(spark):
    rows = sharding.shard(odd_docs(spark, TEXTS[:3])).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(0, 0), (1, 0), (2, 0), (3, 0)]


def test_curve_visits_neighbours(spark):
    cells = [c for _, c in sorted((r["place"], r["cell"]) for r in sharding.curve(spark).collect())]
    at = [(c >> 8, c >> 4 & 15, c & 15) for c in cells]
    assert len(set(cells)) == 4096 and all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(at, at[1:]))


def words(rng, n):
    return [rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(rng.randrange(400)) for _ in range(n)]


def near_fixture():
    rng = random.Random(6)
    docs = []
    for _ in range(12):
        w = words(rng, rng.randrange(60, 300))
        docs.append(w)
        for _ in range(rng.randrange(5)):
            v = list(w)
            for _ in range(rng.randrange(1, 4)):
                k = rng.randrange(len(v))
                v[k : k + 1] = rng.choice([[], ["new"], [v[k], "more"]])
            docs.append(v)
    docs += [docs[0], docs[5][:30] + words(rng, 100)]
    return [" ".join(w) for w in docs]


def jaccard(a, b):
    s = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    x, y = s(a), s(b)
    return len(x & y) / max(1, len(x | y))


def test_near_duplicates_against_all_pairs(spark):
    texts = near_fixture()
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(odd_docs(spark, texts)).collect()}
    assert got == {i: top(i) for i in range(len(texts))}


def templated(seed=60, n=400, pairs=40, k=600, own=78, changed=45):
    """Texts of a template with an own end; pairs share most of their ends. Returns texts and the pairs' places."""
    rng = random.Random(seed)
    template = words(rng, k - own + 4)
    docs = [template + words(rng, own) for _ in range(n)]
    for i in range(pairs):
        docs.append(docs[i][: len(template) + own - changed] + words(rng, changed))
    return [" ".join(w) for w in docs], [(i, n + i) for i in range(pairs)]


def test_near_duplicates_on_a_template(spark):
    texts, pairs = templated()
    assert all(jaccard(texts[i], texts[j]) >= 0.8 for i, j in pairs)
    # texts of the template alone aren't alike
    assert jaccard(texts[100], texts[200]) < 0.8 and jaccard(texts[0], texts[401]) < 0.8
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(odd_docs(spark, texts)).collect()}
    assert got == {i: i for i in range(len(texts))} | {j: i for i, j in pairs}


def test_blocks_of_an_open_bucket(spark, monkeypatch):
    texts, pairs = templated(n=60, pairs=8)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(odd_docs(spark, texts)).collect()}
    assert got == {i: i for i in range(len(texts))} | {j: i for i, j in pairs}


def classes_by_all_pairs(texts):
    """The least place of each text's class, by an exact index of shingles and a union of all alike pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders, links = {}, 0
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders.get(g, ()))
        for j, n in common.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                links += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
        for g in s:
            holders.setdefault(g, []).append(i)
    return [top(i) for i in range(len(texts))], links


def test_near_duplicates_in_families_of_three_edits(spark):
    """Members of a family are alike in pairs only where their edits meet; every such link counts."""
    rng = random.Random(12)
    texts = []
    for _ in range(3):
        w = words(rng, 200)
        for _ in range(60):
            v = list(w)
            for _ in range(3):
                v[rng.randrange(70)] = "new" + str(rng.randrange(1000))
            texts.append(" ".join(v))
    want, links = classes_by_all_pairs(texts)
    assert 100 < links < 2500
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(odd_docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_in_a_chain_take_few_tables(spark, monkeypatch):
    """Each text is alike to the next only; what is written must not grow with the rounds of a slow search for components."""
    rng = random.Random(23)
    w = words(rng, 300 + 20 * 79)
    texts = [" ".join(w[20 * i : 20 * i + 300]) for i in range(80)]
    assert classes_by_all_pairs(texts) == ([0] * 80, 79)
    written, stage = [], near_dup.stage
    monkeypatch.setattr(near_dup, "stage", lambda df, name: written.append(name) or stage(df, name))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(odd_docs(spark, texts)).collect()}
    assert set(got) == set(range(80)) and set(got.values()) == {0}
    assert len(written) <= 45, Counter(written)


def test_components_of_odd_graphs(spark):
    """Chains, a hub in the middle, a cycle, loops and repeated edges, against a search over neighbours."""
    rng = random.Random(24)
    name = rng.sample(range(1 << 20), 400)
    places = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(70, 131)] + [(i, 140 + (i - 139) % 9) for i in range(140, 149)] + [(150, 151), (151, 150), (150, 151), (160, 160)]
    places += [(200 + rng.randrange(150), 200 + rng.randrange(150)) for _ in range(90)]
    pairs = [(name[a], name[b]) for a, b in places]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        ask = [n] if n not in want else []
        while ask:
            x = ask.pop()
            if want.setdefault(x, n) == n:
                ask += [y for y in near[x] if y not in want]
    code = lambda n: n.to_bytes(16, "big")
    edges = spark.createDataFrame([(code(a), code(b)) for a, b in pairs], "a binary, b binary")
    rows = near_dup.components(edges).collect()
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["component"], "big") for r in rows}
    assert len(got) == len(rows)
    assert {n: c for n, c in got.items() if n != c} == {n: c for n, c in want.items() if n != c}
    assert near_dup.components(empty(edges)).count() == 0


def test_near_duplicates_of_every_twentieth_document(spark):
    """The documents whose id is divisible by 20 against all rows, by exact shingles: recall of links."""
    rows = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(table(spark, "/root/testdata/sf0.1", "documents")).collect()}
    holders, sets = {}, {}
    for r in rows:
        w = (r["text"] or "").split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for g in sets[r["doc_id"]]:
            holders.setdefault(g, []).append(r["doc_id"])
    links = found = 0
    for q in (r["doc_id"] for r in rows if r["doc_id"] % 20 == 0):
        for d, n in Counter(d for g in sets[q] for d in holders[g]).items():
            if d != q and n >= 0.8 * (len(sets[q]) + len(sets[d]) - n):
                links += 1
                found += got[d] == got[q]
    assert links > 50 and found >= 0.98 * links, (found, links)


def test_near_duplicates_odd_rows(spark):
    docs = odd_docs(spark, [*TEXTS, "a b", "a  b", "a b c"])
    rows = near_dup.classes(docs).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(rows) == docs.count()
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 0, 9: 4, 10: 4, 11: 11}
    kept = near_dup.keep_one(docs)
    assert set(kept.columns) == set(docs.columns) and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 11]
    assert near_dup.classes(empty(docs)).count() == 0


def test_keep_one_with_null_and_repeated_ids(spark):
    base = near_fixture()[0]
    texts = [(None, "a unique text of a null id here"), (None, base), (7, base + " end"), (8, "one text of a repeated id"), (8, "quite another text under that id"), (None, "pair of null ids in two rows"), (None, "pair of null ids in two rows")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(texts)], "doc_id long, text string, n long")
    got = [tuple(r) for r in near_dup.classes(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, None)] * 3 + [(7, 7), (None, 7), (8, 8), (8, 8)], key=str)
    kept = {tuple(r) for r in near_dup.keep_one(docs).select("doc_id", "text").collect()}
    assert kept == {texts[0], texts[2], texts[3], texts[4], texts[5]} and near_dup.keep_one(docs).count() == 5


def test_leaks_against_all_pairs(spark):
    rng = random.Random(8)
    items = [" ".join(words(rng, n)) for n in (3, 5, 9, 14, 20, 33, 60, 130)] + [None, "", "a b"]
    texts = []
    for i, item in enumerate(items):
        w = (item or "").split()
        for n in (0, 40, 3000):
            around = words(rng, n)
            at = rng.randrange(n + 1)
            texts.append(" ".join(around[:at] + w + around[at:]))
            if len(w) > 20:
                texts.append(" ".join(around[:at] + w[: len(w) // 2] + ["x"] + w[len(w) // 2 :] + around[at:]))
                texts.append(" ".join(around[:at] + w[: len(w) // 2] + around[at:]))
    docs = odd_docs(spark, [*texts, None, ""])
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, doc_id int")

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = set()
    for d, t in enumerate(texts):
        for i, q in enumerate(items):
            s = shingles(q)
            if s and len(s & shingles(t)) >= 0.8 * len(s):
                want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()} == want
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts) + 2)) - {d for d, _ in want}
    assert decontam.leaks(docs, empty(bench)).count() == 0 and decontam.leaks(empty(docs), bench).count() == 0


def test_items_strewn_over_long_documents(spark):
    """Items cut into 2 to 12 parts that lie far apart: found whenever exact containment says so."""
    rng = random.Random(80)
    items, texts = [], []
    for i in range(80):
        w = words(rng, rng.choice([60, 130, 400, 900]))
        items.append((i, " ".join(w)))
        parts = rng.randrange(2, 13)
        cuts = [0, *sorted(rng.sample(range(1, len(w)), parts - 1)), len(w)]
        pieces = [w[a:z] for a, z in zip(cuts, cuts[1:])]
        rng.shuffle(pieces)
        text = words(rng, 300)
        for piece in pieces:
            text += piece + words(rng, rng.randrange(20, 200))
        texts.append((i, " ".join(text)))
    sets = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    want = {i for i in range(80) if len(sets(items[i][1]) & sets(texts[i][1])) >= 0.8 * len(sets(items[i][1]))}
    assert len(want) > 30
    found = decontam.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, i) for i in want}


def test_leaks_read_each_text_once(spark):
    """Texts that hold nothing are left where they are: no join brings all texts to their candidates."""
    rng = random.Random(81)
    item = " ".join(words(rng, 40))
    texts = [" ".join(words(rng, 200)) + (" " + item if i % 20 == 0 else "") for i in range(100)]
    read = spark.sparkContext.accumulator(0)

    def counted(t):
        read.add(1)
        return t

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text", F.udf(counted, "string").asNondeterministic()("text"))
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.leaks(docs, bench).collect()} == set(range(0, 100, 20))
    assert read.value == 100


def test_clean_shuffles_no_clean_texts(spark, monkeypatch):
    """As on large tables, where no join is by broadcast unless it says so; with a tiny bitmap most texts take the exact way."""
    rng = random.Random(82)
    item = " ".join(words(rng, 40))
    texts = [" ".join(words(rng, 1500)) + (" " + item if i % 50 == 0 else "") for i in range(300)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        clean = decontam.clean(docs, bench).collect()
        sent = shuffled() - before
        monkeypatch.setattr(decontam, "HELD_BITS", 2)
        exact = decontam.clean(docs, bench).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = [(i, t) for i, t in enumerate(texts) if i % 50 or i == 300]
    for got in (clean, exact):
        assert sorted(map(tuple, got), key=lambda r: r[0]) == want
    assert sent < sum(len(t or "") for t in texts) / 5


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.ORG", "https://x.Example.org/es/1?q#f", "http://example.org/en/12", "http://badexample.org/es/1", "http://com/de/x", "http://a.com/fr/", "http://xcom/de/", "http://net/#/a"]
    labelled = [(f"http://h.net/spam/{i}", True) for i in range(20)] + [(f"http://h.net/good/{i}", False) for i in range(20)]
    pages = spark.createDataFrame([(i, u, "n") for i, u in enumerate(urls + ["http://h.net/spam/77", "http://h.net/good/77"])], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.org", "", None, "allow")
    assert got[4] == ("x.example.org", "/es/1", "example.org/es/", "block")
    assert got[5][2:] == ("example.org/en/1", "block")
    assert got[6][2:] == ("org/", "allow")
    assert got[7][2:] == ("com/de/", "block") and got[8][2:] == ("com/fr/", "allow") and got[9][2:] == (None, "allow")
    assert got[10][:2] == ("net", "/")
    known = spark.createDataFrame(labelled, "url string, blocked boolean")
    learnt = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, labelled=known).collect()}
    assert learnt[11] == "block" and learnt[12] == "allow"
    assert url_filters.judge(empty(pages)).count() == 0


def test_url_tree_decides_unruled_urls(spark):
    # /es/ is blocked on example.org wherever it is labelled, /en/ hardly ever; no rule fits these hosts
    ruled = [f"http://a.example.org/es/{i}" for i in range(40)] + [f"http://a.example.org/en/{i}" for i in range(200, 300)]
    asked = [f"http://x.net/es/{i}" for i in range(500, 520)] + [f"http://x.net/en/{i}" for i in range(500, 520)]
    pages = spark.createDataFrame(list(enumerate(ruled + asked)), "id long, url string")
    got = {r["id"]: r["verdict"] for r in url_filters.judge(pages, key="id").collect()}
    assert all(got[140 + i] == "block" for i in range(20)) and all(got[160 + i] == "allow" for i in range(20))


def test_url_tree_at_any_depth(spark):
    deep = "/".join("abcde")
    labelled = [(f"http://h.net/{deep}/spam/{i}/x", True) for i in range(40)] + [(f"http://h.net/{deep}/good/{i}/x", False) for i in range(40)]
    # a branch of few labels takes the counts of those like it
    labelled += [(f"http://h.net/{deep}/spam/{i}/y", True) for i in range(2)]
    known = spark.createDataFrame(labelled, "url string, blocked boolean")
    urls = [f"http://h.net/{deep}/spam/77/x", f"http://h.net/{deep}/good/77/x", f"http://h.net/{deep}/spam/99/y", "http://h.net/" + "s/" * 3000]
    pages = spark.createDataFrame(list(enumerate(urls)) * 2, "page_id long, url string")
    rows = url_filters.judge(pages, labelled=known).collect()
    assert len(rows) == 8
    got = {r["page_id"]: r for r in rows}
    assert [got[i]["verdict"] for i in range(3)] == ["block", "allow", "block"]
    assert got[0]["template"] == f"/{deep}/spam/{{n}}/x"
