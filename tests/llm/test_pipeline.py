"""The corpus pipeline, stage by stage, on the smallest tables."""

import random
import tracemalloc

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.fixtures import TEXTS, odd_docs
from tideline.llm import bpe, decontam, near_dup, quality, secrets
from tideline.llm.common import FILE_ROWS, fewer, stage, table

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in quality.rate(docs).filter("kept").collect()}
    left = docs.filter(docs["doc_id"].isin(sorted(kept)))
    heads = {r["class_id"] for r in near_dup.classes(left).collect()}
    leaked = {r["doc_id"] for r in decontam.leaks(docs, table(spark, SF, "benchmark")).collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == heads - leaked
    assert all(r["round_trip"] for r in rows)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows:
        text = texts[r["doc_id"]]
        if not any(k < 3 for _, k, *_ in secrets.find(text, secrets.Pairs(secrets.prior_counts().tolist()))):
            assert r["ids"] == lib.encode(text, add_special_tokens=False).ids
        else:
            assert "[SECRET]" in lib.decode(r["ids"])


def test_stages_keep_columns(spark):
    docs = odd_docs(spark, TEXTS)
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def nodes_of(df, kind):
    """How many nodes of a kind the final plan of df has."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count(kind)


def test_one_python_worker_a_task(spark, monkeypatch):
    # each Python node of a task is a worker of its own, and idle ones keep their tables
    docs = odd_docs(spark, TEXTS)
    assert nodes_of(corpus_pipeline.tokens(spark, docs, SF), "ArrowEvalPython") == 1
    plans = {}

    def watched(df, name):
        plans[name] = nodes_of(df, "ArrowEvalPython")
        return stage(df, name)

    monkeypatch.setattr(decontam, "stage", watched)
    decontam.clean(docs, table(spark, SF, "benchmark"))
    assert plans["values"] == 1


def test_round_trip_equals_both_steps(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = odd_docs(spark, TEXTS)
    order = lambda df: sorted(map(repr, df.select("doc_id", "text", "ids", "decoded").collect()))
    assert order(bpe.round_trip(docs, path)) == order(bpe.decode(bpe.encode(docs, path), path))


def test_tokenizer_tables_stay_bounded():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        raw = f.read()
    tracemalloc.start()
    try:
        a = bpe.Automaton(raw)
        letters = random.Random(5)
        for _ in range(300):
            a.encode_plain(" ".join("".join(letters.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(400)))
            assert tracemalloc.get_traced_memory()[0] < 110e6  # before: 130 MB, and growing
    finally:
        tracemalloc.stop()


def test_small_tables_have_few_files(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, f"some words of text number {i % 40} and more of them") for i in range(200)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        label = near_dup.labelled(docs)[1]
        assert len(label.inputFiles()) <= 8  # two for each of four cores; before: 29
        assert label.count() == 40
        # in step with the rows: no file for more than FILE_ROWS of them
        many = stage(fewer(spark.range(400).repartition(64, "id"), 20 * FILE_ROWS), "many")
        assert len(many.inputFiles()) == 20 and many.count() == 400
        got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
        assert all(got[i] == got[i % 40] for i in range(200))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
