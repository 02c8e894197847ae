"""Suffix-array removal against a table of all 200-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm.fixtures import TEXTS, empty, odd_docs
from tideline.llm import suffix_dedup


def prose(rng, n):
    return "".join(rng.choice("abcdefghij klmnop. é\n") for _ in range(n))


def fixture():
    rng = random.Random(3)
    passage, short = prose(rng, 420), prose(rng, 150)
    texts = []
    for _ in range(8):
        texts.append(prose(rng, rng.randrange(900)) + passage + prose(rng, rng.randrange(900)))
        texts.append(prose(rng, 300) + short + prose(rng, 300))
    texts += [texts[0], texts[1] + "x", "y" + texts[2][5:], texts[3][:700] + "##" + texts[3][700:]]
    texts += ["ab" * 400, "a" * 1000, "Und " * 200 + prose(rng, 50), prose(rng, 199), prose(rng, 200)]
    w = prose(rng, 260)
    texts += [w + "1" + w[:230] + "2" + w[30:], "\x00" * 300 + prose(rng, 20)]
    return texts


def check(spark, texts):
    docs = odd_docs(spark, texts)
    want = suffix_dedup.brute([*texts, texts[0]])
    got = suffix_dedup.dedup(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        here = (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
        assert here == want[r["doc_id"]], r["doc_id"]


def test_against_brute_force(spark):
    check(spark, fixture())


def test_odd_rows(spark):
    check(spark, TEXTS)
    assert suffix_dedup.dedup(empty(odd_docs(spark, TEXTS))).count() == 0


@pytest.mark.parametrize("hot", [1, 3])
def test_split_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    check(spark, fixture())


def test_anchors_cover_every_window(monkeypatch):
    rng = random.Random(1)
    for chunk in (1 << 22, 512):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        for text in (prose(rng, 3000), "abc" * 500, prose(rng, 200)):
            b = np.frombuffer(text.encode(), np.uint8)
            p, h, x0, x1 = suffix_dedup.anchors(b)
            grams = suffix_dedup.gram_hashes(b)
            assert np.array_equal(h, grams[p])
            for i in range(len(b) - 199):
                own = (p >= i) & (p < i + suffix_dedup.STARTS) & (x0 <= i) & (i <= x1)
                assert grams[i : i + suffix_dedup.STARTS].min() in h[own]


def test_two_stage_order():
    rng = np.random.default_rng(0)
    for letters in (1, 2, 3, 30):
        t = np.append(rng.integers(1, 1 + letters, 2000), 0).astype(np.uint8)
        raw = t.tobytes()
        sa = suffix_dedup.two_stage(t, 200)
        assert sorted(sa.tolist()) == list(range(len(t)))
        keys = [raw[i : i + 200] for i in sa.tolist()]
        assert keys == sorted(keys)
        lcp = suffix_dedup.common_prefixes(t, sa, 200)
        for j in range(1, len(sa), 37):
            a, b = raw[sa[j - 1] :][:200], raw[sa[j] :][:200]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert lcp[j] == n or n >= min(len(a), len(b))
