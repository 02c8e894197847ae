"""Byte-level BPE by a tokenization automaton.

The automaton of tokens is built by gadgets. It starts with one state that loops on every
byte. Each merge a b -> c, in order, adds a gadget: where b could follow a, that arc goes
and an arc labelled c takes its place, leading to where b led; every state that had an arc a
gets the arc c. As all arcs of a label end in the same state, the state is the last token.
Written out, its arcs would be 2.5 billion; they are kept as the rows that gadgets share:
three numbers for each, and whether an arc survived is read off them.

Words are bytes, so the automaton is made deterministic over bytes by the subset
construction: a state is the set of (place in a label, token before it) that the bytes so
far allow. Every prefix of a word has one correct tokenization, so each state names one last
token. States and their transitions are compiled when a text first needs them and kept in
the table. To encode, a pre-split word runs through the table from left to right, one
transition a byte, without search or backtracking; the tokens are those of the states at
the word's end, at that token's start, and so on. To decode, the labels of the arcs are
emitted.

Defined cases: null text is empty; an empty text has no tokens; strings of added special
tokens become those tokens, as in the tokenizers library; ids outside the vocabulary are
an error in decoding; bytes that aren't UTF-8 decode to U+FFFD; repeated rows are each
encoded; further columns are carried along.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import table, tune

#: Fixed value: the public pattern that splits text before merging; white space as Unicode defines it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries of each of two word caches and of the transition table before they are emptied, and slots for arcs (a prime).
CACHED_WORDS, CACHED_STEPS, ARC_SLOTS = 60_000, 340_000, 262_139


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Automaton:
    """Compiled from the JSON text of a byte-level BPE tokenizer."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"]:
            raise ValueError("only byte-level BPE without prefix space or normalizer is supported")
        letter_byte = {c: b for b, c in enumerate(byte_letters())}
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with flags are not supported")
        # one number more than there are tokens
        size = 2 + max(chain(vocab.values(), added.values()))
        #: The label of each arc.
        self.labels = [b""] * size
        for t, i in vocab.items():
            self.labels[i] = bytes(map(letter_byte.__getitem__, t))
        for t, i in added.items():
            self.labels[i] = t.encode()
        self.added = added
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.split = regex.compile(SPLIT)
        # the gadgets
        self.size = size
        self.time = [-1] * size
        self.first, self.second = [0] * size, [0] * size
        self.gone: dict[int, int] = {}
        for when, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, c = vocab[a], vocab[b], vocab[a + b]
            self.add_gadget(x, y, c, when)
        # a trie of the labels, as a table from (node, byte) to node
        self.next: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for t, i in vocab.items():
            # a label that no merge makes, other than a byte, is on no arc
            if self.time[i] < 0 and len(self.labels[i]) > 1:
                continue
            node = 0
            for byte in self.labels[i]:
                key = node << 8 | byte
                node = self.next.get(key, 0)
                if not node:
                    node = self.next[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = i
        #: Whether a node has further ones.
        self.inner = bytearray(len(self.token_at))
        for key in self.next:
            self.inner[key >> 8] = 1
        self.length = list(map(len, self.labels))
        self.reset()
        #: At (pair of tokens) % ARC_SLOTS, the last such pair and whether it is an arc: pair * 2 + answer.
        self.arcs = array("q", [-1]) * ARC_SLOTS
        #: Words in use, and those of the time before, so that common ones stay.
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def add_gadget(self, a: int, b: int, c: int, when: int) -> None:
        """From `when` on no arc b leaves state a; state c leaves as b did; c is an arc wherever a is."""
        self.gone.setdefault(a * self.size + b, when)
        if self.time[c] < 0:
            self.first[c], self.second[c], self.time[c] = a, b, when

    def arc(self, state: int, token: int) -> bool:
        """Whether token leads out of state, by the gadgets from the last to the first."""
        before = len(self.gone) + 1
        while True:
            when = self.gone.get(state * self.size + token)
            if when is not None and when < before:
                return False
            s, t = self.time[state], self.time[token]
            if s < 0 and t < 0:
                return True
            if t > s:  # the arc came where its first half was, after that gadget's removal
                token, before = self.first[token], t + 1
            elif s > t:  # the state was copied from its second half, before the removal
                state, before = self.second[state], s
            else:  # a token after itself
                state, token, before = self.second[state], self.first[token], s

    def reset(self) -> None:
        """The byte automaton with its first state only: at the start of a label, after no token."""
        #: Of each state, (place in a label) * size + (token before it, or the last number for none), as packed 64-bit numbers.
        self.subsets: list[bytes] = [array("q", [self.size - 1]).tobytes()]
        self.numbers = {self.subsets[0]: 0}
        #: The last token of each state, and the table of transitions from (state, byte).
        self.last = [-1]
        self.table: dict[int, int] = {}

    def step(self, state: int, byte: int) -> int:
        """Compiles one transition."""
        size, none = self.size, self.size - 1
        token, further = -1, []
        for pair in memoryview(self.subsets[state]).cast("q"):
            node, before = divmod(pair, size)
            node = self.next.get(node << 8 | byte)
            if node is None:
                continue
            if self.inner[node]:
                further.append(node * size + before)
            t = self.token_at[node]
            if t >= 0:
                ok = True
                if before != none:
                    key = before * size + t
                    known = self.arcs[key % ARC_SLOTS]
                    if known >> 1 == key:
                        ok = known & 1
                    else:
                        ok = self.arc(before, t)
                        self.arcs[key % ARC_SLOTS] = key * 2 + ok
                if ok:
                    token = t
        subset = array("q", (token, *further)).tobytes()
        to = self.numbers.setdefault(subset, len(self.subsets))
        if to == len(self.subsets):
            self.subsets.append(subset)
            self.last.append(token)
        self.table[state << 8 | byte] = to
        return to

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The tokens of a word, by one transition a byte."""
        table, last, state, tokens = self.table, self.last, 0, []
        for byte in word:
            to = table.get(state << 8 | byte)
            state = self.step(state, byte) if to is None else to
            tokens.append(last[state])
        out, at = [], len(tokens)
        while at:
            out.append(tokens[at - 1])
            at -= self.length[tokens[at - 1]]
        return tuple(reversed(out))

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text in which no added token is looked for."""
        words = self.split.findall(text)
        if len(self.words) > CACHED_WORDS:
            self.older, self.words = self.words, {}
        if len(self.table) > CACHED_STEPS:
            self.reset()
        known, older = self.words, self.older
        for w in set(words).difference(known):
            known[w] = older.get(w) or self.encode_word(w.encode())
        return list(chain.from_iterable(map(known.__getitem__, words)))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.added_split is None or not self.added_split.search(text):
            return self.encode_plain(text)
        out: list[int] = []
        for k, part in enumerate(self.added_split.split(text)):
            if k % 2:
                out.append(self.added[part])
            elif part:
                out += self.encode_plain(part)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def compiled(raw: str) -> Automaton:
    """One automaton a worker and vocabulary."""
    return Automaton(raw)


def vocabulary(spark: SparkSession, path: str):
    """The tokenizer file, as a broadcast: a file of fixed size (1.5 MB for 50,000 merges), read once by the driver."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the token ids of a text column."""
    tune(docs.sparkSession)
    raw = vocabulary(docs.sparkSession, path)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = compiled(raw.value)
        for texts in batches:
            yield pa.array([a.encode(t.as_py()) for t in texts], pa.list_(pa.int32()))

    return docs.withColumn(into, run(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of a column of token ids."""
    tune(docs.sparkSession)
    raw = vocabulary(docs.sparkSession, path)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = compiled(raw.value)
        for rows in batches:
            yield pa.array([a.decode(r.values.to_numpy(zero_copy_only=False).tolist() if r.is_valid and len(r) else ()) for r in rows], pa.string())

    return docs.withColumn(into, run(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the token ids of a text column and the text that they decode to.

    The columns are those of encode and decode, but one Python worker of a task makes both,
    so that there are not twice as many workers with tables of their own.
    """
    tune(docs.sparkSession)
    raw = vocabulary(docs.sparkSession, path)
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = compiled(raw.value)
        for texts in batches:
            rows = [a.encode(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(map(a.decode, rows), pa.string())], ["ids", "decoded"])

    both = docs.withColumn("_tl_both", run(F.col(text)))
    return both.withColumn(ids, F.col("_tl_both.ids")).withColumn(decoded, F.col("_tl_both.decoded")).drop("_tl_both")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = round_trip(docs.select("doc_id", "text"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
