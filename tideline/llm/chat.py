"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, then
the reply, which alone is trainable. Turns after the last reply form one more example with
nothing trainable, so that no turn is lost. A turn is written as `### role: text</turn>`
and a line break; the backslash, the hash and the end mark inside roles and texts are
escaped with a backslash, so reading back is exact.

Rows are dealt by conversation and sorted; tasks then stream over them and hold one
conversation's formatted prefix at a time, not its rows.

Defined cases: null role or text is empty; null conversation ids are one conversation;
equal turn numbers are ordered by role, then text; repeated rows are turns of their own;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import table, tune

HEAD, COLON, END = "### ", ": ", "</turn>\n"
TARGET = "assistant"
_ESCAPE = re.compile(r"[\\#]|<(?=/turn>)|:(?= )")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
#: One turn as written: role and text without unescaped marks.
_TURN = re.compile(r"### ((?:[^\\:]|\\.|:(?! ))*): ((?:[^\\<]|\\.|<(?!/turn>\n))*)</turn>\n", re.DOTALL)

EXAMPLE = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
#: Characters of output gathered before a batch is sent on.
BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to examples, a conversation after the other."""
    rows: list[tuple] = []
    chars = 0
    conv, started, prefix, number, open_ = None, False, "", 0, False

    def batch():
        nonlocal rows, chars
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), EXAMPLE)], schema=EXAMPLE)
        rows, chars = [], 0
        return out

    for b in batches:
        for c, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
            if not started or c != conv:
                if open_:
                    rows.append((conv, number, prefix, 0, 0))
                conv, started, prefix, number, open_ = c, True, "", 0, False
            said = escape(text or "")
            prefix += HEAD + escape(role or "") + COLON
            at = len(prefix)
            prefix += said + END
            open_ = role != TARGET
            if not open_:
                rows.append((conv, number, prefix, at, at + len(said)))
                number += 1
                chars += len(prefix)
                if chars > BATCH_CHARS:
                    yield batch()
    if open_:
        rows.append((conv, number, prefix, 0, 0))
    if rows:
        yield batch()


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_end (code points, end exclusive), in order within a conversation."""
    tune(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return turns.select("conv_id", "role", "text").mapInArrow(_expand, "conv_id long, example long, formatted string, loss_start long, loss_end long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples of a conversation follow one another; its last one holds all turns."""
    held: dict | None = None

    def close(h: dict) -> tuple:
        turns = parse(h["last"])
        said = hashlib.sha256()
        for role, text in turns:
            said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        return h["conv"], len(turns), said.hexdigest(), h["n"], h["loss"].hexdigest(), h["chars"]

    for b in batches:
        rows = []
        for conv, text, a, z in zip(*(b.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end"))):
            if held is None or held["conv"] != conv:
                if held:
                    rows.append(close(held))
                held = {"conv": conv, "n": 0, "loss": hashlib.sha256(), "chars": 0}
            target = unescape(text[a:z])
            held["n"] += len(target)
            held["loss"].update(target.encode("utf-8", "surrogatepass"))
            held["chars"] += len(text)
            held["last"] = text
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), DIGEST)], schema=DIGEST)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(close(held)), DIGEST)], schema=DIGEST)


def read_back(examples: DataFrame) -> DataFrame:
    """A digest of each conversation from its examples; takes them as expand() leaves them, without a shuffle between."""
    return examples.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text")
    )
    return read_back(expand(known.unionByName(extra)))
