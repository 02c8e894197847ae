"""Personal data in texts: fixed patterns, and a character tagger trained on them.

The tagger is a bidirectional LSTM over characters with a CRF over its labels, in numpy.
It is trained here, on a sample of at most TRAIN_WINDOWS windows with spans and as many
without, taken by hash from all texts. The labels are the pattern spans; texts with spans
are also shown VARIANTS times with their spans rewritten in ways that the patterns don't
cover: other separators, a missing country code, an at sign or dots in words or brackets,
and other digits. So the tagger learns the form of the spans and finds what the patterns
miss.

Texts are cut into windows of WIDTH characters that overlap by half, batched through the
network, and decoded. Every character takes its label from the window in whose middle it
lies; runs of labels that cross windows are then joined over the whole text. A window
without a digit, an at sign or a bracket before "at" isn't run: no span, plain or
rewritten, is without one. A run becomes a `model` span if the CRF's marginal probability
of lying in a span is MODEL_SURE on average and MODEL_LEAST everywhere, and if it touches no
pattern span.

Defined cases: null text is empty; empty texts have no spans; a corpus without any pattern
span gets no model, hence pattern spans only; overlapping pattern spans of different kinds
are all reported; repeated rows are each scanned; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import stage, table, tune

#: The kinds and their patterns.
KINDS = ["email", "ip", "card", "phone", "model"]
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)
_DIGIT = re.compile(r"[0-9]")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Windows of characters, how many of either sort the model is fitted to at most, and rewritten versions of a text.
WIDTH, TRAIN_WINDOWS, VARIANTS = 64, 1500, 3
#: Epochs, but at least STEPS steps of BATCH windows.
HIDDEN, EPOCHS, STEPS, BATCH, RATE = 16, 7, 200, 96, 0.03
#: Character classes: ASCII one by one, everything else together.
CLASSES = 129
#: Labels: 0 outside, then begin and inside of each pattern kind.
LABELS = 1 + 2 * (len(KINDS) - 1)
MODEL_SURE, MODEL_LEAST = 0.95, 0.6
RUN = 512


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their at signs so that long words cost no more than short ones."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _NAME:
            start -= 1
        m = EMAIL_HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(a, 0, z) for a, z in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= CARD_DIGITS[0]:
                digits = re.sub("[^0-9]", "", m[0])
                if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if PHONE_DIGITS[0] <= sum(c.isdigit() for c in m[0]) <= PHONE_DIGITS[1]:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- rewritten spans ------------------------------------------------------------------------

#: How addresses, numbers and cards are also written.
AT, DOT = ["(at)", "[at]", " (at) ", " [at] ", " @ ", "@"], ["[dot]", "(dot)", " (dot) ", "[.]", " . "]
IP_DOT, CARD_GAP, PHONE_GAP = ["[.]", " . ", "(.)", " [.] "], [".", "/", "_", " - ", "  "], [" ", ".", "/", "-", "  ", " - "]


def rewritten(span: str, kind: int, rng: random.Random) -> str:
    """A pattern span in a form that the patterns don't cover, with other digits."""
    span = _DIGIT.sub(lambda m: rng.choice("0123456789"), span)
    if kind == 0:
        name, host = span.split("@", 1)
        return name + rng.choice(AT) + host.replace(".", rng.choice(DOT))
    if kind == 1:
        return rng.choice(IP_DOT).join(re.split(r"\.", span))
    digits = re.sub("[^0-9]", "", span)
    if kind == 2:
        gap = rng.choice(CARD_GAP)
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    # a phone number: country code with two zeros, in brackets or not at all, and any separator
    gap, code, rest = rng.choice(PHONE_GAP), digits[:-10], digits[-10:]
    area = rest[:3] if rng.random() < 0.5 else f"({rest[:3]})"
    head = rng.choice(["", "", "00" + code + gap, f"({code}) ", code + gap]) if code else ""
    return head + area + gap + rest[3:6] + gap + rest[6:]


def variant(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """text with all its spans rewritten, and where they are then; of spans that overlap the first."""
    out, size, at, found = [], 0, 0, []
    for a, k, z in spans:
        if a < at:
            continue
        new = rewritten(text[a:z], k, rng)
        out += [text[at:a], new]
        size += a - at
        found.append((size, k, size + len(new)))
        size, at = size + len(new), z
    return "".join([*out, text[at:]]), found


# -- windows --------------------------------------------------------------------------------


def codes(text: str) -> np.ndarray:
    """The class of each code point."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < CLASSES - 1, c, CLASSES - 1).astype(np.uint8)


def windows(c: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit, an at sign, "(at" or "[at"; starts are multiples of half a window."""
    half = WIDTH // 2
    some = ((c >= 48) & (c <= 57)) | (c == 64)
    some[:-2] |= ((c[:-2] == 40) | (c[:-2] == 91)) & (c[1:-1] == 97) & (c[2:] == 116)
    if not some.any():
        return np.zeros(0, np.int64)
    blocks = np.pad(some, (0, -len(c) % half)).reshape(-1, half).any(axis=1)
    either = blocks.copy()
    either[:-1] |= blocks[1:]
    return np.flatnonzero(either) * half


def cut(c: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The windows as rows, filled up with class 0."""
    padded = np.pad(c, (0, WIDTH))
    return padded[starts[:, None] + np.arange(WIDTH)]


def labels_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.uint8)
    for a, k, z in reversed(spans):
        out[a:z] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


# -- the network ----------------------------------------------------------------------------


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(w: dict, d: str, x: np.ndarray, keep: bool = False):
    """Hidden states of one direction, (time, batch, HIDDEN); keep: what the backward pass needs, too."""
    steps, n = x.shape[1], x.shape[0]
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    saved = []
    for t in range(steps):
        z = w[f"x{d}"][x[:, t]] + h @ w[f"h{d}"]
        s = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        old_h, old_c = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        if keep:
            saved.append((i, f, o, g, old_h, old_c, tc))
    return (out, saved) if keep else out


def lstm_back(w: dict, d: str, x: np.ndarray, saved: list, dout: np.ndarray, grad: dict) -> None:
    n = x.shape[0]
    dh = np.zeros((n, HIDDEN), np.float32)
    dc = np.zeros((n, HIDDEN), np.float32)
    gh = np.zeros_like(w[f"h{d}"])
    dzs = np.empty((x.shape[1], n, 4 * HIDDEN), np.float32)
    for t in range(x.shape[1] - 1, -1, -1):
        i, f, o, g, old_h, old_c, tc = saved[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * old_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dzs[t] = dz
        gh += old_h.T @ dz
        dh, dc = dz @ w[f"h{d}"].T, dc * f
    which = np.zeros((x.size, CLASSES), np.float32)
    which[np.arange(x.size), x.T.ravel()] = 1
    grad[f"x{d}"], grad[f"h{d}"] = which.T @ dzs.reshape(-1, 4 * HIDDEN), gh


def emissions(w: dict, x: np.ndarray) -> np.ndarray:
    """(time, batch, LABELS) scores."""
    both = np.concatenate([lstm(w, "f", x), lstm(w, "b", x[:, ::-1])[::-1]], axis=2)
    return both @ w["out"] + w["bias"]


def crf(e: np.ndarray, trans: np.ndarray, y: np.ndarray):
    """Mean negative log-likelihood of labels y (batch, time) and its gradients by e and trans, by the forward-backward sums."""
    steps, n, k = e.shape
    # sums of exponentials, scaled to one at each step; the scales make up the logarithm of the whole
    top = e.max(axis=2, keepdims=True)
    p, t_ = np.exp(e - top), np.exp(trans)
    alpha, beta = np.empty_like(p), np.ones_like(p)
    z = top[:, :, 0].sum(axis=0)
    for t in range(steps):
        a = (alpha[t - 1] @ t_) * p[t] if t else p[0]
        scale = a.sum(axis=1, keepdims=True)
        alpha[t] = a / scale
        z = z + np.log(scale[:, 0])
    for t in range(steps - 2, -1, -1):
        b = (p[t + 1] * beta[t + 1]) @ t_.T
        beta[t] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    de = both / both.sum(axis=2, keepdims=True)
    ahead = p[1:] * beta[1:]
    # the chance of each transition, scaled to one for each place
    total = np.einsum("tnj,tnj->tn", alpha[:-1] @ t_, ahead)
    dt = t_ * np.einsum("tni,tnj->ij", alpha[:-1] / total[:, :, None], ahead)
    rows, ts = np.arange(n), np.arange(steps)
    gold = e[ts[:, None], rows[None, :], y.T].sum(axis=0) + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
    np.subtract.at(de, (ts[:, None], rows[None, :], y.T), 1)
    np.subtract.at(dt, (y[:, :-1], y[:, 1:]), 1)
    return float((z - gold).mean()), de / n, dt / n


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """(batch, time) best labels."""
    steps, n, _ = e.shape
    back = np.zeros(e.shape, np.uint8)
    score = e[0]
    for t in range(1, steps):
        s = score[:, :, None] + trans
        back[t] = s.argmax(axis=1)
        score = s.max(axis=1) + e[t]
    out = np.empty((n, steps), np.uint8)
    out[:, -1] = score.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(n), out[:, t]]
    return out


def train(x: np.ndarray, y: np.ndarray, seed: int = 9) -> dict:
    """Weights fitted to windows x (rows of classes) and labels y, by Adam."""
    rng = np.random.default_rng(seed)
    init = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
    w = {f"x{d}": init(CLASSES, 4 * HIDDEN) for d in "fb"} | {f"h{d}": init(HIDDEN, 4 * HIDDEN) for d in "fb"}
    w |= {"out": init(2 * HIDDEN, LABELS), "bias": np.zeros(LABELS, np.float32), "trans": np.zeros((LABELS, LABELS), np.float32)}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(x)))):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            xb, yb = x[rows].copy(), y[rows].astype(np.int64)
            # digits inside spans are shown at random, so that the form is learnt and not the numbers
            digit = (xb >= 48) & (xb <= 57) & (yb > 0) & (rng.random(len(rows)) < 0.5)[:, None]
            xb[digit] = rng.integers(48, 58, int(digit.sum()))
            hf, sf = lstm(w, "f", xb, True)
            rev = np.ascontiguousarray(xb[:, ::-1])
            hb, sb = lstm(w, "b", rev, True)
            both = np.concatenate([hf, hb[::-1]], axis=2)
            _, de, dt = crf(both @ w["out"] + w["bias"], w["trans"], yb)
            de = de.astype(np.float32)
            grad = {"trans": dt.astype(np.float32), "out": np.einsum("tnh,tnk->hk", both, de), "bias": de.sum(axis=(0, 1))}
            db = de @ w["out"].T
            lstm_back(w, "f", xb, sf, db[:, :, :HIDDEN], grad)
            lstm_back(w, "b", rev, sb, db[::-1, :, HIDDEN:], grad)
            step += 1
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w[k] = (w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return w


def inside(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """(batch, time) CRF marginals of any label but 0, by scaled forward-backward sums."""
    steps, n, k = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True))
    t = np.exp(trans)
    forward, back = np.empty_like(p), np.ones_like(p)
    forward[0] = p[0] / p[0].sum(axis=1, keepdims=True)
    for i in range(1, steps):
        a = (forward[i - 1] @ t) * p[i]
        forward[i] = a / a.sum(axis=1, keepdims=True)
    for i in range(steps - 2, -1, -1):
        b = (back[i + 1] * p[i + 1]) @ t.T
        back[i] = b / b.sum(axis=1, keepdims=True)
    both = forward * back
    return (1 - both[:, :, 0] / both.sum(axis=2)).T


def tag(w: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of windows, and the marginal probability of lying in a span (0 in windows without labels)."""
    ys, ps = [], []
    for at in range(0, len(x), RUN):
        e = emissions(w, x[at : at + RUN])
        y = viterbi(e, w["trans"])
        p = np.zeros(y.shape, np.float32)
        some = y.any(axis=1)
        if some.any():
            p[some] = inside(e[:, some], w["trans"])
        ys.append(y)
        ps.append(p)
    return np.concatenate(ys), np.concatenate(ps)


def reconcile(n: int, starts: np.ndarray, y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One label and certainty for each character of a text, from the window in whose middle half it lies, if that was run."""
    label, sure = np.zeros(n + WIDTH, np.uint8), np.zeros(n + WIDTH, np.float32)
    q = WIDTH // 4
    for inner in (False, True):
        for s, a, b in zip(starts.tolist(), y, p):
            lo, hi = (q, WIDTH - q) if inner else (0, WIDTH)
            label[s + lo : s + hi], sure[s + lo : s + hi] = a[lo:hi], b[lo:hi]
    return label[:n], sure[:n]


def model_spans(text: str, label: np.ndarray, sure: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of labels as spans, those that qualify and touch no pattern span."""
    inside = np.flatnonzero(label > 0)
    if not len(inside):
        return []
    out = []
    for run in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1):
        a, z = int(run[0]), int(run[-1]) + 1
        while z > a and not text[z - 1].isalnum():
            z -= 1
        if z > a and sure[a:z].mean() >= MODEL_SURE and sure[a:z].min() >= MODEL_LEAST and not any(s < z and a < e for s, _, e in base):
            out.append((a, 4, z))
    return out


def find_all(texts: list[str | None], w: dict | None) -> list[list[tuple[int, int, int]]]:
    """The spans of each text, by start, then kind; the windows of all texts are run together."""
    out, todo, parts = [], [], []
    for i, t in enumerate(texts):
        out.append(pattern_spans(t) if t else [])
        if t and w is not None:
            c = codes(t)
            s = windows(c)
            if len(s):
                todo.append((i, s))
                parts.append(cut(c, s))
    if parts:
        y, p = tag(w, np.concatenate(parts))
        at = 0
        for i, s in todo:
            label, sure = reconcile(len(texts[i]), s, y[at : at + len(s)], p[at : at + len(s)])
            out[i] = sorted(out[i] + model_spans(texts[i], label, sure, out[i]))
            at += len(s)
    return out


# -- on DataFrames ----------------------------------------------------------------------------

_WINDOW = pa.schema([("h", pa.int64()), ("full", pa.bool_()), ("x", pa.binary()), ("y", pa.binary())])


def labelled_windows(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, labels) of a text and of its variants."""
    spans = pattern_spans(text) if text else []
    forms = [(text, spans)] if text else []
    if spans:
        rng = random.Random(text)
        forms += [variant(text, spans, rng) for _ in range(VARIANTS)]
    for t, found in forms:
        c = codes(t)
        s = windows(c)
        if len(s):
            yield cut(c, s), cut(labels_of(len(t), found), s)


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each partition, the windows of least hash, TRAIN_WINDOWS with spans and as many without."""
    least: dict[bool, dict[int, tuple[bytes, bytes]]] = {True: {}, False: {}}
    for b in batches:
        for t in b.column(0):
            for x, y in labelled_windows(t.as_py()):
                full = y.any(axis=1)
                for k in range(len(x)):
                    row = x[k].tobytes()
                    # equal windows count once
                    least[bool(full[k])][xxhash.xxh3_64_intdigest(row, 9) >> 1] = row, y[k].tobytes()
            for kept in least.values():
                if len(kept) > 4 * TRAIN_WINDOWS:
                    for h in sorted(kept)[TRAIN_WINDOWS:]:
                        del kept[h]
    for full, kept in least.items():
        rows = [(h, full, *kept[h]) for h in sorted(kept)[:TRAIN_WINDOWS]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _WINDOW)], schema=_WINDOW)


def fit(docs: DataFrame) -> dict | None:
    """A model from at most 2 x TRAIN_WINDOWS windows of docs (2 x WIDTH bytes each on the driver), or None if no text has a span."""
    found = stage(docs.select("text").mapInArrow(_training, "h long, full boolean, x binary, y binary"), "windows")
    rows = [r for full in (True, False) for r in found.filter(F.col("full") == full).dropDuplicates(["h"]).orderBy("h").limit(TRAIN_WINDOWS).collect()]
    if not rows or not rows[0]["full"]:
        return None
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.uint8).reshape(-1, WIDTH)
    y = np.frombuffer(b"".join(bytes(r["y"]) for r in rows), np.uint8).reshape(-1, WIDTH)
    return train(x, y)


def scan(docs: DataFrame, key: str = "doc_id", model: dict | None = None) -> DataFrame:
    """key and spans: array of (start, kind, end). model: from fit(); by default one is fitted to docs."""
    spark = docs.sparkSession
    tune(spark)
    weights = spark.sparkContext.broadcast(model if model is not None else fit(docs))  # some 80 kB

    @F.arrow_udf("array<struct<start:int,kind:int,end:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([(f, pa.int32()) for f in ("start", "kind", "end")]))
        for texts in batches:
            found = find_all([t.as_py() for t in texts], weights.value)
            yield pa.array([[dict(zip(("start", "kind", "end"), s)) for s in x] for x in found], kind)

    return docs.select(F.col(key), run(F.col("text")).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def op9_char_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 4)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return s.select("doc_id", *(count(k) for k in range(4)), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), count(4))
