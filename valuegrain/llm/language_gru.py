"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on short byte windows of a bounded sample; every
position of a window gets a label, and a document's probabilities are the means over all its
positions.  Long texts are read whole, in consecutive segments of ``SEGMENT`` bytes that run as
one batch.  Scoring is row by row on the executors: no shuffle.

Gates are piecewise linear (clipped), so a step costs few array operations per byte.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every
text if nothing could be learned; repeated rows are labelled alike; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_order, slices, small_batches, table, written
from .quality_nbsvm import fold

#: Documents of a language to train on, about, and characters of each.
MAX_TRAIN_PER_LANG = 300
TRAIN_CHARS = 1500
#: Languages whose counts are broadcast at most.
MAX_BROADCAST_LANGS = 100_000
HIDDEN = 8
SEGMENT = 128
#: Segments that run as one batch.
BATCH = 1024
UNDETERMINED = "und"
F4 = np.float32


@dataclass
class Direction:
    table: np.ndarray  # (3H, 256): what a byte adds to the update, reset and candidate gates
    own: np.ndarray  # (3H, H): recurrent weights

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = HIDDEN
        a = self.own @ h
        gates = np.clip((x[: 2 * n] + a[: 2 * n]) * F4(0.2) + F4(0.5), F4(0), F4(1))
        z, r = gates[:n], gates[n:]
        c = np.clip(x[2 * n :] + r * a[2 * n :], F4(-1), F4(1))
        return c + z * (h - c), z, r, c, a[2 * n :]


@dataclass
class Gru:
    langs: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # (C, 2H)
    bias: np.ndarray  # (C, 1)

    def states(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """(2H, T, N) for bytes ``x`` (T, N); positions that are not ``live`` leave the state at 0."""
        size, n = x.shape
        s = np.empty((2 * HIDDEN, size, n), F4)
        for d, way, at in ((self.ahead, range(size), 0), (self.back, range(size - 1, -1, -1), HIDDEN)):
            h = np.zeros((HIDDEN, n), F4)
            for t in way:
                h = d.step(np.take(d.table, x[t], axis=1), h)[0]
                h *= live[t]
                s[at : at + HIDDEN, t] = h
        return s

    def label(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Summed position probabilities (C, N)."""
        s = self.states(x, live)
        y = self.out @ s.reshape(2 * HIDDEN, -1) + self.bias
        y -= y.max(0)
        np.exp(y, out=y)
        y /= y.sum(0)
        return (y.reshape(len(self.langs), *x.shape) * live).sum(1)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean position probabilities (documents, C)."""
        sums, sizes = np.zeros((len(texts), len(self.langs))), np.array([len(t) for t in texts])
        parts = (sizes + SEGMENT - 1) // SEGMENT
        of = np.repeat(np.arange(len(texts)), parts)
        if not len(of):
            return sums
        start = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        for i in range(0, len(of), BATCH):
            pieces = [texts[d][s : s + SEGMENT] for d, s in zip(of[i : i + BATCH].tolist(), start[i : i + BATCH].tolist(), strict=True)]
            x = np.frombuffer(b"".join(p.ljust(SEGMENT, b"\0") for p in pieces), np.uint8).reshape(len(pieces), SEGMENT).T
            live = (np.arange(SEGMENT)[:, None] < np.array([len(p) for p in pieces])).astype(F4)
            np.add.at(sums, of[i : i + BATCH], self.label(np.ascontiguousarray(x), live).T)
        return sums / np.maximum(sizes, 1)[:, None]


def _window_batch(texts: list[list[bytes]], size: int, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``n`` random windows, the languages in turn."""
    y = np.arange(n) % len(texts)
    x, live = np.zeros((size, n), np.uint8), np.zeros((size, n), F4)
    for i in range(n):
        t = texts[y[i]][rng.integers(len(texts[y[i]]))]
        s = int(rng.integers(max(1, len(t) - size + 1)))
        w = np.frombuffer(t[s : s + size], np.uint8)
        x[: len(w), i], live[: len(w), i] = w, 1
    return x, live, y


def fit(texts: dict[str, list[bytes]], steps: int = 220, size: int = 48, batch: int = 256, rate: float = 0.02, seed: int = 11) -> Gru:
    """``texts``: training bytes by language."""
    langs = sorted(k for k, v in texts.items() if any(v))
    rng = np.random.default_rng(seed)
    c, n3 = len(langs), 3 * HIDDEN
    new = lambda *s, k=0.3: rng.normal(0, k, s).astype(F4)
    net = Gru(langs, Direction(new(n3, 256), new(n3, HIDDEN)), Direction(new(n3, 256), new(n3, HIDDEN)), new(c, 2 * HIDDEN), np.zeros((c, 1), F4))
    if c < 2:
        return net
    own = [[t for t in texts[k] if t] for k in langs]
    params = [net.ahead.table, net.ahead.own, net.back.table, net.back.own, net.out, net.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        x, live, y = _window_batch(own, size, batch, rng)
        grads = _gradients(net, x, live, y)
        scale = min(1.0, 1.0 / max(1e-9, float(np.sqrt(sum(float((g * g).sum()) for g in grads)))))
        lr = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            g = g * F4(scale)
            a += F4(0.1) * (g - a)
            b += F4(0.01) * (g * g - b)
            p -= F4(lr) * (a / F4(1 - 0.9**step)) / (np.sqrt(b / F4(1 - 0.99**step)) + F4(1e-8))
    return net


def _gradients(net: Gru, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy over all live positions, by backpropagation through time."""
    size, n = x.shape
    trace, s = {}, np.empty((2 * HIDDEN, size, n), F4)
    ways = ((net.ahead, list(range(size)), 0), (net.back, list(range(size - 1, -1, -1)), HIDDEN))
    for d, way, at in ways:
        h = np.zeros((HIDDEN, n), F4)
        for t in way:
            before = h
            h, z, r, c, a = d.step(np.take(d.table, x[t], axis=1), before)
            h = h * live[t]
            trace[at, t] = (before, z, r, c, a)
            s[at : at + HIDDEN, t] = h
    flat = s.reshape(2 * HIDDEN, -1)
    p = net.out @ flat + net.bias
    p = np.exp(p - p.max(0))
    p /= p.sum(0)
    p = p.reshape(len(net.langs), size, n)
    p[y, :, np.arange(n)] -= 1
    p *= live / live.sum()
    p = p.reshape(len(net.langs), -1).astype(F4)
    g_out, g_bias = p @ flat.T, p.sum(1, keepdims=True)
    g_s = (net.out.T @ p).reshape(2 * HIDDEN, size, n)
    found = []
    for d, way, at in ways:
        g_h, g_own, g_x = np.zeros((HIDDEN, n), F4), np.zeros_like(d.own), np.empty((3 * HIDDEN, size, n), F4)
        for t in reversed(way):
            before, z, r, c, a = trace[at, t]
            g = (g_h + g_s[at : at + HIDDEN, t]) * live[t]
            g_c = g * (1 - z) * (np.abs(c) < 1)
            g_z = g * (before - c) * ((z > 0) & (z < 1)) * F4(0.2)
            g_r = g_c * a * ((r > 0) & (r < 1)) * F4(0.2)
            g_a = np.concatenate([g_z, g_r, g_c * r])
            g_x[: 2 * HIDDEN, t], g_x[2 * HIDDEN :, t] = g_a[: 2 * HIDDEN], g_c
            g_own += g_a @ before.T
            g_h = g * z + d.own.T @ g_a
        at_byte = x.ravel()
        g_table = np.stack([np.bincount(at_byte, row, 256) for row in g_x.reshape(3 * HIDDEN, -1)]).astype(F4)
        found += [g_table, g_own]
    return [*found, g_out, g_bias]


def train(docs: DataFrame, per_lang: int = MAX_TRAIN_PER_LANG) -> Gru:
    """Fit on documents with a language outside fold 2 of 4: about ``per_lang`` of each, by a hash of their ids.

    Counting reads no text, and the sample is a filter: nothing is ranked or shuffled by language.
    """
    usable = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    counts = written(usable.groupBy("lang").agg(F.count("*").alias("n")))
    share = F.abs(F.xxhash64("doc_id") / F.lit(float(2**63)))
    n_langs = counts.count()
    picked = usable.join(F.broadcast(counts) if n_langs <= MAX_BROADCAST_LANGS else counts, "lang").filter(share * F.col("n") < per_lang)
    # a passage from anywhere in the text, not its start: headers need not be in the text's language
    at = F.pmod(F.xxhash64("doc_id", F.lit("passage")), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1)))
    passage = F.col("text").substr((at + 1).cast("int"), F.lit(TRAIN_CHARS))
    some = picked.filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", passage.alias("text"))
    rows = some.orderBy(*hash_order("doc_id"), "lang", "text").limit(4 * per_lang * max(1, n_langs)).collect()
    texts: dict[str, list[bytes]] = {}
    for r in rows:
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    return fit(texts)


def predict(docs: DataFrame, net: Gru, carried: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``, and columns of it by number (carried_0, ...)."""
    own = [c for c in carried if c not in ("doc_id", "text")]
    at = {"doc_id": 0, "text": 2, **{c: 3 + i for i, c in enumerate(own)}}
    out_names = ["doc_id", "held_out", "lang_pred", "score", *(f"carried_{i}" for i in range(len(carried)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 400):
            texts = [t if t and any(map(str.isalpha, t)) else "" for t in batch.column(2).to_pylist()]
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if len(net.langs) == 1:
                lang, score = [net.langs[0] if t else UNDETERMINED for t in texts], np.array([float(bool(t)) for t in texts])
            elif net.langs:
                p = net.documents([t.encode() for t in texts])
                best = p.argmax(1)
                score = np.where([bool(t) for t in texts], p.max(1), 0.0)
                lang = [net.langs[k] if t else UNDETERMINED for k, t in zip(best, texts, strict=True)]
            told = [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))]
            yield pa.RecordBatch.from_arrays([*told, *(batch.column(at[c]) for c in carried)], out_names)

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text", *(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)))
    kinds = dict(docs.dtypes)
    told = ["doc_id " + kinds["doc_id"], "held_out boolean", "lang_pred string", "score double"]
    return rows.mapInArrow(run, ", ".join([*told, *(f"carried_{i} {kinds[c]}" for i, c in enumerate(carried))]))


def least_score(net: Gru) -> float:
    """A text's language is told by a score above this: most of its positions' probability, or twice chance where over four languages share it."""
    return min(0.5, 2 / max(1, len(net.langs)))


def op6_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
