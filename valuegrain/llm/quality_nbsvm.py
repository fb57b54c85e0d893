"""Quality classifier: Naive Bayes support vectors.

Indicators of hashed n-grams, taken from the bytes of the text and from the shapes of its words
(case, end mark, new, repeated), are scaled by the log-count ratio of the two classes; a linear
hinge-loss model is fitted on the scaled, length-normalised vectors by dual coordinate descent;
a logistic curve fitted on held-back training rows, weighted to the classes' true shares, turns
margins into scores.

Training: numpy on a bounded hash sample of labelled documents (``MAX_TRAIN``).  Scoring is row
by row on the executors over whole texts: no shuffle.

Defined results: null or empty texts have no n-grams and get the score of the bare intercept;
repeated rows score alike; without labels of both classes every score is 0.5; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_order, slices, small_batches, table

#: Labelled documents to train on, at most.
MAX_TRAIN = 3000
BITS = 17
SIZE = 1 << BITS
BYTE_NS = (1, 2, 3, 4)
SHAPE_NS = (1, 2, 3, 6)
THRESHOLD = 0.3
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _grams(x: np.ndarray, ns: tuple[int, ...], salt: int) -> list[np.ndarray]:
    out, h, n = [], np.zeros(len(x), np.uint64), 0
    for n_next in ns:
        while n < n_next and len(h):
            h = (h[: len(x) - n] if n else h) * np.uint64(257) + x[n:] + np.uint64(1)
            n += 1
        if n < n_next or len(x) < n_next:
            break
        out.append((((h + np.uint64(salt * 16 + n)) * _MUL) >> np.uint64(64 - BITS)).astype(np.int64))
        if n < ns[-1]:
            h = h[:-1]
    return out


def word_shapes(words: list[bytes]) -> np.ndarray:
    """One small number per word: short or long, case, end mark, and whether it came before."""
    seen: set[bytes] = set()
    out, last = [], b""
    for w in words:
        size = len(w)
        if w == last:
            code = 1
        elif size < 4:
            code = 2
        elif w in seen:
            code = 3
        else:
            seen.add(w)
            code = 4 + (w.isupper() or 2 * w.istitle())
        end = w[-1]
        out.append(code * 128 + (end if end < 64 else 0))
        last = w
    return np.array(out, np.uint64)


class Grams:
    """Distinct hashed n-grams of a text, with one reused buffer."""

    def __init__(self) -> None:
        self.buffer = np.zeros(SIZE, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        if not raw:
            return np.zeros(0, np.int64)
        for h in _grams(np.frombuffer(raw, np.uint8).astype(np.uint64), BYTE_NS, 1) + _grams(word_shapes(raw.split()), SHAPE_NS, 2):
            self.buffer[h] = True
        found = np.flatnonzero(self.buffer)
        self.buffer[found] = False
        return found


@dataclass
class NbSvm:
    ratio: np.ndarray  # log-count ratio of each n-gram
    weight: np.ndarray  # of the scaled indicators
    bias: float
    slope: float
    offset: float

    def margin(self, grams: np.ndarray) -> float:
        if not len(grams):
            return self.bias
        r = self.ratio[grams].astype(np.float64)
        return float((r * self.weight[grams]).sum() / max(np.sqrt((r * r).sum()), 1e-12)) + self.bias

    def score(self, grams: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(grams) + self.offset, -40, 40))))


def dual_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: np.ndarray, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear L1-loss support vectors with an intercept feature of 1, one dual variable at a time."""
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(y))
    square = np.array([(v * v).sum() + 1.0 for _, v in x])
    order, rng = np.arange(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            at, v = x[i]
            grad = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - grad / square[i], 0.0), c[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[at] += step * y[i] * v
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def fit(texts: list[str | None], labels: list[int], prior: float, smooth: float = 1.0, c: float = 1.0) -> NbSvm:
    """``prior``: the true share of label 1, to which the scores are calibrated."""
    y = np.where(np.array(labels) > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        return NbSvm(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 0.0, 0.0)
    grams = list(map(Grams(), texts))
    back = np.arange(len(y)) % 5 == 4  # rows come in hash order
    if min(len(set(y[back].tolist())), len(set(y[~back].tolist()))) < 2:
        back = np.zeros(len(y), bool)
    p, q = np.full(SIZE, smooth), np.full(SIZE, smooth)
    for g, sign, out in zip(grams, y, back, strict=True):
        if not out:
            (p if sign > 0 else q)[g] += 1
    ratio = np.log(p / ((y[~back] > 0).sum() + 2 * smooth)) - np.log(q / ((y[~back] < 0).sum() + 2 * smooth))
    x = [(g, (v := ratio[g]) / max(np.sqrt((v * v).sum()), 1e-12)) for g in grams]
    balance = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    w, bias = dual_descent([a for a, out in zip(x, back, strict=True) if not out], y[~back], c * balance[~back])
    use = back if back.any() else ~back
    m = np.array([w[g] @ v + bias for (g, v), u in zip(x, use, strict=True) if u])
    t = (y[use] > 0).astype(float)
    weight = np.where(t > 0, prior / max(t.mean(), 1e-9), (1 - prior) / max(1 - t.mean(), 1e-9))
    n1, n0 = t.sum(), (1 - t).sum()
    t = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # Platt's soft targets
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton
        s = 1 / (1 + np.exp(-(a * m + b)))
        g = np.array([(weight * (s - t) * m).sum() + 1e-3 * (a - 1), (weight * (s - t)).sum()])
        h = weight * s * (1 - s)
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
    return NbSvm(ratio.astype(np.float32), w.astype(np.float32), float(bias), float(a), float(b))


def fold(doc_id: Column, of: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> NbSvm:
    """Fit on at most ``max_train`` labelled documents outside fold 0 of 5."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("y"))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    sides = [known.filter(f"y = {k}").orderBy(*hash_order("doc_id")).limit(size) for k, size in ((1, max_train * 2 // 3), (0, max_train // 3))]
    picked = F.broadcast(sides[0].unionByName(sides[1]))  # max_train rows at most
    rows = docs.select("doc_id", "text").join(picked, "doc_id").orderBy(*hash_order("doc_id"), "text").limit(2 * max_train).collect()
    return fit([r["text"] for r in rows], [r["y"] for r in rows], ones / n if n else 0.5)


def score(docs: DataFrame, model: NbSvm) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in slices(batches, 1000):
            s = np.array([model.score(grams(x.as_py())) for x in batch.column(2)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op7_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
