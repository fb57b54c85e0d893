"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line gets a few surface features (symbols, capitals, separators, repetition, length, place);
Viterbi decoding gives the most likely label sequence; a document stays if content lines hold
enough of its words and none of the base rules failed.

Training: numpy, forward-backward gradients with Adam on a bounded hash sample of documents with
a quality label (``MAX_TRAIN``); every line of a document carries its document's label as a weak
label, and the chain sorts out the mixed ones.  Scoring is row by row on the executors: no shuffle.

Defined results: null, empty or blank texts have no words, fail the base rules and go; the whole
text counts, however long; repeated rows are judged alike; without labelled documents of both
classes the line model is neutral and the base rules decide; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_order, slices, small_batches, table

#: Labelled documents to train on, at most.
MAX_TRAIN = 1500
#: Lines of a training document that a window holds; longer ones give several windows.
WINDOW = 48
CONTENT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
N_FEATURES = 16


def repeated_positions(words: list[bytes]) -> np.ndarray:
    """Which words lie in a 3-word window that occurs twice or more."""
    n, mask = len(words), np.zeros(len(words), bool)
    if n < 4:
        return mask
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    k = len(ids) + 1
    _, pair = np.unique(x[:-1] * k + x[1:], return_inverse=True)
    _, where, count = np.unique(pair[:-1] * k + x[2:], return_inverse=True, return_counts=True)
    twice = count[where] > 1
    for i in range(3):
        mask[i : n - 2 + i] |= twice
    return mask


def analyse(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), line features, words per line."""
    raw = (text or "").encode()
    lines = raw.split(b"\n")
    split = [x.split() for x in lines]
    words = [w for x in split for w in x]
    repeat = repeated_positions(words)
    feats, counts, seen, dups, at = np.zeros((len(lines), N_FEATURES), np.float32), np.zeros(len(lines), np.int64), set(), 0, 0
    for i, (line, own) in enumerate(zip(lines, split, strict=True)):
        n = counts[i] = len(own)
        dup = n > 0 and line in seen
        dups += dup
        if n:
            seen.add(line)
            size = len(line)
            sym = size - len(line.translate(None, SYMBOLS))
            up = size - len(line.translate(None, UPPER))
            feats[i] = (
                1.0, min(sym / n, 1.0), sym > 0.3 * n, min(line.count(b"!!") / n, 1.0), min(up / size, 1.0), up > 0.4 * size, min(line.count(b"|") / n, 1.0),
                1.0 - len(set(own)) / n, sum(map(eq, own, own[1:])) / n, dup, repeat[at : at + n].mean(), np.log1p(n) / 5, line[-1:] in b".!?:", (size - len(line.translate(None, DIGITS))) / size,
                i == 0, n < 3,
            )
        at += n
    n_chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    base = (len(words), n_chars, len(raw) - len(raw.translate(None, SYMBOLS)), int(dups), int(repeat.sum()))
    live = counts > 0
    return base, feats[live], counts[live]


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def fit_crf(docs: list[tuple[np.ndarray, int]], epochs: int = 80, rate: float = 0.1, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2) and transitions (2 x 2); ``docs``: line features and 0/1 label (1: content)."""
    parts = [(x[i : i + WINDOW], y) for x, y in docs for i in range(0, len(x), WINDOW)]
    w, t = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if len({y for _, y in parts}) < 2:
        return w, t
    n, size = len(parts), max(len(x) for x, _ in parts)
    x, live = np.zeros((n, size, N_FEATURES)), np.zeros((n, size))
    for i, (f, _) in enumerate(parts):
        x[i, : len(f)], live[i, : len(f)] = f, 1
    y = np.array([y for _, y in parts])
    weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9)) / live.sum()
    gold_u = np.einsum("nlf,nl,n->nf", x, live, weight)
    gold_t = (live[:, 1:].sum(1) * weight)
    one = np.stack([y == 0, y == 1], 1).astype(float)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, epochs + 1):
        u = x @ w
        a, b = np.zeros((n, size, 2)), np.zeros((n, size, 2))
        a[:, 0] = u[:, 0]
        for i in range(1, size):
            nxt = _sum_exp(a[:, i - 1, :, None] + t, 1) + u[:, i]
            a[:, i] = np.where(live[:, i, None] > 0, nxt, a[:, i - 1])
        for i in range(size - 2, -1, -1):
            back = _sum_exp(t[None] + (u[:, i + 1] + b[:, i + 1])[:, None, :], 2)
            b[:, i] = np.where(live[:, i + 1, None] > 0, back, 0)
        z = _sum_exp(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None]) * live[..., None] * weight[:, None, None]
        gw = np.einsum("nf,nk->fk", gold_u, one) - np.einsum("nlf,nlk->fk", x, p) - l2 * w
        pair = np.exp(a[:, :-1, :, None] + t + (u + b)[:, 1:, None, :] - z[:, None, None, None]) * (live[:, 1:] * weight[:, None])[..., None, None]
        gt = np.einsum("n,nk->k", gold_t, one)
        gt = np.diag(gt) - pair.sum((0, 1)) - l2 * t
        for m, v, g, q in ((moments[0], moments[1], gw, w), (moments[2], moments[3], gt, t)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, t


def viterbi(unary: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The most likely of the two labels for each row of ``unary``."""
    n = len(unary)
    if not n:
        return np.zeros(0, np.int64)
    (t00, t01), (t10, t11) = trans.tolist()
    rows = unary.tolist()
    s0, s1 = rows[0]
    back = []
    for u0, u1 in rows[1:]:
        a, b, c, d = s0 + t00, s1 + t10, s0 + t01, s1 + t11
        back.append((a < b, c < d))
        s0, s1 = (b if a < b else a) + u0, (d if c < d else c) + u1
    path = [int(s1 > s0)]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return np.array(path[::-1])


def train_line_model(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most ``max_train`` labelled documents, half of each class where there are enough."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = [known.filter(test).orderBy(*hash_order("doc_id")).limit(max_train // 2) for test in ("quality > 0", "quality <= 0")]
    picked = F.broadcast(ids[0].unionByName(ids[1]))  # max_train rows at most
    rows = docs.select("doc_id", "text").join(picked, "doc_id").orderBy("doc_id", "text").limit(2 * max_train).collect()
    return fit_crf([(f, int(r["quality"] > 0)) for r in rows if len(f := analyse(r["text"])[1])])


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def line_quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], content_share: float = CONTENT_SHARE) -> DataFrame:
    """The base figures, the share of words in content lines, and the verdict for every row."""
    w, t = (np.asarray(x, np.float64) for x in model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1):
                base, feats, counts = analyse(text.as_py())
                label = viterbi(feats.astype(np.float64) @ w, t)
                share = float(counts[label == 1].sum() / base[0]) if base[0] else 0.0
                if not w.any():
                    share = float(base[0] > 0)
                failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
                for col, value in zip(out, (*base, failed, share, not failed and share >= content_share), strict=True):
                    col.append(value)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(score, RESULT)


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_quality(docs, train_line_model(docs, table(spark, sf_dir, "labels")))
