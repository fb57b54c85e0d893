"""Language-model scoring by stupid backoff, as joins of n-gram counts.

Every n-gram up to ``order`` of every document is counted over the whole corpus; a document is
scored with the counts of all *other* documents (its own are subtracted), so a text is not
predicted by itself.  For the word at each place the longest history seen elsewhere gives
``count(n-gram) / count(history)``, times ``ALPHA`` for each word the history was shortened by; a
word that no other document has counts as half an occurrence.

Relations, each row a packed block so that neither rows nor bytes explode:

* documents by block (a hash of the row), about ``BLOCK_CHARS`` of text each;
* exploded n-grams (block, part, hashes, counts): distinct within the block before the shuffle, so
  a frequent n-gram is one entry per block and no part is hot; ``part`` is the top of the hash, the
  rest is sorted and packed as steps;
* n-gram counts: all blocks' rows of a part are summed, and the totals join back to (block, part);
* scores: a block's documents with its totals, summed per document.

Hashes keep enough bits that about one n-gram in 100,000 shares its hash with another.

Defined results: null or blank texts have no words and score 0; one-word texts have a unigram
score; repeated rows are separate documents (each predicts the other); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .near_dedup import Words

ORDER = 3
ALPHA = 0.4
BLOCK_CHARS = 6_000_000
#: Distinct n-grams of a part, about.
PART_GRAMS = 4_000_000
MIN_PARTS = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers as steps of the fewest bytes that hold them all, like bytes together, compressed."""
    steps = np.diff(x, prepend=np.uint64(0))
    size = max(1, -(-int(steps.max()).bit_length() // 8)) if len(x) else 1
    return bytes([size]) + zstandard.compress(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes(), 1)


def unpack_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : raw[0]] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(c: np.ndarray) -> bytes:
    """Counts as bytes; those from 255 on follow in full."""
    return len(c).to_bytes(4, "little") + np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype("<u8").tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    c = np.frombuffer(raw, np.uint8, n, 4).astype(np.int64)
    c[c == 255] = np.frombuffer(raw, "<u8", offset=4 + n)
    return c


class Block:
    """The words of some documents and the hashes of their n-grams, in ``bits`` bits."""

    def __init__(self, texts: list[str | None], order: int, bits: int, words: Words) -> None:
        split = [(t or "").encode().lower().split() for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        h = np.fromiter((words[w] for own in split for w in own), np.uint64, int(self.sizes.sum()))
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(h)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.ends, grams = [], []  # where n-grams end, and their hashes, by order
        x = np.zeros(len(h), np.uint64)
        for n in range(1, order + 1):
            x[n - 1 :] = (x[n - 1 :] ^ h[: len(h) - n + 1]) * _MIX
            x ^= x >> np.uint64(31)
            at = np.flatnonzero(self.place >= n - 1)
            self.ends.append(at)
            y = (x[at] + np.uint64(n)) * _MIX
            grams.append((y ^ (y >> np.uint64(32))) * _MIX >> np.uint64(64 - bits))
        self.grams, self.of = np.unique(np.concatenate(grams), return_inverse=True)

    def counts(self) -> np.ndarray:
        return np.bincount(self.of, minlength=len(self.grams))

    def scores(self, totals: np.ndarray, corpus_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log10 scores, and places that backed off, by document; ``totals``: corpus counts of ``grams``."""
        size, seen, lo = len(self.doc), [], 0
        for at in self.ends:  # counts in all other documents of the n-gram that ends at each place
            of = self.of[lo : lo + len(at)]
            lo += len(at)
            _, where, own = np.unique(self.doc[at] * (len(self.grams) + 1) + of, return_inverse=True, return_counts=True)
            c = np.zeros(size)
            c[at] = totals[of] - own[where]
            seen.append(c)
        rest = np.maximum(corpus_words - self.sizes[self.doc], 1)
        best = np.log10(np.where(seen[0] > 0, seen[0], 0.5) / rest)
        steps = np.minimum(self.place, len(self.ends) - 1)  # words of history there are
        used = np.zeros(size, np.int64)
        for n in range(2, len(self.ends) + 1):
            ok = np.flatnonzero(seen[n - 1] > 0)
            best[ok] = np.log10(seen[n - 1][ok] / seen[n - 2][ok - 1])
            used[ok] = n - 1
        back = steps - used
        best += back * math.log10(ALPHA)
        return np.bincount(self.doc, best, len(self.sizes)), np.bincount(self.doc, back > 0, len(self.sizes)).astype(np.int64)


def stupid_backoff(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_backoff, log10_score (sum) and mean_log10 for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    chars, words = docs.agg(F.sum(F.length("text")), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()
    chars, corpus_words = chars or 0, words or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    part_bits = max(int(math.log2(MIN_PARTS)), math.ceil(math.log2(max(1, order * corpus_words / PART_GRAMS))))
    width = min(8 - -(-part_bits // 8), max(5, math.ceil((math.log2(max(2, order * corpus_words)) + 17 - part_bits) / 8)))
    bits, low = part_bits + 8 * width, np.uint64(8 * width)
    rows = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def explode(frame: pd.DataFrame) -> pd.DataFrame:
        b = Block(frame["text"].tolist(), order, bits, Words())
        part, counts = (b.grams >> low).astype(np.int64), b.counts()
        start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        rest = b.grams & ((np.uint64(1) << low) - np.uint64(1))
        cut = list(zip(start, np.r_[start[1:], len(part)], strict=True)) if len(part) else []
        return pd.DataFrame(
            {"part": part[start], "block": int(frame["block"].iloc[0]) if len(frame) else 0, "grams": [pack_sorted(rest[i:j]) for i, j in cut], "counts": [pack_counts(counts[i:j]) for i, j in cut]}
        )

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        grams = list(map(unpack_sorted, frame["grams"]))
        _, of = np.unique(np.concatenate(grams), return_inverse=True)
        sums = np.bincount(of, np.concatenate(list(map(unpack_counts, frame["counts"]))))[of].astype(np.int64)
        cut = np.cumsum(list(map(len, grams)))[:-1]
        return pd.DataFrame({"block": frame["block"], "part": frame["part"], "totals": list(map(pack_counts, np.split(sums, cut)))})

    def score(frame: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        b = Block(frame["text"].tolist(), order, bits, Words())
        totals = np.concatenate([np.zeros(0), *map(unpack_counts, sums.sort_values("part")["totals"])])
        if len(totals) != len(b.grams):
            raise ValueError("the block's documents changed between the count and the score")
        logs, back = b.scores(totals, corpus_words)
        return pd.DataFrame({"doc_id": frame["doc_id"], "n_words": b.sizes, "n_backoff": back, "log10_score": logs, "mean_log10": logs / np.maximum(b.sizes, 1)})

    grams = rows.groupBy("block").applyInPandas(explode, "part long, block long, grams binary, counts binary")
    totals = grams.groupBy("part").applyInPandas(total, "block long, part long, totals binary")
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_backoff long, log10_score double, mean_log10 double"
    return rows.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(score, kind)


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stupid_backoff(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_backoff", F.round("log10_score", 3).alias("log10_score"), F.round("mean_log10", 6).alias("mean_log10"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, c, lag(c) OVER o AS b, lag(c, 2) OVER o AS a FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) AS n1,
             CASE WHEN b IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY doc_id, b, c) END AS n2,
             CASE WHEN a IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) END AS n3,
             count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS rest FROM g),
h AS (SELECT *, lag(n1) OVER o AS h1, lag(n2) OVER o AS h2, least(i - 1, 2) AS most FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, CASE WHEN n3 > 0 THEN 0 WHEN n2 > 0 THEN most - 1 ELSE most END AS k,
             CASE WHEN n3 > 0 THEN log10(n3 / h2) WHEN n2 > 0 THEN log10(n2 / h1)
                  ELSE log10(CASE WHEN n1 > 0 THEN n1 ELSE 0.5 END / greatest(rest, 1)) END AS p FROM h),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (k > 0) AS n_backoff, sum(p + k * log10(0.4)) AS z FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_backoff, 0)::BIGINT AS n_backoff,
       round(coalesce(z, 0), 3) AS log10_score, round(coalesce(z, 0) / greatest(coalesce(n_words, 0), 1), 6) AS mean_log10
FROM d LEFT JOIN r USING (doc_id)
"""
