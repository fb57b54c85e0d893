"""Best-fit packing by length patterns and non-negative least squares.

1. Every document becomes token pieces of at most ``LIMIT`` tokens (only longer ones are cut).
2. The lengths' histogram (``LIMIT`` counts at most, whatever the input) goes to the driver.
   Patterns of up to ``MAX_PARTS`` length bins that fill a sequence are enumerated; non-negative
   least squares fits their repeat counts to the binned histogram; a share of each count is rounded
   down (of ``SHARES`` the one that needs fewest sequences, since short residual pieces fill gaps) and
   each pattern's last part is taken as the longest length that still fits.  Residual lengths are
   packed best-fit, longest first, into gaps and new sequences.  Equal cases are handled as runs
   (length, first rank, count, first sequence, offset), so the work depends on the number of
   distinct lengths, not of documents.
3. Pieces get a rank within their length, counted in salted parts so that a common length is not
   sorted in one task, and look up their run.

Defined results: null and empty texts are one piece, the end token; repeated rows are packed each;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, small_batches, table, written
from .tokens import encoder, tokenizer_path

LIMIT = 4096
END = (1).to_bytes(4, "little")
BIN = 128
MAX_PARTS = 6
SHARES = (1.0, 0.5, 0.3, 0.2)
#: Pieces of one length and salt, about: what one window holds, however many there are of a length.
PER_SALT = 4000
#: (length, salt) rows that are broadcast at most (about 10 MB); more are joined by shuffle.
MAX_BROADCAST = 300_000


def token_pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; ``with_ids`` adds the ids' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = path or tokenizer_path()
        encode = encoder(own)
        for batch in slices(batches, 256, own):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(encode(batch.column(1).to_pylist())):
                raw += END
                for k, lo in enumerate(range(0, len(raw), 4 * limit)):
                    part = raw[lo : lo + 4 * limit]
                    row.append(i)
                    piece.append(k)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary())] if with_ids else cols, [*names, "ids"] if with_ids else names)

    small_batches(docs.sparkSession)
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(run, kind + ", ids binary" * with_ids)


@cache
def patterns(bins: int, parts: int) -> tuple[tuple[int, ...], ...]:
    """Descending bins, at most ``parts`` of them, that sum to ``bins``."""
    found: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            found.append(head)
        elif len(head) < parts:
            for k in range(min(most, left), 0, -1):
                grow((*head, k), left - k, k)

    grow((), bins, bins)
    return tuple(found)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """argmin |a x - b| over x >= 0, by Lawson and Hanson's active sets."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * a.shape[0] + 30):
        w = a.T @ (b - a @ x)
        w[inside] = -np.inf
        if inside.all() or w.max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        inside[w.argmax()] = True
        for _ in range(n):
            s = np.zeros(n)
            s[inside] = np.linalg.lstsq(a[:, inside], b, rcond=None)[0]
            bad = inside & (s <= 0)
            if not bad.any():
                break
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x += step * (s - x)
            inside &= x > 1e-12
            x[~inside] = 0
        x = np.where(inside, s, 0)
    return np.maximum(x, 0)


class Plan:
    """Runs that place the pieces of a histogram ``counts`` (index: length) into sequences."""

    def __init__(self, counts: np.ndarray, limit: int = LIMIT, share: float = 1.0) -> None:
        self.left = counts.astype(np.int64).copy()  # pieces not placed yet, by length
        self.rank = np.zeros(len(counts), np.int64)
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.limit, self.share, self.sequences = limit, share, 0
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, count)
        self.keys: list[int] = []
        self._patterns()
        self._rest()

    def _place(self, length: int, count: int, first: int, used: int) -> None:
        self.runs.append((length, int(self.rank[length]), count, first, used))
        self.rank[length] += count
        self.left[length] -= count

    def _open(self, room: int, first: int, count: int) -> None:
        if room > 0 and count:
            if room not in self.gaps:
                self.gaps[room] = []
                insort(self.keys, room)
            self.gaps[room].append((first, count))

    def _patterns(self) -> None:
        width = max(1, self.limit * BIN // LIMIT)
        bins = self.limit // width
        of = np.clip(np.rint(np.arange(len(self.left)) / width).astype(int), 1, bins)
        have = np.bincount(of[1:], self.left[1:], bins + 1)
        found = patterns(bins, MAX_PARTS)
        use = [p for p in found if all(have[k] for k in set(p))]
        if not use:
            return
        a = np.zeros((bins, len(use)))
        for j, p in enumerate(use):
            for k in p:
                a[k - 1, j] += 1
        repeats = np.floor(nnls(a, have[1:]) * self.share + 1e-9).astype(np.int64)
        members = [np.flatnonzero(of == k)[::-1] for k in range(bins + 1)]
        for j in np.argsort([-use[j][0] for j in range(len(use))], kind="stable"):
            if repeats[j]:
                self._realise(use[j], int(repeats[j]), members)

    def _realise(self, pattern: tuple[int, ...], repeats: int, members: list[np.ndarray]) -> None:
        states = [(self.sequences, repeats, 0)]  # first sequence, count, tokens used
        self.sequences += repeats
        for place, k in enumerate(pattern):
            done: list[tuple[int, int, int]] = []
            while states:
                first, count, used = states.pop()
                room = self.limit - used
                if place == len(pattern) - 1 and place:  # the last part: the longest that fits
                    fit = np.flatnonzero(self.left[1 : room + 1])
                    pick = int(fit[-1]) + 1 if len(fit) else 0
                    if pick < room * 0.5:
                        pick = 0
                else:
                    pick = next((int(n) for n in members[k] if n <= room and self.left[n]), 0)
                if not pick:
                    done.append((first, count, used))
                    continue
                n = min(count, int(self.left[pick]))
                self._place(pick, n, first, used)
                done.append((first, n, used + pick))
                if n < count:
                    states.append((first + n, count - n, used))
            states = done
        for first, count, used in states:
            self._open(self.limit - used, first, count)

    def _rest(self) -> None:
        for length in range(len(self.left) - 1, 0, -1):
            while n := int(self.left[length]):
                at = bisect_left(self.keys, length)
                if at == len(self.keys):
                    per = self.limit // length  # alike pieces side by side
                    full, odd = divmod(n, per)
                    for count, each in ((full, per), (int(odd > 0), odd)):
                        for i in range(each if count else 0):
                            self._place(length, count, self.sequences, i * length)
                        if count:
                            self._open(self.limit - each * length, self.sequences, count)
                            self.sequences += count
                    continue
                room = self.keys[at]
                first, count = self.gaps[room].pop()
                if not self.gaps[room]:
                    del self.gaps[room]
                    self.keys.pop(at)
                take = min(n, count)
                self._place(length, take, first, self.limit - room)
                self._open(room - length, first, take)
                self._open(room, first + take, count - take)


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    pieces = written(pieces)
    counts = np.zeros(limit + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # one row per length: ``limit`` at most
        counts[length] = n
    plan = min((Plan(counts, limit, x) for x in SHARES), key=lambda p: p.sequences)
    runs = np.array(sorted(plan.runs) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    # a length has as many salts as its pieces need, so no rank is taken over many more than ``PER_SALT``
    needed = [(k, int(-(-n // PER_SALT))) for k, n in enumerate(counts.tolist()) if n]
    salts = pieces.sparkSession.createDataFrame(needed, "length long, salts long")  # ``limit`` rows at most
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.col("salts"))
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", salt).drop("salts")
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    base = written(base.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n"))
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")) - 1
    side = F.broadcast(base) if sum(n for _, n in needed) <= MAX_BROADCAST else base
    ranked = salted.withColumn("rank", rank).join(side, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).drop("salt", "base")
    key = (runs[:, 0] << 44) + runs[:, 1]

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = runs[np.searchsorted(key, (b["length"].to_numpy(np.int64) << 44) + b["rank"].to_numpy(np.int64), side="right") - 1]
            b["sequence_id"], b["offset"] = r[:, 3] + b["rank"].to_numpy(np.int64) - r[:, 1], r[:, 4]
            yield b[names]

    kinds = [f"{n} {t}" for n, t in pieces.dtypes]
    names = [*pieces.columns, "sequence_id", "offset"]
    return ranked.mapInPandas(look_up, ", ".join([*kinds, "sequence_id long", "offset long"]))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents")))
