"""Stable 64-bit hashes: FNV-1a over UTF-8, and a finalizer that spreads its bits.

Both exist twice: as numpy functions over whole Arrow batches (the way the profiler takes: a
byte-wise hash has no built-in) and as column expressions without Python.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a 64 and of the MurmurHash3 finalizer.
OFFSET = 0xCBF29CE484222325
PRIME = 0x100000001B3
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53

#: Separates the parts of an id's input.
UNIT = "\x1f"
MASK_63 = 0x7FFFFFFFFFFFFFFF


def _steps(data: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One vector step per byte position, over the rows that are long enough; ``h``: where each row, or each of its columns, stands."""
    order = np.argsort(-size, kind="stable")
    start, size, h = start[order], size[order], h[order]
    for i in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -i, side="left"))  # rows of more than i bytes
        byte = data[start[:live] + i]
        h[:live] = (h[:live] ^ (byte[:, None] if h.ndim > 1 else byte)) * np.uint64(PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv64(texts: Iterable[str]) -> np.ndarray:
    """FNV-1a of each text."""
    raw = [t.encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    return _steps(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size, np.full(len(raw), OFFSET, np.uint64))


def fnv64_onto(texts: pa.Array, start: np.ndarray) -> np.ndarray:
    """Hashes whose first parts are hashed (``start``: a row for each text, with columns for several) and go on with ``texts``."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return _steps(np.frombuffer(data or b"", np.uint8), ends[:-1], np.diff(ends), start)


def fnv64_distinct(texts: list[str]) -> np.ndarray:
    """The same, hashing each distinct text once."""
    index: dict[str, int] = {}
    at = np.fromiter((index.setdefault(t, len(index)) for t in texts), np.int64, len(texts))
    return fnv64(index)[at] if index else np.zeros(0, np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(MIX_1)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(33))


def hex64(h: Column) -> Column:
    """16 lower-case digits of a 64-bit hash held as a long."""
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def fnv64_expr(text: Column) -> Column:
    """FNV-1a as a column expression; 64-bit products are taken in 32-bit halves, so nothing overflows."""
    raw = F.encode(text, "UTF-8")
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long")

    def step(h: Column, b: Column) -> Column:
        y = h.bitwiseXOR(b)
        low, high = y.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(y, 32)
        p = low * 435  # PRIME is 2 ** 40 + 435
        top = (high * 435 + F.shiftrightunsigned(p, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(top, 32).bitwiseOR(p.bitwiseAND(F.lit(0xFFFFFFFF)))

    start = F.lit(OFFSET - 2**64)
    places = F.sequence(F.lit(1), F.octet_length(text))
    return F.when(F.octet_length(text) == 0, start).otherwise(F.aggregate(F.transform(places, byte), start, step))
