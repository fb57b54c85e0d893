"""Bounded, deterministic samples: the first, the first that is not empty, and the K of least hash.

All three depend on ids and places only, so partitions and order of rows change nothing.  Each task
reduces its rows to what may still be a sample (per key the first, the first that is not empty and the
K of least hash) before anything is shuffled, in a table that it gives away when it grows large; windows
then pick from these rows.  So texts leave a task only for rows that stand among its own samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Sampling
from ..functions.hashing import MASK_63, UNIT, fnv64, fnv64_onto, hex64
from ..functions.json_text import quoted
from .ids import FIRST_NON_EMPTY, FIRST_SEEN, PRIORITY, SCOPES, fnv_hex, value_hashes


def _joined(*parts: Column | str) -> Column:
    return F.concat_ws(UNIT, *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))


def cut(text: str, limit: int) -> tuple[str, int]:
    """At most ``limit`` bytes of a text, cut between characters, and whether it was cut."""
    if 4 * len(text) <= limit:
        return text, 0
    raw = text.encode()
    return (text, 0) if len(raw) <= limit else (raw[:limit].decode(errors="ignore"), 1)


#: Stands for a missing document index when rows are put in order.
NO_DOCUMENT = -(2**63)


class Best:
    """Rows of each group that may be samples: the first, the first that is not empty, the ``limit`` of least priority."""

    def __init__(self) -> None:
        self.limits: list[int] = []  # by group
        self.clear()

    def clear(self) -> None:
        self.kept: dict[int, list[tuple]] = {}  # rows: (document, place, path, priority, some, payload)
        self.size = 0
        n = len(self.limits)
        self._worst = np.full(n, MASK_63, np.int64)
        self._first, self._full = np.full(n, MASK_63, np.int64), np.full(n, MASK_63, np.int64)

    def group(self, limit: int) -> int:
        """A new group."""
        self.limits.append(limit)
        return len(self.limits) - 1

    def _grow(self) -> None:
        more = len(self.limits) - len(self._worst)
        if more:
            limits = np.array(self.limits[-more:])
            self._worst = np.r_[self._worst, np.where(limits > 0, MASK_63, -1)]
            self._first, self._full = (np.r_[x, np.full(more, MASK_63, np.int64)] for x in (self._first, self._full))

    def wanted(self, group: np.ndarray, doc: np.ndarray, some: np.ndarray, priority: np.ndarray) -> np.ndarray:
        """Indices of rows that may be samples, as far as these rows and those before tell."""
        self._grow()
        at = np.flatnonzero((priority <= self._worst[group]) | (doc <= self._first[group]) | (some & (doc <= self._full[group])))
        if len(at) < 2:
            return at
        g, d, s, p = group[at], doc[at], some[at], priority[at]
        good = np.zeros(len(at), bool)
        by = np.lexsort((p, g))
        start = np.flatnonzero(np.r_[True, g[by][1:] != g[by][:-1]])
        rank = np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)]))
        good[by[rank < np.array(self.limits)[g[by]]]] = True
        for rows in (np.arange(len(at)), np.flatnonzero(s)):  # all rows of the least document, whose places decide
            by = rows[np.lexsort((d[rows], g[rows]))]
            if len(by):
                start = np.flatnonzero(np.r_[True, g[by][1:] != g[by][:-1]])
                least = np.repeat(d[by][start], np.diff(np.r_[start, len(by)]))
                good[by[d[by] == least]] = True
        return at[good]

    def put(self, group: int, row: tuple, size: int) -> None:
        rows = self.kept.setdefault(group, [])
        rows.append(row)
        self.size += size
        if len(rows) > 2 * self.limits[group] + 6:
            self.prune(group)

    def prune(self, group: int) -> None:
        rows, limit = self.kept[group], self.limits[group]
        doc = lambda r: NO_DOCUMENT if r[0] is None else r[0]
        order = sorted(rows, key=lambda r: (r[3], doc(r), r[2]))[:limit]
        full = [r for r in rows if r[4]]
        firsts = [min(x, key=lambda r: (doc(r), r[1])) for x in (rows, full) if x]
        self.kept[group] = list({id(r): r for r in (*order, *firsts)}.values())
        self._first[group] = doc(firsts[0])
        if full:
            self._full[group] = doc(firsts[1])
        if limit and len(order) == limit:
            self._worst[group] = order[-1][3]


#: A task gives away its rows when they are this many or their texts this long.
MOST_GROUPS, MOST_CHARS = 20_000, 16_000_000


def _picked(rows: DataFrame, keys: list[str], limit: Column) -> DataFrame:
    """Of a task's candidates, the samples themselves: one row for each kind."""
    at = lambda *order: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    full = F.row_number().over(W.partitionBy(*keys, "some").orderBy("doc_idx", "ord"))
    ranked = rows.withColumns({"rank_seen": at("doc_idx", "ord"), "rank_full": full, "rank_least": at("priority", "doc_idx", "source_path")})
    kind = lambda name, when, *facts: F.when(when, F.struct(F.lit(name).alias("sample_kind"), *facts))
    none = F.lit(None).cast("long").alias("sample_priority"), F.lit(None).cast("int").alias("sample_rank")
    kinds = F.array_compact(
        F.array(
            kind(FIRST_SEEN, F.col("rank_seen") == 1, *none),
            kind(FIRST_NON_EMPTY, (F.col("rank_full") == 1) & F.col("some"), *none),
            kind(PRIORITY, F.col("rank_least") <= limit, F.col("priority").alias("sample_priority"), F.col("rank_least").alias("sample_rank")),
        )
    )
    return ranked.select("*", F.inline(kinds)).drop("rank_seen", "rank_full", "rank_least", "some", "priority")


def _strings(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*parts, UNIT, null_handling="replace", null_replacement="")


def _whole(a: pa.Array | pa.ChunkedArray) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def _documents(column: pa.Array) -> np.ndarray:
    """Document indices for comparing; rows without one come first."""
    return column.fill_null(NO_DOCUMENT).to_numpy(zero_copy_only=False)


def _reduced(rows: DataFrame, fill: Callable, schema: str) -> DataFrame:
    """``rows`` through ``fill(best, groups, batch)`` and out of ``best``: ``groups`` names the groups of a task's table."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[c.split(" ")[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, groups = Best(), {}

        def out() -> pa.RecordBatch:
            for g in list(best.kept):
                best.prune(g)
            named = {g: k for k, (g, *_) in groups.items()}
            found = [(*named[g], *r[:5], *r[5]) for g, rows in best.kept.items() for r in rows]
            cols = list(zip(*found, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            if batch.num_rows:
                fill(best, groups, batch)
            if len(best.kept) > MOST_GROUPS or best.size > MOST_CHARS:
                yield out()
                groups.clear()
                best = Best()
        yield out()

    return rows.mapInArrow(run, schema)


def _limits(options: Sampling) -> dict[str, int]:
    return dict(zip(SCOPES, (options.canonical_priority_limit, options.site_priority_limit, options.field_set_priority_limit, options.type_set_priority_limit), strict=True))


def object_limits(options: Sampling) -> Column:
    """How many priority samples the scope of a row may have."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in _limits(options).items() for x in kv)), F.col("sample_scope"))


def merged_samples(parts: DataFrame, keys: list[str], limit: Column) -> DataFrame:
    """The samples of a whole from those of its parts: least priorities ranked anew, one first of each kind."""
    order = ["sample_priority", "document_index", "source_path"]
    rank = F.row_number().over(W.partitionBy(*keys, "sample_kind").orderBy(*order))
    least = F.col("sample_kind") == PRIORITY
    ranked = parts.withColumn("rank", rank).filter(F.col("rank") <= F.when(least, limit).otherwise(1))
    return ranked.withColumn("sample_rank", F.when(least, F.col("rank"))).drop("rank")


_PLACE = "doc_idx long, ord string, source_path string, priority long, some boolean, "


def object_samples(objects: DataFrame, options: Sampling) -> DataFrame:
    """Samples of each scope's keys: path, site, field set, type set."""
    limits, most = _limits(options), options.object_json_limit_bytes
    facts = ["canonical_path", "site_path", "schema_path", "field_set_hash", "type_set_hash", "shape_id"]
    slim = objects.select("doc_idx", "ord", "path", *facts, "json")

    def fill(best: Best, groups: dict, batch: pa.RecordBatch) -> None:
        col = dict(zip(batch.schema.names, batch.columns, strict=True))
        whole = _whole(_strings(*(col[c] for c in ("canonical_path", "site_path", "field_set_hash", "type_set_hash")))).dictionary_encode()
        code = whole.indices.to_numpy(zero_copy_only=False)
        heads = np.zeros(len(whole.dictionary), np.int64)
        heads[code[::-1]] = np.arange(len(code))[::-1]
        parts = list(zip(*(col[c].take(pa.array(heads)).fill_null("").to_pylist() for c in ("canonical_path", "site_path", "field_set_hash", "type_set_hash")), strict=True))
        keys = [(scope, UNIT.join(p[: i + 1])) for p in parts for i, scope in enumerate(SCOPES)]
        new = [k for k in dict.fromkeys(keys) if k not in groups]
        for k, start in zip(new, fnv64([f"{s}{UNIT}{k}{UNIT}" for s, k in new]).tolist(), strict=True):
            groups[k] = best.group(limits[k[0]]), start
        group, start = (np.array([groups[k][i] for k in keys], t).reshape(-1, len(SCOPES))[code] for i, t in ((0, np.int64), (1, np.uint64)))
        priority = (fnv64_onto(_whole(_strings(col["doc_idx"].cast(pa.string()), col["path"])), start) & np.uint64(MASK_63)).view(np.int64)
        doc, some = _documents(col["doc_idx"]), pc.not_equal(col["json"], "{}").to_numpy(zero_copy_only=False)
        n = len(SCOPES)
        at = best.wanted(group.ravel(), np.repeat(doc, n), np.repeat(some, n), priority.ravel())
        rows = np.unique(at // n)
        place = {r: i for i, r in enumerate(rows.tolist())}
        chosen = batch.take(pa.array(rows)).to_pylist()
        for i in at.tolist():
            r = chosen[place[i // n]]
            text, was_cut = cut(r["json"], most)
            best.put(int(group.ravel()[i]), (r["doc_idx"], r["ord"], r["path"], int(priority.ravel()[i]), r["json"] != "{}", (*(r[f] for f in facts), text, was_cut)), len(text))

    keys = "sample_scope string, sample_key string, "
    rows = _reduced(slim, fill, keys + _PLACE + ", ".join(f"{f} string" for f in facts) + ", sample_json string, sample_json_truncated int")
    picked = _picked(rows, ["sample_scope", "sample_key"], object_limits(options))
    sample_id = fnv_hex(_joined("sample_scope", "sample_key", "sample_kind", "doc_idx", "source_path", "sample_priority", "shape_id"))
    return picked.select(
        sample_id.alias("object_sample_id"),
        "sample_scope",
        "sample_key",
        *facts,
        "sample_kind",
        F.col("doc_idx").alias("document_index"),
        "source_path",
        "sample_json",
        "sample_json_truncated",
        (F.col("sample_json") == "{}").cast("int").alias("sample_is_empty_object"),
        F.lit(0).alias("sample_is_empty_array"),
        "sample_priority",
        "sample_rank",
    )


def value_samples(objects: DataFrame, options: Sampling) -> DataFrame:
    """Samples of each field profile's values, with the object they stand in."""
    limit, most, most_parent = options.value_priority_limit_per_field_profile, options.value_json_limit_bytes, options.parent_object_json_limit_bytes

    def fill(best: Best, groups: dict, batch: pa.RecordBatch) -> None:
        col = dict(zip(batch.schema.names, batch.columns, strict=True))
        fields = col["fields"].flatten()
        if not len(fields):
            return
        of = col["fields"].value_parent_indices() if hasattr(col["fields"], "value_parent_indices") else pc.list_parent_indices(col["fields"])
        name, kind, text = fields.field("name"), fields.field("type"), fields.field("text")
        whole = _whole(_strings(col["shape_id"].take(of), name, kind)).dictionary_encode()
        code = whole.indices.to_numpy(zero_copy_only=False)
        profiles = fnv64(whole.dictionary.to_pylist())
        new = [h for h in dict.fromkeys(f"{x:016x}" for x in profiles.tolist()) if (h,) not in groups]
        for h, start in zip(new, fnv64([h + UNIT for h in new]).tolist(), strict=True):
            groups[(h,)] = best.group(limit), start
        mine = [groups[(f"{x:016x}",)] for x in profiles.tolist()]
        group, start = (np.array([m[i] for m in mine], t)[code] for i, t in ((0, np.int64), (1, np.uint64)))
        path = pc.binary_join_element_wise(col["path"].take(of), name, ".")
        priority = (fnv64_onto(_whole(_strings(col["doc_idx"].take(of).cast(pa.string()), path)), start) & np.uint64(MASK_63)).view(np.int64)
        empty = pc.or_(pc.equal(kind, "null"), pc.or_(pc.and_(pc.equal(kind, "object"), pc.equal(text, "{}")), pc.and_(pc.equal(kind, "array"), pc.equal(text, "[]"))))
        some = ~empty.to_numpy(zero_copy_only=False)
        at = best.wanted(group, _documents(col["doc_idx"].take(of)), some, priority)
        where = pa.array(at)
        kinds, texts = kind.take(where).to_pylist(), text.take(where).to_pylist()
        hashes = value_hashes(kinds, texts).view(np.int64).tolist()
        parent = of.take(where)
        facts = zip(at.tolist(), kinds, texts, hashes, path.take(where).to_pylist(), *(col[c].take(parent).to_pylist() for c in ("doc_idx", "ord", "json")), strict=True)
        for i, k, t, h, p, doc, place, js in facts:
            shown, parents = cut(quoted(t) if k == "string" else t, most), cut(js, most_parent)
            best.put(int(group[i]), (doc, place, p, int(priority[i]), bool(some[i]), (h, *shown, *parents)), len(shown[0]) + len(parents[0]))

    schema = "field_profile_id string, " + _PLACE + "hash long, value_json string, value_json_truncated int, parent_object_json string, parent_object_json_truncated int"
    rows = _reduced(objects.select("doc_idx", "ord", "path", "shape_id", "fields", "json"), fill, schema)
    picked = _picked(rows, ["field_profile_id"], F.lit(limit)).withColumn("value_hash", hex64(F.col("hash")))
    sample_id = fnv_hex(_joined("field_profile_id", "sample_kind", "doc_idx", "source_path", "value_hash", "sample_priority"))
    return picked.select(
        sample_id.alias("value_sample_id"),
        "field_profile_id",
        "value_hash",
        "sample_kind",
        F.col("doc_idx").alias("document_index"),
        "source_path",
        "value_json",
        "value_json_truncated",
        "parent_object_json",
        "parent_object_json_truncated",
        "sample_priority",
        "sample_rank",
    )


def heavy_hitter_context(fields: DataFrame, stored: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` places of each heavy hitter, in document order.

    Only on request: a profile never holds these rows, whatever ``heavy_hitter_context_sample_limit`` says.
    """
    hitters = stored.filter("value_source = 'heavy_hitter'").select("field_profile_id", "value_hash")
    rows = fields.withColumn("value_hash", hex64(F.col("value_hash"))).join(hitters, ["field_profile_id", "value_hash"])
    rank = F.row_number().over(W.partitionBy("field_profile_id", "value_hash").orderBy("doc_idx", "source_path"))
    ranked = rows.withColumn("sample_rank", rank).filter(F.col("sample_rank") <= limit)
    return ranked.select("field_profile_id", "value_hash", F.lit("heavy_hitter_context").alias("sample_kind"), F.col("doc_idx").alias("document_index"), "source_path", "sample_rank")
