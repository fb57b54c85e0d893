"""Documents to nodes and to objects.

Two scanners give the same frames:

* ``strict``, the default: one narrow pass over Arrow batches with a strict JSON reader: exact number
  texts, nesting limit, and an error for anything that is not one JSON value.  It is also the faster
  one, for it touches a document once whatever its depth (see README).
* ``native``: VARIANT values in the JVM, expanded level by level with ``variant_explode``; each level is
  written once, so no level is evaluated twice and a lost executor costs one level's tasks.

``ord`` sorts the nodes of a document in pre-order (object keys in byte order, arrays by place).
Paths: ``$``, ``.field``, ``[i]``; the canonical path has ``[]`` for every ``[i]``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import UNIT, fnv64
from ..functions.json_columns import json_type, quote, value_text
from ..functions.json_text import MAX_DEPTH, JsonError, canonical, decode, number_text, quoted, type_of
from ..functions.paths import materialize
from .context import UNKNOWN

OBJECTS = (
    "doc_idx long, ord string, path string, canon string, json string, fields array<struct<name: string, type: string, text: string>>, field_set_json string, type_set_json string"
)
#: Objects, and one row without a path per document with its arrays and scalars.
SCAN = OBJECTS + ", n_arrays long, n_scalars long"
#: Context and ids, which a scan adds that knows the contexts.
SCAN_IDS = ", canonical_path string, site_path string, schema_path string, field_set_hash string, type_set_hash string, shape_id string, resolved boolean"
_PLACE = 10


def parse_variant(docs: DataFrame) -> DataFrame:
    """(doc_idx, ord, path, canon, v): the root node of every document."""
    return docs.select("doc_idx", F.lit("").alias("ord"), F.lit("$").alias("path"), F.lit("$").alias("canon"), F.parse_json("raw").alias("v"))


def expand(level: DataFrame) -> DataFrame:
    """The children of all containers of ``level`` (with kind)."""
    spark = level.sparkSession
    return spark.sql(
        f"""
        SELECT doc_idx,
               concat(ord, '/', lpad(pos, {_PLACE}, '0')) AS ord,
               CASE WHEN kind = 'object' THEN concat(path, '.', key) ELSE concat(path, '[', pos, ']') END AS path,
               CASE WHEN kind = 'object' THEN concat(canon, '.', key) ELSE concat(canon, '[]') END AS canon,
               value AS v
        FROM {{level}}, LATERAL variant_explode(v) AS e(pos, key, value)
        WHERE kind IN ('object', 'array')
        """,
        level=level,
    )


def nodes(docs: DataFrame) -> DataFrame:
    """Every node: (doc_idx, ord, path, canon, v, kind, depth).  Native scanner."""
    level = materialize(_kinds(parse_variant(docs), 0))
    found, depth = level, 0
    while not level.filter("kind IN ('object', 'array')").isEmpty():
        depth += 1
        level = materialize(_kinds(expand(level), depth))
        found = found.unionByName(level)
    return found


def _kinds(level: DataFrame, depth: int) -> DataFrame:
    return level.withColumn("kind", json_type(F.col("v"))).withColumn("depth", F.lit(depth))


def scan_native(docs: DataFrame) -> DataFrame:
    """Objects with their fields, and a row of counts per document, from VARIANT containers."""
    level = materialize(_kinds(parse_variant(docs), 0))
    every = level
    while not level.filter("kind IN ('object', 'array')").isEmpty():
        level = materialize(_kinds(expand(level), 0).filter("kind IN ('object', 'array')"))
        every = every.unionByName(level)
    entries = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
    named = lambda e: F.struct(e["key"].alias("name"), (k := json_type(e["value"])).alias("type"), value_text(e["value"], k).alias("text"))
    none = F.lit(None).cast("long")
    objects = every.filter("kind = 'object'").select("doc_idx", "ord", "path", "canon", F.transform(entries, named).alias("fields"))
    objects = set_texts(objects).select("*", object_text(F.col("fields")).alias("json"), none.alias("n_arrays"), none.alias("n_scalars"))
    leaf = lambda v: ~json_type(v).isin("array", "object")
    inside = F.coalesce(F.map_values(F.try_variant_get("v", "$", "map<string,variant>")), F.try_variant_get("v", "$", "array<variant>"))
    leaves = F.when(F.col("kind").isin("array", "object"), F.size(F.filter(inside, leaf))).otherwise(1)
    counts = every.groupBy("doc_idx").agg(F.count_if(F.col("kind") == "array").alias("n_arrays"), F.sum(leaves).alias("n_scalars"))
    return objects.unionByName(counts, allowMissingColumns=True)


def object_text(fields: Column) -> Column:
    """An object's canonical text from its fields' texts."""
    value = lambda f: F.when(f["type"] == "string", quote(f["text"])).otherwise(f["text"])
    return F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda f: F.concat(quote(f["name"]), F.lit(":"), value(f))), ","), F.lit("}"))


class Walker:
    """The objects of a batch of documents in pre-order, as columns.

    What objects of one place with one set of typed fields have in common is a shape and kept once: an
    object is the number of its shape, its canonical text and the texts of its fields.  Texts are built
    from the leaves up, so no container is written out once more for each level above it.
    """

    #: Key orders and shapes that are remembered at most from one batch to the next.
    MOST = 50_000

    def __init__(self) -> None:
        self._plans: dict[tuple[str, ...], tuple[tuple[str, str], ...]] = {}
        self.shapes: dict[tuple, int] = {}  # (path, canonical path, names, types): number
        self.turns = 0  # how often the shapes were forgotten
        self.clear()

    def clear(self) -> None:
        """Start a batch."""
        if len(self._plans) > self.MOST:
            self._plans.clear()
        if len(self.shapes) > self.MOST:
            self.shapes.clear()
            self.turns += 1
        self.shape: list[int] = []
        self.json: list[str] = []
        self.texts: list[list[str]] = []
        self.arrays = self.scalars = 0

    def add(self, value: object, odd: bool) -> tuple[int, int, int]:
        """Walk one document; its objects, arrays and scalars."""
        before = len(self.json), self.arrays, self.scalars
        kind = type_of(value)
        if kind in ("object", "array"):
            (self._object if kind == "object" else self._array)(value, odd, "$", "$", 1)
        else:
            self.scalars += 1
        return len(self.json) - before[0], self.arrays - before[1], self.scalars - before[2]

    def _plan(self, keys: tuple[str, ...]) -> tuple[tuple[str, str], ...]:
        self._plans[keys] = plan = tuple((k, quoted(k) + ":") for k in sorted(keys))
        return plan

    def _object(self, v: dict, odd: bool, path: str, canon: str, depth: int) -> str:
        if depth > MAX_DEPTH:
            raise JsonError("recursion limit exceeded")
        keys = tuple(v)
        plan = self._plans.get(keys) or self._plan(keys)
        at = len(self.json)
        own: list[str] = []
        self.json.append("")
        self.shape.append(0)
        self.texts.append(own)
        kinds, parts = [], []
        for k, head in plan:
            c = v[k]
            t = type(c)
            if t is str:
                kinds.append("string")
                own.append(c)
                parts.append(head + quoted(c))
                continue
            if t is int:
                kind, text = "integer", str(c)
            elif t is dict:
                kind, text = "object", self._object(c, odd, f"{path}.{k}", f"{canon}.{k}", depth + 1)
            elif t is list:
                kind, text = "array", self._array(c, odd, f"{path}.{k}", f"{canon}.{k}", depth + 1)
            elif t is float:
                kind, text = "number", number_text(c) if odd else repr(c)
            else:
                kind, text = ("null", "null") if c is None else ("boolean", "true" if c else "false")
            kinds.append(kind)
            own.append(text)
            parts.append(head + text)
        self.scalars += len(kinds) - kinds.count("object") - kinds.count("array")
        key = (path, canon, tuple(k for k, _ in plan), tuple(kinds))
        self.shape[at] = self.shapes.setdefault(key, len(self.shapes))
        self.json[at] = text = "{" + ",".join(parts) + "}"
        return text

    def _array(self, v: list, odd: bool, path: str, canon: str, depth: int) -> str:
        if depth > MAX_DEPTH:
            raise JsonError("recursion limit exceeded")
        self.arrays += 1
        parts, inner = [], f"{canon}[]"
        for i, c in enumerate(v):
            t = type(c)
            if t is dict:
                parts.append(self._object(c, odd, f"{path}[{i}]", inner, depth + 1))
            elif t is list:
                parts.append(self._array(c, odd, f"{path}[{i}]", inner, depth + 1))
            else:
                self.scalars += 1
                parts.append(quoted(c) if t is str else str(c) if t is int else number_text(c) if t is float and odd else canonical(c, False))
        return "[" + ",".join(parts) + "]"


def walk(value: object, odd: bool) -> tuple[list[tuple], int, int]:
    """Objects of one document in pre-order: (ord, path, canon, json, fields), then its arrays and scalars."""
    w = Walker()
    _, arrays, scalars = w.add(value, odd)
    shapes = list(w.shapes)
    out = []
    for i, (s, js, texts) in enumerate(zip(w.shape, w.json, w.texts, strict=True)):
        path, canon, names, kinds = shapes[s]
        out.append((f"{i:0{_PLACE}d}", path, canon, js, list(zip(names, kinds, texts, strict=True))))
    return out, arrays, scalars


class ShapeFacts:
    """What follows from an object's shape, as columns that a batch picks from by number."""

    NAMES = ("path", "canon", "field_set_json", "type_set_json", "canonical_path", "site_path", "schema_path", "field_set_hash", "type_set_hash", "shape_id")

    def __init__(self, known: Mapping[str, tuple[str, str]], turns: int = 0) -> None:
        self._known, self._turns = known, turns
        self._rows: list[tuple] = []
        self._resolved: list[bool] = []
        self._names: list[str] = []
        self._kinds: list[str] = []
        self._sizes: list[int] = []

    def update(self, walker: Walker) -> None:
        """Take in the shapes that are new; those of a walker that forgot its shapes, from the start."""
        if walker.turns != self._turns:
            self.__init__(self._known, walker.turns)
        new = list(islice(walker.shapes, len(self._rows), None))
        if not new and self._rows:
            return
        facts = []
        for path, canon, names, kinds in new:
            mine = [quoted(n) for n in names]
            sets = "[" + ",".join(mine) + "]", "[" + ",".join(f'[{n},"{k}"]' for n, k in zip(mine, kinds, strict=True)) + "]"
            at = self._known.get(path)
            facts.append((path, canon, *sets, *((at[0], path, at[1]) if at else (canon, path, UNKNOWN))))
            self._resolved.append(at is not None)
            self._names += names
            self._kinds += kinds
            self._sizes.append(len(names))
        if facts:
            fields, types = ([f"{x:016x}" for x in fnv64([f[i] for f in facts]).tolist()] for i in (2, 3))
            ids = fnv64([UNIT.join((*f[4:7], a, b)) for f, a, b in zip(facts, fields, types, strict=True)]).tolist()
            self._rows += [(*f, a, b, f"{i:016x}") for f, a, b, i in zip(facts, fields, types, ids, strict=True)]
        self._columns = [pa.array([r[i] for r in self._rows], pa.string()) for i in range(len(self.NAMES))]
        self._flat = [pa.array(x, pa.string()) for x in (self._names, self._kinds)]
        self._size = np.array(self._sizes, np.int64)
        self._start = np.cumsum(self._size) - self._size

    def columns(self, shape: list[int]) -> tuple[list[pa.Array], pa.Array, np.ndarray, list[pa.Array]]:
        """For each object: its facts, whether its site is known, the ends of its fields; then all fields' names and types."""
        at = np.array(shape, np.int64)
        size = self._size[at] if len(at) else at
        ends = np.r_[0, np.cumsum(size)]
        flat = np.repeat(self._start[at] - ends[:-1], size) + np.arange(ends[-1]) if len(at) else at
        where = pa.array(at)
        return [c.take(where) for c in self._columns], pa.array(self._resolved, pa.bool_()).take(where), ends, [c.take(pa.array(flat)) for c in self._flat]


def scan_strict(docs: DataFrame, known: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """The same frame by a strict reader; a document that is not JSON stops the run.

    With ``known`` (site to canonical and schema path, few enough to be sent along; may be empty) the
    objects come with their context and ids, and need no further pass for them.
    """
    text = pa.string()
    field = pa.list_(pa.struct([("name", text), ("type", text), ("text", text)]))
    extra = SCAN_IDS if known is not None else ""
    facts_of = ShapeFacts.NAMES if known is not None else ShapeFacts.NAMES[:4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, facts = Walker(), ShapeFacts(known or {})
        places = [f"{i:0{_PLACE}d}" for i in range(256)]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                walker.clear()
                n_objects, n_arrays, n_scalars = [], [], []
                for doc, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    try:
                        found = walker.add(*decode(raw))
                    except JsonError as e:
                        raise JsonError(f"json parse error: document {doc}: {e}") from e
                    for out, x in zip((n_objects, n_arrays, n_scalars), found, strict=True):
                        out.append(x)
                facts.update(walker)
                columns, resolved, ends, flat = facts.columns(walker.shape)
                of = dict(zip(ShapeFacts.NAMES, columns, strict=True))
                fields = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([*flat, pa.array(list(chain.from_iterable(walker.texts)), text)], ["name", "type", "text"])).cast(field)
                ords = [places[i] if i < 256 else f"{i:0{_PLACE}d}" for n in n_objects for i in range(n)]
                docs_of = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), n_objects)))
                none = pa.nulls(len(ords), pa.int64())
                rows = [docs_of, pa.array(ords, text), of["path"], of["canon"], pa.array(walker.json, text), fields, of["field_set_json"], of["type_set_json"], none, none]
                blank = [pa.nulls(part.num_rows, t) for t in (text, text, text, text, field, text, text)]
                tail = [part.column(0), *blank, pa.array(n_arrays, pa.int64()), pa.array(n_scalars, pa.int64())]
                if known is not None:
                    rows += [*(of[n] for n in facts_of[4:]), resolved]
                    tail += [*(pa.nulls(part.num_rows, text) for _ in facts_of[4:]), pa.nulls(part.num_rows, pa.bool_())]
                for one in (rows, tail):
                    yield pa.RecordBatch.from_arrays(one, names)

    names = ["doc_idx", "ord", "path", "canon", "json", "fields", "field_set_json", "type_set_json", "n_arrays", "n_scalars", *facts_of[4:], *(["resolved"] if extra else [])]
    return docs.select("doc_idx", "raw").mapInArrow(run, SCAN + extra)


def scan(docs: DataFrame, scanner: str = "strict") -> DataFrame:
    return (scan_native if scanner == "native" else scan_strict)(docs)


def set_texts(objects: DataFrame) -> DataFrame:
    """Adds the texts of an object's field set and type set."""
    names = F.transform("fields", lambda f: quote(f["name"]))
    pairs = F.transform("fields", lambda f: F.concat(F.lit("["), quote(f["name"]), F.lit(',"'), f["type"], F.lit('"]')))
    whole = lambda parts: F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    return objects.withColumn("field_set_json", whole(names)).withColumn("type_set_json", whole(pairs))
