"""Stable ids as Arrow-batched functions, equal inputs hashed once a batch; they are applied after rows are grouped."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import UNIT, fnv64_distinct, hex64, mix64
from ..functions.json_text import key_text

# Names of sample scopes and kinds: fixed values, part of ids.
SCOPES = ("canonical_path", "site_path", "field_set", "type_set")
FIRST_SEEN, FIRST_NON_EMPTY, PRIORITY = "first_seen", "first_non_empty", "priority_sample"


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def _long(h: np.ndarray) -> pd.Series:
    return pd.Series(h.view(np.int64))


def _hex(h: np.ndarray) -> list[str]:
    return [f"{x:016x}" for x in h.tolist()]


@F.pandas_udf(T.LongType())
def fnv(text: pd.Series) -> pd.Series:
    """FNV-1a of a string, as a long."""
    return _long(fnv64_distinct(text.tolist()))


def fnv_hex(text: Column) -> Column:
    return hex64(fnv(text))


@F.pandas_udf(_struct(field_set_hash=T.StringType(), type_set_hash=T.StringType(), shape_id=T.StringType()))
def shape_ids(canon: pd.Series, site: pd.Series, schema: pd.Series, field_set: pd.Series, type_set: pd.Series) -> pd.DataFrame:
    fields, types = (_hex(fnv64_distinct(x.fillna("").tolist())) for x in (field_set, type_set))
    whole = [UNIT.join(x) for x in zip(canon.fillna(""), site.fillna(""), schema, fields, types, strict=True)]
    return pd.DataFrame({"field_set_hash": fields, "type_set_hash": types, "shape_id": _hex(fnv64_distinct(whole))})


def value_hashes(kinds: list[str], texts: list[str]) -> np.ndarray:
    """What tells values apart, from their types and texts."""
    inner = [i for i, k in enumerate(kinds) if k in ("object", "array")]
    hashes = dict(zip(inner, _hex(fnv64_distinct([texts[i] for i in inner])), strict=True))
    return fnv64_distinct([key_text(k, t, hashes.get(i, "")) for i, (k, t) in enumerate(zip(kinds, texts, strict=True))])


@F.pandas_udf(T.StringType())
def profile_ids(shape: pd.Series, name: pd.Series, kind: pd.Series) -> pd.Series:
    """Of the profile of a shape's field."""
    return pd.Series(_hex(fnv64_distinct([UNIT.join(x) for x in zip(shape, name, kind, strict=True)])), dtype=object)


@F.pandas_udf(_struct(field_profile_id=T.StringType(), value_hash=T.LongType()))
def field_ids(shape: pd.Series, name: pd.Series, kind: pd.Series, text: pd.Series) -> pd.DataFrame:
    """Of a field's profile and of its value."""
    profile = _hex(fnv64_distinct([UNIT.join(x) for x in zip(shape, name, kind, strict=True)]))
    return pd.DataFrame({"field_profile_id": profile, "value_hash": _long(value_hashes(kind.tolist(), text.tolist()))})


def hll_place(precision: int):  # noqa: ANN201
    """A function of a value hash: its HyperLogLog register and rank."""

    @F.pandas_udf(_struct(register=T.IntegerType(), rank=T.IntegerType()))
    def place(h: pd.Series) -> pd.DataFrame:
        x = mix64(h.to_numpy(np.int64).view(np.uint64))
        rest, most = x << np.uint64(precision), 64 - precision + 1
        zeros = np.full(len(x), 64, np.int64)
        high, low = (rest >> np.uint64(32)).astype(np.float64), (rest & np.uint64(0xFFFFFFFF)).astype(np.float64)
        zeros = np.where(high > 0, 32 - np.frexp(high)[1], np.where(low > 0, 64 - np.frexp(low)[1], 64))
        return pd.DataFrame({"register": (x >> np.uint64(64 - precision)).astype(np.int32), "rank": np.minimum(zeros + 1, most).astype(np.int32)})

    return place


def with_shape_ids(objects: DataFrame) -> DataFrame:
    ids = shape_ids("canonical_path", "site_path", "schema_path", "field_set_json", "type_set_json").alias("ids")
    return objects.withColumn("ids", ids).select("*", "ids.field_set_hash", "ids.type_set_hash", "ids.shape_id").drop("ids")
