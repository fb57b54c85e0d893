"""Structural references: which canonical path and schema the object at a site has.

A SQLite file with nine tables (only their names are checked) or a folder of Parquet tables.
"""

from __future__ import annotations

import json
import os
import sqlite3
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The nine tables of a references file: fixed values.
REQUIRED_TABLES = (
    "schema_paths",
    "array_index_refs",
    "schema_definitions",
    "schema_object_counts",
    "schema_field_counts",
    "schema_site_counts",
    "schema_site_field_counts",
    "schema_site_presence_shapes",
    "schema_site_presence_shape_limits",
)
TRUNCATED = "W_REFS_PRESENCE_SHAPES_TRUNCATED"
#: Columns that are read, by table.
_READ = {
    "schema_paths": "schema_path string, object_path string",
    "schema_site_counts": "site_path string, schema_path string",
    "schema_site_presence_shape_limits": "schema_path string, site_path string, site_kind string, truncated long",
    "schema_site_presence_shapes": "schema_path string, site_path string, site_kind string, present_fields_json string",
}


@dataclass
class Refs:
    """``contexts`` (site_path, canonical_path, schema_path), ``seeds`` of presence shapes, ``paths``."""

    contexts: DataFrame
    seeds: DataFrame
    paths: DataFrame
    truncated: bool = False
    warnings: list[tuple[str, str]] = field(default_factory=list)


def _tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    if os.path.isdir(path) or "://" in path:
        missing = [t for t in REQUIRED_TABLES if not _exists(spark, f"{path}/{t}") and not _exists(spark, f"{path}/{t}.parquet")]
        if missing:
            raise ValueError(f"refs database is missing required table: {missing[0]}")
        return {t: spark.read.parquet(f"{path}/{t}" if _exists(spark, f"{path}/{t}") else f"{path}/{t}.parquet") for t in _READ}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        have = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        for t in REQUIRED_TABLES:
            if t not in have:
                raise ValueError(f"refs database is missing required table: {t}")
        out = {}
        for t, kind in _READ.items():
            names = [c.split()[0] for c in kind.split(", ")]
            rows = pd.DataFrame(db.execute(f"SELECT {', '.join(names)} FROM {t}").fetchall(), columns=names)
            out[t] = spark.createDataFrame(rows, kind) if len(rows) else spark.createDataFrame([], kind)
        return out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def site_contexts(counts: DataFrame, paths: DataFrame) -> DataFrame:
    """One context per site; of several, that of the last schema and object path.

    The canonical path is the schema's object path, or the schema's own path if it has none.
    """
    joined = counts.select("site_path", "schema_path").join(paths.select("schema_path", "object_path"), "schema_path", "left")
    last = F.max(F.struct("schema_path", "object_path")).alias("last")
    return joined.groupBy("site_path").agg(last).select("site_path", F.coalesce("last.object_path", "last.schema_path").alias("canonical_path"), F.col("last.schema_path").alias("schema_path"))


def presence_seeds(shapes: DataFrame, limits: DataFrame, paths: DataFrame) -> DataFrame:
    """Field sets that the references know, with their site's truncation mark."""
    keys = ["schema_path", "site_path", "site_kind"]
    cut = limits.filter("truncated <> 0").select(*keys).distinct().withColumn("cut", F.lit(True))
    path = paths.groupBy("schema_path").agg(F.max("object_path").alias("object_path"))
    return (
        shapes.join(cut, keys, "left")
        .join(path, "schema_path", "left")
        .select(
            F.coalesce("object_path", "schema_path").alias("canonical_path"),
            "site_path",
            "schema_path",
            F.from_json("present_fields_json", "array<string>").alias("field_names"),
            F.coalesce("cut", F.lit(False)).alias("truncated"),
        )
    )


def load_refs(spark: SparkSession, path: str) -> Refs:
    t = _tables(spark, path)
    bad = [r for r in t["schema_site_presence_shapes"].select("site_path", "present_fields_json").filter(F.from_json("present_fields_json", "array<string>").isNull()).take(1)]
    for r in bad:
        try:
            json.loads(r["present_fields_json"])
            why = "not a list of names"
        except (TypeError, ValueError) as e:
            why = str(e)
        raise ValueError(f"invalid refs presence shape field list for {r['site_path']}: {why}")
    limits = t["schema_site_presence_shape_limits"]
    cut = not limits.filter("truncated <> 0").isEmpty()
    return Refs(
        site_contexts(t["schema_site_counts"], t["schema_paths"]),
        presence_seeds(t["schema_site_presence_shapes"], limits, t["schema_paths"]),
        t["schema_paths"],
        cut,
        [(TRUNCATED, "refs database indicates truncated site presence shapes")] if cut else [],
    )
