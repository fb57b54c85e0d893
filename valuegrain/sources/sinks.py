"""Where profiles go: Parquet folders, or one SQLite file with keys, checks and indexes.

The SQLite form is for profiles that one file can hold; rows stream from the executors partition by
partition, so the driver holds one partition at a time.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

# Columns of the seven tables with their SQLite types and constraints: fixed values of the artifact.
_FLAG = "INTEGER NOT NULL DEFAULT 0 CHECK ({0} IN (0, 1))"
_COUNT = "INTEGER CHECK ({0} >= 0)"
_TOTAL = "INTEGER NOT NULL CHECK ({0} >= 0)"
_ZERO = "INTEGER NOT NULL DEFAULT 0 CHECK ({0} >= 0)"
_TYPE = "TEXT NOT NULL CHECK ({0} IN ('null','boolean','integer','number','string','object','array','unknown'))"
_OF_FIELD = "TEXT NOT NULL REFERENCES prof_shape_field(field_profile_id)"
SCHEMA: dict[str, dict[str, str]] = {
    "prof_source_summary": {
        "source_format": "TEXT NOT NULL CHECK ({0} IN ('json', 'jsonl', 'unknown'))",
        **{f"total_{n}_count": _COUNT for n in ("document", "object", "array", "scalar", "canonical_path", "site_path", "shape", "field_profile", "stored_value")},
    },
    "prof_object_sample": {
        "object_sample_id": "TEXT PRIMARY KEY",
        "sample_scope": "TEXT NOT NULL CHECK ({0} IN ('canonical_path', 'site_path', 'field_set', 'type_set'))",
        "sample_key": "TEXT NOT NULL",
        "canonical_path": "TEXT NOT NULL",
        "site_path": "TEXT",
        "schema_path": "TEXT",
        "field_set_hash": "TEXT",
        "type_set_hash": "TEXT",
        "shape_id": "TEXT",
        "sample_kind": "TEXT NOT NULL CHECK ({0} IN ('first_seen', 'first_non_empty', 'priority_sample'))",
        "document_index": "INTEGER",
        "source_path": "TEXT",
        "sample_json": "TEXT NOT NULL",
        "sample_json_truncated": _FLAG,
        "sample_is_empty_object": _FLAG,
        "sample_is_empty_array": _FLAG,
        "sample_priority": "INTEGER",
        "sample_rank": "INTEGER",
    },
    "prof_shape": {
        "shape_id": "TEXT PRIMARY KEY",
        "canonical_path": "TEXT NOT NULL",
        "site_path": "TEXT",
        "schema_path": "TEXT NOT NULL",
        "field_set_hash": "TEXT NOT NULL",
        "type_set_hash": "TEXT NOT NULL",
        "field_set_json": "TEXT NOT NULL",
        "type_set_json": "TEXT NOT NULL",
        "object_count": _TOTAL,
        "first_seen_document_index": "INTEGER",
        "first_seen_path": "TEXT",
    },
    "prof_shape_field": {
        "field_profile_id": "TEXT PRIMARY KEY",
        "shape_id": "TEXT NOT NULL REFERENCES prof_shape(shape_id)",
        "field_name": "TEXT NOT NULL",
        "observed_type": _TYPE,
        "observed_count": _TOTAL,
        "null_count": _ZERO,
    },
    "prof_field_summary": {
        "field_profile_id": "TEXT PRIMARY KEY REFERENCES prof_shape_field(field_profile_id)",
        "profiled_count": _TOTAL,
        "null_count": _ZERO,
        "non_null_count": _ZERO,
        "empty_object_count": _ZERO,
        "empty_array_count": _ZERO,
        "empty_string_count": _ZERO,
        "distinct_count": _COUNT,
        "distinct_count_method": "TEXT NOT NULL CHECK ({0} IN ('exact','approximate','unavailable'))",
        "distinct_algorithm": "TEXT CHECK ({0} IN ('hyperloglog'))",
        "distinct_error_rate": "REAL",
        "stored_value_count": _ZERO,
    },
    "prof_field_value": {
        "field_profile_id": _OF_FIELD,
        "value_hash": "TEXT NOT NULL",
        "value_type": _TYPE,
        "value_text": "TEXT",
        "value_text_truncated": _FLAG,
        "count": _COUNT,
        "count_method": "TEXT NOT NULL CHECK ({0} IN ('exact','approximate','sampled','unavailable'))",
        "value_source": "TEXT NOT NULL CHECK ({0} IN ('exact_full','exact_selected','heavy_hitter','sampled'))",
        "rank": "INTEGER",
        "is_complete_distribution": _FLAG,
        "": "PRIMARY KEY (field_profile_id, value_hash, value_source)",
    },
    "prof_field_value_sample": {
        "value_sample_id": "TEXT PRIMARY KEY",
        "field_profile_id": _OF_FIELD,
        "value_hash": "TEXT",
        "sample_kind": "TEXT NOT NULL CHECK ({0} IN ('first_seen','first_non_empty','priority_sample','heavy_hitter_context'))",
        "document_index": "INTEGER",
        "source_path": "TEXT",
        "value_json": "TEXT",
        "value_json_truncated": _FLAG,
        "parent_object_json": "TEXT",
        "parent_object_json_truncated": _FLAG,
        "sample_priority": "INTEGER",
        "sample_rank": "INTEGER",
    },
}
# Name, table and columns of each index: fixed values of the artifact.
INDEXES = (
    ("idx_prof_object_sample_key", "prof_object_sample", "sample_scope, sample_key, sample_rank"),
    ("idx_prof_object_sample_shape", "prof_object_sample", "shape_id, sample_rank"),
    ("idx_prof_shape_canonical", "prof_shape", "canonical_path, object_count DESC"),
    ("idx_prof_shape_site", "prof_shape", "site_path, object_count DESC"),
    ("idx_prof_shape_schema", "prof_shape", "schema_path, object_count DESC"),
    ("idx_prof_shape_field_set", "prof_shape", "field_set_hash"),
    ("idx_prof_shape_type_set", "prof_shape", "type_set_hash"),
    ("idx_prof_shape_field_name", "prof_shape_field", "field_name"),
    ("idx_prof_field_value_count", "prof_field_value", "field_profile_id, count DESC"),
    ("idx_prof_field_value_hash", "prof_field_value", "value_hash"),
    ("idx_prof_field_value_sample_field", "prof_field_value_sample", "field_profile_id, sample_rank"),
    ("idx_prof_field_value_sample_hash", "prof_field_value_sample", "value_hash"),
)
UNIQUE_INDEXES = (
    ("idx_prof_object_sample_once", "prof_object_sample", "sample_scope, sample_key, sample_kind", "WHERE sample_kind IN ('first_seen', 'first_non_empty')"),
    ("idx_prof_shape_field_unique", "prof_shape_field", "shape_id, field_name, observed_type", ""),
)
#: Tables that others refer to come first.
ORDER = ("prof_shape", "prof_shape_field", "prof_field_summary", "prof_field_value", "prof_field_value_sample", "prof_object_sample", "prof_source_summary")


def columns(table: str) -> list[str]:
    return [c for c in SCHEMA[table] if c]


def create_schema(db: sqlite3.Connection) -> None:
    for table, cols in SCHEMA.items():
        body = ", ".join(f"{name} {kind.format(name)}" if name else kind for name, kind in cols.items())
        db.execute(f"CREATE TABLE {table} ({body})")


def create_indexes(db: sqlite3.Connection) -> None:
    for name, table, cols in INDEXES:
        db.execute(f"CREATE INDEX IF NOT EXISTS {name} ON {table}({cols})")
    for name, table, cols, where in UNIQUE_INDEXES:
        db.execute(f"CREATE UNIQUE INDEX IF NOT EXISTS {name} ON {table}({cols}) {where}")


def write_parquet(tables: Mapping[str, DataFrame], path: str) -> None:
    """One folder per table, replacing what is there."""
    for name in ORDER:
        tables[name].write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read_parquet(spark: SparkSession, path: str, names: Iterable[str] = ORDER) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in names}


def folder_catalog(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(kind, name) of the tables of a Parquet profile."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(("table", x.getPath().getName()) for x in found if x.isDirectory())


def write_sqlite(tables: Mapping[str, DataFrame], path: str) -> None:
    """A new file at ``path``; parents are made, an old file is replaced."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    for old in (path, f"{path}-wal", f"{path}-shm"):
        if os.path.exists(old):
            os.remove(old)
    with sqlite3.connect(path) as db:
        db.execute("PRAGMA journal_mode = WAL")
        db.execute("PRAGMA foreign_keys = ON")
        create_schema(db)
        for name in ORDER:
            cols = columns(name)
            rows = (tuple(r) for r in tables[name].select(*cols).toLocalIterator(prefetchPartitions=True))
            db.executemany(f"INSERT OR IGNORE INTO {name} ({', '.join(cols)}) VALUES ({', '.join('?' * len(cols))})", rows)
        create_indexes(db)
    db.close()


def sqlite_catalog(path: str) -> list[tuple[str, str]]:
    """(kind, name) of the tables and views of a file."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return db.execute("SELECT type, name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall()


def read_sqlite(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Those of the seven tables and of their columns that a file has, as DataFrames."""
    out = {}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        for name in ORDER:
            there = {r[1] for r in db.execute(f"PRAGMA table_info({name})")}
            cols = [c for c in columns(name) if c in there]
            if cols:
                kind = ", ".join(f"`{c}` {_spark_type(SCHEMA[name][c])}" for c in cols)
                rows = db.execute(f"SELECT {', '.join(cols)} FROM {name}").fetchall()
                out[name] = spark.createDataFrame(rows, kind)
    return out


def _spark_type(kind: str) -> str:
    return "int" if kind == _FLAG else "long" if kind.startswith("INTEGER") else "double" if kind.startswith("REAL") else "string"


def sqlite_sizes(path: str, limit: int = 8) -> list[tuple[str, int]]:
    """The largest tables and indexes of a file by bytes; empty where SQLite can't tell."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        try:
            return db.execute("SELECT name, SUM(pgsize) AS bytes FROM dbstat GROUP BY name ORDER BY bytes DESC LIMIT ?", (limit,)).fetchall()
        except sqlite3.OperationalError:
            return []


def folder_sizes(spark: SparkSession, path: str, limit: int = 8) -> list[tuple[str, int]]:
    """The same for a Parquet profile, by folder."""
    jvm = spark.sparkContext._jvm
    found = []
    for name in ORDER:
        p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(p):
            found.append((name, fs.getContentSummary(p).getLength()))
    return sorted(found, key=lambda x: -x[1])[:limit]
