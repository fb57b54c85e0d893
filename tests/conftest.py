"""A shared session and small inputs."""

import json
import os
import sqlite3
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


#: site path: (canonical path, schema path)
SITES = {
    "$": ("$", "refs/root.json"),
    **{f"$[{i}]": ("$[]", "refs/root_array_item.json") for i in range(3)},
    **{f"$.documents[{i}]": ("$.documents[]", "refs/documents_item.json") for i in range(2)},
    **{f"$.items[{i}]": ("$.items[]", "refs/items_item.json") for i in range(3)},
    "$.payload": ("$.payload", "refs/payload.json"),
    "$.payload.nested": ("$.payload.nested", "refs/payload_nested.json"),
}
REF_TABLES = {
    "schema_paths": "schema_path TEXT, object_path TEXT PRIMARY KEY",
    "array_index_refs": "array_path TEXT, array_index_path TEXT, schema_path TEXT",
    "schema_definitions": "schema_path TEXT PRIMARY KEY, schema_kind TEXT, schema_json TEXT",
    "schema_object_counts": "schema_path TEXT PRIMARY KEY, object_count INTEGER",
    "schema_field_counts": "schema_path TEXT, field_name TEXT, field_type TEXT, field_count INTEGER",
    "schema_site_counts": "schema_path TEXT, site_path TEXT, site_kind TEXT, object_count INTEGER",
    "schema_site_field_counts": "schema_path TEXT, site_path TEXT, site_kind TEXT, field_name TEXT, schema_field_type TEXT, present_count INTEGER, missing_count INTEGER",
    "schema_site_presence_shapes": "schema_path TEXT, site_path TEXT, site_kind TEXT, present_fields_hash TEXT, present_fields_json TEXT, missing_fields_json TEXT, object_count INTEGER, first_array_index_path TEXT",
    "schema_site_presence_shape_limits": "schema_path TEXT, site_path TEXT, site_kind TEXT, observed_shape_count INTEGER, stored_shape_count INTEGER, truncated INTEGER",
}


def make_refs(path, without=(), truncated=0, fields='["id"]'):
    db = sqlite3.connect(path)
    for table, cols in REF_TABLES.items():
        if table not in without:
            db.execute(f"CREATE TABLE {table} ({cols})")
    if not without:
        db.executemany("INSERT INTO schema_paths VALUES (?, ?)", sorted({(s, c) for c, s in SITES.values()}))
        db.executemany("INSERT INTO schema_site_counts VALUES (?, ?, 'object', 1)", [(s, site) for site, (_, s) in SITES.items()])
        db.execute("INSERT INTO schema_site_presence_shapes VALUES ('refs/root.json', '$', 'object', 'h', ?, '[]', 1, NULL)", (fields,))
        db.execute("INSERT INTO schema_site_presence_shape_limits VALUES ('refs/root.json', '$', 'object', 1, 1, ?)", (truncated,))
    db.commit()
    db.close()
    return str(path)


@pytest.fixture(scope="session")
def refs_path(tmp_path_factory):
    return make_refs(tmp_path_factory.mktemp("refs") / "refs.sqlite")


def jsonl(*docs):
    return "".join(json.dumps(d, ensure_ascii=False) + "\n" for d in docs)


#: name: (file name, text)
INPUTS = {
    "basic_json": ("a.json", json.dumps({"documents": [{"id": 1, "status": "A", "amount": 10}, {"id": 2, "status": "B", "amount": 20}]})),
    "heterogeneous_shape": ("b.json", json.dumps([{"id": 1, "amount": 5}, {"id": 2, "amount": "five"}, {"id": 3, "error": "none"}])),
    "heterogeneous_array": ("c.json", json.dumps({"items": [{"id": 1, "type": "a", "amount": 5}, {"id": 2, "type": "b", "amount": "five"}, {"id": 3, "type": "c", "error": "none"}]})),
    "basic_jsonl": ("d.jsonl", jsonl({"id": 1, "status": "A"}, {"id": 2, "status": "B"}, {"id": 3, "status": "A"})),
    "empty_string": ("e.jsonl", jsonl({"code": None}, {"code": ""}, {"code": "X"})),
    "empty_then_full": ("f.jsonl", jsonl({"payload": {}}, {"payload": {"id": 1, "name": "Ada"}})),
    "exact": ("g.jsonl", jsonl(*({"status": s} for s in "ABAC"))),
    "approximate": ("h.jsonl", jsonl(*({"id": f"v{i:06d}"} for i in range(1, 25)))),
}
