"""Whole profiles of small inputs, by both scanners."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tests.conftest import INPUTS, jsonl
from valuegrain import ProfileConfig, profile, profile_documents
from valuegrain.plans.diagnose import diagnose
from valuegrain.sources.sinks import ORDER, columns, folder_sizes, read_parquet, read_sqlite, sqlite_sizes, write_parquet, write_sqlite

#: documents, objects, arrays, scalars, canonical paths, sites, shapes, field profiles, stored values
GOLDEN = {
    "basic_json": (1, 3, 1, 6, 2, 3, 3, 7, 7),
    "heterogeneous_shape": (1, 3, 1, 6, 1, 3, 3, 6, 6),
    "heterogeneous_array": (1, 4, 1, 9, 2, 4, 4, 10, 10),
    "basic_jsonl": (3, 3, 0, 6, 1, 1, 1, 2, 5),
    "empty_string": (3, 3, 0, 3, 1, 1, 2, 2, 3),
    "empty_then_full": (2, 4, 0, 2, 2, 2, 3, 3, 4),
    "exact": (4, 4, 0, 4, 1, 1, 1, 1, 3),
}


def approximate():
    c = ProfileConfig()
    c.value_profile.exact_distinct_threshold, c.value_profile.exact_value_bytes_per_field_profile = 16, 4096
    c.value_profile.hll_precision, c.value_profile.heavy_hitter_limit = 10, 8
    return c


def run(spark, tmp_path, name, refs=None, config=None):
    file, text = INPUTS[name]
    (tmp_path / file).write_text(text)
    return profile(spark, str(tmp_path / file), config, refs)


@pytest.mark.parametrize("scanner", ["native", "strict"])
@pytest.mark.parametrize("name", list(GOLDEN))
def test_totals(spark, tmp_path, refs_path, name, scanner):
    result = run(spark, tmp_path, name, refs_path, ProfileConfig(scanner=scanner))
    assert tuple(result["prof_source_summary"].first())[1:] == GOLDEN[name]


def test_ids(spark, tmp_path, refs_path):
    basic = run(spark, tmp_path, "basic_jsonl", refs_path)
    assert basic.warnings == []
    assert [r["shape_id"] for r in basic["prof_shape"].collect()] == ["1a2f0639a36627c7"]
    assert {r["field_name"]: r["field_profile_id"] for r in basic["prof_shape_field"].collect()} == {"id": "12fd979c89b83ed1", "status": "9354b69cad049fa5"}
    exact = run(spark, tmp_path, "exact", refs_path)
    assert [r["shape_id"] for r in exact["prof_shape"].collect()] == ["47806ff1f720361f"]
    rows = exact["prof_field_value"].orderBy("rank").collect()
    assert [(r["value_text"], r["count"], r["rank"]) for r in rows] == [("A", 2, 1), ("B", 1, 2), ("C", 1, 3)]
    assert rows[0]["value_hash"] == "cbfc13ec058f1d94" and rows[0]["field_profile_id"] == "13435b9b6c3d6943"


@pytest.mark.parametrize("mode", ["sequential", "exact"])
def test_approximate(spark, tmp_path, refs_path, mode):
    config = approximate()
    config.heavy_hitters = mode
    result = run(spark, tmp_path, "approximate", refs_path, config)
    s = result["prof_field_summary"].first()
    assert (s["distinct_count"], s["distinct_count_method"], s["distinct_algorithm"], s["distinct_error_rate"], s["stored_value_count"]) == (24, "approximate", "hyperloglog", 0.0325, 8)
    rows = result["prof_field_value"].orderBy("rank").collect()
    assert {(r["count_method"], r["value_source"], r["is_complete_distribution"]) for r in rows} == {("approximate", "heavy_hitter", 0)}
    if mode == "sequential":
        assert [(r["value_text"], r["count"]) for r in rows] == [(f"v{i:06d}", 3) for i in range(17, 25)]
    else:
        assert [r["count"] for r in rows] == [1] * 8


def test_empties(spark, tmp_path, refs_path):
    result = run(spark, tmp_path, "empty_string", refs_path)
    sums = result["prof_field_summary"].join(result["prof_shape_field"].select("field_profile_id", "observed_type"), "field_profile_id").collect()
    by = {r["observed_type"]: r for r in sums}
    assert (by["null"]["null_count"], by["null"]["non_null_count"], by["null"]["distinct_count"]) == (1, 0, 1)
    assert (by["string"]["empty_string_count"], by["string"]["non_null_count"]) == (1, 2)
    full = run(spark, tmp_path, "empty_then_full", refs_path)
    samples = full["prof_object_sample"].filter("canonical_path = '$.payload' AND sample_scope = 'canonical_path'").collect()
    first = {r["sample_kind"]: (r["document_index"], r["sample_json"], r["sample_is_empty_object"]) for r in samples}
    assert first["first_seen"] == (0, "{}", 1)
    assert first["first_non_empty"] == (1, '{"id":1,"name":"Ada"}', 0)
    values = full["prof_field_value_sample"].filter("source_path = '$.payload'").collect()
    kinds = {(r["value_json"], r["sample_kind"]) for r in values}
    assert ("{}", "first_seen") in kinds and ("{}", "first_non_empty") not in kinds


def test_unresolved_warning(spark, tmp_path, refs_path):
    (tmp_path / "x.json").write_text('{"other": {"a": 1}, "payload": {}}')
    result = profile(spark, str(tmp_path / "x.json"), refs=refs_path)
    assert result.warnings == [("W_CANONICAL_PATH_UNAVAILABLE", "refs database did not contain an exact context for source path $.other")]
    shape = {r["site_path"]: (r["canonical_path"], r["schema_path"]) for r in result["prof_shape"].collect()}
    assert shape["$.other"] == ("$.other", "unknown") and shape["$.payload"] == ("$.payload", "refs/payload.json")


MIXED = [{"id": i, "k": ["a", "b"][i % 2], "n": {"x": i % 3, "t": [1, {"y": None}]}, "big": 2**63 + i, "f": [0.5, 100.0, 1e20, 1e-5][i % 4], "s": "é\"\n"} for i in range(40)]


def snapshot(result):
    return {t: sorted(map(tuple, result[t].select(*columns(t)).collect()), key=str) for t in ORDER}


def test_partitions_and_order_change_nothing(spark):
    rows = [(i, json.dumps(d)) for i, d in enumerate(MIXED)]
    docs = spark.createDataFrame(rows, "doc_idx long, raw string")
    one = snapshot(profile_documents(docs.coalesce(1)))
    assert snapshot(profile_documents(docs.orderBy(F.desc("doc_idx")).repartition(7))) == one
    d = diagnose(profile_documents(docs).tables)
    assert d.status == "ok" and d.risks == []


def test_scanners_agree(spark):
    plain = [{k: v for k, v in d.items()} for d in MIXED]
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(plain)], "doc_idx long, raw string")
    assert snapshot(profile_documents(docs, ProfileConfig(scanner="native"))) == snapshot(profile_documents(docs, ProfileConfig(scanner="strict")))


def test_sample_bounds(spark):
    c = ProfileConfig()
    c.sampling.site_priority_limit, c.sampling.type_set_priority_limit, c.sampling.value_priority_limit_per_field_profile = 0, 2, 3
    docs = spark.createDataFrame([(i, json.dumps({"a": i})) for i in range(50)], "doc_idx long, raw string")
    r = profile_documents(docs, c)
    counts = {x["sample_scope"]: x["count"] for x in r["prof_object_sample"].filter("sample_kind = 'priority_sample'").groupBy("sample_scope").count().collect()}
    assert counts == {"canonical_path": 1, "field_set": 2, "type_set": 2}
    values = r["prof_field_value_sample"].filter("sample_kind = 'priority_sample'").orderBy("sample_rank").collect()
    assert [v["sample_rank"] for v in values] == [1, 2, 3]
    assert [v["sample_priority"] for v in values] == sorted(v["sample_priority"] for v in values)
    assert r["prof_field_value_sample"].filter("sample_kind = 'heavy_hitter_context'").isEmpty()


def test_sinks(spark, tmp_path, refs_path):
    result = run(spark, tmp_path, "heterogeneous_array", refs_path)
    want = snapshot(result)
    write_sqlite(result.tables, str(tmp_path / "out" / "p.sqlite"))
    write_sqlite(result.tables, str(tmp_path / "out" / "p.sqlite"))
    db = sqlite3.connect(tmp_path / "out" / "p.sqlite")
    have = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    assert have == set(ORDER) and not db.execute("SELECT 1 FROM sqlite_master WHERE type = 'view'").fetchall()
    assert len(db.execute("SELECT 1 FROM sqlite_master WHERE type = 'index' AND name LIKE 'idx_%'").fetchall()) == 14
    with pytest.raises(sqlite3.IntegrityError):
        db.execute("INSERT INTO prof_object_sample SELECT 'new', sample_scope, sample_key, canonical_path, site_path, schema_path, field_set_hash, type_set_hash, shape_id, sample_kind, document_index, source_path, sample_json, 0, 0, 0, NULL, NULL FROM prof_object_sample WHERE sample_kind = 'first_seen' LIMIT 1")
    db.close()
    assert snapshot(read_sqlite(spark, str(tmp_path / "out" / "p.sqlite"))) == want
    write_parquet(result.tables, str(tmp_path / "pq"))
    back = read_parquet(spark, str(tmp_path / "pq"))
    assert snapshot(back) == want
    assert diagnose(back).risks == []
    sizes = folder_sizes(spark, str(tmp_path / "pq"))
    assert len(sizes) == 7 and sizes == sorted(sizes, key=lambda x: -x[1]) and sizes[-1][1] > 0
    assert len(sqlite_sizes(str(tmp_path / "out" / "p.sqlite"), 3)) in (0, 3)


def test_diagnose_finds_risks(spark, tmp_path):
    docs = spark.createDataFrame([(0, '{"a": 1}')], "doc_idx long, raw string")
    tables = dict(profile_documents(docs).tables)
    more = tables["prof_field_value_sample"].filter("sample_kind = 'priority_sample'").crossJoin(spark.range(9)).drop("id")
    tables["prof_field_value_sample"] = more.withColumn("sample_kind", F.when(F.rand(1) < 0.3, "heavy_hitter_context").otherwise(F.col("sample_kind")))
    tables["prof_shape"] = tables["prof_shape"].limit(0)
    risks = " ".join(diagnose(tables).risks)
    assert "value priority samples exceed" in risks and "heavy_hitter_context rows exist" in risks and "do not exist" in risks
    assert diagnose({k: v for k, v in tables.items() if k != "prof_shape"}).risks == ["missing table prof_shape"]


def test_empty_input(spark):
    for scanner in ("native", "strict"):
        r = profile_documents(spark.createDataFrame([], "doc_idx long, raw string"), ProfileConfig(scanner=scanner))
        assert tuple(r["prof_source_summary"].first())[1:] == (0,) * 9
        assert r["prof_field_value"].count() == r["prof_object_sample"].count() == 0
    assert "prof_field_summary is empty" in " ".join(diagnose(r.tables).risks)


def test_jsonl_line_numbers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_bytes(b'{"a":1}\r\n\n  \t\n' + b'{"a":2}\n' * 3 + " \n[1,{}]".encode())
    from valuegrain.sources.documents import read_jsonl

    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = sorted(map(tuple, read_jsonl(spark, str(tmp_path / "m.jsonl")).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == [(0, '{"a":1}'), (3, '{"a":2}'), (4, '{"a":2}'), (5, '{"a":2}'), (7, "[1,{}]")]


def test_heterogeneous_site(spark):
    docs = spark.createDataFrame([(0, jsonl({"v": 1}).strip()), (1, '{"v":"x"}'), (2, '{"w":1}')], "doc_idx long, raw string")
    shapes = profile_documents(docs)["prof_shape"].collect()
    assert len(shapes) == 3 and len({s["field_set_hash"] for s in shapes}) == 2
    assert {(s["field_set_json"], s["type_set_json"]) for s in shapes} == {('["v"]', '[["v","integer"]]'), ('["v"]', '[["v","string"]]'), ('["w"]', '[["w","integer"]]')}
