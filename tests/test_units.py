"""Functions, options, references, sketches, the command line, the entry points."""

import json
import math
import random
import struct
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import INPUTS, SITES, make_refs
from valuegrain import cli
from valuegrain.config import ConfigError, ProfileConfig, load_yaml
from valuegrain.functions import hashing, json_columns, json_text
from valuegrain.operators.values import SpaceSaving, decide, hll_estimates, relative_error, value_counts
from valuegrain.operators.walk import scan_native, scan_strict, walk
from valuegrain.sources.documents import from_table, resolve_format
from valuegrain.sources.refs import load_refs

# ------------------------------------------------------------------ hashes


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


@given(st.lists(st.text(max_size=40), max_size=30))
def test_fnv(texts):
    assert hashing.fnv64(texts).tolist() == hashing.fnv64_distinct(texts).tolist() == [fnv(t) for t in texts]


def test_hash_goldens(spark):
    want = {"a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8", '["id"]': "87b249783a3b5ff8", "한글": "5900dac74a762e41", "": "cbf29ce484222325", 'Integer("1")': "69c1bb522e2413b3", "Null": "8629c5c653f17cc4"}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r["t"]: r["h"] for r in df.select("t", hashing.hex64(hashing.fnv64_expr(F.col("t"))).alias("h")).collect()} == want
    assert {t: f"{h:016x}" for t, h in zip(want, hashing.fnv64(want), strict=True)} == want


def test_mix64():
    def slow(v):
        v ^= v >> 33
        v = v * 0xFF51AFD7ED558CCD % 2**64
        v ^= v >> 33
        v = v * 0xC4CEB9FE1A85EC53 % 2**64
        return v ^ (v >> 33)

    x = np.random.default_rng(0).integers(0, 2**64 - 1, 100, dtype=np.uint64)
    assert hashing.mix64(x).tolist() == [slow(int(v)) for v in x]


# ------------------------------------------------------------------ JSON text

NUMBERS = {0.0: "0.0", 100.0: "100.0", 1e20: "1e20", 1.5e300: "1.5e300", 1e16: "1e16", 1e15: "1000000000000000.0", 1e-5: "0.00001", 1e-6: "1e-6", 1.25e-7: "1.25e-7", -2.5: "-2.5", 123456789012345680.0: "1.2345678901234568e17"}


def test_number_text(spark):
    assert {x: json_text.number_text(x) for x in NUMBERS} == NUMBERS and json_text.number_text(-0.0) == "-0.0"
    df = spark.createDataFrame([(x,) for x in NUMBERS if x], "x double")
    assert all(r["t"] == NUMBERS[r["x"]] for r in df.select("x", json_columns.number_text(F.col("x")).alias("t")).collect())


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_number_text_round_trip(x):
    assert struct.pack("d", float(json_text.number_text(x))) == struct.pack("d", x)


JSON = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4), max_leaves=12)


@given(JSON)
@settings(max_examples=200)
def test_canonical_text(value):
    value, odd = json_text.decode(json.dumps(value))
    text = json_text.canonical(value, odd)
    assert json.loads(text) == value and json_text.canonical(*json_text.decode(text)) == text == json_text.canonical(value, True)


@pytest.mark.parametrize("text", ["", "{", "NaN", "[Infinity]", '{"a":1} x', "1e999", "'a'", '"\x01"', "[" * 200 + "]" * 200])
def test_not_json(text):
    with pytest.raises(json_text.JsonError):
        walk(*json_text.decode(text))


def test_decoding():
    assert json_text.decode('{"a":1,"a":2}')[0] == {"a": 2}  # the last one counts
    big = json_text.decode("[18446744073709551615, 18446744073709551616, -9223372036854775808, -9223372036854775809, -0]")[0]
    assert [json_text.type_of(x) for x in big] == ["integer", "number", "integer", "number", "number"]
    assert json_text.key_text("string", 'a"\ń\0') == 'String("a\\"\\n\\u{301}\\0")'
    assert [json_text.key_text(k, t, "h") for k, t in (("null", "null"), ("boolean", "true"), ("integer", "1"), ("number", "1.5"), ("array", "[]"), ("string", "it's"))] == [
        "Null", "Bool(true)", 'Integer("1")', 'Number("1.5")', 'ArrayHash("h")', 'String("it\'s")',
    ]


def test_truncation(spark):
    rows = [("가나다", 4, "가", 1), ("가나다", 9, "가나다", 0), ("abc", 2, "ab", 1), ("é", 1, "", 1), ("", 3, "", 0), ("a😀b", 4, "a", 1), ("a😀b", 5, "a😀", 1)]
    for text, limit, want, flag in rows:
        df = spark.createDataFrame([(text,)], "t string").select(json_columns.truncate_utf8(F.col("t"), limit).alias("x"), json_columns.truncated(F.col("t"), limit).alias("f"))
        assert tuple(df.first()) == (want, flag)


def test_quote(spark):
    texts = ['a"b', "\\", "\n\t\r\b\f", "\x01\x1f", "é😀", "", "/"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(json_columns.quote(F.col("t"))).collect()]
    assert got == [json_text.quoted(t) for t in texts]


# ------------------------------------------------------------------ scans


def test_walk():
    objects, arrays, scalars = walk(*json_text.decode('{"items":[{"id":1,"tags":["a",null]},{"id":2}],"active":true,"empty":{}}'))
    assert (len(objects), arrays, scalars) == (4, 2, 5)
    assert [(o[1], o[2]) for o in objects] == [("$", "$"), ("$.empty", "$.empty"), ("$.items[0]", "$.items[]"), ("$.items[1]", "$.items[]")]
    assert walk([1, {"nested": True}], False)[1:] == (1, 2) and walk(5, False) == ([], 0, 1)


def test_scans_agree_on_odd_documents(spark):
    raw = ['{"b":{"y":1,"x":[]},"a.b":"é\\u0001","z":[[1,{}],null]}', "3", "[]", "null", '"s"', '{"":""}', '[{"a":[{"b":{}}]}]', '{"n":1.50,"u":18446744073709551615,"e":1e3}']
    docs = spark.createDataFrame(list(enumerate(raw)), "doc_idx long, raw string")
    pick = lambda df: sorted(map(str, df.select("doc_idx", "path", "canon", "json", "fields", "field_set_json", "type_set_json", "n_arrays", "n_scalars").collect()))
    assert pick(scan_native(docs)) == pick(scan_strict(docs))


def test_bad_document_stops_the_run(spark):
    with pytest.raises(Exception, match="json parse error: document 1"):
        scan_strict(spark.createDataFrame([(0, "{}"), (1, "{]")], "doc_idx long, raw string")).collect()


def test_tables_as_documents(spark):
    df = from_table(spark.createDataFrame([(1, "x", None)], "k long, b string, a int"), "k")
    assert tuple(df.first()) == (1, '{"a":null,"b":"x"}')
    assert [resolve_format(p, *a) for p, *a in (("a.JSONL",), ("a.json",), ("a", "auto", True), ("a.jsonl", "json"))] == ["jsonl", "json", "jsonl", "json"]


# ------------------------------------------------------------------ sketches


class SlowSpaceSaving:
    def __init__(self, limit):
        self.limit, self.c = limit, {}

    def observe(self, k):
        if k in self.c:
            self.c[k][0] += 1
        elif len(self.c) < self.limit:
            self.c[k] = [1, 0]
        else:
            v = min(self.c, key=lambda x: (self.c[x][0], x))
            n = self.c.pop(v)[0]
            self.c[k] = [n + 1, n]


@given(st.lists(st.sampled_from("abcdefghij"), max_size=80), st.integers(1, 5))
def test_space_saving(keys, limit):
    fast, slow = SpaceSaving(limit), SlowSpaceSaving(limit)
    for k in keys:
        fast.observe(k)
        slow.observe(k)
    assert {k: c for k, *c in fast.top()} == {k: c for k, c in slow.c.items()}
    assert [x[0] for x in fast.top()] == sorted(slow.c, key=lambda k: (-slow.c[k][0], k))


def slow_hll(hashes, p):
    m = 1 << p
    reg = [0] * m
    for h in hashes:
        h = int(hashing.mix64(np.array([h], np.uint64))[0])
        rest = (h << p) % 2**64
        reg[h >> (64 - p)] = max(reg[h >> (64 - p)], min(64 - rest.bit_length() + 1, 64 - p + 1))
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    raw, zeros = alpha * m * m / sum(2.0**-r for r in reg), reg.count(0)
    return round(m * math.log(m / zeros) if raw <= 2.5 * m and zeros else raw)


@pytest.mark.parametrize(("p", "n"), [(4, 3), (4, 500), (10, 100), (14, 3000)])
def test_hll(spark, p, n):
    hashes = hashing.fnv64([f'String("v{i}")' for i in range(n)])
    df = spark.createDataFrame([("f", int(h)) for h in hashes.view(np.int64)], "field_profile_id string, value_hash long")
    assert hll_estimates(df, p).first()["estimate"] == slow_hll(hashes.tolist(), p)
    assert relative_error(10) == 0.0325


def test_exact_limits(spark):
    from valuegrain.config import ValueProfile

    rows = [("few", i % 2, "string", "ab") for i in range(9)] + [("many", i, "integer", str(i)) for i in range(20)] + [("wide", i, "string", "x" * 60) for i in range(2)]
    fields = spark.createDataFrame([("s", name, kind, f"{i}{text}") for name, i, kind, text in rows], "shape_id string, field_name string, observed_type string, text string")
    names = {f"{fnv(hashing.UNIT.join(('s', name, kind))):016x}": name for name, _, kind, _ in rows}
    limits = ValueProfile(exact_distinct_threshold=10, exact_value_bytes_per_field_profile=100)
    got = {names[r["field_profile_id"]]: (r["n_values"], r["is_exact"]) for r in decide(value_counts(fields), limits).collect()}
    assert got == {"few": (2, True), "many": (20, False), "wide": (2, False)}


# ------------------------------------------------------------------ references


def test_refs(spark, tmp_path, refs_path):
    refs = load_refs(spark, refs_path)
    assert {r["site_path"]: (r["canonical_path"], r["schema_path"]) for r in refs.contexts.collect()} == SITES
    assert [tuple(r) for r in refs.seeds.collect()] == [("$", "$", "refs/root.json", ["id"], False)] and refs.warnings == []
    cut = load_refs(spark, make_refs(tmp_path / "cut.sqlite", truncated=1))
    assert cut.warnings == [("W_REFS_PRESENCE_SHAPES_TRUNCATED", "refs database indicates truncated site presence shapes")] and cut.seeds.first()["truncated"]
    with pytest.raises(ValueError, match="refs database is missing required table: schema_site_counts"):
        load_refs(spark, make_refs(tmp_path / "less.sqlite", without=("schema_site_counts",)))
    with pytest.raises(ValueError, match="invalid refs presence shape field list for \\$"):
        load_refs(spark, make_refs(tmp_path / "bad.sqlite", fields="{"))


# ------------------------------------------------------------------ options


def test_defaults_and_yaml(tmp_path):
    c = ProfileConfig()
    assert (c.value_profile.hll_precision, c.value_profile.heavy_hitter_limit, c.sampling.type_set_priority_limit, c.out) == (14, 128, 4, "profile.sqlite")
    (tmp_path / "c.yaml").write_text("input: {file: x, format: JSONL}\nsampling: {object: {site_path: {priority_sample_limit: 9, first_seen: false}}, value: {chunk_flush_rows: 7}}\nvalue_profile: {hll_precision: 9}\nperf: {file: p.log}\n")
    y = load_yaml(c, str(tmp_path / "c.yaml"))
    assert (y.input_format, y.sampling.site_priority_limit, y.flush.chunk_value_sample_rows, y.value_profile.hll_precision, y.perf_log) == ("jsonl", 9, 7, 9, True)
    assert c.sampling.site_priority_limit == 1 and c.value_profile.hll_precision == 14
    args = cli.parser().parse_args(["in.jsonl", "--config", str(tmp_path / "c.yaml"), "--hll-precision", "8", "-o", "o"])
    assert (cli.config_of(args).value_profile.hll_precision, cli.config_of(args).sampling.site_priority_limit, cli.config_of(args).out) == (8, 9, "o")
    for bad in ("nope: 1", "flush: {x: 1}", "input: {format: csv}", "value_profile: {hll_precision: many}", "value_profile: {hll_precision: -1}", "- 1", "a: [", "sampling: 3"):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises(ConfigError):
            load_yaml(c, str(tmp_path / "bad.yaml"))
    with pytest.raises(ConfigError, match="failed to read config"):
        load_yaml(c, str(tmp_path / "none.yaml"))


@pytest.mark.parametrize(("owner", "name", "value", "says"), [
    ("value_profile", "hll_precision", 3, "between 4 and 18"), ("value_profile", "hll_precision", 19, "between 4 and 18"), ("value_profile", "heavy_hitter_limit", 0, "heavy_hitter_limit must be > 0"),
    ("value_profile", "exact_distinct_threshold", 128, "greater than heavy_hitter_limit"), ("sampling", "type_set_priority_limit", 0, "type_set"), ("flush", "chunk_field_rows", 0, "chunk_field_rows"),
    ("value_profile", "global_exact_value_bytes_budget", 0, "global_exact"), ("sampling", "parent_object_json_limit_bytes", 0, "parent object"),
])
def test_checks(owner, name, value, says):
    c = ProfileConfig()
    setattr(getattr(c, owner), name, value)
    with pytest.raises(ConfigError, match=says):
        c.validate()


def test_zero_limits_that_are_allowed():
    c = ProfileConfig()
    c.sampling.canonical_priority_limit = c.sampling.site_priority_limit = c.sampling.field_set_priority_limit = 0
    c.validate()


# ------------------------------------------------------------------ command line


def test_command_line(spark, tmp_path, refs_path, capsys):
    file, text = INPUTS["basic_json"]
    (tmp_path / file).write_text(text)
    out = str(tmp_path / "p.sqlite")
    assert cli.main([str(tmp_path / file), "--refs", refs_path, "-o", out, "--perf-log-file", str(tmp_path / "perf.log"), "--perf-log-dbstat"], spark) == 0
    got = capsys.readouterr()
    assert got.out.splitlines()[:11] == [f"valuegrain: wrote {out}", "", "documents: 1", "objects: 3", "arrays: 1", "scalars: 6", "canonical_paths: 2", "site_paths: 3", "shapes: 3", "field_profiles: 7", "stored_values: 7"] and got.err == ""
    log = (tmp_path / "perf.log").read_text()
    assert all(f"bucket.{n}" in log for n in ("refs.load", "scan.walk", "scan.fields", "scan.flush_values", "sqlite.flush", "total"))
    assert cli.main(["--diagnose", "--fail-on-risk", out], spark) == 0 and "status=ok" in capsys.readouterr().out
    (tmp_path / "u.json").write_text('{"other":{}}')
    assert cli.main([str(tmp_path / "u.json"), "--refs", refs_path, "-o", str(tmp_path / "pq"), "--quiet"], spark) == 0
    got = capsys.readouterr()
    assert got.out == "" and got.err.startswith("WARNING W_CANONICAL_PATH_UNAVAILABLE ")


def test_diagnosis_of_broken_files(spark, tmp_path, refs_path, capsys):
    import sqlite3

    (tmp_path / "a.jsonl").write_text('{"a":1}\n{"a":2}\n')
    out, folder = str(tmp_path / "p.sqlite"), str(tmp_path / "pq")
    for to in (out, folder):
        assert cli.main([str(tmp_path / "a.jsonl"), "--refs", refs_path, "-o", to, "--quiet"], spark) == 0
    capsys.readouterr()
    assert cli.main(["--diagnose", "--fail-on-risk", folder], spark) == 0
    assert "== sizes" in (got := capsys.readouterr().out) and "status=ok" in got
    assert cli.main(["--diagnose", "--fail-on-risk", "--value-sample-limit", "1", "--type-set-limit", "1", "--top", "1", out], spark) == 2
    got = capsys.readouterr().out
    assert "RISK value priority samples exceed" in got and "RISK object priority samples exceed" in got and "risk_count=2" in got
    with sqlite3.connect(out) as db:
        db.execute("CREATE TABLE prof_run (x)")
        db.execute("CREATE VIEW v AS SELECT 1")
        db.execute("DROP TABLE prof_field_value")
    db.close()
    assert cli.main(["--diagnose", out], spark) == 0 and cli.main(["--diagnose", "--fail-on-risk", out], spark) == 2
    got = capsys.readouterr().out
    assert all(f"RISK {x}" in got for x in ("missing table prof_field_value", "forbidden table prof_run", "view v"))


def test_command_line_errors(spark, tmp_path, refs_path, capsys):
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n{]\n')
    for args, says in ((["-"], "stdin is not supported"), (["none.json"], "input path is not a file"), ([str(tmp_path / "bad.jsonl"), "--refs", "none"], "refs sqlite path is not a file"), ([str(tmp_path / "bad.jsonl"), "--refs", refs_path, "--hll-precision", "2"], "hll_precision"), ([str(tmp_path / "bad.jsonl"), "--refs", refs_path, "-o", str(tmp_path / "x.sqlite")], "json parse error")):
        assert cli.main(args, spark) == 1
        got = capsys.readouterr()
        assert got.out == "" and got.err.startswith("ERROR ") and says in got.err
    assert not (tmp_path / "x.sqlite").exists()


# ------------------------------------------------------------------ streaming


def test_incremental(spark, tmp_path):
    from valuegrain.plans.profile import profile
    from valuegrain.streaming.incremental import merged, start

    rng, source, state = random.Random(1), tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    docs = [{"id": i, "k": rng.choice("abc"), "o": {"x": rng.randrange(3)}} for i in range(60)]
    for part in range(3):
        (source / f"{part}.jsonl").write_text("".join(json.dumps(d) + "\n" for d in docs[20 * part : 20 * part + 20]))
        start(spark, str(source), state).awaitTermination()
    got, whole = merged(spark, state), profile(spark, str(source), ProfileConfig(input_format="jsonl", heavy_hitters="exact"))
    for name, cols in (("prof_source_summary", None), ("prof_shape", ["shape_id", "object_count"]), ("prof_shape_field", None), ("prof_field_summary", None), ("prof_field_value", None)):
        a, b = (sorted(map(str, (df.select(*cols) if cols else df.select(*got[name].columns)).collect())) for df in (got[name], whole[name]))
        assert a == b
    for name, keys in (("prof_object_sample", ["sample_scope", "sample_key", "sample_kind"]), ("prof_field_value_sample", ["field_profile_id", "sample_kind"])):
        a, b = (Counter(tuple(r) for r in df.select(*keys).collect()) for df in (got[name], whole[name]))
        assert a == b
    one = profile(spark, str(source / "0.jsonl"), ProfileConfig(input_format="jsonl", heavy_hitters="exact"))
    low = [r["document_index"] % 2**38 for r in merged(spark, state)["prof_object_sample"].filter("sample_kind = 'first_seen'").collect()]
    assert low and max(low) < 20 and one["prof_shape"].count()


# ------------------------------------------------------------------ entry points


def test_entry_points(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and "field_summary" in queries
    assert __spark_entry__.entry(spark).count() == 1


def test_queries_against_duckdb(spark):
    import duckdb

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    db, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("events", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    text = lambda rows: sorted(tuple("" if v is None else str(v) for v in r) for r in rows)
    for name in ("scan_node_counts", "path_inventory", "shape_counts", "field_summary_nested", "exact_distribution", "hll_estimate", "object_samples", "value_samples", "source_summary", "stable_hash"):
        df, want = queries[name](spark, folder), db.execute(oracles[name])
        cols = sorted(df.columns)
        assert sorted(c[0] for c in want.description) == cols
        frame = want.df()
        assert len(frame) == df.count()
        assert text(map(tuple, df.select(*cols).collect())) == text(db.execute(f"SELECT {', '.join(cols)} FROM ({oracles[name]})").fetchall())


def test_rest_works_without_the_llm_part(tmp_path):
    """A copy of the repository without the subpackage, its tests and the pipeline still imports."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)
