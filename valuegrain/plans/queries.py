"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows.

Documents come from two places: ``events.props`` (flat JSON texts) and nested documents built from
``orders`` and ``lineitem`` (arrays, optional fields, empty objects and strings).  The SQL derives
its rows from the relational tables, not from JSON, so it checks the scan as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import ProfileConfig, Sampling, ValueProfile
from ..functions.hashing import fnv64_expr, hex64
from ..functions.json_columns import truncate_utf8, truncated
from ..functions.paths import materialize
from ..operators import samples, values
from ..operators.context import resolve
from ..operators.fields import explode_fields, shape_fields, summary_counts, with_field_ids
from ..operators.ids import SCOPES, fnv_hex
from ..operators.shapes import shapes
from ..operators.walk import nodes, scan
from ..sources.documents import from_column
from ..sources.refs import presence_seeds, site_contexts
from . import diagnose as d
from .profile import object_frame, profile_documents

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = ProfileConfig(heavy_hitters="exact")


# ------------------------------------------------------------------ documents


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_column(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "props")


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order: its items as an array, fields that are absent in some, empties."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(n, "o_orderkey")  # one shuffle each, for group and join
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(n, "l_orderkey")
    item = F.struct(
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("qty"), F.when(F.col("l_returnflag") == "R", "R").alias("ret")
    )
    items = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    memo = F.when(F.col("o_orderkey") % 10 == 0, "").alias("memo")
    meta = F.struct(F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("prio")).alias("meta")
    parts = F.struct(F.coalesce("items", F.array().cast("array<struct<line:int,part:bigint,qty:int,ret:string>>")).alias("items"), F.col("o_orderkey").alias("key"), memo, meta, F.col("o_orderstatus").alias("status"))
    return orders.join(items, orders["o_orderkey"] == items["l_orderkey"], "left").select(F.col("o_orderkey").alias("doc_idx"), F.to_json(parts).alias("raw"))


#: The same documents as rows: objects (doc, path, canon, fset, tset) and fields (…, name, type, text).
ORDER_SQL = """
i AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity::INT, CASE WHEN l_returnflag = 'R' THEN 'R' END NULLS FIRST) - 1 AS p,
             l_linenumber AS line, l_partkey AS part, l_quantity::INT AS qty, l_returnflag = 'R' AS ret FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
o AS (SELECT o_orderkey AS doc, o_orderkey % 10 = 0 AS memo, o_orderstatus AS status, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS prio FROM orders),
obj AS (
  SELECT doc, '$' AS path, '$' AS canon, 0 AS seq,
         CASE WHEN memo THEN '["items","key","memo","meta","status"]' ELSE '["items","key","meta","status"]' END AS fset,
         CASE WHEN memo THEN '[["items","array"],["key","integer"],["memo","string"],["meta","object"],["status","string"]]'
              ELSE '[["items","array"],["key","integer"],["meta","object"],["status","string"]]' END AS tset FROM o
  UNION ALL
  SELECT doc, '$.meta', '$.meta', 1000, CASE WHEN prio IS NULL THEN '[]' ELSE '["prio"]' END, CASE WHEN prio IS NULL THEN '[]' ELSE '[["prio","string"]]' END FROM o
  UNION ALL
  SELECT doc, '$.items[' || p || ']', '$.items[]', 1 + p, CASE WHEN ret THEN '["line","part","qty","ret"]' ELSE '["line","part","qty"]' END,
         CASE WHEN ret THEN '[["line","integer"],["part","integer"],["qty","integer"],["ret","string"]]' ELSE '[["line","integer"],["part","integer"],["qty","integer"]]' END FROM i),
t AS (
  SELECT doc, '$' AS path, 'key' AS name, 'integer' AS type, doc::VARCHAR AS text FROM o
  UNION ALL SELECT doc, '$', 'status', 'string', status FROM o
  UNION ALL SELECT doc, '$', 'memo', 'string', '' FROM o WHERE memo
  UNION ALL SELECT doc, '$', 'meta', 'object', CASE WHEN prio IS NULL THEN '{}' ELSE '{"prio":"' || prio || '"}' END FROM o
  UNION ALL SELECT o.doc, '$', 'items', 'array', '[' || coalesce(string_agg('{"line":' || line || ',"part":' || part || ',"qty":' || qty || CASE WHEN ret THEN ',"ret":"R"' ELSE '' END || '}', ',' ORDER BY p), '') || ']' FROM o LEFT JOIN i ON o.doc = i.doc GROUP BY o.doc
  UNION ALL SELECT doc, '$.meta', 'prio', 'string', prio FROM o WHERE prio IS NOT NULL
  UNION ALL SELECT doc, '$.items[' || p || ']', 'line', 'integer', line::VARCHAR FROM i
  UNION ALL SELECT doc, '$.items[' || p || ']', 'part', 'integer', part::VARCHAR FROM i
  UNION ALL SELECT doc, '$.items[' || p || ']', 'qty', 'integer', qty::VARCHAR FROM i
  UNION ALL SELECT doc, '$.items[' || p || ']', 'ret', 'string', 'R' FROM i WHERE ret),
f AS (SELECT t.*, obj.canon, obj.tset, t.path || '.' || t.name AS field_path FROM t JOIN obj ON t.doc = obj.doc AND t.path = obj.path)
"""


def sql_fnv(text: str) -> str:
    """FNV-1a of a text in DuckDB, as UHUGEINT."""
    raw = f"hex(encode({text}))"
    data = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr({raw}, (2 * i + 1)::BIGINT, 2))::UHUGEINT)"
    return f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, {data}), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def sql_hex(text: str) -> str:
    return f"lpad(lower(to_hex(({sql_fnv(text)})::UBIGINT)), 16, '0')"


def sql_key(kind: str, text: str) -> str:
    """The text a value's hash is taken of; texts here need no escapes but quotes inside containers."""
    return f"CASE {kind} WHEN 'string' THEN 'String(\"' || {text} || '\")' WHEN 'integer' THEN 'Integer(\"' || {text} || '\")' WHEN 'object' THEN 'ObjectHash(\"' || {sql_hex(text)} || '\")' ELSE 'ArrayHash(\"' || {sql_hex(text)} || '\")' END"


U = "chr(31)"


# ------------------------------------------------------------------ frames that queries share


def order_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_frame(order_docs(spark, sf_dir))


def order_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_fields(order_objects(spark, sf_dir))


def event_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_frame(event_docs(spark, sf_dir))


# ------------------------------------------------------------------ scans and paths


def scan_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by type, from VARIANT values."""
    return nodes(order_docs(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n_nodes"))


def path_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(order_docs(spark, sf_dir)).groupBy("canon", "kind", "depth").agg(F.count("*").alias("n_nodes"), F.count_distinct("path").alias("n_paths"))


def resolve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("$", "$", "refs/order.json"), ("$.items[0]", "$.items[]", "refs/item.json"), ("$.items[1]", "$.items[]", "refs/item.json")], "site_path string, canonical_path string, schema_path string")
    found = resolve(scan(order_docs(spark, sf_dir)).filter("path IS NOT NULL"), known)
    return found.groupBy("canonical_path", "site_path", "schema_path", "resolved").agg(F.count("*").alias("n_objects"))


# ------------------------------------------------------------------ shapes and fields


def shape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(order_objects(spark, sf_dir))


def shape_field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(shapes(order_objects(spark, sf_dir)))
    named = shape_fields(found).join(found.select("shape_id", "site_path"), "shape_id")
    return named.select("field_profile_id", "site_path", "field_name", "observed_type", "observed_count", "null_count")


def field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and distinct values of every field profile of ``events.props``."""
    objects = materialize(event_objects(spark, sf_dir))
    counts = materialize(values.value_counts(explode_fields(objects)))
    options = ValueProfile(exact_distinct_threshold=2**40, exact_value_bytes_per_field_profile=2**60)  # all exact
    decided = values.decide(counts, options)
    stored = values.distributions(explode_fields(objects), counts, decided, options, "exact")
    told = values.field_summaries(summary_counts(counts), counts, decided, stored, options)
    sums = told.drop("distinct_count_method", "distinct_algorithm", "distinct_error_rate", "stored_value_count")
    names = shape_fields(shapes(objects)).select("field_profile_id", "field_name", "observed_type")
    return names.join(sums, "field_profile_id").drop("field_profile_id")


def field_summary_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = materialize(values.value_counts(order_fields(spark, sf_dir)))
    return summary_counts(counts).join(counts.groupBy("field_profile_id").agg(F.count("*").alias("distinct_count"), F.sum("bytes").alias("value_bytes")), "field_profile_id")


# ------------------------------------------------------------------ values


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    fields = order_fields(spark, sf_dir)
    counts = materialize(values.value_counts(fields))
    return fields, counts, values.decide(counts, ValueProfile())


def exact_or_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)[2]


def exact_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, counts, decided = _decided(spark, sf_dir)
    stored = values.distributions(fields, counts, decided, ValueProfile(), "exact").filter("value_source = 'exact_full'")
    return stored.select("field_profile_id", "value_hash", "value_type", "value_text", "count", "rank")


def hll_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, counts, _ = _decided(spark, sf_dir)
    whole = counts.groupBy("field_profile_id").agg(F.count("*").alias("n_values"))
    return values.hll_estimates(counts.select("field_profile_id", "value_hash"), 10).join(whole, "field_profile_id")


def heavy_hitters_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent values of every field profile; ties by the values' keys."""
    found = values.heavy_hitters_exact(values.value_counts(order_fields(spark, sf_dir)), 5)
    return found.select("field_profile_id", "observed_type", "text", "n", "rank")


def heavy_hitters_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = values.heavy_hitters_sequential(order_fields(spark, sf_dir), ValueProfile().heavy_hitter_limit)
    return found.select("field_profile_id", hex64(F.col("value_hash")).alias("value_hash"), "observed_type", "text", "n", "rank")


def heavy_hitter_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the most frequent line numbers stand first; the threshold of 3 makes them approximate."""
    fields = materialize(with_field_ids(order_fields(spark, sf_dir).filter("field_name = 'qty'")))
    counts = materialize(values.value_counts(fields))
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy("field_profile_id").orderBy(F.desc("n"), F.col("text").cast("long")))).filter("r <= 3")
    stored = ranked.select("field_profile_id", hex64(F.col("value_hash")).alias("value_hash"), F.lit("heavy_hitter").alias("value_source"))
    return samples.heavy_hitter_context(fields, stored, 2).select("field_profile_id", "value_hash", "document_index", "source_path", "sample_rank")


def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field types by canonical path, from the strict scan."""
    scanned = scan(order_docs(spark, sf_dir)).filter("path IS NOT NULL")
    return scanned.select("canon", F.inline("fields")).groupBy("canon", F.col("name").alias("field_name"), F.col("type").alias("observed_type")).agg(F.count("*").alias("n"))


def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays, scalars and objects of every document."""
    scanned = scan(order_docs(spark, sf_dir))
    return scanned.groupBy("doc_idx").agg(F.max("n_arrays").alias("n_arrays"), F.max("n_scalars").alias("n_scalars"), F.count("path").alias("n_objects"))


def value_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("props")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", truncate_utf8(text, 8).alias("value_text"), truncated(text, 8).alias("value_text_truncated"))


def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash as a column expression and as an Arrow-batched function."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", hex64(fnv64_expr(F.col("props"))).alias("by_expression"), fnv_hex(F.col("props")).alias("by_batch"))


# ------------------------------------------------------------------ samples


def _ranked() -> tuple[Column, Column]:
    """Without nulls, so that 63-bit numbers stay whole wherever nullable numbers become floats."""
    return F.coalesce(F.col("sample_priority").cast("string"), F.lit("")).alias("sample_priority"), F.coalesce("sample_rank", F.lit(0)).alias("sample_rank")


def object_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = samples.object_samples(event_objects(spark, sf_dir), Sampling())
    return found.select("object_sample_id", "sample_scope", "sample_key", "sample_kind", "document_index", "sample_json", *_ranked())


def object_samples_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = samples.object_samples(order_objects(spark, sf_dir), Sampling()).filter("sample_kind <> 'priority_sample'")
    return found.select("sample_scope", "sample_key", "sample_kind", "document_index", "source_path", "sample_is_empty_object")


def value_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = samples.value_samples(event_objects(spark, sf_dir), Sampling())
    return found.select("value_sample_id", "field_profile_id", "value_hash", "sample_kind", "document_index", "value_json", "parent_object_json", *_ranked())


def sample_keys_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample keys of all objects that are no keys of the objects with fields."""
    found = materialize(samples.object_samples(order_objects(spark, sf_dir), Sampling()))
    keys = found.select("sample_scope", "sample_key").distinct()
    return keys.subtract(found.filter("sample_kind = 'first_non_empty'").select("sample_scope", "sample_key"))


# ------------------------------------------------------------------ whole profiles and diagnostics


def _whole(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return profile_documents(order_docs(spark, sf_dir), CONFIG, None, "unknown").tables


def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir)["prof_source_summary"]


def diag_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.row_counts(_whole(spark, sf_dir))


def diag_sample_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.object_sample_kinds(samples.object_samples(order_objects(spark, sf_dir), Sampling()))


def diag_value_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.value_sources(_whole(spark, sf_dir)["prof_field_value"])


def diag_distinct_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.distinct_methods(_whole(spark, sf_dir)["prof_field_summary"])


def diag_top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.top_paths(shapes(order_objects(spark, sf_dir)), "canonical_path", 20)


def diag_priority_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most priority samples that any key of a scope has."""
    found = samples.object_samples(order_objects(spark, sf_dir), Sampling())
    above_none = d.object_priority_violations(found, dict.fromkeys(SCOPES, 0))
    return above_none.groupBy("sample_scope").agg(F.max("rows").alias("most"), F.count("*").alias("n_keys"))


def diag_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.orphans(_whole(spark, sf_dir))


def profile_field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All summaries of a whole profile; estimates are left to ``hll_estimate``."""
    found = _whole(spark, sf_dir)["prof_field_summary"]
    exact = F.when(F.col("distinct_count_method") == "exact", F.col("distinct_count")).otherwise(-1)
    return found.withColumn("distinct_count", exact).withColumn("distinct_error_rate", F.coalesce("distinct_error_rate", F.lit(0.0))).withColumn("distinct_algorithm", F.coalesce("distinct_algorithm", F.lit("")))


def diag_value_sample_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.value_sample_kinds(samples.value_samples(event_objects(spark, sf_dir), Sampling()))


def diag_value_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field profiles with more priority values than a limit of three, which the default of four allows."""
    return d.value_priority_violations(samples.value_samples(order_objects(spark, sf_dir), Sampling()), 3)


def diag_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context rows of each field profile, and how many of its values have more than one."""
    places = materialize(heavy_hitter_context(spark, sf_dir).withColumn("sample_kind", F.lit(d.CONTEXT)))
    more = d.context_duplicates(places, 1).groupBy("field_profile_id").agg(F.count("*").alias("above_one"))
    return d.context_rows(places).join(more, "field_profile_id", "left").withColumn("above_one", F.coalesce("above_one", F.lit(0)))


def diag_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of a profile that lost the shapes of ``$.meta`` and the fields named ``qty``."""
    tables = dict(_whole(spark, sf_dir))
    tables["prof_shape"] = tables["prof_shape"].filter("canonical_path <> '$.meta'")
    tables["prof_shape_field"] = tables["prof_shape_field"].filter("field_name <> 'qty'")
    return d.orphans(tables)


def diag_shapes_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes without a first sample, where those of array items are lost."""
    objects = materialize(order_objects(spark, sf_dir))
    found = samples.object_samples(objects, Sampling()).filter("canonical_path <> '$.items[]'")
    return d.shapes_without_first_seen({"prof_shape": shapes(objects), "prof_object_sample": found}).select("shape_id", "canonical_path", "object_count")


# ------------------------------------------------------------------ references

REF_COUNTS = [("$", "s/root"), ("$.items[0]", "s/item"), ("$.items[0]", "s/old"), ("$.x", "s/none")]
REF_PATHS = [("s/root", "$"), ("s/item", "$.items[]"), ("s/old", "$.a[]")]
REF_SHAPES = [("s/root", "$", "object", '["id","name"]'), ("s/item", "$.items[0]", "array_item", "[]"), ("s/none", "$.x", "object", '["k"]')]
REF_LIMITS = [("s/root", "$", "object", 1), ("s/item", "$.items[0]", "array_item", 0)]


def refs_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_contexts(spark.createDataFrame(REF_COUNTS, "site_path string, schema_path string"), spark.createDataFrame(REF_PATHS, "schema_path string, object_path string"))


def refs_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = "schema_path string, site_path string, site_kind string, "
    seeds = presence_seeds(
        spark.createDataFrame(REF_SHAPES, keys + "present_fields_json string"), spark.createDataFrame(REF_LIMITS, keys + "truncated long"), spark.createDataFrame(REF_PATHS, "schema_path string, object_path string")
    )
    return seeds.select("canonical_path", "site_path", "schema_path", F.array_join("field_names", "|").alias("field_names"), "truncated")


def _values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join(str(r) for r in rows)}) AS v({names})"


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        scan_node_counts, path_inventory, resolve_context, shape_counts, shape_field_counts, field_summary, field_summary_nested, exact_or_approximate, exact_distribution,
        hll_estimate, heavy_hitters_top, heavy_hitters_sequential, heavy_hitter_context, type_distribution, document_counts, value_text, stable_hash, object_samples, object_samples_first, value_samples, sample_keys_except,
        source_summary, diag_row_counts, diag_sample_kinds, diag_value_sources, diag_distinct_methods, diag_top_paths, diag_priority_bounds, diag_orphans, profile_field_summary, diag_value_sample_kinds, diag_value_priority, diag_contexts, diag_broken, diag_shapes_unseen, refs_contexts, refs_seeds,
    )
}

#: Distinct shapes with their ids.
_SHAPES = f"""
k AS (SELECT DISTINCT path, canon, fset, tset FROM obj),
kh AS (SELECT *, {sql_hex('fset')} AS fh, {sql_hex('tset')} AS th FROM k),
sh AS (SELECT *, {sql_hex(f"canon || {U} || path || {U} || 'unknown' || {U} || fh || {U} || th")} AS shape_id FROM kh)
"""
#: Field profiles with their ids; value counts.
_FIELDS = f"""
fk AS (SELECT DISTINCT f.path, f.tset, f.name, f.type, sh.shape_id FROM f JOIN sh ON f.path = sh.path AND f.tset = sh.tset),
fp AS (SELECT *, {sql_hex(f"shape_id || {U} || name || {U} || type")} AS fp FROM fk),
fv AS (SELECT f.*, fp.fp FROM f JOIN fp ON f.path = fp.path AND f.tset = fp.tset AND f.name = fp.name AND f.type = fp.type),
vc AS (SELECT fp, type, text, count(*) AS n, strlen(text) AS bytes FROM fv GROUP BY ALL),
dd AS (SELECT fp, count(*) AS n_values, count(*) <= 4096 AND sum(bytes) <= 1048576 AS is_exact FROM vc GROUP BY fp)
"""
_NODES = f"""
WITH {ORDER_SQL.strip()},
n AS (SELECT canon, path, 'object' AS kind, CASE WHEN path = '$' THEN 0 WHEN path = '$.meta' THEN 1 ELSE 2 END AS depth FROM obj
      UNION ALL SELECT CASE WHEN canon = '$.items[]' THEN '$.items[].' || name ELSE field_path END, field_path, type,
                       CASE WHEN path = '$' THEN 1 WHEN path = '$.meta' THEN 2 ELSE 3 END FROM f WHERE type <> 'object')
"""
_EVENT = f"""
WITH e AS (SELECT event_id AS doc, props FROM events WHERE props IS NOT NULL),
w AS (SELECT DISTINCT {sql_hex("'[' || chr(34) || 'k' || chr(34) || ']'")} AS fh, {sql_hex("'[[' || chr(34) || 'k' || chr(34) || ',' || chr(34) || 'integer' || chr(34) || ']]'")} AS th),
x AS (SELECT *, {sql_hex(f"'$' || {U} || '$' || {U} || 'unknown' || {U} || fh || {U} || th")} AS shape_id FROM w),
c AS (SELECT doc, (props->>'k') AS k, '{{"k":' || (props->>'k') || '}}' AS js FROM e)
"""

ORACLES: dict[str, str] = {
    "scan_node_counts": f"{_NODES} SELECT kind, count(*) AS n_nodes FROM n GROUP BY kind",
    "path_inventory": f"{_NODES} SELECT canon, kind, depth, count(*) AS n_nodes, count(DISTINCT path) AS n_paths FROM n GROUP BY ALL",
    "resolve_context": f"""WITH {ORDER_SQL.strip()}, r AS (SELECT * FROM (VALUES ('$', '$', 'refs/order.json'), ('$.items[0]', '$.items[]', 'refs/item.json'), ('$.items[1]', '$.items[]', 'refs/item.json')) AS v(site, canonical, schema))
        SELECT coalesce(canonical, canon) AS canonical_path, coalesce(site, path) AS site_path, coalesce(schema, 'unknown') AS schema_path, site IS NOT NULL AS resolved, count(*) AS n_objects
        FROM obj LEFT JOIN r ON obj.path = r.site GROUP BY ALL""",
    "shape_counts": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}
        SELECT shape_id, sh.canon AS canonical_path, sh.path AS site_path, 'unknown' AS schema_path, fh AS field_set_hash, th AS type_set_hash, sh.fset AS field_set_json, sh.tset AS type_set_json,
               count(*) AS object_count, min(doc) AS first_seen_document_index, sh.path AS first_seen_path
        FROM obj JOIN sh ON obj.path = sh.path AND obj.tset = sh.tset GROUP BY ALL""",
    "shape_field_counts": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()}
        SELECT fp AS field_profile_id, path AS site_path, name AS field_name, type AS observed_type, count(*) AS observed_count, 0::BIGINT AS null_count FROM fv GROUP BY ALL""",
    "field_summary": """
        SELECT 'k' AS field_name, 'integer' AS observed_type, count(*) AS profiled_count, 0::BIGINT AS null_count, count(*) AS non_null_count, 0::BIGINT AS empty_object_count, 0::BIGINT AS empty_array_count,
               0::BIGINT AS empty_string_count, count(DISTINCT props->>'k') AS distinct_count FROM events WHERE props IS NOT NULL""",
    "field_summary_nested": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()},
        s AS (SELECT fp AS field_profile_id, count(*) AS profiled_count, 0::BIGINT AS null_count, count(*) AS non_null_count, count(*) FILTER (type = 'object' AND text = '{{}}') AS empty_object_count,
                     count(*) FILTER (type = 'array' AND text = '[]') AS empty_array_count, count(*) FILTER (type = 'string' AND text = '') AS empty_string_count FROM fv GROUP BY fp)
        SELECT s.*, v.distinct_count, v.value_bytes FROM s JOIN (SELECT fp, count(*) AS distinct_count, sum(bytes)::BIGINT AS value_bytes FROM vc GROUP BY fp) v ON s.field_profile_id = v.fp""",
    "exact_or_approximate": f"WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()} SELECT fp AS field_profile_id, n_values, is_exact FROM dd",
    "exact_distribution": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()},
        e AS (SELECT vc.*, {sql_key('vc.type', 'vc.text')} AS vk FROM vc JOIN dd ON vc.fp = dd.fp WHERE is_exact), h AS (SELECT *, {sql_hex('vk')} AS value_hash FROM e)
        SELECT fp AS field_profile_id, value_hash, type AS value_type, text AS value_text, n AS count, (row_number() OVER (PARTITION BY fp ORDER BY n DESC, value_hash))::INT AS rank FROM h""",
    "hll_estimate": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()},
        k0 AS (SELECT fp, {sql_key('type', 'text')} AS vk FROM vc), h0 AS (SELECT fp, {sql_fnv('vk')} AS h FROM k0),
        h1 AS (SELECT fp, xor(h, h >> 33) AS h FROM h0), h2 AS (SELECT fp, ((h % 4294967296) * 18397679294719823053::UHUGEINT + (((h >> 32) * 18397679294719823053::UHUGEINT) % 4294967296) * 4294967296) % 18446744073709551616::UHUGEINT AS h FROM h1),
        h3 AS (SELECT fp, xor(h, h >> 33) AS h FROM h2), h4 AS (SELECT fp, ((h % 4294967296) * 14181476777654086739::UHUGEINT + (((h >> 32) * 14181476777654086739::UHUGEINT) % 4294967296) * 4294967296) % 18446744073709551616::UHUGEINT AS h FROM h3),
        h5 AS (SELECT fp, xor(h, h >> 33) AS h FROM h4),
        p AS (SELECT fp, h >> 54 AS reg, least(55, 64 - length(ltrim(bin(((h % 18014398509481984::UHUGEINT) * 1024)::UBIGINT), '0')) + 1) AS rk FROM h5),
        g AS (SELECT fp, reg, max(rk) AS rk FROM p GROUP BY fp, reg),
        z AS (SELECT fp, count(*) AS used, sum(pow(2.0, -rk)) AS inv FROM g GROUP BY fp),
        r AS (SELECT fp, 1024 - used AS zeros, (0.7213 / (1 + 1.079 / 1024)) * 1024 * 1024 / (inv + 1024 - used) AS raw FROM z)
        SELECT r.fp AS field_profile_id, round(CASE WHEN raw <= 2.5 * 1024 AND zeros > 0 THEN 1024 * ln(1024.0 / zeros) ELSE raw END)::BIGINT AS estimate, dd.n_values FROM r JOIN dd ON r.fp = dd.fp""",
    "heavy_hitters_top": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()},
        tk AS (SELECT *, CASE WHEN type IN ('object', 'array') THEN {sql_hex('text')} ELSE text END AS sk FROM vc),
        q AS (SELECT fp AS field_profile_id, type AS observed_type, text, n, (row_number() OVER (PARTITION BY fp ORDER BY n DESC, sk))::INT AS rank FROM tk) SELECT * FROM q WHERE rank <= 5""",
    "heavy_hitter_context": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()},
        q AS (SELECT fp, text, row_number() OVER (PARTITION BY fp ORDER BY n DESC, text::BIGINT) AS r FROM vc WHERE fp IN (SELECT fp FROM fp WHERE name = 'qty')),
        c AS (SELECT fv.fp, fv.text, fv.doc, fv.field_path, (row_number() OVER (PARTITION BY fv.fp, fv.text ORDER BY doc, field_path))::INT AS k FROM fv JOIN q ON fv.fp = q.fp AND fv.text = q.text WHERE q.r <= 3)
        SELECT fp AS field_profile_id, {sql_hex("'Integer(' || chr(34) || text || chr(34) || ')'")} AS value_hash, doc AS document_index, field_path AS source_path, k AS sample_rank FROM c WHERE k <= 2""",
    "type_distribution": f"WITH {ORDER_SQL.strip()} SELECT canon, name AS field_name, type AS observed_type, count(*) AS n FROM f GROUP BY ALL",
    "document_counts": f"""WITH {ORDER_SQL.strip()}, a AS (SELECT doc, count(*) FILTER (type = 'array') AS n_arrays, count(*) FILTER (type IN ('integer', 'string')) AS n_scalars FROM f GROUP BY doc),
        b AS (SELECT doc, count(*) AS n_objects FROM obj GROUP BY doc) SELECT a.doc AS doc_idx, n_arrays, n_scalars, n_objects FROM a JOIN b ON a.doc = b.doc""",
    "value_text": "SELECT event_id, substr(props, 1, 8) AS value_text, (length(props) > 8)::INT AS value_text_truncated FROM events",
    "stable_hash": f"SELECT event_id, {sql_hex('props')} AS by_expression, {sql_hex('props')} AS by_batch FROM events",
    "object_samples": f"""{_EVENT},
        y AS (SELECT c.*, x.*, '$' AS k1, '$' || {U} || '$' AS k2, '$' || {U} || '$' || {U} || fh AS k3, '$' || {U} || '$' || {U} || fh || {U} || th AS k4 FROM c, x),
        s AS (SELECT doc, js, shape_id, unnest(['canonical_path', 'site_path', 'field_set', 'type_set']) AS scope, unnest([k1, k2, k3, k4]) AS key, unnest([1, 1, 2, 4]) AS lim FROM y),
        p AS (SELECT *, ({sql_fnv(f"scope || {U} || key || {U} || doc || {U} || '$'")} % 9223372036854775808::UHUGEINT)::BIGINT AS pr FROM s),
        q AS (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY pr, doc) AS rn, row_number() OVER (PARTITION BY scope, key ORDER BY doc) AS fs FROM p),
        a AS (SELECT scope, key, doc, js, shape_id, 'priority_sample' AS kind, pr, rn::INT AS rk FROM q WHERE rn <= lim
              UNION ALL SELECT scope, key, doc, js, shape_id, unnest(['first_seen', 'first_non_empty']), NULL, NULL FROM q WHERE fs = 1)
        SELECT {sql_hex(f"scope || {U} || key || {U} || kind || {U} || doc || {U} || '$' || {U} || coalesce(pr::VARCHAR, '') || {U} || shape_id")} AS object_sample_id,
               scope AS sample_scope, key AS sample_key, kind AS sample_kind, doc AS document_index, js AS sample_json, coalesce(pr::VARCHAR, '') AS sample_priority, coalesce(rk, 0) AS sample_rank FROM a""",
    "object_samples_first": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()},
        y AS (SELECT obj.doc, obj.seq, obj.path, obj.canon, obj.fset = '[]' AS blank, fh, th FROM obj JOIN sh ON obj.path = sh.path AND obj.tset = sh.tset),
        s AS (SELECT doc, seq, path, blank, unnest(['canonical_path', 'site_path', 'field_set', 'type_set']) AS scope,
                     unnest([canon, canon || {U} || path, canon || {U} || path || {U} || fh, canon || {U} || path || {U} || fh || {U} || th]) AS key FROM y),
        a AS (SELECT scope, key, 'first_seen' AS kind, arg_min({{'d': doc, 'p': path, 'b': blank}}, doc * 10000 + seq) AS x FROM s GROUP BY scope, key
              UNION ALL SELECT scope, key, 'first_non_empty', arg_min({{'d': doc, 'p': path, 'b': blank}}, doc * 10000 + seq) FROM s WHERE NOT blank GROUP BY scope, key)
        SELECT scope AS sample_scope, key AS sample_key, kind AS sample_kind, x.d AS document_index, x.p AS source_path, x.b::INT AS sample_is_empty_object FROM a""",
    "value_samples": f"""{_EVENT},
        y AS (SELECT c.*, {sql_hex(f"shape_id || {U} || 'k' || {U} || 'integer'")} AS fp FROM c, (SELECT shape_id FROM x)),
        p AS (SELECT *, ({sql_fnv(f"fp || {U} || doc || {U} || '$.k'")} % 9223372036854775808::UHUGEINT)::BIGINT AS pr FROM y),
        q AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY pr, doc) AS rn, row_number() OVER (PARTITION BY fp ORDER BY doc) AS fs FROM p),
        a AS (SELECT fp, doc, k, js, 'priority_sample' AS kind, pr, rn::INT AS rk FROM q WHERE rn <= 4 UNION ALL SELECT fp, doc, k, js, unnest(['first_seen', 'first_non_empty']), NULL, NULL FROM q WHERE fs = 1),
        h AS (SELECT *, {sql_hex("'Integer(' || chr(34) || k || chr(34) || ')'")} AS vh FROM a)
        SELECT {sql_hex(f"fp || {U} || kind || {U} || doc || {U} || '$.k' || {U} || vh || {U} || coalesce(pr::VARCHAR, '')")} AS value_sample_id, fp AS field_profile_id, vh AS value_hash, kind AS sample_kind,
               doc AS document_index, k AS value_json, js AS parent_object_json, coalesce(pr::VARCHAR, '') AS sample_priority, coalesce(rk, 0) AS sample_rank FROM h""",
    "sample_keys_except": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()},
        s AS (SELECT fset = '[]' AS blank, unnest(['canonical_path', 'site_path', 'field_set', 'type_set']) AS sample_scope,
                     unnest([canon, canon || {U} || path, canon || {U} || path || {U} || fh, canon || {U} || path || {U} || fh || {U} || th]) AS sample_key FROM sh)
        SELECT sample_scope, sample_key FROM s EXCEPT SELECT sample_scope, sample_key FROM s WHERE NOT blank""",
    "source_summary": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()}
        SELECT 'unknown' AS source_format, (SELECT count(*) FROM o) AS total_document_count, (SELECT count(*) FROM obj) AS total_object_count, (SELECT count(*) FROM f WHERE type = 'array') AS total_array_count,
               (SELECT count(*) FROM f WHERE type IN ('string', 'integer')) AS total_scalar_count, (SELECT count(DISTINCT canon) FROM obj) AS total_canonical_path_count, (SELECT count(DISTINCT path) FROM obj) AS total_site_path_count,
               (SELECT count(*) FROM sh) AS total_shape_count, (SELECT count(*) FROM fp) AS total_field_profile_count, (SELECT sum(CASE WHEN is_exact THEN n_values ELSE least(n_values, 128) END)::BIGINT FROM dd) AS total_stored_value_count""",
    "diag_row_counts": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()},
        s AS (SELECT fset = '[]' AS blank, unnest(['canonical_path', 'site_path', 'field_set', 'type_set']) AS scope, unnest([canon, canon || path, canon || path || fset, canon || path || fset || tset]) AS key, unnest([1, 1, 2, 4]) AS lim FROM obj),
        g AS (SELECT scope, key, lim, count(*) AS n, count(*) FILTER (NOT blank) AS m FROM s GROUP BY ALL),
        v AS (SELECT fp, count(*) AS n, count(*) FILTER (text NOT IN ('{{}}', '[]') OR type = 'string') AS m FROM fv GROUP BY fp)
        SELECT 'prof_shape' AS table_name, count(*) AS rows FROM sh UNION ALL SELECT 'prof_shape_field', count(*) FROM fp UNION ALL SELECT 'prof_field_summary', count(*) FROM fp
        UNION ALL SELECT 'prof_field_value', sum(CASE WHEN is_exact THEN n_values ELSE least(n_values, 128) END)::BIGINT FROM dd
        UNION ALL SELECT 'prof_field_value_sample', sum(1 + (m > 0)::INT + least(n, 4))::BIGINT FROM v
        UNION ALL SELECT 'prof_object_sample', sum(1 + (m > 0)::INT + least(n, lim))::BIGINT FROM g UNION ALL SELECT 'prof_source_summary', 1""",
    "diag_sample_kinds": f"""WITH {ORDER_SQL.strip()},
        s AS (SELECT fset = '[]' AS blank, unnest(['canonical_path', 'site_path', 'field_set', 'type_set']) AS scope, unnest([canon, canon || path, canon || path || fset, canon || path || fset || tset]) AS key, unnest([1, 1, 2, 4]) AS lim FROM obj),
        g AS (SELECT scope, key, lim, count(*) AS n, count(*) FILTER (NOT blank) AS m FROM s GROUP BY ALL)
        SELECT scope AS sample_scope, 'first_seen' AS sample_kind, count(*) AS rows FROM g GROUP BY scope UNION ALL SELECT scope, 'first_non_empty', count(*) FROM g WHERE m > 0 GROUP BY scope
        UNION ALL SELECT scope, 'priority_sample', sum(least(n, lim))::BIGINT FROM g GROUP BY scope""",
    "diag_value_sources": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()}
        SELECT CASE WHEN is_exact THEN 'exact_full' ELSE 'heavy_hitter' END AS value_source, CASE WHEN is_exact THEN 'exact' ELSE 'approximate' END AS count_method, is_exact::INT AS is_complete_distribution,
               sum(CASE WHEN is_exact THEN n_values ELSE least(n_values, 128) END)::BIGINT AS rows FROM dd GROUP BY ALL""",
    "diag_distinct_methods": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()}
        SELECT CASE WHEN is_exact THEN 'exact' ELSE 'approximate' END AS distinct_count_method, CASE WHEN NOT is_exact THEN 'hyperloglog' END AS distinct_algorithm, count(*) AS rows FROM dd GROUP BY ALL""",
    "diag_top_paths": f"""WITH {ORDER_SQL.strip()}, s AS (SELECT canon, path, tset, count(*) AS n FROM obj GROUP BY ALL)
        SELECT canon AS canonical_path, count(*) AS shapes, sum(n)::BIGINT AS objects FROM s GROUP BY canon ORDER BY shapes DESC, objects DESC, canon LIMIT 20""",
    "diag_priority_bounds": f"""WITH {ORDER_SQL.strip()},
        s AS (SELECT unnest(['canonical_path', 'site_path', 'field_set', 'type_set']) AS scope, unnest([canon, canon || path, canon || path || fset, canon || path || fset || tset]) AS key, unnest([1, 1, 2, 4]) AS lim FROM obj),
        g AS (SELECT scope, key, least(count(*), any_value(lim)) AS n FROM s GROUP BY ALL) SELECT scope AS sample_scope, max(n)::BIGINT AS most, count(*) AS n_keys FROM g GROUP BY scope""",
    "diag_orphans": "SELECT unnest(['prof_shape_field', 'prof_field_summary', 'prof_field_value', 'prof_field_value_sample']) AS table_name, 0::BIGINT AS rows",
    "profile_field_summary": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()},
        s AS (SELECT fp AS field_profile_id, count(*) AS profiled_count, 0::BIGINT AS null_count, count(*) AS non_null_count, count(*) FILTER (type = 'object' AND text = '{{}}') AS empty_object_count,
                     count(*) FILTER (type = 'array' AND text = '[]') AS empty_array_count, count(*) FILTER (type = 'string' AND text = '') AS empty_string_count FROM fv GROUP BY fp)
        SELECT s.*, CASE WHEN is_exact THEN n_values ELSE -1 END AS distinct_count, CASE WHEN is_exact THEN 'exact' ELSE 'approximate' END AS distinct_count_method, CASE WHEN is_exact THEN '' ELSE 'hyperloglog' END AS distinct_algorithm,
               CASE WHEN is_exact THEN 0.0::DOUBLE ELSE 0.008125::DOUBLE END AS distinct_error_rate, CASE WHEN is_exact THEN n_values ELSE least(n_values, 128) END AS stored_value_count FROM s JOIN dd ON s.field_profile_id = dd.fp""",
    "diag_value_sample_kinds": f"""{_EVENT},
        y AS (SELECT c.*, {sql_hex(f"shape_id || {U} || 'k' || {U} || 'integer'")} AS fp FROM c, (SELECT shape_id FROM x)),
        p AS (SELECT *, ({sql_fnv(f"fp || {U} || doc || {U} || '$.k'")} % 9223372036854775808::UHUGEINT)::BIGINT AS pr FROM y),
        q AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY pr, doc) AS rn, row_number() OVER (PARTITION BY fp ORDER BY doc) AS fs FROM p),
        a AS (SELECT k, js, 'priority_sample' AS kind FROM q WHERE rn <= 4 UNION ALL SELECT k, js, unnest(['first_seen', 'first_non_empty']) FROM q WHERE fs = 1)
        SELECT kind AS sample_kind, count(*) AS rows, round(sum(length(k)) / 1024.0 / 1024.0, 2) AS value_json_mb, round(sum(length(js)) / 1024.0 / 1024.0, 2) AS parent_json_mb, round(avg(length(js)), 1) AS avg_parent_json,
               max(length(js))::INT AS max_parent_json FROM a GROUP BY kind""",
    "diag_value_priority": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()} SELECT fp AS field_profile_id, 4::BIGINT AS rows FROM fv GROUP BY fp HAVING count(*) >= 4""",
    "diag_contexts": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()},
        q AS (SELECT fp, text, n, row_number() OVER (PARTITION BY fp ORDER BY n DESC, text::BIGINT) AS r FROM vc WHERE fp IN (SELECT fp FROM fp WHERE name = 'qty'))
        SELECT fp AS field_profile_id, sum(least(n, 2))::BIGINT AS rows, count(*) AS distinct_values, count(*) FILTER (n > 1) AS above_one FROM q WHERE r <= 3 GROUP BY fp""",
    "diag_broken": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}, {_FIELDS.strip()},
        v AS (SELECT fv.fp, count(*) AS n FROM fv WHERE name = 'qty' GROUP BY fv.fp)
        SELECT 'prof_shape_field' AS table_name, count(*) AS rows FROM fp WHERE path = '$.meta' UNION ALL SELECT 'prof_field_summary', count(*) FROM fp WHERE name = 'qty'
        UNION ALL SELECT 'prof_field_value', coalesce(sum(CASE WHEN is_exact THEN n_values ELSE least(n_values, 128) END), 0)::BIGINT FROM dd JOIN v ON dd.fp = v.fp
        UNION ALL SELECT 'prof_field_value_sample', coalesce(sum(2 + least(n, 4)), 0)::BIGINT FROM v""",
    "diag_shapes_unseen": f"""WITH {ORDER_SQL.strip()}, {_SHAPES.strip()}
        SELECT shape_id, obj.canon AS canonical_path, count(*) AS object_count FROM obj JOIN sh ON obj.path = sh.path AND obj.tset = sh.tset WHERE obj.canon = '$.items[]' GROUP BY ALL""",
    "refs_contexts": f"""WITH c AS (SELECT * FROM {_values(REF_COUNTS, 'site_path, schema_path')}), p AS (SELECT * FROM {_values(REF_PATHS, 'schema_path, object_path')}),
        j AS (SELECT c.*, p.object_path, row_number() OVER (PARTITION BY site_path ORDER BY c.schema_path DESC, p.object_path DESC NULLS LAST) AS rn FROM c LEFT JOIN p ON c.schema_path = p.schema_path)
        SELECT site_path, coalesce(object_path, schema_path) AS canonical_path, schema_path FROM j WHERE rn = 1""",
    "refs_seeds": f"""WITH s AS (SELECT * FROM {_values(REF_SHAPES, 'schema_path, site_path, site_kind, fields')}), l AS (SELECT * FROM {_values(REF_LIMITS, 'schema_path, site_path, site_kind, truncated')}), p AS (SELECT * FROM {_values(REF_PATHS, 'schema_path, object_path')})
        SELECT coalesce(object_path, s.schema_path) AS canonical_path, s.site_path, s.schema_path, array_to_string(from_json(fields, '["VARCHAR"]'), '|') AS field_names, l.schema_path IS NOT NULL AS truncated
        FROM s LEFT JOIN (SELECT * FROM l WHERE truncated <> 0) l USING (schema_path, site_path, site_kind) LEFT JOIN p ON s.schema_path = p.schema_path""",
}
