"""Checks and reports over a profile's seven tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import ORDER, columns

# Tables that a profile must not have: fixed values.
FORBIDDEN = ("prof_run", "prof_manifest", "prof_algorithm", "prof_warning", "prof_path_sample", "prof_shape_sample")
CONTEXT = "heavy_hitter_context"


@dataclass
class Limits:
    heavy_hitter: int = 128
    context: int = 0
    value: int = 4
    scopes: Mapping[str, int] = field(default_factory=lambda: {"canonical_path": 1, "site_path": 1, "field_set": 2, "type_set": 4})
    top: int = 20


@dataclass
class Diagnosis:
    reports: dict[str, DataFrame]
    risks: list[str]

    @property
    def status(self) -> str:
        return "risk" if self.risks else "ok"


def contract_risks(tables: Mapping[str, DataFrame], catalog: Iterable[tuple[str, str]] = ()) -> list[str]:
    """Missing and forbidden tables, views, missing columns.  ``catalog``: (kind, name) of all that the profile holds."""
    there = list(dict.fromkeys([*(("table", t) for t in tables), *catalog]))
    risks = [f"missing table {t}" for t in ORDER if t not in tables]
    risks += [f"forbidden table {t}" for kind, t in there if kind == "table" and (t in FORBIDDEN or t.startswith("prof_array"))]
    risks += [f"view {t}" for kind, t in there if kind == "view"]
    for t in ORDER:
        if t in tables:
            risks += [f"missing column {t}.{c}" for c in columns(t) if c not in tables[t].columns]
    return risks


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for t in ORDER:
        one = tables[t].agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def object_sample_kinds(samples: DataFrame) -> DataFrame:
    return samples.groupBy("sample_scope", "sample_kind").agg(F.count("*").alias("rows"))


def value_sample_kinds(samples: DataFrame) -> DataFrame:
    """Rows of each kind and how much their texts take."""
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return samples.groupBy("sample_kind").agg(
        F.count("*").alias("rows"),
        F.round(F.sum(size("value_json")) / 1024.0 / 1024.0, 2).alias("value_json_mb"),
        F.round(F.sum(size("parent_object_json")) / 1024.0 / 1024.0, 2).alias("parent_json_mb"),
        F.round(F.avg(size("parent_object_json")), 1).alias("avg_parent_json"),
        F.max(size("parent_object_json")).alias("max_parent_json"),
    )


def value_sources(values: DataFrame) -> DataFrame:
    return values.groupBy("value_source", "count_method", "is_complete_distribution").agg(F.count("*").alias("rows"))


def distinct_methods(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("distinct_count_method", "distinct_algorithm").agg(F.count("*").alias("rows"))


def context_rows(samples: DataFrame) -> DataFrame:
    """Heavy-hitter context rows of each field profile."""
    return samples.filter(F.col("sample_kind") == CONTEXT).groupBy("field_profile_id").agg(F.count("*").alias("rows"), F.count_distinct("value_hash").alias("distinct_values"))


def context_duplicates(samples: DataFrame, limit: int) -> DataFrame:
    grouped = samples.filter(F.col("sample_kind") == CONTEXT).groupBy("field_profile_id", "value_hash").agg(F.count("*").alias("rows"))
    return grouped.filter(F.col("rows") > max(limit, 0))


def value_priority_violations(samples: DataFrame, limit: int) -> DataFrame:
    return samples.filter("sample_kind = 'priority_sample'").groupBy("field_profile_id").agg(F.count("*").alias("rows")).filter(F.col("rows") > limit)


def object_priority_violations(samples: DataFrame, scopes: Mapping[str, int]) -> DataFrame:
    limits = F.element_at(F.create_map(*(F.lit(x) for kv in scopes.items() for x in kv)), F.col("sample_scope"))
    grouped = samples.filter("sample_kind = 'priority_sample'").groupBy("sample_scope", "sample_key").agg(F.count("*").alias("rows"))
    return grouped.withColumn("lim", limits).filter(F.col("rows") > F.col("lim"))


def top_paths(shapes: DataFrame, column: str, top: int) -> DataFrame:
    """The ``top`` canonical or site paths with most shapes."""
    grouped = shapes.groupBy(column).agg(F.count("*").alias("shapes"), F.sum("object_count").alias("objects"))
    return grouped.orderBy(F.desc("shapes"), F.desc("objects"), column).limit(top)


def orphans(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows whose shape or field profile does not exist, by table."""
    shapes, fields = tables["prof_shape"].select("shape_id"), tables["prof_shape_field"].select("field_profile_id")
    out = tables["prof_shape_field"].join(shapes, "shape_id", "left_anti").agg(F.count("*").alias("rows")).select(F.lit("prof_shape_field").alias("table_name"), "rows")
    for t in ("prof_field_summary", "prof_field_value", "prof_field_value_sample"):
        out = out.unionByName(tables[t].join(fields, "field_profile_id", "left_anti").agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows"))
    return out


def shapes_without_first_seen(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Shapes that have no first sample in the type-set scope."""
    first = tables["prof_object_sample"].filter("sample_scope = 'type_set' AND sample_kind = 'first_seen'").select("shape_id")
    return tables["prof_shape"].join(first, "shape_id", "left_anti")


def diagnose(tables: Mapping[str, DataFrame], limits: Limits | None = None, catalog: Iterable[tuple[str, str]] = ()) -> Diagnosis:
    limits = limits or Limits()
    risks = contract_risks(tables, catalog)
    if any(r.startswith("missing") for r in risks):
        return Diagnosis({}, risks)
    samples, values = tables["prof_object_sample"], tables["prof_field_value_sample"]
    reports = {
        "row_counts": row_counts(tables),
        "object_sample_kinds": object_sample_kinds(samples),
        "value_sample_kinds": value_sample_kinds(values),
        "value_sources": value_sources(tables["prof_field_value"]),
        "distinct_methods": distinct_methods(tables["prof_field_summary"]),
        "context_rows": context_rows(values).orderBy(F.desc("rows")).limit(limits.top),
        "context_duplicates": context_duplicates(values, limits.context),
        "value_priority_violations": value_priority_violations(values, limits.value),
        "object_priority_violations": object_priority_violations(samples, limits.scopes),
        "top_canonical_paths": top_paths(tables["prof_shape"], "canonical_path", limits.top),
        "top_site_paths": top_paths(tables["prof_shape"], "site_path", limits.top),
        "orphans": orphans(tables),
        "shapes_without_first_seen": shapes_without_first_seen(tables),
    }
    rows = {r["table_name"]: r["rows"] for r in reports["row_counts"].collect()}
    for t, why in (
        ("prof_source_summary", "run may not have finalized"),
        ("prof_field_summary", "value finalization may not have completed"),
        ("prof_field_value", "value distribution finalization may not have completed"),
    ):
        if not rows[t]:
            risks.append(f"{t} is empty; {why}")
    if limits.context == 0 and not reports["context_rows"].isEmpty():
        risks.append("heavy_hitter_context rows exist while expected limit is 0")
    if not context_rows(values).filter(F.col("rows") > limits.heavy_hitter * limits.context).isEmpty():
        risks.append("heavy_hitter_context rows exceed expected per-field bound")
    if not reports["value_priority_violations"].isEmpty():
        risks.append("value priority samples exceed configured per-field limit")
    if not reports["object_priority_violations"].isEmpty():
        risks.append("object priority samples exceed configured scope limit")
    if not reports["orphans"].filter("rows > 0").isEmpty():
        risks.append("rows refer to shapes or field profiles that do not exist")
    return Diagnosis(reports, risks)
