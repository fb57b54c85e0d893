"""Fields of objects: one row per object and field, their counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ids import field_ids, profile_ids


def explode_fields(objects: DataFrame) -> DataFrame:
    """(shape_id, field_name, observed_type, doc_idx, ord, source_path, text): in the JVM, without ids."""
    rows = objects.select("doc_idx", "ord", "path", "shape_id", F.inline("fields"))
    return rows.select("doc_idx", "ord", "shape_id", F.col("name").alias("field_name"), F.col("type").alias("observed_type"), "text", F.concat("path", F.lit("."), "name").alias("source_path"))


def with_field_ids(fields: DataFrame) -> DataFrame:
    """Adds field_profile_id and value_hash; to rows that are grouped first wherever that is possible."""
    return fields.withColumn("ids", field_ids("shape_id", "field_name", "observed_type", "text")).select("*", "ids.*").drop("ids")


def non_empty(kind: Column, text: Column) -> Column:
    """Not null, not ``{}``, not ``[]``; an empty string counts as a value."""
    return ~((kind == "null") | ((kind == "object") & (text == "{}")) | ((kind == "array") & (text == "[]")))


def shape_fields(shapes: DataFrame) -> DataFrame:
    """(field_profile_id, shape_id, field_name, observed_type, observed_count, null_count).

    Every object of a shape has each of its fields once, so the shapes tell all counts.
    """
    pairs = F.explode(F.from_json("type_set_json", "array<array<string>>"))
    rows = shapes.select("shape_id", "object_count", pairs.alias("pair")).select("shape_id", "object_count", F.col("pair")[0].alias("field_name"), F.col("pair")[1].alias("observed_type"))
    nulls = F.when(F.col("observed_type") == "null", F.col("object_count")).otherwise(0).alias("null_count")
    return rows.select(profile_ids("shape_id", "field_name", "observed_type").alias("field_profile_id"), "shape_id", "field_name", "observed_type", F.col("object_count").alias("observed_count"), nulls)


def summary_counts(counts: DataFrame) -> DataFrame:
    """profiled, null, non-null and empty counts of every field profile, from its value counts."""
    kind, text, n = F.col("observed_type"), F.col("text"), F.col("n")
    total = lambda when, name: F.coalesce(F.sum(F.when(when, n)), F.lit(0)).alias(name)
    return counts.groupBy("field_profile_id").agg(
        F.sum(n).alias("profiled_count"),
        total(kind == "null", "null_count"),
        total(kind != "null", "non_null_count"),
        total((kind == "object") & (text == "{}"), "empty_object_count"),
        total((kind == "array") & (text == "[]"), "empty_array_count"),
        total((kind == "string") & (text == ""), "empty_string_count"),
    )
