"""Shapes: objects of one place with the same fields and the same field types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE = ["shape_id", "canonical_path", "site_path", "schema_path", "field_set_hash", "type_set_hash", "field_set_json", "type_set_json"]


def shapes(objects: DataFrame) -> DataFrame:
    """One row per shape: its texts, how many objects, and the first in document order.

    All texts follow from the id, so they are group keys (which hash) rather than aggregates (which would
    sort).  A shape has one site and a site is one path, so the path of the first object is the site.
    """
    grouped = objects.groupBy(*SHAPE).agg(F.count("*").alias("object_count"), F.min("doc_idx").alias("first_seen_document_index"))
    return grouped.withColumn("first_seen_path", F.col("site_path"))
