"""Structural context of objects: the references' where they know the path, else the path itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNAVAILABLE = "W_CANONICAL_PATH_UNAVAILABLE"
UNKNOWN = "unknown"
#: Contexts that are broadcast at most; more are joined by shuffle.
MAX_BROADCAST = 200_000


def small_contexts(contexts: DataFrame | None) -> dict[str, tuple[str, str]] | None:
    """Canonical and schema path by site, where there are at most ``MAX_BROADCAST``; None beyond that."""
    if contexts is None:
        return {}
    if contexts.count() > MAX_BROADCAST:
        return None
    return {r["site_path"]: (r["canonical_path"], r["schema_path"]) for r in contexts.select("site_path", "canonical_path", "schema_path").collect()}


def resolve(objects: DataFrame, contexts: DataFrame | None) -> DataFrame:
    """Adds canonical_path, site_path, schema_path, resolved."""
    if contexts is None:
        return objects.select("*", F.col("canon").alias("canonical_path"), F.col("path").alias("site_path"), F.lit(UNKNOWN).alias("schema_path"), F.lit(False).alias("resolved"))
    known = contexts.select(F.col("site_path").alias("known_site"), F.col("canonical_path").alias("known_path"), F.col("schema_path").alias("known_schema"))
    side = F.broadcast(known) if known.count() <= MAX_BROADCAST else known
    joined = objects.join(side, objects["path"] == side["known_site"], "left")
    return joined.select(
        *objects.columns,
        F.coalesce("known_path", "canon").alias("canonical_path"),
        F.coalesce("known_site", "path").alias("site_path"),
        F.coalesce("known_schema", F.lit(UNKNOWN)).alias("schema_path"),
        F.col("known_site").isNotNull().alias("resolved"),
    )


def unresolved_warning(objects: DataFrame) -> list[tuple[str, str]]:
    """One warning, for the first object in document order that the references don't know."""
    first = objects.filter(~F.col("resolved")).agg(F.min(F.struct("doc_idx", "ord", "path")).alias("x")).first()["x"]
    return [] if first is None else [(UNAVAILABLE, f"refs database did not contain an exact context for source path {first['path']}")]
