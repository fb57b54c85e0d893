"""The whole profile: documents to seven tables.

One scan gives the objects with their ids, which are written once.  Shapes and value counts are grouped
from them and written; all that is told by these small tables (fields, summaries, distributions) is
derived from them, and samples are cut within the tasks that read the objects.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ProfileConfig
from ..functions.paths import materialize
from ..operators import samples, values
from ..operators.context import resolve, small_contexts, unresolved_warning
from ..operators.fields import explode_fields, shape_fields, summary_counts
from ..operators.ids import with_shape_ids
from ..operators.shapes import shapes
from ..operators.walk import scan, scan_strict
from ..perf import PerfLog
from ..sources.documents import read_documents
from ..sources.refs import Refs, load_refs

TABLES = ("prof_source_summary", "prof_object_sample", "prof_shape", "prof_shape_field", "prof_field_summary", "prof_field_value", "prof_field_value_sample")


@dataclass
class ProfileResult:
    tables: dict[str, DataFrame]
    warnings: list[tuple[str, str]] = field(default_factory=list)
    #: The working frames: objects (with shape ids) and fields (with profile ids).
    objects: DataFrame | None = None
    fields: DataFrame | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def register(self, prefix: str = "") -> None:
        """Make the tables visible to Spark SQL."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(prefix + name)


def scanned(docs: DataFrame, scanner: str = "strict", contexts: DataFrame | None = None) -> DataFrame:
    """Objects with their context and ids, and a row of counts per document.

    The strict scanner adds contexts and ids in its own pass, where the contexts are few enough to send along.
    """
    if scanner == "strict":
        known = small_contexts(contexts)
        if known is not None:
            return scan_strict(docs, known)
    return with_shape_ids(resolve(scan(docs, scanner), contexts))


def object_frame(docs: DataFrame, scanner: str = "strict", contexts: DataFrame | None = None) -> DataFrame:
    """The objects of documents with their context and shape ids."""
    return scanned(docs, scanner, contexts).filter("path IS NOT NULL").drop("n_arrays", "n_scalars")


def source_summary(documents: DataFrame, shape_table: DataFrame, field_table: DataFrame, value_table: DataFrame, source_format: str) -> DataFrame:
    """One row of totals.  ``documents``: a row per document with its arrays and scalars."""
    return totals(documents.agg(F.count("*").alias("d"), F.sum("n_arrays").alias("a"), F.sum("n_scalars").alias("s")), shape_table, field_table, value_table, source_format)


def totals(counts: DataFrame, shape_table: DataFrame, field_table: DataFrame, value_table: DataFrame, source_format: str) -> DataFrame:
    """The row of totals from counts that are summed already: documents, arrays, scalars."""
    of_shapes = shape_table.agg(
        F.sum("object_count").alias("o"), F.count_distinct("canonical_path").alias("c"), F.count_distinct(F.coalesce("site_path", F.lit(""))).alias("p"), F.count("*").alias("n")
    )
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  single rows, joined on a constant key
    joined = one(counts).join(one(of_shapes), "one").join(one(field_table.agg(F.count("*").alias("f"))), "one").join(one(value_table.agg(F.count("*").alias("v"))), "one")
    names = ("total_document_count", "total_object_count", "total_array_count", "total_scalar_count", "total_canonical_path_count", "total_site_path_count", "total_shape_count", "total_field_profile_count", "total_stored_value_count")
    return joined.select(F.lit(source_format).alias("source_format"), *(F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in zip("doascpnfv", names, strict=True)))


def profile_documents(docs: DataFrame, config: ProfileConfig | None = None, refs: Refs | None = None, source_format: str = "unknown", perf: PerfLog | None = None) -> ProfileResult:
    """Profile documents (doc_idx, raw)."""
    config, perf = config or ProfileConfig(), perf or PerfLog()
    config.validate()
    with perf.phase("scan.walk"):  # objects with their ids, and the documents' counts, in one table
        everything = materialize(scanned(docs, config.scanner, refs.contexts if refs else None))
        objects = everything.filter("path IS NOT NULL")
    options, fields = config.value_profile, explode_fields(objects)
    with perf.phase("scan.fields"):
        shape_table = materialize(shapes(objects))
        counts = materialize(values.value_counts(fields))
    with perf.phase("scan.flush_values"):
        decided = materialize(values.decide(counts, options))
        stored = materialize(values.distributions(fields, counts, decided, options, config.heavy_hitters))
    field_table = shape_fields(shape_table)
    summary = source_summary(everything.filter("path IS NULL"), shape_table, field_table, stored, source_format)
    tables = {
        "prof_source_summary": summary,
        "prof_object_sample": samples.object_samples(objects, config.sampling),
        "prof_shape": shape_table,
        "prof_shape_field": field_table,
        "prof_field_summary": values.field_summaries(summary_counts(counts), counts, decided, stored, options),
        "prof_field_value": stored,
        "prof_field_value_sample": samples.value_samples(objects, config.sampling),
    }
    warnings = list(refs.warnings) if refs else []
    if refs:
        warnings += unresolved_warning(objects)
    return ProfileResult(tables, warnings, objects, fields)


def profile(spark: SparkSession, path: str, config: ProfileConfig | None = None, refs: str | Refs | None = None, perf: PerfLog | None = None) -> ProfileResult:
    """Profile a JSON or JSONL file or folder; ``refs``: a references file, folder or loaded references."""
    config, perf = config or ProfileConfig(), perf or PerfLog()
    with perf.phase("refs.load"):
        loaded = load_refs(spark, refs) if isinstance(refs, str) else refs
    docs, kind = read_documents(spark, path, config.input_format)
    return profile_documents(docs, config, loaded, kind, perf)
