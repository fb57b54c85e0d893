"""Profiles of growing folders by Structured Streaming.

New JSONL files are profiled as micro-batches.  Each batch leaves mergeable partial rows (counts, firsts,
value counts, HyperLogLog registers, least priorities) under its own number, so a batch that is run again
replaces itself; ``merged`` folds all batches with the same aggregations that a batch run uses.  Space-Saving
does not merge and is left out: heavy hitters come from the merged value counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ProfileConfig
from ..functions.paths import materialize
from ..operators.fields import explode_fields, shape_fields, summary_counts
from ..operators.samples import merged_samples, object_limits, object_samples, value_samples
from ..operators.shapes import SHAPE, shapes
from ..operators.values import decide, distributions, field_summaries, value_bytes, value_counts
from ..plans.profile import scanned, totals
from ..sources.documents import number_lines

PARTIALS = ("documents", "shapes", "values", "object_samples", "value_samples")


def batch_partials(docs: DataFrame, config: ProfileConfig) -> dict[str, DataFrame]:
    """The mergeable tables of one batch of documents."""
    everything = materialize(scanned(docs, config.scanner))
    objects = everything.filter("path IS NOT NULL")
    return {
        "documents": everything.filter("path IS NULL").agg(F.count("*").alias("documents"), F.sum("n_arrays").alias("arrays"), F.sum("n_scalars").alias("scalars")),
        "shapes": shapes(objects),
        "values": value_counts(explode_fields(objects)).drop("bytes"),
        "object_samples": object_samples(objects, config.sampling),
        "value_samples": value_samples(objects, config.sampling),
    }


def start(spark: SparkSession, source: str, state: str, config: ProfileConfig | None = None, available_now: bool = True):  # noqa: ANN201
    """Follow the JSONL files of folder ``source``; partial tables go to ``state``.

    A document's index is stable across batches and tells places apart: the upper bits are a hash of the
    file's name (so two files may share it with probability 2e-8 a pair), the lower 38 the line's number in
    its file as ``read_jsonl`` counts it.  Order is that of lines within a file, files come by hash.
    """
    config = config or ProfileConfig(heavy_hitters="exact")
    lines = spark.readStream.option("lineSep", "\n").text(source)
    rows = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def save(batch: DataFrame, number: int) -> None:
        numbered = number_lines(materialize(batch.withColumn("id", F.monotonically_increasing_id())))
        at = F.shiftleft(F.pmod(F.xxhash64("file"), F.lit(1 << 25)), 38) + F.col("line")
        for name, df in batch_partials(numbered.select(at.alias("doc_idx"), "raw"), config).items():
            df.write.mode("overwrite").parquet(f"{state}/{name}/batch={number}")

    writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", f"{state}/_checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merged(spark: SparkSession, state: str, config: ProfileConfig | None = None) -> dict[str, DataFrame]:
    """The seven tables over all batches so far.

    Least hashes and firsts of a whole are among those of its parts, so the samples of the batches merge.
    """
    config = config or ProfileConfig(heavy_hitters="exact")
    part = {name: spark.read.parquet(f"{state}/{name}").drop("batch") for name in PARTIALS}
    first = F.min("first_seen_document_index").alias("first_seen_document_index")
    shape_table = part["shapes"].groupBy(*SHAPE, "first_seen_path").agg(F.sum("object_count").alias("object_count"), first)
    shape_table = materialize(shape_table.select(*SHAPE, "object_count", "first_seen_document_index", "first_seen_path"))
    values = part["values"].groupBy("field_profile_id", "value_hash", "observed_type", "text").agg(F.sum("n").alias("n"))
    counts = materialize(values.withColumn("bytes", value_bytes(F.col("observed_type"), F.col("text"))))
    decided = materialize(decide(counts, config.value_profile))
    stored = materialize(distributions(counts, counts, decided, config.value_profile, "exact"))
    documents = part["documents"].agg(F.sum("documents").alias("d"), F.sum("arrays").alias("a"), F.sum("scalars").alias("s"))
    field_table = shape_fields(shape_table)
    return {
        "prof_source_summary": totals(documents, shape_table, field_table, stored, "jsonl"),
        "prof_object_sample": merged_samples(part["object_samples"], ["sample_scope", "sample_key"], object_limits(config.sampling)),
        "prof_shape": shape_table,
        "prof_shape_field": field_table,
        "prof_field_summary": field_summaries(summary_counts(counts), counts, decided, stored, config.value_profile),
        "prof_field_value": stored,
        "prof_field_value_sample": merged_samples(part["value_samples"], ["field_profile_id"], F.lit(config.sampling.value_priority_limit_per_field_profile)),
    }
