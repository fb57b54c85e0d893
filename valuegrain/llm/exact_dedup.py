"""Exact deduplication by Structured Streaming with disk-backed keyed state.

A streaming aggregation keyed by the SHA-256 of the normalised text keeps, in RocksDB and
without a watermark (so without expiry), for every digest: the stable identifier of the row
that stays, its content locator (file and size) and the number of rows seen.  A digest that is
hit more than once is confirmed on the full bytes: the smallest and the largest normalised text
of the group are compared, which needs one text per group and task only; groups in which they
differ (a digest collision) are regrouped by digest and text.

Defined results: null text counts as empty, so null, empty and blank texts are one group;
a null id loses every tie; rows that repeat an id are each counted and returned, and those
that carry the id that stays are all marked kept; an empty input gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, shared_dir, table, written

#: State on the executors' disks; RocksDB else reserves 4 MB of disk a store for its logs and 8 MB of memory for its writes.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "2",
}
#: Hit digests are broadcast, as 8-byte hashes, up to this number (about 64 MB); beyond it they are joined by shuffle.
MAX_BROADCAST_HITS = 2_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder or single file as a stream."""
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rstrip("/").rpartition("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent)


def keep_state(stream: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Run the stream to its present end; one row per digest: keep_id, locator, group_size.

    ``stream`` has doc_id and text.  The same checkpoint could be carried on with later files.
    """
    spark = stream.sparkSession
    work = shared_dir(spark)
    rows = stream.select(
        digest(normalised(F.col("text"))).alias("digest"),
        F.col("doc_id"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n"),
        F.col("_metadata.file_path").alias("locator"),
    )
    best = F.max(F.struct("n", F.bitwise_not("doc_id").alias("rank"), "doc_id", "locator"))
    state = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))

    def save(batch: DataFrame, number: int) -> None:  # idempotent: a batch that is run again replaces its rows
        batch.write.mode("overwrite").parquet(f"{work}/updates/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        run = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{work}/state")
            .trigger(availableNow=True)
            .foreachBatch(save)
            .start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = "digest string, best struct<n: bigint, rank: bigint, doc_id: bigint, locator: string>, group_size bigint, batch bigint"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{work}/updates")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        updates = spark.createDataFrame([], kind)  # no file, no batch
    else:
        updates = spark.read.schema(kind).parquet(f"{work}/updates")
    last = F.max_by(F.struct("best", "group_size"), "batch").alias("last")
    return updates.groupBy("digest").agg(last).select(
        "digest", F.col("last.best.doc_id").alias("keep_id"), F.col("last.best.locator").alias("locator"), F.col("last.group_size").alias("group_size")
    )


def exact_dedup(docs: DataFrame, stream: DataFrame | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, locator for every row of ``docs``.

    ``stream``: the same rows as a stream; without it ``docs`` (doc_id and text only) is first
    staged in the shared folder.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    if stream is None:
        path = shared_dir(spark) + "/staged"
        docs.write.parquet(path)
        docs, stream = spark.read.schema(docs.schema).parquet(path), stream_of(spark, path)
    state = written(keep_state(stream.select("doc_id", "text", "_metadata"), digest))
    norm = normalised(F.col("text"))
    rows = docs.select("doc_id", "text", digest(norm).alias("digest"))
    # the full bytes of hits only: where few enough, their hashed digests reach the scan and no other text is moved
    again = state.filter("group_size > 1").select(F.xxhash64("digest").alias("hit"))
    few = again.count() <= MAX_BROADCAST_HITS
    hits = rows.withColumn("hit", F.xxhash64("digest")).join(F.broadcast(again) if few else again, "hit", "left_semi")
    full = hits.groupBy("digest").agg(F.min(norm).alias("low"), F.max(norm).alias("high"))
    clash = written(full.filter("low <> high").select("digest"))
    out = rows.select("doc_id", "digest", sha256(norm).alias("text_sha256")).join(state, "digest")
    if not clash.isEmpty():  # only then by digest and text
        apart = rows.join(clash, "digest", "left_semi").withColumn("norm", norm)
        best = F.max(F.struct(F.length("text").alias("n"), F.bitwise_not("doc_id").alias("rank"), "doc_id")).alias("best")
        regroup = apart.groupBy("digest", "norm").agg(best, F.count("*").alias("group_size"))
        again = apart.join(regroup, ["digest", "norm"]).join(state.select("digest", "locator"), "digest")
        again = again.select("doc_id", "digest", sha256(F.col("norm")).alias("text_sha256"), F.col("best.doc_id").alias("keep_id"), "locator", "group_size")
        out = out.join(clash, "digest", "left_anti").unionByName(again)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "locator")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stream = stream_of(spark, f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, stream).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     w AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                  first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
