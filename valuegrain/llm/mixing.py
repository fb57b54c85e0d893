"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share
``total_share`` of all words; a target stops at ``cap`` times its source's size and the excess
is shared again by weight.  The fixed point is a water level over the cap-to-weight ratios.

Selection: every document gets the key ``u ** (1 / w)`` with ``u`` a hash of its id in (0, 1)
and ``w`` its quality weight.  Whole epochs of a source come first; what is left of the target is
filled in descending order of keys, and the document at the edge is taken in part.

At scale: keys fall into ``BUCKETS`` equal bins.  Word counts per (source, bin) are summed before
the shuffle, their running sums show the one bin per source that holds the edge, and only its
rows are sorted.  No task sees a whole source.

Defined results: a null text has size 0 and is taken 0 times; a source without words has target
0; a null source is a source of its own, last; repeated ids are separate rows with equal keys,
ordered by size; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table, written

WEIGHTS = (5.0, 2.0, 1.0)
BUCKETS = 4096
#: More sources than this are joined by shuffle, not by broadcast.
BROADCAST_SOURCES = 50_000
SYMBOLS = r"[#*$%&|<>]"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, less with the share of mark-up symbols to words, 0.1 at least."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0))
    return F.greatest(F.lit(0.1), F.lit(1.0) - symbols / F.greatest(size, F.lit(1)))


def unit_hash(doc_id: Column) -> Column:
    """In (0, 1), from 48 bits of MD5; the same for an id on every run."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10)
    return (digits.cast("double") + 0.5) / F.lit(float(2**48))


def source_targets(sizes: DataFrame, total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source of ``sizes`` (source, source_size): its weight and target.

    The windows run over one row per source, not over documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (cycle + 1).cast("int"))
    level = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    capped = F.coalesce(F.sum("cap").over(level), F.lit(0.0))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(cap))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(total_share))
        # the level if this source and all of higher ratio stay below their caps
        .withColumn("water", (F.col("total") - capped) / F.sum("weight").over(rest))
        .withColumn("open", F.col("water") <= F.col("ratio"))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct("ratio", "water"))).over(everything)["water"])
        .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))))
        .select("source", "source_size", "weight", "target")
    )


def mix(sized: DataFrame, total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sized`` (doc_id, source, size, weight) with source_size, target and taken."""
    spark = sized.sparkSession
    key = F.pow(unit_hash(F.col("doc_id")), F.lit(1.0) / F.col("quality"))
    rows = written(
        sized.select("doc_id", "source", "size", F.col("weight").alias("quality"))
        .withColumn("key", key)
        .withColumn("bucket", F.least(F.floor((F.lit(1.0) - F.col("key")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
        .drop("quality")
    )
    bins = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sizes = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = (
        source_targets(sizes, total_share, cap)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", (F.round(F.col("target")) - F.col("epochs") * F.col("source_size")).cast("long"))
    )
    # the bin in which the running sum passes the budget: BUCKETS rows per source at most
    upto = W.partitionBy("source").orderBy("bucket")
    edge = (
        bins.withColumnRenamed("source", "s").join(targets.select(F.col("source").alias("t"), "budget"), F.col("s").eqNullSafe(F.col("t")))
        .select(F.col("s").alias("source"), "bucket", "words", "budget")
        .withColumn("before", F.sum("words").over(upto) - F.col("words"))
        .filter((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget")))
        .select(F.col("source").alias("e"), F.col("bucket").alias("edge"), "before")
    )
    plan = written(targets.join(edge, F.col("source").eqNullSafe(F.col("e")), "left").drop("e").withColumnRenamed("source", "s"))
    side = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    joined = rows.join(side, F.col("source").eqNullSafe(F.col("s")))
    whole = joined.filter(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).withColumn(
        "part", F.when(F.col("edge").isNull() | (F.col("bucket") < F.col("edge")), F.when(F.col("budget") > 0, F.col("size")).otherwise(0)).otherwise(0).cast("long")
    )
    sorted_rows = W.partitionBy("source", "bucket").orderBy(F.desc("key"), "doc_id", "size")
    at_edge = joined.filter(F.col("bucket") == F.col("edge")).withColumn(
        "until", F.sum("size").over(sorted_rows.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("before")
    )
    at_edge = at_edge.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("budget") - F.col("until") + F.col("size"))).cast("long")).drop("until")
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return whole.unionByName(at_edge).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", "text").withColumn("size", n_words(F.col("text"))).withColumn("weight", quality_weight(F.col("text"), F.col("size"))).drop("text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(sized_documents(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS symbols FROM documents),
k AS (
  SELECT doc_id, source, size,
         pow((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0,
             1.0 / greatest(0.1, 1.0 - symbols / greatest(size, 1))) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM r),
t AS (
  SELECT source, source_size, CASE WHEN v IS NULL THEN cap ELSE least(cap, weight * v) END AS target
  FROM (SELECT *, (SELECT arg_min(water, ratio) FROM l WHERE water <= ratio) AS v FROM l)),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
j AS (
  SELECT k.*, b.source_size, b.target, b.epochs, (round(b.target) - b.epochs * b.source_size)::BIGINT AS budget,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY key DESC, doc_id, size ROWS UNBOUNDED PRECEDING) AS until
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - until + size)))::BIGINT AS taken FROM j
"""
