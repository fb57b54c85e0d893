"""Value distributions of field profiles.

``value_counts`` (one row per profile and value) carries everything: a profile is exact while it has
at most ``exact_distinct_threshold`` values whose texts take at most
``exact_value_bytes_per_field_profile`` bytes; both only grow, so the order of rows doesn't matter.
The rest get a HyperLogLog estimate, which depends on the set of values alone, and heavy hitters.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import ValueProfile
from ..functions.hashing import hex64
from ..functions.json_columns import truncate_utf8, truncated
from .fields import with_field_ids
from .ids import fnv_hex, hll_place, profile_ids

#: Registers to alpha: fixed values of HyperLogLog.
ALPHA = {16: 0.673, 32: 0.697, 64: 0.709}


def value_bytes(kind: Column, text: Column) -> Column:
    return F.when(kind == "null", 0).when(kind == "boolean", 1).otherwise(F.octet_length(text)).cast("long")


def value_counts(fields: DataFrame) -> DataFrame:
    """(field_profile_id, value_hash, observed_type, text, n, bytes).

    Rows are grouped as they are and only the distinct ones, after the shuffle, get their ids.
    """
    grouped = fields.groupBy("shape_id", "field_name", "observed_type", "text").agg(F.count("*").alias("n"))
    return with_field_ids(grouped).select("field_profile_id", "value_hash", "observed_type", "text", "n", value_bytes(F.col("observed_type"), F.col("text")).alias("bytes"))


def decide(counts: DataFrame, options: ValueProfile) -> DataFrame:
    """(field_profile_id, n_values, is_exact): a plain aggregation, so no profile sits in one task."""
    exact = (F.count("*") <= options.exact_distinct_threshold) & (F.sum("bytes") <= options.exact_value_bytes_per_field_profile)
    return counts.groupBy("field_profile_id").agg(F.count("*").alias("n_values"), exact.alias("is_exact"))


def hll_estimates(values: DataFrame, precision: int) -> DataFrame:
    """(field_profile_id, estimate) of distinct (field_profile_id, value_hash) rows, in two group-bys."""
    m = 1 << precision
    placed = values.withColumn("at", hll_place(precision)("value_hash"))
    registers = placed.groupBy("field_profile_id", F.col("at.register").alias("register")).agg(F.max("at.rank").alias("rank"))
    zeros = F.lit(m) - F.col("used")
    sums = registers.groupBy("field_profile_id").agg(F.count("*").alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("inverse"))
    raw = F.lit(ALPHA.get(m, 0.7213 / (1 + 1.079 / m)) * m * m) / (F.col("inverse") + zeros)
    linear = F.lit(float(m)) * F.log(F.lit(float(m)) / zeros)
    estimate = F.when((raw <= 2.5 * m) & (zeros > 0), linear).otherwise(raw)
    return sums.select("field_profile_id", F.round(estimate).cast("long").alias("estimate"))


def relative_error(precision: int) -> float:
    return 1.04 / math.sqrt(1 << precision)


class SpaceSaving:
    """The ``limit`` counters of the Space-Saving summary; the least count, then the least key gives way."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.counts: dict[str, list[int]] = {}  # key: count, error
        self._heap: list[tuple[int, str]] = []  # may lag behind counts

    def observe(self, key: str) -> str | None:
        """Count ``key``; the key that gave way for it, if any."""
        if not self.limit:
            return None
        if (c := self.counts.get(key)) is not None:
            c[0] += 1
            return None
        gone, floor = None, 0
        if len(self.counts) >= self.limit:
            while True:
                n, gone = self._heap[0]
                now = self.counts.get(gone)
                if now is not None and now[0] == n:
                    break
                heapq.heappop(self._heap)
                if now is not None:
                    heapq.heappush(self._heap, (now[0], gone))
            heapq.heappop(self._heap)
            floor = self.counts.pop(gone)[0]
        self.counts[key] = [floor + 1, floor]
        heapq.heappush(self._heap, (floor + 1, key))
        return gone

    def top(self) -> list[tuple[str, int, int]]:
        """(key, count, error), most frequent first, then by key."""
        return sorted(((k, n, e) for k, (n, e) in self.counts.items()), key=lambda x: (-x[1], x[0]))


def heavy_hitters_exact(counts: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most frequent values of each profile with their true counts; ties by key."""
    rank = F.row_number().over(W.partitionBy("field_profile_id").orderBy(F.desc("n"), "key"))
    return counts.withColumn("key", summary_key()).withColumn("rank", rank).filter(F.col("rank") <= limit).drop("key")


def summary_key() -> Column:
    """What counters are kept by: the text of a value, the hash of a container's."""
    return F.when(F.col("observed_type").isin("object", "array"), fnv_hex(F.col("text"))).otherwise(F.col("text"))


def heavy_hitters_sequential(fields: DataFrame, limit: int) -> DataFrame:
    """Space-Saving over each profile's values in document order.

    Rows stream through a task sorted by profile and place, so a task holds ``limit`` counters and a
    batch, never a group.  The summary depends on order, so one profile's rows do pass one task;
    ``heavy_hitters_exact`` is the form for large inputs.
    """
    keyed = with_field_ids(fields).select("field_profile_id", "doc_idx", "ord", "value_hash", "observed_type", "text", summary_key().alias("key"))
    ordered = keyed.repartition("field_profile_id").sortWithinPartitions("field_profile_id", "doc_idx", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, summary, held = None, SpaceSaving(limit), {}

        def done() -> pa.RecordBatch:
            rows = [(current, *held[k], n, i + 1) for i, (k, n, _) in enumerate(summary.top())]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["field_profile_id", "value_hash", "observed_type", "text", "n", "rank"])

        for b in batches:
            names = ("field_profile_id", "value_hash", "observed_type", "text", "key")
            for profile, h, kind, text, key in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                if profile != current:
                    if current is not None:
                        yield done()
                    current, summary, held = profile, SpaceSaving(limit), {}
                if (gone := summary.observe(key)) is not None:
                    del held[gone]
                held[key] = (h, kind, text)
        if current is not None:
            yield done()

    return ordered.mapInArrow(run, "field_profile_id string, value_hash long, observed_type string, text string, n long, rank int")


def distributions(fields: DataFrame, counts: DataFrame, decided: DataFrame, options: ValueProfile, mode: str = "exact") -> DataFrame:
    """Stored values: all of an exact profile, the heavy hitters of the others."""
    known = counts.join(decided, "field_profile_id")
    rank = F.row_number().over(W.partitionBy("field_profile_id").orderBy(F.desc("n"), hex64(F.col("value_hash"))))
    exact = known.filter("is_exact").withColumn("rank", rank)
    if mode == "exact":
        heavy = heavy_hitters_exact(known.filter("NOT is_exact"), options.heavy_hitter_limit)
    else:
        loose = fields.withColumn("field_profile_id", profile_ids("shape_id", "field_name", "observed_type")).join(decided.filter("NOT is_exact").select("field_profile_id"), "field_profile_id", "left_semi")
        heavy = heavy_hitters_sequential(loose.drop("field_profile_id"), options.heavy_hitter_limit)
    shown = lambda df, full: df.select(
        "field_profile_id",
        hex64(F.col("value_hash")).alias("value_hash"),
        F.col("observed_type").alias("value_type"),
        truncate_utf8(F.col("text"), options.value_text_limit_bytes).alias("value_text"),
        truncated(F.col("text"), options.value_text_limit_bytes).alias("value_text_truncated"),
        F.col("n").alias("count"),
        F.lit("exact" if full else "approximate").alias("count_method"),
        F.lit("exact_full" if full else "heavy_hitter").alias("value_source"),
        F.col("rank").cast("int").alias("rank"),
        F.lit(int(full)).alias("is_complete_distribution"),
    )
    return shown(exact, True).unionByName(shown(heavy, False))


def field_summaries(sums: DataFrame, counts: DataFrame, decided: DataFrame, stored: DataFrame, options: ValueProfile) -> DataFrame:
    """A row per field profile: counts, distinct count and how it was had, stored values."""
    loose = counts.join(decided.filter("NOT is_exact").select("field_profile_id"), "field_profile_id", "left_semi")
    estimates = hll_estimates(loose.select("field_profile_id", "value_hash"), options.hll_precision)
    kept = stored.groupBy("field_profile_id").agg(F.count("*").alias("stored_value_count"))
    joined = sums.join(decided, "field_profile_id").join(estimates, "field_profile_id", "left").join(kept, "field_profile_id", "left")
    return joined.select(
        *sums.columns,
        F.when(F.col("is_exact"), F.col("n_values")).otherwise(F.col("estimate")).alias("distinct_count"),
        F.when(F.col("is_exact"), "exact").otherwise("approximate").alias("distinct_count_method"),
        F.when(~F.col("is_exact"), "hyperloglog").alias("distinct_algorithm"),
        F.when(~F.col("is_exact"), F.lit(relative_error(options.hll_precision))).alias("distinct_error_rate"),
        F.coalesce("stored_value_count", F.lit(0)).alias("stored_value_count"),
    )
