"""Sources of documents: frames of (doc_idx BIGINT, raw STRING), one JSON text a row.

* a JSON file is one document, index 0;
* a JSONL file is one document per line that is not blank; its index is the number of the physical
  line, blank ones included, from 0;
* a folder or several files go on counting in the order of their paths;
* a table gives one document per row, indexed by a column of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import materialize

FORMATS = ("auto", "json", "jsonl")
#: File splits whose line counts are broadcast at most (about 128 TB at Spark's default split size).
MAX_BROADCAST_SPLITS = 1_000_000


def resolve_format(path: str, wanted: str = "auto", jsonl: bool = False) -> str:
    """An explicit format, else JSONL if asked for or named ``*.jsonl``, else JSON."""
    if wanted.lower() not in FORMATS:
        raise ValueError(f"invalid config: unsupported input.format: {wanted}")
    if wanted.lower() != "auto":
        return wanted.lower()
    return "jsonl" if jsonl or path.lower().endswith(".jsonl") else "json"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
    names = files.select("file").distinct().select("file", (F.row_number().over(W.orderBy("file")) - 1).cast("long").alias("doc_idx"))  # a row per file
    return files.join(names, "file").select("doc_idx", "raw")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their numbers, without a global sort.

    A file split is read in order by one task, so a row's running id within its split gives its place;
    splits are put in order by (file, start) and their row counts are summed: one row per split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value"), F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    splits = line_splits(lines)
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return _numbered(lines, materialize(splits.withColumn("before", before).drop("n"))).select(F.col("line").alias("doc_idx"), "raw")


def number_lines(lines: DataFrame) -> DataFrame:
    """(file, line, raw) of lines that are not blank, numbered within their file; ``lines``: value, id, file, block."""
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return _numbered(lines, materialize(line_splits(lines).withColumn("before", before).drop("n"))).select("file", "line", "raw")


def line_splits(lines: DataFrame) -> DataFrame:
    """Lines and least running id of every file split."""
    return lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _numbered(lines: DataFrame, splits: DataFrame) -> DataFrame:
    side = F.broadcast(splits) if splits.count() <= MAX_BROADCAST_SPLITS else splits
    rows = lines.join(side, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first_id")).alias("line"), F.regexp_replace("value", "\r$", "").alias("raw"))
    return rows.filter(F.col("raw").rlike(r"(?U)\S"))


def read_documents(spark: SparkSession, path: str, wanted: str = "auto") -> tuple[DataFrame, str]:
    """The documents of a file or folder and the format that was used."""
    if path == "-":
        raise ValueError("stdin is not supported; pass a JSON or JSONL file path")
    kind = resolve_format(path, wanted)
    return (read_jsonl if kind == "jsonl" else read_json)(spark, path), kind


def from_column(df: DataFrame, index: str | Column, text: str | Column) -> DataFrame:
    """Documents from a column of JSON texts; rows with a null text are left out."""
    index, text = (F.col(c) if isinstance(c, str) else c for c in (index, text))
    return df.select(index.cast("long").alias("doc_idx"), text.alias("raw")).filter("raw IS NOT NULL")


def from_table(df: DataFrame, index: str, columns: list[str] | None = None) -> DataFrame:
    """Documents from the rows of a table: one object each, with its columns in name order."""
    names = sorted(columns or [c for c in df.columns if c != index])
    return df.select(F.col(index).cast("long").alias("doc_idx"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("raw"))
