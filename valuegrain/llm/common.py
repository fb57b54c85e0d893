"""Helpers that all training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
WORD = r"[^\x20\x09-\x0D]+"

#: Folders of this process, by session folder, removed at exit.
_made: set[str] = set()
#: What this worker process keeps from one task to the next, by operator.
_kept: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where no folder is configured (a local session, as in tests) a temporary one is set.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all share")
        base = "file://" + tempfile.mkdtemp(prefix="valuegrain-")
        sc.setCheckpointDir(base)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/valuegrain-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean, spark)
    _made.add(path)
    return path


def _clean(spark: SparkSession) -> None:
    for path in list(_made):
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone
            return


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, no lineage behind it."""
    path = shared_dir(df.sparkSession) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 800, size: str = "8m") -> None:
    """Fewer rows and bytes in an Arrow batch than Spark's default, for texts are long; an own setting stays.

    It holds for the session, since results are evaluated after an operator has returned.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, size)


def shrink_heaps(spark: SparkSession) -> None:
    """Executors collect garbage now, so that heaps grown by earlier stages go back to the system before workers need room beside them.

    Nothing depends on it: where Spark doesn't allow the call, heaps stay as they are.
    """
    n = spark.sparkContext.defaultParallelism
    try:
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()
    except PySparkException:
        pass


def kept(owner: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a worker process and kept until tasks of another owner run in it."""
    if owner not in _kept:
        _kept[owner] = make()
    return _kept[owner]


def slices(batches: Iterator[pa.RecordBatch], rows: int, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller parts, so that a worker turns few texts at once into Python objects.

    What the worker keeps of other owners goes first.  Then and at the end freed memory goes back to the system: workers are kept for later tasks, and
    beside the JVM's heap each executor has little room.
    """
    if others := [k for k in _kept if k != owner]:
        for other in others:
            del _kept[other]
        _give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    _give_back()


def _give_back() -> None:
    """Freed memory of this worker process goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def hash_order(*cols: str) -> list[Column]:
    """A fixed pseudo-random order of rows, for bounded samples of labelled rows."""
    return [F.xxhash64(*cols), *map(F.col, cols)]


