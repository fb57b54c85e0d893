"""Where driver-written tables go: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where none is configured."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all share")
        base = "file://" + tempfile.mkdtemp(prefix="valuegrain-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/profile-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table there: evaluated once, read again with column pruning, no lineage behind it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
