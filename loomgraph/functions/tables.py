"""Stages written as tables in the folder that the session names for that, which cuts their lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process, which are removed when it ends.
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset, a session on this machine alone (as in tests) gets
    one of its own, and a session on a cluster an error, as its executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "loomgraph-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loom-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: df as a parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{tag}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove_written() -> None:
    """Removes what written() wrote; results that still read it must have been used by then. It runs as the process ends."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session may have ended before; the folder is then left to whoever owns it
            continue


atexit.register(remove_written)
