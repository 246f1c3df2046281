"""Tables that cut lineage, in the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one. Where none is named, a local session gets a temporary one and a cluster's is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, uuid.uuid4().hex)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The frame written to a new folder, or added to the table at `path`, and read again."""
    to = path or folder(df.sparkSession)
    df.write.mode("append").parquet(to)
    out = df.sparkSession.read.schema(df.schema).parquet(to)
    out._scratch = to
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table of a frame that `stored` gave and that no later result reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
