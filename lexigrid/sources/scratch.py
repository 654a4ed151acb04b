"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables that this process wrote, until they are removed.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset in a local session a temporary
    folder is made, recorded in the session and removed when Python ends.  On a
    cluster, where executors do not see such a folder, it has to be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and the executors of {master} share")
        folder = tempfile.mkdtemp(prefix="lexigrid-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    _written.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _written[-1]


def clean(spark: SparkSession) -> int:
    """Remove all tables that this process wrote so far; how many.  What was read from
    them can't be read again."""
    gone = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` and read it back, which cuts its lineage.  Spark's committer
    leaves no partial rows of lost or repeated tasks behind."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
