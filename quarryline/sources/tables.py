"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a folder of the user's home in the default file system, or one
    of our own where that is a single machine's."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    files = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    home = files.getHomeDirectory()
    # a local default file system is that of one machine, as in tests
    return "file:///tmp/checkpoints/quarryline" if home.toUri().getScheme() == "file" else f"{home}/.quarryline"


def cut(df: DataFrame) -> DataFrame:
    """Write a table and read it back: lineage ends here, and a lost executor costs its running tasks only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ql-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return _read(spark, df.schema, [path])


def _read(spark: SparkSession, schema, paths: list[str]) -> DataFrame:
    back = spark.read.schema(schema).parquet(*paths)
    back._ql_paths = paths
    return back


def together(*parts: DataFrame) -> DataFrame:
    """The rows of several tables made by cut(), of one schema, as one scan."""
    return _read(parts[0].sparkSession, parts[0].schema, [p for x in parts for p in x._ql_paths])


@atexit.register
def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is None:
                return
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has gone; the cluster's own cleaner owns the folder
            return
