"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; only a local master, as in tests, may do without."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="strandflow-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Tables in the shared folder, by the identity of their DataFrame.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing before it.

    The table goes with ``forget``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandflow-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, files = _place(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete the table of a DataFrame that ``cut`` gave, once nothing will read it again; others stay as they are."""
    path = _PATHS.pop(df, None) if df is not None else None
    if path:
        at, files = _place(df.sparkSession, path)
        files.delete(at, True)
