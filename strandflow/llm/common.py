"""Helpers shared by the training-data operators.

Every operator takes a DataFrame and the names of its id and text columns, reads only those two, and so is indifferent
to further columns and to their names.  Text travels to Python as UTF-8 bytes in Arrow batches.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


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


@contextmanager
def by_shuffle(spark: SparkSession):
    """Joins that run inside are not broadcast unless a hint says so; the session's setting comes back."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8(name: str):
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns: ``doc_id`` long (may be null or repeated) and ``text`` as bytes (null: empty)."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), utf8(text_col).alias("text"))


def small_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches, so that no step holds more than a few MB of text (or one text) at a time."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        step = max(1, min(most_rows, int(n * most_bytes / max(1, b.nbytes))))
        for i in range(0, n, step):
            yield b.slice(i, step)


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """A function for mapInArrow from a function on one small batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = f(b)
            if out is not None and out.num_rows:
                yield out

    return run


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    have, name, k = {c.lower() for c in df.columns}, base, 0
    while name.lower() in have:
        k += 1
        name = f"{base}_{k}"
    return name


_KEPT: dict[str, list] = {}
_NOW = [""]


def keeps(group: str, *caches: dict) -> None:
    """Say which caches a group of operators keeps in a worker."""
    _KEPT.setdefault(group, []).extend(caches)


def use(group: str) -> None:
    """Empty the caches of all other groups: a worker serves one operator after the other, and has memory for one."""
    if _NOW[0] != group:
        _NOW[0] = group
        for name, caches in _KEPT.items():
            if name != group:
                for c in caches:
                    c.clear()


def ascii_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z: exactly what bytes.lower and bytes.split do."""
    return text.lower().split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
