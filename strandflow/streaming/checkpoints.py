"""Long loops that stop and go on: finished keys are written, and only the open ones are computed.

The analyses read their inputs to the end; there is nothing to stream in them.  What comes nearest is a long loop over keys whose
results are stored as they are ready, and adaptive permutation (see ``strandflow.operators.permutation``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.utils import AnalysisException


def finished(spark, path: str, key: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path).select(key).distinct()
    except AnalysisException:
        return None


def resume(keys: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame], batch: int = 1000) -> DataFrame:
    """Results of ``work`` on batches of keys, appended to ``path``; keys that are there already are left out.

    A batch is written whole or not at all, so a stopped loop goes on where it ended.  Batches go by a hash of the key.
    """
    from pyspark.sql import functions as F

    spark = keys.sparkSession
    done = finished(spark, path, key)
    left = keys if done is None else keys.join(done, key, "left_anti")
    n = -(-left.count() // batch)
    for k in range(n):
        work(left.where(F.pmod(F.xxhash64(key), F.lit(n)) == k)).write.mode("append").parquet(path)
    return spark.read.parquet(path)
