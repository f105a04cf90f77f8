"""Running sums and extremes over a whole table's order, without one task that sorts it.

The table is cut into ranges of the order, each its own window; what comes before a range is carried over from the ranges'
totals, one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.lineage import cut

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}
_BOTH = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}


def in_ranges(x: DataFrame, *order: str) -> DataFrame:
    """The rows with the number of their range of the order, written once so that a task that runs again changes nothing."""
    return cut(x.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def running(x: DataFrame, order: list[str], up: dict[str, tuple[str, Column]], down: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Further columns: sums, maxima or minima (name -> kind, of what) of all rows up to each one, or (``down``) from it on."""
    down = down or {}
    both = {**up, **down}
    total = x.groupBy("_range").agg(*(_FOLD[kind](of).alias(f"_t_{name}") for name, (kind, of) in both.items()))
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    ranges, own = Window.orderBy("_range"), Window.partitionBy("_range").orderBy(*order)
    before = lambda name: ranges.rowsBetween(first, -1) if name in up else ranges.rowsBetween(1, last)
    within = lambda name: own.rowsBetween(first, 0) if name in up else own.rowsBetween(0, last)
    carried = total.select("_range", *(_FOLD[kind](f"_t_{name}").over(before(name)).alias(f"_c_{name}") for name, (kind, _) in both.items()))
    y = x.select("*", *(_FOLD[kind](of).over(within(name)).alias(f"_w_{name}") for name, (kind, of) in both.items())).join(F.broadcast(carried), "_range")
    return y.select(*x.columns, *(_BOTH[kind](F.col(f"_w_{name}"), F.col(f"_c_{name}")).alias(name) for name, (kind, _) in both.items()))
