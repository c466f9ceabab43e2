"""Dense ordinals without a task that sees all rows: keys are dealt out by range, each
range is numbered on its own, and starts where the ones before it end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut, rows

KEYS_A_RANGE = 1_000_000


def ordinals(keys: DataFrame, column: str, into: str, ranges: int | None = None) -> DataFrame:
    """(column, into): the distinct values in order, numbered from 0; a null comes first."""
    distinct = cut(keys.select(column).distinct(), "keys")
    n = ranges or max(1, -(-rows(distinct) // KEYS_A_RANGE))
    ranged = cut(distinct.repartitionByRange(n, F.col(column).asc_nulls_first()).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = F.broadcast(sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(column).asc_nulls_first()))
    return ranged.withColumn("_k", inside).join(starts, "_range").select(column, (F.col("_start") + F.col("_k") - 1).cast("long").alias(into))
