"""Global row numbers and prefix sums over an order, from the totals of range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage


def with_prefix(
    df: DataFrame, order: list[str], size: str | None = None, keep_part: bool = False
) -> DataFrame:
    """Add ``row_no`` (from 0) and, with ``size``, ``before``: the sum of that column over earlier rows.

    One range shuffle over ``order``; only the partitions' totals, one row each, are summed
    across partitions. The rows are written to the shared folder with their partition's number,
    which freezes the sampled bounds, so a recomputed task cannot move rows between partitions.
    ``order`` should tell rows apart: rows equal in all of it share a partition. ``df`` should
    hold short rows only (ids and sizes, no texts). ``keep_part`` leaves the number of the range
    partition in ``part``; rows are clustered by it.
    """
    tagged = stage(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "prefix")
    sums = [F.count("*").alias("rows")] + ([F.sum(size).alias("total")] if size else [])
    earlier = W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    totals = tagged.groupBy(F.col("part").alias("at")).agg(*sums)
    offsets = totals.select(
        "at",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        *([F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("total_before")] if size else []),
    )
    inside = W.partitionBy("part").orderBy(*order)
    numbered = tagged.withColumn("row_no", F.row_number().over(inside) - 1)
    if size:
        up_to = inside.rowsBetween(W.unboundedPreceding, -1)
        numbered = numbered.withColumn("before", F.coalesce(F.sum(size).over(up_to), F.lit(0)))
    out = numbered.join(offsets, F.col("part") == F.col("at"))
    out = out.withColumn("row_no", F.col("row_no") + F.col("rows_before"))
    if size:
        out = out.withColumn("before", F.col("before") + F.col("total_before"))
    out = out.drop("at", "rows_before", "total_before")
    return out if keep_part else out.drop("part")
