"""Ranking and marking that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage


def split_row_number(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str = "rn",
    bucket: Column | None = None,
    offsets_with: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without one task per key."""
    ones = df.withColumn("__one", F.lit(1).cast("long"))
    return split_running_sum(ones, keys, order, "__one", name, bucket, offsets_with).drop("__one")


def split_running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    value: str,
    name: str,
    bucket: Column | None = None,
    offsets_with: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``sum(value) over (partition by keys order by order rows up to here)`` without one task per key.

    Rows are summed up inside (keys, bucket); the sums of earlier buckets are added from a table of
    bucket totals, which is all that is ever gathered per key. Keys must not be null.

    Buckets follow the order. Without ``bucket`` they are the partitions of a range shuffle over
    keys and order: sampled from the data, so even, and as many per key at most as there are
    partitions. Their numbers are frozen by staging the rows. ``bucket`` names a cheaper split
    where the order column itself has one, such as the hundred-thousands of a position.

    ``offsets_with`` is given the small table of bucket offsets, which has ``keys``: columns it adds reach
    the rows of the bucket, and rows of the buckets it leaves out are dropped, without a shuffle of the rows.
    """
    part = "__bucket"
    if bucket is None:
        ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
        tagged = stage(ranged.withColumn(part, F.spark_partition_id()), "ranked")
    else:
        tagged = df.withColumn(part, bucket)
    totals = tagged.groupBy(*keys, part).agg(F.sum(value).alias("__n"))
    earlier = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, F.col(part).alias("__part"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    if offsets_with is not None:
        offsets = offsets_with(offsets)
    offsets = offsets.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.col(part) == F.col("__part")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    up_to = W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        tagged.withColumn("__inside", F.sum(value).over(up_to))
        .join(offsets, same)
        .withColumn(name, (F.col("__before") + F.col("__inside")).cast("long"))
        .drop(part, "__inside", "__before", "__part", *[f"__{k}" for k in keys])
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the highest ``order`` per key, combined map-side before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*").select(*df.columns)


def mark_latest(
    df: DataFrame, key: str, row_id: str | list[str], flag: str = "is_current"
) -> DataFrame:
    """Set ``flag`` on the row with the highest ``row_id`` of each key.

    ``row_id`` is a column, or several that name a row together. The winners are found with a
    pre-combined ``max`` and joined back on the row id, which is unique, so no task ever sees all
    rows of a hot key.
    """
    ids = [row_id] if isinstance(row_id, str) else row_id
    top = df.groupBy(F.col(key).alias("__key")).agg(F.max(F.struct(*ids)).alias("__r"))
    winners = top.select("__r.*").withColumn("__top", F.lit(True))
    rows = df.drop(flag) if flag in df.columns else df
    return (
        rows.join(winners, ids, "left")
        .select(*rows.columns, F.coalesce("__top", F.lit(False)).alias(flag))
    )
