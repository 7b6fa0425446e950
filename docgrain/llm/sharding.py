"""Contiguous shards of near-equal size, cut from global prefix sums of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from .prefix import with_prefix

SHARDS = 40
OVERHEAD = 16


def balanced_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    overhead: int = OVERHEAD,
    order: list | None = None,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row; the law is ``bytes``.

    Rows are put in one order, the bytes before each row follow from the totals of range
    partitions, and the order is cut at equal byte targets: a row lies in the shard in which its
    middle byte lies, so a shard's size differs from the target by less than the largest row.

    ``order``: columns of ``docs`` to keep as the order. By default rows are ordered by a hash
    of the text, then id, so equal texts are neighbours; a group of equal texts no larger than
    the largest row is placed whole, by its own middle byte, which keeps shards within twice
    the largest row of the target. Larger groups may cross a cut.

    size: UTF-8 bytes of the text plus ``overhead``; a null text has no bytes and CRC 0. ``slot``
    numbers the rows of a shard from 0 in that order. With fewer rows than shards some shards stay
    empty. Repeated rows count each; rows without id take part. An empty table gives no rows.
    Only ids, sizes and hashes are shuffled, never texts.
    """
    text = F.col(text_col).cast("string")
    keys = [F.xxhash64(text)] if order is None else order
    names = [f"k{i}" for i in range(len(keys))]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        *[k.alias(n) for k, n in zip(keys, names, strict=True)],
    )
    placed = with_prefix(rows, [*names, "doc_id", "text_crc32"], "size", keep_part=True)
    total, most = rows.agg(F.sum("size"), F.max("size")).first()
    middle = 2 * F.col("before") + F.col("size")
    if order is None:
        placed = _with_group_bounds(placed)
        middle = F.when(F.col("high") - F.col("low") <= (most or 0), F.col("low") + F.col("high")).otherwise(middle)
    placed = placed.withColumn("middle", middle).withColumn("shard", F.expr(f"(middle * {shards}) div {2 * (total or 1)}"))
    first = placed.groupBy(F.col("shard").alias("s")).agg(F.min("row_no").alias("first"))
    return placed.join(F.broadcast(first), F.col("shard") == F.col("s")).select(  # a row per shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("row_no") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _with_group_bounds(placed: DataFrame) -> DataFrame:
    """Add ``low`` and ``high``, the bytes between which the row's group of equal texts lies.

    A group is a stretch of the order, so its bounds are found inside the range partition,
    without dealing rows by group. Groups that cross partitions, fewer than there are partitions,
    are summed up by themselves and sent to all tasks.
    """
    end = F.col("before") + F.col("size")
    inside = Win.partitionBy("part", "k0")
    across = placed.groupBy(F.col("k0").alias("g")).agg(
        F.min("part").alias("first"), F.max("part").alias("last"), F.min("before").alias("from"), F.max(end).alias("to")
    )
    across = across.filter("first < last").select("g", "from", "to")
    bounded = placed.withColumn("low", F.min("before").over(inside)).withColumn("high", F.max(end).over(inside))
    return (
        bounded.join(F.broadcast(across), F.col("k0") == F.col("g"), "left")
        .withColumn("low", F.coalesce("from", "low"))
        .withColumn("high", F.coalesce("to", "high"))
        .drop("g", "from", "to")
    )
