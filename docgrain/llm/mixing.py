"""Mixing sources to target weights: a proportionate-fair order of source blocks."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .prefix import with_prefix

BLOCK = 16  # documents of one source that stand together
PERIOD = 1000  # slots of one round of the schedule when shares are derived from the sources
MAX_SOURCES = 10_000


def edf_period(shares: Mapping) -> list[tuple]:
    """One period of the schedule: (source, i, slot), i counting the blocks of a source from 0.

    Source s owns ``shares[s]`` of the ``sum(shares)`` slots. Its block i may not start before
    floor(i / w) and must end by ceil((i + 1) / w), w being its weight. In every slot the released
    block with the earliest deadline goes. At full load all windows are met, so after any number
    of slots each source has its share within less than one block; the period ends with all
    shares used up exactly, so periods can be repeated for ever.
    """
    period = sum(shares.values())
    names = sorted(shares, key=lambda s: (s is not None, str(s)))
    waiting = [(0, no, 0) for no in range(len(names))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, no, i = heapq.heappop(waiting)
            share = shares[names[no]]
            heapq.heappush(ready, (-(-(i + 1) * period // share), no, i))
        _, no, i = heapq.heappop(ready)
        out.append((names[no], i, slot))
        if i + 1 < shares[names[no]]:
            heapq.heappush(waiting, ((i + 1) * period // shares[names[no]], no, i + 1))
    return out


def tempered_shares(counts: Mapping, power: float = 0.5, period: int = PERIOD) -> dict:
    """Integer shares in proportion to a power of the sources' sizes, at least one each.

    The period grows with the number of sources, twenty slots a source, so that small ones keep shares of their own.
    """
    whole = sum(n**power for n in counts.values())
    period = max(period, 20 * len(counts))
    return {s: max(1, round(period * n**power / whole)) for s, n in counts.items()}


def source_counts(docs: DataFrame, source_col: str) -> dict:
    """Rows per source; one row per source comes to the driver, at most ``MAX_SOURCES``."""
    rows = docs.groupBy(F.col(source_col).cast("string").alias("s")).count().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group small ones under one name first")
    return {r["s"]: r["count"] for r in rows}


def _schedule(spark: SparkSession, shares: Mapping) -> DataFrame:
    rows = [(s, shares[s], i, slot) for s, i, slot in edf_period(shares)]
    return spark.createDataFrame(rows, "at_source string, share int, at_block int, at_slot int")


def mix_order(
    docs: DataFrame,
    shares: Mapping | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, source, block, slot, position): the place of each document in the mix.

    The rows of a source are shuffled by a hash of id and content and cut into blocks of ``block``; block n of a
    source takes the slot that the periodic schedule of :func:`edf_period` gives it. ``shares``
    are integer target weights by source; by default they follow the square root of the sources'
    sizes. Until a source runs out, each source's part of any prefix is its target within less than
    one block, besides the block in progress. After that its slots stay empty and the others go on in their proportion: every
    row has a place of its own, none is dropped or repeated.

    ``position`` numbers the rows from 0 in the order of the mix. A null source is a source
    like any other. A source without a share (or a share below one) comes after all others, one slot per block. Rows without id and
    rows that repeat an id are placed like any other. An empty table gives no rows.
    """
    return _places(_keyed(docs, id_col, source_col), shares, block).drop("row")


def _keyed(docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, mixed, row): the hash that orders a source's rows, and a number that tells equal rows apart.

    Written once: a number of a row holds only as long as the input is not split anew.
    """
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        _mixing_hash(docs, id_col),
        F.monotonically_increasing_id().alias("row"),
    )
    return stage(keyed, "mix-rows")


def _places(keyed: DataFrame, shares: Mapping | None, block: int) -> DataFrame:
    """(doc_id, source, block, slot, position, row) of rows of :func:`_keyed`."""
    spark = keyed.sparkSession
    if shares is None:
        shares = tempered_shares(source_counts(keyed, "source"))
    shares = {s: int(n) for s, n in shares.items() if n >= 1}
    period = sum(shares.values())
    ranked = with_prefix(keyed, ["source", "mixed", "doc_id", "row"])
    first = ranked.groupBy(F.col("source").alias("s")).agg(F.min("row_no").alias("first"), F.count("*").alias("n"))
    rows = ranked.join(first, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id",
        "source",
        "row",
        F.expr(f"(row_no - first) div {block}").alias("block"),
        F.expr(f"(row_no - first) % {block}").alias("inside"),
    )
    own = spark.createDataFrame(list(shares.items()), "own_source string, own_share long")
    rows = rows.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("own_source")), "left")
    table = F.broadcast(_schedule(spark, shares))  # as many rows as a period has slots
    fits = F.col("source").eqNullSafe(F.col("at_source")) & (F.col("block") % F.col("own_share") == F.col("at_block"))
    rows = rows.join(table, fits, "left").withColumn("late", F.col("own_share").isNull())
    slot = F.expr(f"(block div own_share) * {period} + at_slot")
    rows = rows.select("doc_id", "source", "row", "block", "late", F.coalesce(slot, "block").alias("slot"), "inside")
    out = with_prefix(rows, ["late", "slot", "source", "inside"])
    return out.select("doc_id", "source", "block", "slot", F.col("row_no").alias("position"), "row")


def mixed(docs: DataFrame, shares: Mapping | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """All rows and columns of ``docs``, range-partitioned and sorted by their place in the mix.

    Written to files, the rows stand in the order of the mix. See :func:`mix_order`.
    """
    spare = "place"
    while any(f"{spare}_{x}" in docs.columns for x in "rp"):
        spare += "_"
    r, p = f"{spare}_r", f"{spare}_p"
    # The rows are written with their numbers, which so hold for both sides of the join.
    whole = stage(docs.withColumn(r, F.monotonically_increasing_id()), "mix-input")
    keyed = whole.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _mixing_hash(docs, id_col), F.col(r).alias("row"))
    places = _places(keyed, shares, block).select(F.col("row").alias(r), F.col("position").alias(p))
    rows = whole.join(places, r)
    return rows.repartitionByRange(F.col(p)).sortWithinPartitions(p).drop(r, p)


def _mixing_hash(docs: DataFrame, id_col: str):
    """Hash of the id and of the plain columns of a row."""
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if kind in ("string", "bigint", "int", "double")]
    return F.xxhash64(F.col(id_col), *plain).alias("mixed")
