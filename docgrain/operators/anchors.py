"""Link extracted values to the OCR blocks they were read from.

A value anchors to a block when one's key contains the other's; the shortest block wins, the
first in block order on ties. Containment has no equi-key, so the pairs to test are kept to one
document by construction: either both sides sit in the document's own row, or each block row
meets the short field list of its run. Only matches become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.barrier import compute_once, unroll
from ..functions.text import anchor_text, blank_to_null, block_id_page, norm_key
from ..session import stage
from .containment import occurrences

MIN_NEEDLE = 2  # shorter keys match almost anything
CHUNK_BYTES = 1 << 20
FEW_PAIRS = 2000  # up to here every pair is tested: cheaper than to index grams


def _needles(fields: Column) -> Column:
    keyed = F.transform(
        fields,
        lambda f: F.struct(
            f["ord"].alias("ord"), f["path"].alias("path"), norm_key(f["value"]).alias("needle")
        ),
    )
    return F.filter(keyed, lambda f: F.length(f["needle"]) >= MIN_NEEDLE)


def _touches(needle: Column, hay: Column) -> Column:
    return F.contains(hay, needle) | F.contains(needle, hay)


def anchors_in_payload(
    df: DataFrame, fields: str, blocks: str, keys: list[str], page_no: int | None = None
) -> DataFrame:
    """Anchors where a row holds both the fields and the blocks of one document.

    ``fields`` is array<struct<ord,path,value>>, ``blocks`` the payload's block array. No
    shuffle: each field is compared with the blocks of its own row, and only anchors leave it.
    """
    usable = F.filter(
        F.transform(
            blocks,
            lambda b, i: F.struct(
                b["id"].alias("id"),
                b["page"].alias("page"),
                norm_key(anchor_text(b["html"], b["markdown"])).alias("hay"),
                i.alias("ord"),
            ),
        ),
        lambda b: (F.length(b["id"]) > 0) & (F.length(b["hay"]) > 0),
    )
    if page_no is not None:
        usable = F.filter(usable, lambda b: F.coalesce(b["page"], F.lit(-1)) == page_no - 1)
    # Both prepared arrays pass an explode, which keeps them computed columns; inlined into the
    # comparison they would be computed again for every pair.
    both = F.struct(usable.alias("blocks"), _needles(F.col(fields)).alias("needles"))
    rows = compute_once(df, keys, both, "__x")

    def anchor(f: Column) -> Column:
        touched = F.filter("__x.blocks", lambda b: _touches(f["needle"], b["hay"]))
        ranked = F.transform(
            touched,
            lambda b: F.struct(
                F.length(b["hay"]).alias("n"), b["ord"].alias("o"), b["id"].alias("id")
            ),
        )
        return F.struct(
            f["ord"].alias("field_ord"),
            f["path"].alias("path"),
            F.array_min(ranked).getField("id").alias("block_id"),
        )

    found = unroll(rows, F.transform("__x.needles", anchor), keys, "__p", "a")
    return found.filter("a.block_id IS NOT NULL").select(*keys, "a.*")


def anchors_over_tables(
    runs: DataFrame, fields: str, blocks: DataFrame, key: str, page_no: int | None = None
) -> DataFrame:
    """Anchors where the blocks are a table of their own.

    ``runs`` has one row per ``key`` with its field array; ``blocks`` has key, ord, block_id,
    html, markdown, page. The join is on the run with one row on the runs side, so a run with
    very many blocks is split by AQE, and each block emits only the fields it matches.
    """
    usable = _usable_blocks(blocks, key, page_no)
    needles = runs.select(key, _needles(F.col(fields)).alias("needles"))
    touched = F.filter("needles", lambda f: _touches(f["needle"], F.col("hay")))
    cand = F.struct(F.length("hay").alias("n"), "ord", "block_id").alias("cand")
    hits = unroll(usable.join(needles, key), touched, [key, cand], "__p", "f")
    best = hits.groupBy(key, "f.path").agg(
        F.min("f.ord").alias("field_ord"), F.min("cand").alias("cand")
    )
    return best.select(key, "field_ord", "path", F.col("cand.block_id").alias("block_id"))


def _usable_blocks(blocks: DataFrame, key: str, page_no: int | None) -> DataFrame:
    """(key, ord, block_id, hay) of the blocks that have an id and text."""
    hay = norm_key(anchor_text(F.col("html"), F.col("markdown")))
    usable = blocks.filter("block_id IS NOT NULL AND block_id <> ''")
    if page_no is not None:
        usable = usable.filter(F.coalesce("page", F.lit(-1)) == page_no - 1)
    return compute_once(usable, [key, "ord", "block_id"], blank_to_null(hay), "hay")


def anchors_in_chunks(
    fields: DataFrame, blocks: DataFrame, key: str, page_no: int | None = None, chunk: int = CHUNK_BYTES
) -> DataFrame:
    """Anchors where both the fields and the blocks of a run may be very many.

    ``fields``: key, ord, path, value; ``blocks``: key, ord, block_id, html, markdown, page. The result is that of
    :func:`anchors_over_tables`. Texts that a run repeats are taken once, blocks by their first place. Values and block texts of
    a run are dealt into chunks of about ``chunk`` bytes, and each pair of chunks is a row of an equi-join on (run, chunk), so
    a run of any size is spread over tasks and no row outgrows two chunks and one text. Inside a pair, a value in a block and a
    block in a value are both looked up by the rarest gram of the shorter text.
    """
    usable = _usable_blocks(blocks, key, page_no).filter(F.col(key).isNotNull())
    needles = compute_once(
        fields.filter(F.col(key).isNotNull()), [key, "ord", "path"], norm_key(F.col("value").cast("string")), "needle"
    ).filter(F.length("needle") >= MIN_NEEDLE)
    needles = stage(needles, "anchor-values")
    hays = usable.groupBy(key, "hay").agg(F.min(F.struct("ord", "block_id")).alias("first"))
    hays = stage(hays.select(key, "hay", "first.*"), "anchor-blocks")
    block_chunks = _chunks(hays, key, "hay", chunk, "__b")
    rows = F.collect_list(F.struct("hay", "ord", "block_id")).alias("hays")
    packed = block_chunks.groupBy(key, "__b").agg(rows)
    value_chunks = _chunks(needles.select(key, "needle").distinct(), key, "needle", chunk, "__v")
    lists = value_chunks.groupBy(key, "__v").agg(F.collect_list("needle").alias("values"))
    counts = block_chunks.groupBy(key).agg(F.max("__b").alias("__last"))
    sent = lists.join(counts, key).withColumn("__b", F.explode(F.sequence(F.lit(0), "__last")))
    pairs = packed.join(sent, [key, "__b"]).select(key, "values", "hays")
    out = T.StructType([pairs.schema[key], *[T.StructField(n, t()) for n, t in _BEST]])
    best = pairs.mapInArrow(_best_blocks, out).groupBy(key, "needle").agg(F.min(F.struct("n", "ord", "block_id")).alias("cand"))
    anchored = needles.join(best, [key, "needle"]).groupBy(key, "path").agg(
        F.min("ord").alias("field_ord"), F.min("cand").alias("cand")
    )
    return anchored.select(key, "field_ord", "path", F.col("cand.block_id").alias("block_id"))


_BEST = [("needle", T.StringType), ("n", T.IntegerType), ("ord", T.LongType), ("block_id", T.StringType)]


def _chunks(rows: DataFrame, key: str, text: str, chunk: int, name: str) -> DataFrame:
    """Rows with the number of their chunk inside the key: as many chunks as the bytes of the key ask for."""
    totals = rows.groupBy(key).agg(F.ceil(F.sum(F.octet_length(text)) / chunk).alias("__chunks"))
    dealt = F.pmod(F.xxhash64(text), F.greatest("__chunks", F.lit(1))).cast("int")
    return rows.join(totals, key).withColumn(name, dealt).drop("__chunks")


def _best_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, needle, n, ord, block_id): the first block by length and order that touches each value of a pair of chunks."""
    for batch in batches:
        for i in range(batch.num_rows):
            values = [v.encode() for v in batch.column(1)[i].as_py()]
            hays = sorted((len(h["hay"]), h["ord"], h["block_id"], h["hay"]) for h in batch.column(2)[i].as_py())
            texts = [h[3].encode() for h in hays]
            first = np.full(len(values), len(hays))
            if len(values) * len(texts) <= FEW_PAIRS:
                for v, value in enumerate(values):
                    first[v] = next((h for h, text in enumerate(texts) if value in text or text in value), len(hays))
            else:
                v, h = occurrences(values, texts)
                np.minimum.at(first, v, h)
                h, v = occurrences(texts, values)
                np.minimum.at(first, v, h)
            found = np.flatnonzero(first < len(hays)).tolist()
            cells = [hays[first[v]] for v in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([i] * len(found), pa.int64())),
                    pa.array([values[v].decode() for v in found], pa.string()),
                    pa.array([c[0] for c in cells], pa.int32()),
                    pa.array([c[1] for c in cells], pa.int64()),
                    pa.array([c[2] for c in cells], pa.string()),
                ],
                names=[batch.schema.names[0], "needle", "n", "ord", "block_id"],
            )


def field_pages(anchors: DataFrame) -> DataFrame:
    """Anchors with the 1-based page named in the block id; unnamed pages are left out."""
    return anchors.withColumn("page_no", block_id_page(F.col("block_id"))).filter(
        "page_no IS NOT NULL"
    )


def block_to_field(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Field shown for each block; of several the last in field order."""
    return anchors.groupBy(*keys, "block_id").agg(F.max_by("path", "field_ord").alias("path"))
