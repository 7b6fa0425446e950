"""The four streaming jobs. Each owns a root folder with its checkpoint and its output, so a
restarted job continues where it stopped and a replayed micro-batch rewrites only its own part.

No job of this module holds state or a watermark (those of :mod:`.stateful` do): each micro-batch is folded to what its result needs, and the
folded parts are merged by :class:`.partials.Partials`. The result is that of a batch job over all
rows, whatever the number of micro-batches and the order in which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import parse_request_log
from ..operators.ranking import latest_per_key, split_running_sum
from ..sources.uploads import document_key
from .partials import Fold, Partials


def watch(spark: SparkSession, path: str, schema: T.StructType | str, files: int = 1000) -> DataFrame:
    """Stream of the Parquet files of a table, a bounded number per micro-batch.

    ``path`` is a folder; a table kept as one file is watched by its name in the parent folder.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and fs.getFileStatus(target).isFile():
        return reader.option("pathGlobFilter", target.getName()).parquet(
            target.getParent().toString()
        )
    return reader.parquet(path)


def _start(stream: DataFrame, root: str, fold: Fold, continuous: bool) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(
        lambda batch, number: Partials(batch.sparkSession, root, fold).append(batch, number)
    )
    if continuous:
        return writer.trigger(processingTime="30 seconds").start()
    return writer.trigger(availableNow=True).start()


# ---- ingest ------------------------------------------------------------------------------------


def _first_uploads(rows: DataFrame) -> DataFrame:
    meta = [c for c in rows.columns if c != "sha256"]
    first = rows.groupBy("sha256").agg(F.min_by(F.struct(*meta), "upload_ord").alias("u"))
    return first.select("sha256", "u.*")


def stream_ingest(uploads: DataFrame, root: str, continuous: bool = False) -> StreamingQuery:
    """Store each content once as uploads arrive, under its first upload.

    ``uploads``: upload_ord, content and what else to carry. Only hashes and metadata are kept.
    A copy that arrives later is folded away, however late; one with a smaller ``upload_ord``
    takes the place of the first.
    """
    hashed = uploads.withColumn("sha256", F.sha2("content", 256)).drop("content")
    return _start(hashed, root, _first_uploads, continuous)


def uploads_from_stream(spark: SparkSession, root: str, uploads: T.StructType) -> DataFrame:
    """Stored contents: sha256, the metadata of the first upload, blob_key."""
    meta = [f for f in uploads.fields if f.name != "content"]
    schema = T.StructType([T.StructField("sha256", T.StringType()), *meta])
    rows = Partials(spark, root, _first_uploads).read(schema)
    return rows.withColumn("blob_key", document_key(F.col("sha256")))


# ---- current runs -------------------------------------------------------------------------------


def _newest_runs(rows: DataFrame) -> DataFrame:
    return latest_per_key(rows, ["document_id"], ["extraction_run_id"])


def stream_current_runs(runs: DataFrame, root: str, continuous: bool = False) -> StreamingQuery:
    """Keep the newest run per document while runs arrive in any order.

    ``runs``: document_id, extraction_run_id and what else to carry.
    """
    return _start(runs, root, _newest_runs, continuous)


def current_from_stream(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The current run of each document."""
    return Partials(spark, root, _newest_runs).read(schema)


def flag_current(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Run history with ``is_current`` as the stream has it; exactly one current run per document."""
    newest = current.select("extraction_run_id").withColumn("__current", F.lit(True))
    rows = runs.drop("is_current").join(newest, "extraction_run_id", "left")
    return rows.withColumn("is_current", F.coalesce("__current", F.lit(False))).drop("__current")


def documents_after_runs(documents: DataFrame, current: DataFrame) -> DataFrame:
    """Documents with type and status of their current run: ``extracted`` once there is one."""
    runs = current.select("document_id", F.col("doc_type").alias("__type"), F.lit(True).alias("__ran"))
    joined = documents.join(runs, "document_id", "left")
    return joined.select(
        *[F.col(c) for c in documents.columns if c not in ("doc_type", "status")],
        F.when(F.col("__ran"), F.col("__type")).otherwise(F.col("doc_type")).alias("doc_type"),
        F.when(F.col("__ran"), F.lit("extracted")).otherwise(F.col("status")).alias("status"),
    )


# ---- latest reviews ------------------------------------------------------------------------------


def _latest_edits(rows: DataFrame) -> DataFrame:
    return latest_per_key(
        rows, ["extraction_run_id", "field_path"], ["created_at", "field_review_id"]
    )


def stream_latest_reviews(reviews: DataFrame, root: str, continuous: bool = False) -> StreamingQuery:
    """Latest edit per (run, field)."""
    return _start(reviews, root, _latest_edits, continuous)


def reviews_from_stream(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    return Partials(spark, root, _latest_edits).read(schema)


# ---- request timing --------------------------------------------------------------------------------

# Durations are counted in buckets that grow by two per cent, so a percentile is read within one
# per cent of its value from counts that can be added up.
GROWTH = 1.02
PARTS_DDL = (
    "window_start timestamp, window_end timestamp, method string, path string, bucket int, "
    "n bigint, total_ms double, errors bigint"
)
_KEYS = ["window_start", "window_end", "method", "path"]
_SUMS = ["n", "total_ms", "errors"]


def _add_up(rows: DataFrame) -> DataFrame:
    sums = [F.sum(c).cast(t).alias(c) for c, t in zip(_SUMS, ("bigint", "double", "bigint"))]
    return rows.groupBy(*_KEYS, "bucket").agg(*sums)


def _merge_sessions(rows: DataFrame) -> DataFrame:
    """Sessions that overlap become one, counts added up by bucket.

    A part spans its requests and the gap after the last, so parts belong together exactly if one starts before the other has ended.
    Starts and ends of all parts are put in order; where the number of open parts rises from nothing a session begins, and the sessions
    are numbered by counting these places. Both are running sums over range partitions, so a session or a route of any size is spread
    over tasks, and only sums per session and bucket come together.
    """
    route = ["method", "path"]
    mark = lambda at, step: F.struct(F.col(at).alias("at"), F.lit(step).cast("long").alias("step"))
    # A part that starts where another ends still joins it.
    events = rows.withColumn("__e", F.explode(F.array(mark("window_start", 1), mark("window_end", -1)))).select(
        *[F.when(F.col("__e.step") > 0, F.col(c)).alias(c) for c in ["window_end", "bucket", *_SUMS]],
        *[F.coalesce(c, F.lit("")).alias(f"__{c}") for c in route],
        *route,
        "__e.*",
        F.xxhash64("window_start", "window_end", "bucket", *_SUMS).alias("__tie"),
    )
    keys = ["__method", "__path"]
    order = [F.col("at"), F.col("step").desc(), F.col("__tie")]
    open_now = split_running_sum(events, keys, order, "step", "__open")
    starts = open_now.withColumn("__new", ((F.col("step") > 0) & (F.col("__open") == 1)).cast("long"))
    numbered = split_running_sum(starts, keys, order, "__new", "__session").filter("step > 0")
    spans = numbered.groupBy(*route, "__session").agg(F.min("at").alias("window_start"), F.max("window_end").alias("window_end"))
    sums = [F.sum(c).cast(t).alias(c) for c, t in zip(_SUMS, ("bigint", "double", "bigint"))]
    added = numbered.groupBy(*[F.col(c).alias(f"__{c}") for c in route], F.col("__session").alias("__no"), "bucket").agg(*sums)
    same = F.col("__session") == F.col("__no")
    for c in route:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return added.join(spans, same).select(*_KEYS, "bucket", *_SUMS)


def _parts(span: Column) -> Fold:
    """From parsed requests to counts per window, route and bucket of the duration."""

    def fold(rows: DataFrame) -> DataFrame:
        bucket = F.when(F.col("ms") > 0, F.ceil(F.log("ms") / F.log(F.lit(GROWTH)))).cast("int")
        # A session is cut per bucket here and joined again by the merge, whose parts overlap.
        parts = rows.groupBy(span.alias("w"), "method", "path", bucket.alias("bucket")).agg(
            F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.count_if(F.col("status") >= 500).alias("errors")
        )
        return parts.select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "method", "path", "bucket", *_SUMS
        )

    return fold


def stream_request_timing(
    lines: DataFrame,
    root: str,
    window: str = "10 minutes",
    slide: str | None = None,
    gap: str | None = None,
    continuous: bool = False,
) -> StreamingQuery:
    """Timing per route and window of a request log with columns ``line`` and ``ts``.

    Tumbling windows by default, sliding ones with ``slide``, sessions per route with ``gap``. Each
    micro-batch leaves counts per window, route and duration bucket; they add up when they are
    read, and sessions of different batches that overlap are joined. Late lines count like others.
    """
    parsed = parse_request_log(lines, "line", keep=["ts"])
    if gap:
        span = F.session_window("ts", gap)
    elif slide:
        span = F.window("ts", window, slide)
    else:
        span = F.window("ts", window)
    count, merge = _parts(span), _merge_sessions if gap else _add_up

    def fold(rows: DataFrame) -> DataFrame:
        return merge(rows) if "bucket" in rows.columns else count(rows)

    return _start(parsed, root, fold, continuous)


def timing_from_stream(spark: SparkSession, root: str, sessions: bool = False) -> DataFrame:
    """window_start, window_end, method, path, n, total_ms, errors and ``p95_ms_1pct``: the 95th
    percentile within one per cent."""
    parts = Partials(spark, root, _merge_sessions if sessions else _add_up).read(PARTS_DDL)
    # At most some hundred buckets stand in one window of a route.
    up_to = W.partitionBy(*_KEYS).orderBy(F.col("bucket").asc_nulls_first())
    every = W.partitionBy(*_KEYS)
    ranked = parts.withColumn("below", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(every))
    middle = F.coalesce(F.pow(F.lit(GROWTH), F.col("bucket") - 0.5), F.lit(0.0))
    return ranked.groupBy(*_KEYS).agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.min(F.when(F.col("below") >= F.col("all") * 0.95, middle)).alias("p95_ms_1pct"),
    )
