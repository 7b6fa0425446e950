"""Streaming jobs with keyed state: a horizon for uploads, a feed of changed flags, windows that close.

They are fast paths beside :mod:`.jobs`. State is bounded (by a time to live, by one row per document, by the open
windows) and lies in the state store of the checkpoint; what leaves it is written per micro-batch under the batch's number, so a replayed
batch overwrites its own rows. What state no longer knows is put right on the stored side, so results stay those of a batch job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.metrics import parse_request_log
from .jobs import _KEYS, _SUMS, PARTS_DDL, _add_up, _first_uploads, _parts, _start
from .partials import NUMBER, Partials

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keep_state(spark: SparkSession) -> None:
    """State that need not fit the memory of an executor."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _best_of_task(stream: DataFrame, key: str, order: str, way: str) -> DataFrame:
    """The first row of each key in order, per Arrow batch: a hot key sends one row of a batch to its state."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.table({"key": batch.column(key), "order": batch.column(order), "at": pa.array(range(batch.num_rows), pa.int64())})
            ranked = rows.sort_by([("order", way), ("at", "ascending")])
            first = ranked.group_by("key", use_threads=False).aggregate([("at", "first")])
            yield batch.take(first.column("at_first").combine_chunks())

    return stream.mapInArrow(best, stream.schema)


def _write_batches(stream: DataFrame, root: str, folder: str) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{folder}/{NUMBER}={number}")

    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint-{folder}").outputMode("append")
    return writer.foreachBatch(write).trigger(availableNow=True).start()


def _read_batches(spark: SparkSession, root: str, folder: str, ddl: str) -> DataFrame:
    numbered = T.StructType.fromDDL(ddl).add(NUMBER, T.LongType())
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], numbered)
    return spark.read.schema(numbered).parquet(f"{root}/{folder}")


def state_report(query: StreamingQuery) -> dict[str, int]:
    """Largest state of the last micro-batches: rows, bytes, and rows that came behind the watermark."""
    seen = {"rows": 0, "bytes": 0, "late": 0}
    for progress in query.recentProgress:
        operators = progress["stateOperators"]
        seen["rows"] = max(seen["rows"], sum(o["numRowsTotal"] for o in operators))
        seen["bytes"] = max(seen["bytes"], sum(o["memoryUsedBytes"] for o in operators))
        seen["late"] += sum(o["numRowsDroppedByWatermark"] for o in operators)
    return seen


# ---- uploads within a horizon -------------------------------------------------------------------


_ARRIVED = "__arrived"


class _FirstUpload(StatefulProcessor):
    """Lets an upload pass if its content is new or older than the first known one."""

    def __init__(self, upload: T.StructType, horizon_ms: int):
        self.make, self.horizon_ms = Row(*upload.names), horizon_ms
        self.schema = T.StructType([T.StructField("first", upload["upload_ord"].dataType), T.StructField("until", T.LongType())])

    def init(self, handle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        best = min(rows, key=lambda r: (r.upload_ord is None, r.upload_ord or 0))
        held = self.first.get()
        if held is not None and (best.upload_ord is None or (held[0] is not None and held[0] <= best.upload_ord)):
            return
        until = int(best[_ARRIVED].timestamp() * 1000) + self.horizon_ms
        self.first.update((best.upload_ord, until))
        self.handle.registerTimer(until)
        yield self.make(*[best[c] for c in self.make])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        held = self.first.get()
        if held is not None and held[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_ingest_within(uploads: DataFrame, root: str, horizon_ms: int) -> StreamingQuery:
    """:func:`.jobs.stream_ingest` with the copies of ``horizon_ms`` milliseconds held back by state.

    State keeps the smallest ``upload_ord`` of a content until the horizon after its last change has passed. The clock is the start of
    the micro-batch that an upload arrives in, so no upload is ever behind the watermark, and the size of the state follows the
    contents of one horizon and not the store (:func:`state_report`). A copy within the horizon is not written. A copy after it
    is written once and folded away when the contents are read (:func:`.jobs.uploads_from_stream`), as is a first
    upload that comes after its copies: the result is the batch result for any order of files.
    """
    _keep_state(uploads.sparkSession)
    hashed = uploads.withColumn("sha256", F.sha2("content", 256)).drop("content")
    few = _best_of_task(hashed, "sha256", "upload_ord", "ascending")
    clocked = few.withColumn(_ARRIVED, F.current_timestamp()).withWatermark(_ARRIVED, f"{max(1, horizon_ms)} milliseconds")
    passed = clocked.groupBy("sha256").transformWithState(
        statefulProcessor=_FirstUpload(hashed.schema, horizon_ms), outputStructType=hashed.schema, outputMode="append", timeMode="EventTime"
    )
    return _start(passed, root, _first_uploads, False)


# ---- feed of current flags ----------------------------------------------------------------------

FEED_DDL = "document_id {0}, extraction_run_id bigint, is_current boolean, change_no bigint"


class _CurrentRun(StatefulProcessor):
    """Emits the demotion of the old and the promotion of the new current run of a document."""

    def init(self, handle) -> None:
        self.current = handle.getValueState("current", "extraction_run_id bigint, change_no bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        newest = max((r.extraction_run_id for r in rows if r.extraction_run_id is not None), default=None)
        held = self.current.get()
        if newest is None or (held is not None and held[0] >= newest):
            return
        change = 1 if held is None else held[1] + 1
        feed = Row("document_id", "extraction_run_id", "is_current", "change_no")
        if held is not None:
            yield feed(key[0], held[0], False, change)
        yield feed(key[0], newest, True, change)
        self.current.update((newest, change))

    def close(self) -> None:
        pass


def stream_current_changes(runs: DataFrame, root: str) -> StreamingQuery:
    """Change feed of the current flags: per micro-batch and touched document at most one demotion and one promotion.

    ``runs``: document_id, extraction_run_id (a run without id changes nothing). State is one row per document. ``change_no`` counts the
    changes of a document, so consumers can put a document's changes in order. Read it with :func:`current_changes`.
    """
    _keep_state(runs.sparkSession)
    rows = runs.select("document_id", F.col("extraction_run_id").cast("long").alias("extraction_run_id"))
    few = _best_of_task(rows, "document_id", "extraction_run_id", "descending")
    changes = few.groupBy("document_id").transformWithState(
        statefulProcessor=_CurrentRun(),
        outputStructType=T.StructType.fromDDL(FEED_DDL.format(rows.schema["document_id"].dataType.simpleString())),
        outputMode="append",
        timeMode="None",
    )
    return _write_batches(changes, root, "changes")


def current_changes(spark: SparkSession, root: str, document_id: str = "string") -> DataFrame:
    """The feed so far, with the number of the micro-batch of each change."""
    return _read_batches(spark, root, "changes", FEED_DDL.format(document_id))


def apply_changes(runs: DataFrame, feed: DataFrame) -> DataFrame:
    """Run history with ``is_current`` as the feed leaves it.

    A run is promoted at most once and never again after a demotion, so neither the order nor repeats of changes matter.
    """
    flags = feed.groupBy(F.col("extraction_run_id").alias("__run")).agg(F.bool_and("is_current").alias("__current"))
    rows = runs.drop("is_current").join(flags, F.col("extraction_run_id") == F.col("__run"), "left")
    return rows.withColumn("is_current", F.coalesce("__current", F.lit(False))).drop("__run", "__current")


# ---- windows that close -------------------------------------------------------------------------


def stream_closed_windows(lines: DataFrame, root: str, window: str = "10 minutes", delay: str = "10 minutes") -> StreamingQuery:
    """Counts per route, window and duration bucket, put out once, when the watermark passes the window's end.

    State holds the windows of the last ``delay`` only. Lines that come later than that are not in the closed windows;
    :func:`corrections` finds them with the parts that :func:`.jobs.stream_request_timing` keeps of the same log.
    """
    _keep_state(lines.sparkSession)
    parsed = parse_request_log(lines, "line", keep=["ts"]).withWatermark("ts", delay)
    return _write_batches(_parts(F.window("ts", window))(parsed), root, "closed")


def closed_windows(spark: SparkSession, root: str) -> DataFrame:
    """The counts of all windows closed so far, in the columns of the timing parts."""
    return _read_batches(spark, root, "closed", PARTS_DDL).drop(NUMBER)


def corrections(spark: SparkSession, root: str, parts_root: str) -> DataFrame:
    """What the closed windows lack against all lines: window, route, bucket, sums, and ``closed``.

    ``closed`` is true for lines that came after their window was put out (or would have been): windows up to the end of the last closed
    one. The other rows belong to windows still open. Closed windows and corrections add up to the batch result. Both
    sides are sums per window, route and bucket; lines themselves are not kept.
    """
    out = closed_windows(spark, root)
    less = out.select(*_KEYS, "bucket", *[(-F.col(c)).alias(c) for c in _SUMS])
    every = Partials(spark, parts_root, _add_up).read(PARTS_DDL)
    missing = _add_up(every.unionByName(less)).filter("n <> 0")
    last = out.agg(F.max(F.unix_micros("window_end"))).first()[0]  # one number
    late = F.lit(False) if last is None else F.unix_micros("window_end") <= last
    return missing.withColumn("closed", late)
