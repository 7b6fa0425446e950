"""Streams with keyed state: bounded state, and the results of a batch job after all."""

from pyspark.sql import functions as F

from docgrain.streaming import jobs as J
from docgrain.streaming import stateful as K
from test_streams import drop, minute, run

UPLOADS = "upload_ord long, filename string, content binary"


def test_uploads_within_a_horizon(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    drop(spark, src, [(5, "e", b"x"), (5, "e2", b"x"), (2, "b", b"y"), (9, "n", None)], UPLOADS, "0")
    drop(spark, src, [(6, "f", b"x"), (1, "a", b"y"), (None, "q", b"y")], UPLOADS, "1")

    def go(name, horizon):
        root = str(tmp_path / name)
        stream = J.watch(spark, str(src), UPLOADS, files=1)
        job = K.stream_ingest_within(stream, root, horizon)
        run(job)
        rows = J.uploads_from_stream(spark, root, stream.schema)
        written = spark.read.parquet(f"{root}/data").count()
        return {(r.upload_ord, r.filename) for r in rows.collect()}, written, K.state_report(job)

    first = {(5, "e"), (1, "a"), (9, "n")}
    rows, written, report = go("long", 3_600_000)
    # The copy of x is held back, the older upload of y goes through. The timers are state as well.
    assert rows == first and written == 4 and report["rows"] >= 3 and report["bytes"] > 0 and report["late"] == 0
    rows, written, _ = go("short", 1)
    assert rows == first and 4 <= written <= 5
    # A restart goes on where the job stopped, with copies much later than the short horizon.
    drop(spark, src, [(0, "z", b"x"), (7, "g", b"y"), (8, "h", b"w")], UPLOADS, "2")
    want = {(0, "z"), (1, "a"), (9, "n"), (8, "h")}
    assert go("long", 3_600_000)[0] == want
    rows, written, report = go("short", 1)
    assert rows == want and report["late"] == 0


def test_feed_of_current_flags(spark, tmp_path):
    src = tmp_path / "runs"
    src.mkdir()
    ddl = "document_id string, extraction_run_id long"
    history = []

    def more(rows, name):
        drop(spark, src, rows, ddl, name)
        history.extend(rows)

    root = str(tmp_path / "feed")

    def flags():
        run(K.stream_current_changes(J.watch(spark, str(src), ddl, files=1), root))
        feed = K.current_changes(spark, root)
        # A replayed or repeated change alters nothing.
        runs = spark.createDataFrame(history, ddl)
        rows = K.apply_changes(runs, feed.unionByName(feed.limit(3))).collect()
        return feed.collect(), {(r.document_id, r.extraction_run_id) for r in rows if r.is_current}, len(rows)

    assert K.current_changes(spark, root).count() == 0
    more([("a", 5), ("a", 3), ("b", 2), ("c", None), (None, 11)], "0")
    more([("a", 4), ("b", 9), (None, 10)], "1")
    feed, current, n = flags()
    assert current == {("a", 5), ("b", 9), (None, 11)} and n == 8
    assert sorted((r.extraction_run_id, r.is_current, r.change_no) for r in feed if r.document_id == "b") == [(2, False, 2), (2, True, 1), (9, True, 2)]
    assert [r.extraction_run_id for r in feed if r.document_id == "a"] == [5]
    more([("a", 8), ("a", 7), ("b", 1), ("c", 20)], "2")
    feed, current, n = flags()
    assert current == {("a", 8), ("b", 9), ("c", 20), (None, 11)} and n == 12
    # One demotion and one promotion for a batch with several newer runs.
    assert sorted((r.extraction_run_id, r.is_current) for r in feed if r.document_id == "a" and r.change_no == 2) == [(5, False), (8, True)]


def test_windows_close_once(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    ddl = "ts timestamp, line string"

    def hit(m, ms, status=200):
        return (minute(m), f"GET /a -> {status} in {ms:.2f}ms")

    drop(spark, src, [hit(1, 10), hit(3, 20, 500), (minute(3), "noise")], ddl, "0")
    drop(spark, src, [hit(4, 30), hit(31, 40)], ddl, "1")
    drop(spark, src, [hit(200, 1)], ddl, "2")
    drop(spark, src, [hit(201, 1)], ddl, "3")
    # Hours late. Spark judges a micro-batch by the watermark that the batch before it started with.
    drop(spark, src, [hit(2, 99), hit(33, 7)], ddl, "4")
    root, parts = str(tmp_path / "closed"), str(tmp_path / "parts")

    def go():
        stream = J.watch(spark, str(src), ddl, files=1)
        job = K.stream_closed_windows(stream, root)
        run(job)
        run(J.stream_request_timing(stream, parts))
        closed = K.closed_windows(spark, root)
        return job, closed, K.corrections(spark, root, parts)

    def sums(rows, *more):
        keys = ["window_start", *more]
        out = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total_ms").alias("ms"), F.sum("errors").alias("e")).collect()
        return {(int((r.window_start - minute(0)).total_seconds()) // 60, *[r[c] for c in more]): (r.n, round(r.ms, 2), r.e) for r in out}

    job, closed, wrong = go()
    assert sums(closed) == {(0,): (3, 60.0, 1), (30,): (1, 40.0, 0)}
    assert closed.count() == closed.select("window_start", "method", "path", "bucket").distinct().count()
    assert sums(wrong, "closed") == {(0, True): (1, 99.0, 0), (30, True): (1, 7.0, 0), (200, False): (2, 2.0, 0)}
    assert K.state_report(job)["late"] == 2
    # Nothing new: nothing is put out again. New lines close the open window.
    assert sums(go()[1]) == sums(closed)
    drop(spark, src, [hit(300, 5)], ddl, "5")
    _, closed, wrong = go()
    both = closed.unionByName(wrong.drop("closed"))
    assert sums(closed)[(200,)] == (2, 2.0, 0)
    assert sums(both) == sums(J.timing_from_stream(spark, parts))
    assert sums(wrong, "closed")[(300, False)] == (1, 5.0, 0)
