import datetime as dt

import pytest
from pyspark.sql import functions as F

from docgrain.plans import QUERIES, streams
from docgrain.streaming import jobs as J
from docgrain.streaming.partials import Partials

SF = "/root/testdata/sf0.001"


def minute(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


def drop(spark, folder, rows, ddl, name):
    """One more input file, written aside and moved in whole."""
    part = folder.parent / f"tmp-{folder.name}-{name}"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(part))
    next(part.glob("part-*.parquet")).rename(folder / f"{name}.parquet")


def run(job):
    job.awaitTermination()
    assert job.exception() is None


def test_ingest_over_batches(spark, tmp_path):
    ddl = "upload_ord long, filename string, content binary, created_at timestamp"
    src = tmp_path / "in"
    src.mkdir()
    root = str(tmp_path / "out")

    def go():
        stream = J.watch(spark, str(src), ddl, files=1)
        run(J.stream_ingest(stream, root))
        out = J.uploads_from_stream(spark, root, stream.schema)
        return {(r.upload_ord, r.filename) for r in out.collect()}

    drop(spark, src, [(2, "b", b"x", minute(1)), (1, "a", b"x", minute(0)), (3, "c", b"y", minute(2))], ddl, "0")
    assert go() == {(1, "a"), (3, "c")}
    # Much later, the same content again: the job picks up where it stopped and folds it away.
    drop(spark, src, [(4, "d", b"x", minute(9000)), (5, "e", b"z", minute(9001))], ddl, "1")
    assert go() == {(1, "a"), (3, "c"), (5, "e")}
    # An upload that was made first and arrives last takes its place; a unique late one is kept.
    drop(spark, src, [(0, "f", b"x", minute(-5)), (6, "g", b"w", minute(-9000))], ddl, "2")
    assert go() == {(0, "f"), (3, "c"), (5, "e"), (6, "g")}


def test_current_and_latest_out_of_order(spark, tmp_path):
    src = tmp_path / "runs"
    src.mkdir()
    ddl = "document_id string, extraction_run_id long, doc_type string"
    drop(spark, src, [("a", 5, "m5"), ("b", 2, "m2")], ddl, "0")
    drop(spark, src, [("a", 3, "m3"), ("b", 9, "m9")], ddl, "1")
    stream = J.watch(spark, str(src), ddl, files=1)
    root = str(tmp_path / "current")
    run(J.stream_current_runs(stream, root))
    out = J.current_from_stream(spark, root, stream.schema)
    assert {(r.document_id, r.extraction_run_id, r.doc_type) for r in out.collect()} == {("a", 5, "m5"), ("b", 9, "m9")}
    history = spark.createDataFrame([(5, True), (2, True), (3, False), (9, False)], "extraction_run_id long, is_current boolean")
    assert {r.extraction_run_id for r in J.flag_current(history, out).filter("is_current").collect()} == {5, 9}
    documents = spark.createDataFrame([("a", None, "uploaded"), ("c", None, "uploaded")], "document_id string, doc_type string, status string")
    after = {(r.document_id, r.doc_type, r.status) for r in J.documents_after_runs(documents, out).collect()}
    assert after == {("a", "m5", "extracted"), ("c", None, "uploaded")}

    src = tmp_path / "edits"
    src.mkdir()
    ddl = "extraction_run_id long, field_path string, field_review_id long, edited_value string, created_at timestamp"
    drop(spark, src, [(1, "a", 1, "old", minute(5)), (1, "b", 2, "x", minute(1))], ddl, "0")
    drop(spark, src, [(1, "a", 3, "late", minute(2)), (1, "b", 4, "new", minute(8))], ddl, "1")
    stream = J.watch(spark, str(src), ddl, files=1)
    root = str(tmp_path / "latest")
    run(J.stream_latest_reviews(stream, root))
    out = J.reviews_from_stream(spark, root, stream.schema)
    assert {(r.field_path, r.edited_value) for r in out.collect()} == {("a", "old"), ("b", "new")}


def test_timing_windows(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    ddl = "ts timestamp, line string"

    def hit(m, ms, status=200):
        return (minute(m), f"GET /a -> {status} in {ms:.2f}ms")

    drop(spark, src, [hit(1, 10), hit(3, 20, 500), (minute(3), "noise")], ddl, "0")
    drop(spark, src, [hit(4, 30), hit(31, 40)], ddl, "1")
    drop(spark, src, [hit(200, 1)], ddl, "2")
    drop(spark, src, [hit(2, 99), hit(201, 1), hit(12, 0)], ddl, "3")  # hours late, and counted

    def stats(name, **options):
        root = str(tmp_path / name)
        run(J.stream_request_timing(J.watch(spark, str(src), ddl, files=1), root, **options))
        rows = J.timing_from_stream(spark, root, "gap" in options).orderBy("window_start").collect()
        for r in rows:
            assert r.p95_ms_1pct <= 100
        return [(int((r.window_start - minute(0)).total_seconds()) // 60, r.n, r.total_ms, r.errors) for r in rows]

    assert stats("tumbling") == [(0, 4, 159.0, 1), (10, 1, 0.0, 0), (30, 1, 40.0, 0), (200, 2, 2.0, 0)]
    sliding = stats("sliding", window="20 minutes", slide="10 minutes")
    assert sliding[:3] == [(-10, 4, 159.0, 1), (0, 5, 159.0, 1), (10, 1, 0.0, 0)] or sliding[2][0] == 10
    # The request at minute 12 joins what would otherwise end at minute 14.
    assert stats("session", gap="10 minutes") == [(1, 5, 159.0, 1), (31, 1, 40.0, 0), (200, 2, 2.0, 0)]


def test_percentile_is_within_one_per_cent(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    rows = [(minute(0), f"GET /a -> 200 in {i * 3.7:.2f}ms") for i in range(1, 1001)]
    drop(spark, src, rows[::2], "ts timestamp, line string", "0")
    drop(spark, src, rows[1::2], "ts timestamp, line string", "1")
    root = str(tmp_path / "out")
    run(J.stream_request_timing(J.watch(spark, str(src), "ts timestamp, line string", files=1), root))
    assert abs(J.timing_from_stream(spark, root).first().p95_ms_1pct / (950 * 3.7) - 1) < 0.011


def test_replays_and_rewrites_change_nothing(spark, tmp_path):
    fold = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    ddl = "k string, n long"
    store = Partials(spark, str(tmp_path), fold)
    assert store.read(ddl).count() == 0
    store.rewrite(ddl, 3)

    def append(i):
        store.append(spark.createDataFrame([("ab"[i % 2], 10**i)], ddl), i)

    def rows():
        return {r.k: r.n for r in store.read(ddl).collect()}

    for i in range(9):
        append(i)
        if i in (2, 6):
            append(i)
        if i == 4:
            store.rewrite(ddl, 3)
            assert store.last_base() == 3
    want = {"a": sum(10**i for i in range(0, 9, 2)), "b": sum(10**i for i in range(1, 9, 2))}
    assert rows() == want
    append(3)  # a batch that the base holds is replayed
    assert rows() == want
    store.rewrite(ddl, 8)
    store.rewrite(ddl, 5)
    assert store.last_base() == 8 and rows() == want
    # A base that broke off is not read.
    (tmp_path / "base" / "8" / "_SUCCESS").unlink()
    assert store.last_base() == 3 and rows() == want


def test_sessions_of_a_hot_route_merge_without_gathering(spark):
    """Against one pass over the spans in order."""
    import random

    rng = random.Random(8)
    rows = []
    for _ in range(400):
        start = rng.randrange(3000)
        rows.append((minute(start), minute(start + rng.choice([10, 10, 14])), rng.choice(["GET", "GET", None]), "/a", rng.choice([1, 2, None]), rng.randrange(5), 1.0, 0))
    got = J._merge_sessions(spark.createDataFrame(rows, J.PARTS_DDL).repartition(5))
    want = {}
    for method in ("GET", None):
        start = end = None
        for s, e, m, p, bucket, n, total, errors in sorted((r for r in rows if r[2] == method), key=lambda r: r[0]):
            if end is None or s > end:
                start, end, members = s, e, []
            end = max(end, e)
            members.append((bucket, n, total))
            for b in {x for x, _, _ in members}:
                want[method, start, b] = (end, sum(x for y, x, _ in members if y == b), sum(x for y, _, x in members if y == b))
            for key in [k for k in want if k[:2] == (method, start)]:
                want[key] = (end, *want[key][1:])
    assert {(r.method, r.window_start, r.bucket): (r.window_end, r.n, r.total_ms) for r in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """The given tables in many files whose order has nothing to do with time."""
    root = tmp_path_factory.mktemp("scattered")
    for name, key in (("events", "event_id"), ("orders", "o_orderkey"), ("documents", "doc_id"), ("customer", "c_custkey")):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        df.repartition(10, F.xxhash64(key)).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("stream_")))
def test_results_do_not_depend_on_the_micro_batches(spark, scattered, name, monkeypatch):
    def rows(files):
        monkeypatch.setattr(streams, "FILES", files)
        return sorted(map(repr, QUERIES[name](spark, scattered).collect()))

    one = rows(1000)
    assert rows(1) == one
    whole = sorted(map(repr, QUERIES[name](spark, SF).collect()))
    assert one == whole
