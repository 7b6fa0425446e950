import base64
import gzip
import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from docgrain.llm import warc

PAGES = "page_id long, url string, html string"


def brute(rows, least=0):
    keep = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if i is not None:
            keep[p] = max(keep.get(p, i), i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        k = keep.get(p)
        again = len(p) >= least and k is not None and k != i
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((i, len(p), digest, "revisit" if again else "response", k if again else None, "ok"))
    return sorted(out, key=repr)


def round_trip(spark, df, path, **options):
    warc.write_archives(df, str(path), **options)
    return sorted((tuple(r) for r in warc.read_archives(spark, str(path)).collect()), key=repr)


def test_table_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert round_trip(spark, pages, tmp_path / "a") == brute(rows)
    # Short segments: most pages are continued, and files are many.
    assert round_trip(spark, pages, tmp_path / "b", segment=700, file_records=5) == brute(rows)


def test_edges(spark, tmp_path):
    rows = [(1, "http://a b\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same")]
    rows += [(5, "u", "é語" * 40_000), (6, "u", "WARC/1.1\r\n\r\n\r\n0\r\n\r\n"), (7, "u", "lone"), (None, "u", "other")]
    rows += [(8, "u", "twice"), (8, "u", "twice"), (9, "u", "é語" * 40_000)]
    df = spark.createDataFrame(rows, PAGES).withColumn("h", warc.F.lit(1)).withColumn("keep", warc.F.lit(2))
    assert round_trip(spark, df, tmp_path / "a") == brute(rows)
    assert round_trip(spark, df, tmp_path / "b", segment=64, min_revisit=5) == brute(rows, 5)
    assert round_trip(spark, df.limit(0), tmp_path / "c") == []


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_framing_round_trips(payload, size):
    assert warc.dechunk(warc.chunked(payload, size)) == payload


def test_dechunk_skips_extensions_and_trailers_and_finds_cuts():
    assert warc.dechunk(b"3;x=1\r\nabc\r\n0;y\r\nTrailer: z\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        warc.dechunk(b"3\r\nabc\r\n")


def test_segments_in_any_order_and_what_may_be_wrong():
    parts = [(1, b"ab"), (2, b"cd"), (3, b"e")]
    for seed in range(5):
        shuffled = random.Random(seed).sample(parts, 3)
        assert warc.assemble(shuffled, 5, True) == (b"abcde", "ok")
    assert warc.assemble([parts[0], parts[2]], 5, True)[1] == "segment missing"
    assert warc.assemble(parts[:2], None, True)[1] == "segment missing"
    assert warc.assemble(parts, 6, True)[1] == "length differs"


def test_damaged_archives_are_reported(spark, tmp_path):
    def write(name, records):
        (tmp_path / name).mkdir()
        with gzip.open(tmp_path / name / "x.gz", "wb") as f:
            f.write(b"".join(r + b"\r\n\r\n" for r in records))
        return [tuple(r) for r in warc.read_archives(spark, str(tmp_path / name)).collect()]

    whole = list(warc.page_records(1, 7, "u", b"payload" * 50, None, 100))
    assert len(whole) > 3
    assert write("ok", whole[::-1])[0][3:] == ("response", None, "ok")
    assert write("gap", [whole[0], *whole[2:]])[0][5] == "segment missing"
    assert write("end", whole[:-1])[0][5] == "segment missing"
    other = whole[1].replace(b"payload", b"PAYLOAD")
    assert write("changed", [whole[0], other, *whole[2:]])[0][5] == "digest differs"
    plain = list(warc.page_records(1, 7, "u", b"payload", None, 1 << 20))[0]
    assert write("framing", [plain.replace(b"\r\n7\r\n", b"\r\n8\r\n")])[0][5] == "bad framing"
