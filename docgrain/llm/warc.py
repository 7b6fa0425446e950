"""WARC archives: writing with revisits and segments, reading with reassembly of segments."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_BYTES = 16 << 10  # longest block of one record; a longer one is continued
CHUNK_BYTES = 4 << 10  # chunks of the transfer framing
FILE_RECORDS = 2048  # records per archive file, which bounds its size
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
_PAGE = "urn:page:"
_END = b"\r\n\r\n"

_RECORD = "origin string, number int, total long, kind string, page_id long, digest string, refers_to long, block binary"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, status string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing --------------------------------------------------------------------------------------


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it; the writer's line separator adds them."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(
    row_id: int, page_id: int | None, url: str | None, payload: bytes, keep: int | None, segment: int
) -> Iterator[bytes]:
    """Records of one page: a revisit, or a response in one or more segments."""
    record_id = f"<urn:record:{row_id}>"
    uri = "".join(c if c.isprintable() and c != " " else "_" for c in url or "") or None
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "response" if keep is None else "revisit"),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Concurrent-To", None if page_id is None else f"<{_PAGE}{page_id}>"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    kind = ("Content-Type", "application/http; msgtype=response")
    if keep is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([*fields, ("WARC-Refers-To", f"<{_PAGE}{keep}>"), ("WARC-Profile", profile), kind], http)
        return
    block = http + chunked(payload)
    if len(block) <= segment:
        yield _record([*fields, kind], block)
        return
    yield _record([*fields, kind, ("WARC-Segment-Number", 1)], block[:segment])
    for no, at in enumerate(range(segment, len(block), segment), 2):
        more = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:record:{row_id}:{no}>"),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", uri),
            ("WARC-Segment-Origin-ID", record_id),
            ("WARC-Segment-Number", no),
            ("WARC-Segment-Total-Length", len(block) if at + segment >= len(block) else None),
        ]
        yield _record(more, block[at : at + segment])


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    segment: int = SEGMENT_BYTES,
    min_revisit: int = MIN_REVISIT_BYTES,
    file_records: int = FILE_RECORDS,
) -> None:
    """Write one record per page, and continuations of long ones, as gzipped WARC files.

    Of pages with equal payloads of ``min_revisit`` bytes or more, the one with the largest id is the
    response, the others revisit it. Only payload hashes with several pages are joined back, by
    hash, so a corpus without copies is not shuffled; a payload that fills a third of the rows is the
    skewed side of a join with one row per hash.

    The archive is a text file whose lines end in the two line ends that close a WARC record, so it
    is written by Spark's own committer to any file system it knows.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    )
    rows = rows.withColumn("h", F.sha1("payload"))
    copies = rows.filter(F.octet_length("payload") >= min_revisit).groupBy("h").agg(
        F.max("page_id").alias("keep"), F.count("*").alias("n")
    )
    copies = copies.filter("n > 1 AND keep IS NOT NULL").select(F.col("h").alias("copy"), "keep")
    rows = rows.join(copies, F.col("h") == F.col("copy"), "left").select(
        F.monotonically_increasing_id().alias("row_id"),
        "page_id",
        "url",
        "payload",
        F.when(F.col("page_id").eqNullSafe(F.col("keep")), None).otherwise(F.col("keep")).alias("keep"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                for record in page_records(*(c[i].as_py() for c in batch.columns), segment):
                    out.append(record)
                    size += len(record)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = records.write.option("lineSep", _END.decode()).option("compression", "gzip")
    writer.option("maxRecordsPerFile", file_records).text(path)


# ---- reading --------------------------------------------------------------------------------------


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of an archive."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record starts at byte {at}")
        end = data.index(_END, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + len(_END)
        at = start + int(fields["content-length"])
        yield fields, data[start:at]
        if data[at : at + 4] != _END:
            raise ValueError(f"the record that ends at byte {at} is not closed")
        at += 4


def dechunk(body: bytes) -> bytes:
    """Payload of a body in chunked transfer framing; extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        start = end + 2
        if body[start + size : start + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[start : start + size])
        at = start + size + 2


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP response, out of its transfer framing."""
    head, _, body = block.partition(_END)
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and value.strip().lower() == b"chunked":
            return dechunk(body)
    return body


def assemble(segments: list[tuple[int, bytes]], total: int | None, segmented: bool) -> tuple[bytes | None, str]:
    """(block, status) of a record from its segments in any order."""
    segments = sorted(segments, key=lambda s: s[0])
    if segmented:
        if [n for n, _ in segments] != list(range(1, len(segments) + 1)) or total is None:
            return None, "segment missing"
        if sum(len(b) for _, b in segments) != total:
            return None, "length differs"
    return b"".join(b for _, b in segments), "ok"


def _urn(text: str | None) -> int | None:
    return int(text[1:-1].removeprefix(_PAGE)) if text else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, status) per page.

    Files are parsed one at a time. Segments are grouped by the id of the record they continue,
    put in order of their numbers, checked against the total length, taken out of the chunked framing and
    hashed; ``status`` tells what does not hold: a missing segment, a length or a digest that differs, a bad framing. Whole
    records are decoded where they are read and pass the grouping without their block. A revisit has the digest
    of its payload, its length comes from the response it refers to (null if that is not in the archives).

    An archive without records gives no rows. A record without page id keeps a null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parsed = files.mapInArrow(_parse, _RECORD)
    one = lambda c: F.max(c).alias(c)  # noqa: E731  only the first segment has these
    grouped = parsed.groupBy("origin").agg(
        *[one(c) for c in ("total", "kind", "page_id", "digest", "refers_to")],
        F.collect_list(F.struct("number", "block")).alias("segments"),
    )
    decoded = grouped.mapInArrow(_decode, RESULT)
    sizes = decoded.filter("record_type = 'response'").groupBy(F.col("page_id").alias("of")).agg(
        F.max("payload_bytes").alias("size")
    )
    revisits = decoded.filter("record_type = 'revisit'").join(sizes, F.col("refers_to") == F.col("of"), "left")
    revisits = revisits.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "status")
    return decoded.filter("record_type <> 'revisit'").union(revisits)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _RECORD.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for i in range(batch.num_rows):
            rows = []
            for fields, block in parse_records(gzip.decompress(batch.column(0)[i].as_py())):
                kind = fields["warc-type"]
                number = int(fields.get("warc-segment-number", 0))
                total = fields.get("warc-segment-total-length")
                digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                if kind == "response" and number == 0:  # a whole record: only its length goes on
                    length, status = _payload(block, digest)
                    kind, total, block = f"response {status}", length, None
                elif kind == "revisit":
                    block = None
                rows.append(
                    (
                        fields.get("warc-segment-origin-id", fields["warc-record-id"]),
                        number,
                        None if total is None else int(total),
                        None if kind == "continuation" else kind,
                        _urn(fields.get("warc-concurrent-to")),
                        digest,
                        _urn(fields.get("warc-refers-to")),
                        block,
                    )
                )
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _payload(block: bytes, digest: str | None) -> tuple[int | None, str]:
    try:
        payload = http_payload(block)
    except ValueError:
        return None, "bad framing"
    return len(payload), "ok" if sha1_base32(payload) == digest else "digest differs"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            kind, length, status = r["kind"] or "continuation", r["total"], "ok"
            if kind.startswith("response "):
                kind, _, status = kind.partition(" ")
            elif kind != "revisit":
                segments = [(s["number"], s["block"]) for s in r["segments"]]
                block, status = assemble(segments, r["total"], True)
                length = None
                if block is not None:
                    length, status = _payload(block, r["digest"])
            rows.append((r["page_id"], length, r["digest"], kind, r["refers_to"], status))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        names = [f.split()[0] for f in RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

