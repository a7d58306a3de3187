r"""WARC archives: writing with revisits, segments and chunked transfer framing, and reading all of it back.

A record is one gzip member of a ``.warc.gz`` part that Spark's text writer puts in a shared folder; the separator that
the writer sets between rows is an empty gzip member, so a part is a plain multi-member archive.  A block beyond the
segment size becomes a first record and continuation records.  Reading groups those by origin identifier, orders them by
segment number, verifies numbers and total length, and then decodes the chunked framing of the HTTP response.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, tune

#: Payloads below this are always written in full.
REVISIT_BYTES = 100
#: Bytes of a record's block, of a chunk of the HTTP body, and records of a file at most.
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 32_768, 8_192, 4_000
#: Bytes that are decompressed at once.
SLICE = 4_096
VERSION = b"WARC/1.1\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"1970-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def gzip_members(data: bytes) -> Iterator[bytes]:
    """The contents of each member that isn't empty."""
    data, at = memoryview(data), 0
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:  # in slices: what follows a member is copied out of a slice only
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            piece = data[at : at + SLICE]
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        if got := b"".join(out):
            yield got


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(c := payload[i : i + size]), c) for i in range(0, len(payload), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are allowed, anything else raises."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        out.append(body[at : at + n])
        if len(out[-1]) != n or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        at += n + 2


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    names = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return unchunked(body) if names.get(b"transfer-encoding") == b"chunked" else body


def record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = b"".join(b"%b: %b\r\n" % f for f in [*fields, (b"Content-Length", b"%d" % len(block))])
    return VERSION + head + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Fields by lower-case name, and the block, of one record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] + b"\r\n" != VERSION:
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    n = int(fields[b"content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, unique: str, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page: a revisit, a response, or the segments of a response."""
    page = b"" if page_id is None else b"%d" % page_id
    rid = b"<urn:page:%b:%b>" % (page, unique.encode())
    fields = [(b"WARC-Date", DATE), (b"WARC-Page-ID", page), (b"WARC-Payload-Digest", b"sha256:" + digest.encode())]
    if url:
        fields.append((b"WARC-Target-URI", b" ".join(url.encode("utf-8", "surrogatepass").split())))
    if refers_to is not None:
        more = [(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", rid), (b"WARC-Profile", PROFILE), (b"WARC-Refers-To", b"<urn:page:%d>" % refers_to)]
        return [record(more + fields, b"")]
    block = HTTP_HEAD + chunked(payload)
    first = [(b"WARC-Type", b"response"), (b"WARC-Record-ID", rid), (b"Content-Type", b"application/http;msgtype=response")]
    if len(block) <= segment:
        return [record(first + fields, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record(first + fields + [(b"WARC-Segment-Number", b"1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = [(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", b"%b:%d>" % (rid[:-1], n)), (b"WARC-Date", DATE), (b"WARC-Segment-Origin-ID", rid), (b"WARC-Segment-Number", b"%d" % n)]
        out.append(record(more + [(b"WARC-Segment-Total-Length", b"%d" % len(block))] * (n == len(parts)), part))
    return out


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Archives of (page_id, url, html) at ``path``.

    Of rows with equal payloads of at least REVISIT_BYTES, those with the smallest page_id are responses and others
    revisits of it; a null html is an empty payload; a row with a null id is a response.
    """
    tune(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    least = rows.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(least, "digest", "left").withColumn("refers_to", F.expr("if(page_id > least, least, null)"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get().partitionId(), 0
        for pdf in batches:
            out = []
            for p, u, b, d, r in zip(pdf.page_id, pdf.url, pdf.payload, pdf.digest, pdf.refers_to, strict=True):
                ids = [None if pd.isna(x) else int(x) for x in (p, r)]
                out += map(gzip_member, page_records(ids[0], u, bytes(b) if ids[1] is None else b"", d, ids[1], f"{task}-{n}", segment))
                n += 1
            yield pd.DataFrame({"value": out})

    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    lines = rows.mapInPandas(build, "value binary").select(F.col("value").cast("string"))
    separator = gzip_member(b"").decode("latin-1")
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", FILE_RECORDS).text(path)


RECORD = "type string, origin string, page_id long, payload_bytes long, digest string, refers_to long, number int, total long, block binary"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [x.split()[0] for x in RECORD.split(", ")]
    for pdf in batches:
        for content in pdf.content:
            rows = []
            for data in gzip_members(content):
                f, block = parse(data)
                kind, page = f[b"warc-type"].decode(), int(f[b"warc-page-id"]) if f.get(b"warc-page-id") else None
                digest = f.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode()
                if kind == "revisit":
                    rows.append((kind, None, page, None, digest, int(f[b"warc-refers-to"].split(b":")[-1][:-1]), None, None, None))
                elif b"warc-segment-number" in f:
                    total = f.get(b"warc-segment-total-length")
                    origin = f.get(b"warc-segment-origin-id", f[b"warc-record-id"])
                    rows.append((kind, origin.decode(), page, None, digest, None, int(f[b"warc-segment-number"]), int(total) if total else None, block))
                elif kind == "response":
                    rows.append((kind, None, page, *_checked(block, digest), None, None, None, None))
            yield pd.DataFrame(rows, columns=columns).astype(dict.fromkeys(("page_id", "payload_bytes", "refers_to", "number", "total"), "Int64"))


def _checked(block: bytes, digest: str) -> tuple[int, str]:
    payload = http_payload(block)
    if (got := hashlib.sha256(payload).hexdigest()) != digest:
        raise ValueError("a payload doesn't have its digest")
    return len(payload), got


def reassemble(numbers: list[int], totals: list[int | None], blocks: list[bytes]) -> bytes:
    """The block of a segmented record, from its segments in any order."""
    order = sorted(range(len(numbers)), key=numbers.__getitem__)
    if [numbers[i] for i in order] != list(range(1, len(order) + 1)):
        raise ValueError("segments are missing or repeated")
    block = b"".join(blocks[i] for i in order)
    if totals[order[-1]] != len(block):
        raise ValueError("a segmented record doesn't have its total length")
    return block


def _join_segments(pdf: pd.DataFrame) -> pd.DataFrame:
    block = reassemble(pdf.number.tolist(), [None if pd.isna(x) else int(x) for x in pdf.total], [bytes(b) for b in pdf.block])
    first = pdf[pdf.number == 1].iloc[0]
    n, digest = _checked(block, first.digest)
    return pd.DataFrame({"page_id": pd.array([None if pd.isna(first.page_id) else int(first.page_id)], "Int64"), "payload_bytes": [n], "digest": [digest]})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for every page of the archives.

    Segments of a record may stand in any order and in any file.  Truncated, missing or altered parts raise an error.
    A revisit gets its length from the response with the same digest.
    """
    tune(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    records = materialize(files.mapInPandas(_read, RECORD), "records")
    joined = records.where("number is not null").groupBy("origin").applyInPandas(_join_segments, "page_id long, payload_bytes long, digest string")
    responses = records.where("type = 'response' and number is null").select("page_id", "payload_bytes", "digest").unionByName(joined)
    full = responses.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("payload_bytes").alias("payload_bytes"))
    revisits = records.where("type = 'revisit'").select("page_id", "digest", "refers_to").join(full, "digest", "left")
    named = [responses.withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long")), revisits.withColumn("record_type", F.lit("revisit"))]
    out = [x.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to") for x in named]
    return out[0].unionByName(out[1])


def round_trip(pages: DataFrame, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Writes archives to the shared folder and reads them back.  An empty table gives no rows."""
    path = f"{shared_dir(pages.sparkSession)}/archives"
    write_archives(pages, path, segment)
    return read_archives(pages.sparkSession, path)
