"""WARC archives: written with segmented records, read back by reassembling the segments.

Writing. One record per page; its payload is the page's HTML in UTF-8, framed as an HTTP response
with chunked transfer coding. The first page (smallest page_id) of equal payloads is a ``response``,
the others are ``revisit`` records that refer to it. A block longer than ``segment_bytes`` is cut:
the first record carries WARC-Segment-Number 1, ``continuation`` records carry the others with
WARC-Segment-Origin-ID, and the last one has WARC-Segment-Total-Length. A record's id follows from the page and
the digest, so a revisit can name it. Each record is a gzip member.
Every task writes files of bounded size under names of its own in the shared folder and returns
their names; only files named by the tasks that succeeded are read, so a lost executor or a doubled
task leaves nothing that counts.

Reading. Files are parsed record by record, from these archives or others: warcinfo, request, metadata,
resource and conversion records are passed over unless asked for. Unsegmented records are decoded where they
are read and take no part in a shuffle; only segments are grouped, by origin identifier, ordered by segment
number, checked for gaps and against the total length, joined, and freed of their chunk framing. A revisit
names the record it refers to by WARC-Refers-To; where that is a record of the archives, as here, it is
looked up by record id. Nothing outside the archives is needed: the page's id is in WARC-Page-ID, null in other archives.
The digest of a revisit is the one it states; its length is that of the record it refers to, else null.

Defined results: null HTML is an empty payload; all rows of a payload that share its smallest
page_id are responses; null page_ids are never the smallest unless all are, and such records are
responses. Repeated rows are records of their own. Texts of any length are cut in segments, and a record is
in one task's memory. An empty table gives no record. Other columns of
the input but url, whatever their names, are not written.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_hot, open_fs, save, shared_folder

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
FILE_BYTES = 64 << 20
FEW_PAYLOADS = 200_000  # so many hashes of repeated payloads (100 bytes each) are broadcast; more are joined
PASSED_OVER = ("warcinfo", "request", "metadata", "resource", "conversion")
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked transfer coding."""
    out = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Decodes chunked transfer coding (with chunk extensions and trailers); fails on bad framing."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise WarcError("chunk size line is cut off")
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError as e:
            raise WarcError("bad chunk size") from e
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise WarcError("chunk is cut off")
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes, mime: str = "application/http; msgtype=response") -> bytes:
    """The payload of a record's block: what follows the HTTP headers, or all of it if it is no HTTP message."""
    if not mime.lower().startswith("application/http"):
        return block
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no end of HTTP headers")
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower():
            return unchunked(body)
    return body


def record(kind: str, record_id: str, block: bytes, **fields: object) -> bytes:
    """A gzip member that holds one record."""
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <{record_id}>".encode(), f"WARC-Date: {DATE}".encode(), b"Content-Length: %d" % len(block)]
    if kind in ("response", "revisit"):
        head.append(b"Content-Type: application/http; msgtype=response")
    head += [f"WARC-{k.replace('_', '-')}: {v}".encode() for k, v in fields.items() if v is not None]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def records(path) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an open .warc.gz file; one record and
    one read buffer are in memory at a time."""
    raw, z, buf = b"", zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal raw, z
        while True:
            if not raw and not (raw := path.read(1 << 18)):
                return False
            buf.extend(z.decompress(raw))
            raw = z.unused_data if z.eof else b""
            if z.eof:
                z = zlib.decompressobj(31)
            if buf:
                return True

    while buf or more():
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                raise WarcError("headers are cut off")
        lines = bytes(buf[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"not a record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["content-length"])
        while len(buf) < end + 4 + n + 4:
            if not more():
                raise WarcError("block is cut off")
        block = bytes(buf[end + 4 : end + 4 + n])
        if buf[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise WarcError("no end of record")
        del buf[: end + 8 + n]
        yield fields, block


def _page_urn(page: int | None) -> str:
    return "urn:page:" + ("none" if page is None else str(page))


def _page_of(urn: str | None) -> int | None:
    last = (urn or "none").strip("<>").rpartition(":")[2]
    return None if last == "none" else int(last)


def record_id(page: int | None, payload_digest: str, number: int = 1) -> str:
    """The same for every writing of a page, so that a revisit can name the record of its payload's first page."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{_page_urn(page)}/{payload_digest}/{number}')}"


def page_records(page: int | None, url: str | None, payload: bytes, first: int | None, segment_bytes: int) -> list[bytes]:
    """The records of one page; ``first``: the page that a revisit refers to."""
    d = digest(payload)
    common = {"Target_URI": " ".join((url or "").split()) or None, "Payload_Digest": f"sha1:{d}", "Page_ID": _page_urn(page)}
    if first is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [record("revisit", record_id(page, d), HTTP, **common, Refers_To=f"<{record_id(first, d)}>", Profile=profile)]
    own, block = record_id(page, d), HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        return [record("response", own, block, **common)]
    out = [record("response", own, block[:segment_bytes], **common, Segment_Number=1)]
    for n, k in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        last = k + segment_bytes >= len(block)
        out.append(record("continuation", record_id(page, d, n), block[k : k + segment_bytes], Segment_Number=n, Segment_Origin_ID=f"<{own}>", Segment_Total_Length=len(block) if last else None))
    return out


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES, least_bytes: int = 0) -> DataFrame:
    """Writes the archives; returns the manifest (path, records, bytes), which is stored beside them."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    # equal payloads are known by SHA-256, of which the rows of those that repeat are sent to the pages; payloads that
    # are met once stay where they are read
    key = src.withColumn("h", F.sha2("payload", 256))
    firsts = save(pages.sparkSession, key.groupBy("h").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "payloads")
    if firsts.count() <= FEW_PAYLOADS:
        marked = key.join(F.broadcast(firsts.drop("n")), "h", "left")
    else:
        marked = join_hot(key, firsts, ["h"], "n").unionByName(key.join(firsts.select("h"), "h", "left_anti").withColumn("first", F.lit(None).cast("long")))
    marked = marked.select("page_id", "url", "payload", F.when((F.length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        out, name, done = None, "", []
        n = size = 0
        for b in batches:
            for page, url, payload, first in zip(*[c.to_pylist() for c in b.columns]):
                for data in page_records(page, url, payload, first, segment_bytes):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, n, size = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= file_bytes:
                        out.close()
                        done.append((name, n, size))
                        out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x[0]}" for x in done]), pa.array([x[1] for x in done]), pa.array([x[2] for x in done])], names=["path", "records", "bytes"])

    path = f"{folder}/manifest"
    marked.mapInArrow(run, "path string, records long, bytes long").write.parquet(path)
    return spark.read.schema("path string, records long, bytes long").parquet(path)


SEGMENT_DDL = "id string, origin string, kind string, page_id long, refers string, stated string, mime string, payload_bytes long, payload_digest string, seg_no int, total long, block binary"


def read_segments(manifest: DataFrame, other_kinds: bool = False, payloads: bool = False) -> DataFrame:
    """A row per record: id, origin, kind, page_id, refers (record id), stated digest and media type; payload_bytes and
    payload_digest of unsegmented records (with ``payloads`` the payload as block), and seg_no, total and block
    of segments. ``other_kinds``: also of records that are no response, revisit or continuation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SEGMENT_DDL.split(", ")]
        types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}.get(x.split()[1], pa.string()) for x in SEGMENT_DDL.split(", ")]
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = open_fs(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    for x, block in records(f):
                        kind, own, mime = x["warc-type"].lower(), x["warc-record-id"], x.get("content-type", "")
                        if kind in PASSED_OVER and not other_kinds:
                            continue
                        origin, refers = x.get("warc-segment-origin-id", own), x.get("warc-refers-to")
                        stated = x.get("warc-payload-digest", "")
                        stated = stated[5:] if stated.lower().startswith("sha1:") else None  # other digests are not checked
                        start = (own, origin, kind, _page_of(x.get("warc-page-id")), refers, stated, mime)
                        if kind == "revisit":
                            rows.append((*start, None, stated, None, None, None))
                        elif kind == "continuation" or "warc-segment-number" in x:
                            total = x.get("warc-segment-total-length")
                            rows.append((*start, None, None, int(x["warc-segment-number"]), total and int(total), block))
                            size += len(block)
                        else:
                            payload = http_payload(block, mime)
                            if stated and stated != (d := digest(payload)):
                                raise WarcError(f"{own}: payload digest {d}, stated {stated}")
                            rows.append((*start, len(payload), stated or digest(payload), None, None, payload if payloads else None))
                            size += len(payload) if payloads else 0
                        if len(rows) >= 5000 or size > 8 << 20:
                            yield batch()
                            rows, size = [], 0
        if rows:
            yield batch()

    return manifest.select("path").mapInArrow(run, SEGMENT_DDL)


def reassemble(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of one record from its (segment number, total length or None, bytes)."""
    parts = sorted(parts)
    numbers = [p[0] for p in parts]
    if numbers != list(range(1, len(parts) + 1)):
        raise WarcError(f"segments {numbers} are not 1 to {len(parts)}")
    totals = [p[1] for p in parts if p[1] is not None]
    block = b"".join(p[2] for p in parts)
    if len(totals) != 1 or parts[-1][1] is None:
        raise WarcError("the last segment has no total length, or another one has")
    if totals[0] != len(block):
        raise WarcError(f"{len(block)} bytes, stated {totals[0]}")
    return block


def read_archives(manifest: DataFrame, payloads: bool = False, other_kinds: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the page of the record that a revisit refers
    to), id and refers_to_id (record ids) of every record; with ``payloads`` also the payload. Fails on
    records that do not add up."""
    spark = manifest.sparkSession
    read = save(spark, read_segments(manifest, other_kinds, payloads), "records")
    out = ["page_id", "payload_bytes", "payload_digest", "kind", "refers", "id", *(["block"] if payloads else [])]
    # records written several times with one id and equal content are one group, and several rows again afterwards
    seg = read.where("seg_no is not null").groupBy("origin", "seg_no", F.xxhash64("total", "block").alias("h")).agg(F.count("*").alias("n"), F.first(F.struct("kind", "page_id", "stated", "mime")).alias("of"), F.first("total").alias("total"), F.first("block").alias("block"))
    parts = seg.groupBy("origin").agg(F.max(F.when(F.col("seg_no") == 1, F.col("of"))).alias("first"), F.min("n").alias("copies"), F.max("n").alias("most"), F.sort_array(F.collect_list(F.struct("seg_no", "total", "block"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, first, copies, most, p in zip(*[c.to_pylist() for c in b.columns]):
                if first is None or first["kind"] == "continuation":
                    raise WarcError(f"{own}: continuation without its first segment")
                if copies != most:
                    raise WarcError(f"{own}: {copies} to {most} copies of its segments")
                data = http_payload(reassemble([(x["seg_no"], x["total"], x["block"]) for x in p]), first["mime"])
                d = digest(data)
                if first["stated"] and first["stated"] != d:
                    raise WarcError(f"{own}: payload digest {d}, stated {first['stated']}")
                row = {"page_id": first["page_id"], "payload_bytes": len(data), "payload_digest": d, "kind": first["kind"], "refers": None, "id": own, "copies": copies}
                yield pa.RecordBatch.from_pylist([row | ({"block": data} if payloads else {})], pa.schema(fields))

    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("kind", pa.string()), ("refers", pa.string()), ("id", pa.string()), ("copies", pa.int64()), *([("block", pa.binary())] if payloads else [])]
    ddl = "page_id long, payload_bytes long, payload_digest string, kind string, refers string, id string, copies long" + ", block binary" * payloads
    whole = parts.select("origin", "first", "copies", "most", "parts").mapInArrow(run, ddl).withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(*out)
    own = save(spark, read.where("seg_no is null").select(*out).unionByName(whole), "payloads")
    # records that are referred to, each met by as many rows as refer to it
    wanted = own.where("kind = 'revisit' and refers is not null").groupBy("refers").agg(F.count("*").alias("n"))
    known = own.where("kind <> 'revisit'").join(wanted.select(F.col("refers").alias("id")), "id", "left_semi").groupBy("id").agg(F.min(F.struct("page_id", "payload_bytes")).alias("x"))
    known = save(spark, wanted.join(known.withColumnRenamed("id", "refers"), "refers", "left").select("refers", "n", F.col("x.page_id").alias("refers_to"), F.col("x.payload_bytes").alias("of_other")), "referred")
    revisits = join_hot(own.where("kind = 'revisit' and refers is not null"), known, ["refers"], "n")
    others = own.where("kind <> 'revisit' or refers is null").withColumns({"refers_to": F.lit(None).cast("long"), "of_other": F.lit(None).cast("long")})
    cols = ["page_id", F.coalesce("payload_bytes", "of_other").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), "refers_to", "id", F.col("refers").alias("refers_to_id"), *([F.col("block").alias("payload")] if payloads else [])]
    return others.unionByName(revisits).select(*cols)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(spark, pages, shared_folder(spark, "warc"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """From a dictionary of payloads, for tests."""
    first: dict[bytes, int] = {}
    for page, html in rows:
        p = (html or "").encode()
        first[p] = min(first.get(p, page), page)
    return [(page, len(p := (html or "").encode()), digest(p), "response" if first[p] == page else "revisit", None if first[p] == page else first[p]) for page, html in rows]
