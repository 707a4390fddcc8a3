"""WARC writing and reading, with segmented records put together again.

Every page becomes a record.  Of the pages with equal payloads of at least 1,000 bytes the one with the largest id is a
`response`, the others are `revisit` records that refer to it and hold HTTP headers only.  Larger bodies use chunked
transfer framing, and an HTTP block over the segment size is cut into a first record and `continuation` records.  The
reader parses the records' bytes; continuations are grouped by their origin id with the first segment, put in
order of segment number, checked against the total length, and only then is the transfer framing decoded.

Archives are tables of (archive, record) whose `record` bytes, in order, are a WARC 1.1 file: Spark writes them to any
store and commits them even if executors are lost.  `files()` reads plain or gzipped WARC files.

Defined results: null and empty html is an empty payload; a null page_id is a response with a null id; null urls are written as `urn:none`; equal rows are
records of their own with ids of their own, all responses if one is, and come back as often; rows of one id with other html or
another url are told apart; very long bodies are many segments; other columns are left out; no rows, no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import durable

#: Smallest payload that is looked up, HTTP block bytes in a segment, bodies over this use chunked framing, bytes in a frame.
DEDUP, SEGMENT, CHUNKED, FRAME = 1000, 16_384, 8_192, 4_096
DATE = "2024-01-01T00:00:00Z"


#: Copies of equal rows that one task writes at a time.
COPIES = 64


def urn(page_id: int | None, tag: str, copy: int = 0, segment: int = 1) -> str:
    """tag tells rows of one id with different payloads or urls apart, copy the equal ones."""
    return f"<urn:x-page:{page_id}:{tag}{f'.{copy}' if copy else ''}{f'/{segment}' if segment > 1 else ''}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def frame(body: bytes, size: int = FRAME) -> bytes:
    out = []
    for i in range(0, len(body), size):
        part = body[i : i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unframe(data: bytes) -> bytes:
    """Decode chunked transfer framing (extensions and trailers are passed over); cut-off data is an error."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        n = int(data[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if n == 0:
            if data.find(b"\r\n", at) < 0:
                raise ValueError("the last frame has no end")
            return b"".join(out)
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a frame is cut off")
        out.append(data[at : at + n])
        at += n + 2


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_page(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, tag: str = "0", to_tag: str = "0", copy: int = 0, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, in order.  to_tag: tag of the page that is referred to."""
    body = (html or "").encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    digest = ("WARC-Payload-Digest", _sha1(body))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(body)
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", urn(page_id, tag, copy)), *common, digest, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", urn(refers_to, to_tag)), ("Content-Type", "application/http; msgtype=response")], block)
        return
    if len(body) > CHUNKED:
        block = http + b"Transfer-Encoding: chunked\r\n\r\n" + frame(body)
    else:
        block = http + b"Content-Length: %d\r\n\r\n" % len(body) + body
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", urn(page_id, tag, copy)), *common, digest, ("Content-Type", "application/http; msgtype=response")]
    if len(parts) == 1:
        yield record([*first, ("WARC-Block-Digest", _sha1(block))], block)
        return
    yield record([*first, ("WARC-Segment-Number", "1")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", urn(page_id, tag, copy, n)), *common, ("WARC-Segment-Origin-ID", urn(page_id, tag, copy)), ("WARC-Segment-Number", str(n)), *last], part)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record in data; data that is cut off is an error."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield head, data[end + 4 : stop]
        at = stop + 4


def payload(block: bytes) -> tuple[bytes, dict[str, str]]:
    """Body of an HTTP block, transfer framing decoded, and the HTTP headers."""
    end = block.index(b"\r\n\r\n")
    head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in block[:end].decode("latin-1").split("\r\n")[1:])}
    body = block[end + 4 :]
    return (unframe(body) if head.get("transfer-encoding", "").lower() == "chunked" else body), head


def write(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """pages: page_id, url, html.  The written archives: archive int, seq long, record binary."""
    p = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("key", F.sha1(F.coalesce("html", F.lit(""))))
    p = p.withColumn("n", F.octet_length(F.coalesce("html", F.lit(""))))
    # Of each payload: which page has the largest id, and whether there are equal rows at all.
    each = p.groupBy("key", "page_id", "url").agg(F.count("*").alias("c"))
    about = durable(each.groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("top"), (F.max("c") > 1).alias("repeated")), "about")
    tag = lambda url: F.concat(F.substring("key", 1, 16), F.lit("-"), F.lower(F.hex(F.crc32(F.coalesce(url, F.lit(""))))))

    def told(about: DataFrame) -> DataFrame:
        to = F.when((F.col("n") >= DEDUP) & (F.col("top.page_id") != F.col("page_id")), F.col("top.page_id"))
        return p.join(about, "key").withColumn("to", to).withColumn("tag", tag(F.col("url"))).withColumn("to_tag", tag(F.col("top.url")))

    cols = ["page_id", "url", "html", "to", "tag", "to_tag", "start", "copies"]
    one = told(about.where("not repeated").hint("merge")).select(*cols[:-2], F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("copies"))
    # Equal rows become one with a count, which is written in runs of COPIES by many tasks.
    # The payloads that repeat are few as a rule; as a table of their own Spark sees that, and moves no page to find theirs.
    many = told(durable(about.where("repeated"), "repeated")).groupBy("key", "page_id", "url", "to", "tag", "to_tag").agg(F.first("html").alias("html"), F.count("*").alias("c"))
    many = many.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(COPIES).cast("long"))))
    many = many.withColumn("copies", F.least(F.lit(COPIES), F.col("c") - F.col("start"))).select(*cols).repartition("page_id", "tag", "start")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out: tuple = ([], [])
            held = 0
            for *row, start, copies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for copy in range(start, start + copies):
                    for n, r in enumerate(write_page(*row, copy=copy, segment=segment)):
                        out[0].append(n)
                        out[1].append(r)
                        held += len(r)
                    if held > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["seq", "record"])
                        out, held = ([], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["seq", "record"])

    rows = one.union(many).mapInArrow(run, "seq int, record binary")
    return durable(rows.withColumn("archive", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "warc")


def records(archives: DataFrame) -> DataFrame:
    """Parsed records: id, origin (of segmented ones), number, total, type, refers_to, digest, block."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for data in b.column(0):
                for h, block in parse(data.as_py()):
                    n = h.get("warc-segment-number")
                    rows.append({
                        "id": h["warc-record-id"], "number": int(n) if n else None,
                        "origin": h.get("warc-segment-origin-id", h["warc-record-id"]),
                        "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                        "type": h["warc-type"], "refers_to": h.get("warc-refers-to"), "digest": h.get("warc-payload-digest"), "block": block,
                    })
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    import pyarrow as pa

    arrow = pa.schema([("id", pa.string()), ("number", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary())])
    return archives.select("record").mapInArrow(run, "id string, number int, origin string, total long, type string, refers_to string, digest string, block binary")


PAYLOADS = "id string, type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def _row(head: dict, block: bytes, keep: bool) -> dict:
    body, http = payload(block)
    if head["type"] == "revisit":
        n, digest = int(http["content-length"]), base64.b32decode(head["digest"].removeprefix("sha1:")).hex()
    else:
        n, digest = len(body), hashlib.sha1(body).hexdigest()
        if head["digest"] and _sha1(body) != head["digest"]:
            raise ValueError(f"{head['id']}: payload does not match its digest")
    return {"id": head["id"], "type": head["type"], "refers_to": head["refers_to"], "payload_bytes": n, "payload_digest": digest, "payload": body if keep and head["type"] != "revisit" else None}


def reassemble(segments: list[dict]) -> tuple[dict, bytes, int]:
    """Head of the first segment, the whole block, and how many equal copies there are.

    A gap, a wrong total length, or a segment that is repeated without all others is an error.
    """
    segments = sorted(segments, key=lambda s: s["number"])
    copies = sum(s["number"] == segments[0]["number"] for s in segments)
    same = all(s["block"] == t["block"] for i in range(0, len(segments), copies) for s, t in [(segments[i], t) for t in segments[i : i + copies]])
    if len(segments) % copies or not same or any(s["number"] != i // copies + 1 for i, s in enumerate(segments)):
        raise ValueError(f"{segments[0]['origin']}: segments are missing or repeated")
    segments = segments[::copies]
    block = b"".join(s["block"] for s in segments)
    if segments[-1]["total"] != len(block):
        raise ValueError(f"{segments[0]['origin']}: the total length is {len(block)}, not {segments[-1]['total']}")
    return segments[0], block, copies


def read(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One row per response or revisit: PAYLOADS.  Only segmented records are shuffled."""
    r = records(archives)
    import pyarrow as pa

    arrow = pa.schema([("id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def plain(batches: Iterator) -> Iterator:
        for b in batches:
            yield pa.RecordBatch.from_pylist([_row(x, x["block"], keep_payload) for x in b.to_pylist()], schema=arrow)

    def joined(t):  # noqa: ANN001, ANN202
        head, block, copies = reassemble(t.to_pylist())
        return pa.Table.from_pylist([_row(head, block, keep_payload)] * copies, schema=arrow)

    one = r.where("number is null and type in ('response', 'revisit')").mapInArrow(plain, PAYLOADS)
    many = r.where("number is not null").groupBy("origin").applyInArrow(joined, PAYLOADS)
    return one.union(many)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Records of plain or gzipped WARC files, as `archives` of read(): one task a file."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = data.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                yield pa.RecordBatch.from_pylist([{"archive": name, "record": raw}])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, record binary")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(write(spark.read.parquet(f"{sf_dir}/pages.parquet")), keep_payload=False)
    number = lambda c: F.nullif(F.regexp_extract(c, r"x-page:(-?\d+):", 1), F.lit("")).cast("long")
    return found.select(
        number(F.col("id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.when(F.col("refers_to").isNotNull(), number(F.col("refers_to"))).alias("refers_to"),
    )


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM k)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
FROM m
"""
