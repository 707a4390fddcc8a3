"""Media columns: content-defined chunking with a deduplicated chunk store.

A text's payload (UTF-8, zero-padded) becomes an 8-bit mono PCM file.  The file is cut where a rolling gear hash over the
last 32 bytes has its top bits zero (within size limits), each chunk is named by its SHA-256, and a Spark join keeps one
stored copy of every chunk.  A document keeps the ordered list of its chunk names.  Reading back decompresses the stored
chunks, checks every digest, joins multi-chunk media together in order, and checks the media's own digest.

Chunks are compressed with a dictionary that is trained on a bounded sample and kept with the store.

Defined results: null and empty texts are a payload of 64 zero bytes; equal texts share all chunks and have equal
values; repeated rows give a row each; very long texts are a list of chunks, cut within one task; no rows, no result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import durable

#: Lower and upper size of a chunk, and the leading hash bits that must be zero at a cut.
LEAST, MOST, BITS = 4096, 65_536, 12
UNIT, RATE = 64, 8000


def _gear() -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), "<u4")


GEAR = _gear()


def cuts(data: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of data; they depend on content only, so an edit moves cuts near it only."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # the sum over the last 2k bytes, each shifted by its age
        g = h.copy()
        g[k:] += h[:-k] << np.uint32(k)
        h = g
    marks = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    out, at = [], 0
    while n - at > least:
        i = np.searchsorted(marks, at + least)
        end = int(marks[i]) if i < len(marks) else n
        at = min(end, at + most, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def to_media(data: bytes) -> bytes:
    """8-bit unsigned mono PCM in a RIFF container; the length field holds modulo 2**32."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(data) & 0xFFFFFFFF)
    return head + data


def from_media(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[36:40] != b"data" or struct.unpack("<I", media[40:44])[0] != len(media) - 44 & 0xFFFFFFFF:
        raise ValueError("not a whole 8-bit PCM file")
    return media[44:]


#: What is computed from a medium that was read back; digests stay binary until a query names them.
FOUND = "media binary, media_bytes long, payload_bytes long, payload_sha256 binary, tail_crc32 long, mean double, rms double, turns long, chunks int"


def features(media: bytes, chunks: int) -> dict:
    data = from_media(media)
    x = np.frombuffer(data, np.uint8).astype(np.float32) - 128
    turns = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    return {
        "media": hashlib.sha256(media).digest(), "media_bytes": len(media), "payload_bytes": len(data),
        "payload_sha256": hashlib.sha256(data).digest(), "tail_crc32": zlib.crc32(data[-UNIT:]),
        "mean": float(x.mean(dtype=np.float64)), "rms": float(np.sqrt(np.square(x).mean(dtype=np.float64))), "turns": turns, "chunks": chunks,
    }


def feature() -> Column:
    """The features of FOUND as one string."""
    return F.format_string("mean=%.4f rms=%.4f turns=%d chunks=%d", "mean", "rms", "turns", "chunks")


def recipes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (SHA-256) and the ordered digests of the media's chunks; null where it is one chunk itself."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, data = payload(t.as_py())
                m = to_media(data)
                ends = cuts(m)
                digests = None if len(ends) == 1 else [hashlib.sha256(m[a:e]).digest() for a, e in zip([0, *ends], ends, strict=False)]
                rows.append({"doc_id": i, "n_bytes": n, "media": hashlib.sha256(m).digest(), "digests": digests})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    import pyarrow as pa

    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("digests", pa.list_(pa.binary()))])
    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n_bytes long, media binary, digests array<binary>")


#: Bounds of the dictionary's sample (documents first by hash, greatest length, bytes of each) and its size.
SAMPLE, LONGEST, EACH, DICTIONARY = 600, 65_536, 32_768, 65_536


def dictionary(docs: DataFrame, text: str = "text") -> bytes:
    """Compression dictionary for chunks; empty where the sample is too small for one.  It changes no result."""
    import zstandard

    ids = [r[0] for r in docs.select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE).collect()]
    rows = docs.where(F.col("doc_id").isin([i for i in ids if i is not None]) & (F.length(text) <= LONGEST)).select("doc_id", text)
    sample = [to_media(payload(r[1])[1])[:EACH] for r in sorted(rows.limit(2 * SAMPLE).collect())]
    try:
        return zstandard.train_dictionary(DICTIONARY, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _zstd(trained: bytes) -> dict:
    import zstandard

    return {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}


def chunks(docs: DataFrame, trained: bytes = b"", text: str = "text", level: int = 15) -> DataFrame:
    """digest and compressed bytes of every chunk, once per batch of rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=level, **_zstd(trained))
        for b in batches:
            seen, out, held = set(), ([], []), 0
            for t in b.column(0):
                m = to_media(payload(t.as_py())[1])
                ends = cuts(m)
                for a, e in zip([0, *ends], ends, strict=False):
                    d = hashlib.sha256(m[a:e]).digest()
                    if d not in seen:
                        seen.add(d)
                        out[0].append(d)
                        out[1].append(press.compress(m[a:e]))
                        held += len(out[1][-1])
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["digest", "z"])
                    out, held = ([], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["digest", "z"])

    return docs.select(text).mapInArrow(run, "digest binary, z binary")


def store(docs: DataFrame, recipe: DataFrame, trained: bytes = b"", text: str = "text") -> DataFrame:
    """The written chunk store: digest, z, whole (is all of some medium), part (is one chunk of several).

    Copies of a chunk are dropped by each map task before anything moves, so that a common chunk is no hot key; chunks
    move once, as the join with the digests in use is on the key they are already dealt by.
    """
    one = F.col("digests").isNull()
    uses = recipe.select(F.explode(F.coalesce("digests", F.array("media"))).alias("digest"), one.alias("w"), (~one).alias("p"))
    uses = uses.groupBy("digest").agg(F.max("w").alias("whole"), F.max("p").alias("part"))
    held = chunks(docs, trained, text).groupBy("digest").agg(F.first("z").alias("z"))
    return durable(held.join(uses, "digest"), "chunks", "none")


def read_back(stored: DataFrame, recipe: DataFrame, trained: bytes = b"") -> DataFrame:
    """Features of every distinct medium, from the stored bytes alone.  A wrong digest or a lost chunk is an error."""

    def opener():  # noqa: ANN202
        import zstandard

        return zstandard.ZstdDecompressor(**_zstd(trained))

    def unpack(press, digest: bytes, z: bytes) -> bytes:  # noqa: ANN001
        raw = press.decompress(z)
        if hashlib.sha256(raw).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} does not match its digest")
        return raw

    def single(batches: Iterator) -> Iterator:
        import pyarrow as pa

        press = opener()
        for b in batches:
            rows = [features(unpack(press, d.as_py(), z.as_py()), 1) for d, z in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def several(key, t):  # noqa: ANN001, ANN202
        import pyarrow as pa

        t, press = t.sort_by("seq"), opener()
        m = b"".join(unpack(press, d.as_py(), z.as_py()) for d, z in zip(t.column("digest"), t.column("z"), strict=True))
        if t.num_rows != t.column("n")[0].as_py() or hashlib.sha256(m).digest() != key[0].as_py():
            raise ValueError(f"medium {key[0].as_py().hex()} can't be rebuilt")
        return pa.Table.from_pylist([features(m, t.num_rows)], schema=arrow)

    import pyarrow as pa

    whole, real, raw = pa.int64(), pa.float64(), pa.binary()
    arrow = pa.schema([("media", raw), ("media_bytes", whole), ("payload_bytes", whole), ("payload_sha256", raw), ("tail_crc32", whole), ("mean", real), ("rms", real), ("turns", whole), ("chunks", pa.int32())])
    lists = recipe.where("digests is not null").groupBy("media").agg(F.first("digests").alias("digests"))
    lists = lists.select("media", F.size("digests").alias("n"), F.posexplode("digests").alias("seq", "digest"))
    many = lists.join(stored.where("part").select("digest", "z"), "digest").groupBy("media").applyInArrow(several, FOUND)
    return stored.where("whole").select("digest", "z").mapInArrow(single, FOUND).union(many)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    recipe = durable(recipes(docs), "recipes")
    trained = dictionary(docs)
    found = read_back(store(docs, recipe, trained), recipe, trained)
    out = recipe.select("doc_id", "n_bytes", "media").join(found, "media")
    name = lambda c: F.lower(F.hex(c))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", name("payload_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes",
        name("media").alias("media_sha256"), feature().alias("feature"),
    )


#: The RIFF file, its chunks by the gear hash, and the features, from the text alone.  A byte's rolling hash is built by
#: doubling the span, cuts by following the marks from one to the next; the mean is rounded half up from whole numbers.
OP3_SQL = rf"""
WITH RECURSIVE one AS (
  SELECT g AS i, printf('%02x', g) AS two, sha256(unhex(printf('%02x', g))) AS s FROM range(256) r(g)),
gear AS (SELECT i AS v, two, CAST('0x' || s[7:8] || s[5:6] || s[3:4] || s[1:2] AS BIGINT) AS g FROM one),
remainders AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM one),
d AS (SELECT x, row_number() OVER () AS k FROM (SELECT DISTINCT coalesce(text, '') AS x FROM documents)),
p AS (SELECT k, x, strlen(x) AS n_bytes, greatest({UNIT}, (strlen(x) + {UNIT - 1}) // {UNIT} * {UNIT}) AS size FROM d),
q AS (
  SELECT k, n_bytes, size, lower(hex(encode(x))) || repeat('00', size - n_bytes) AS body,
    list_transform([36 + size, {RATE}, size], lambda z: printf('%02x%02x%02x%02x', z & 255, z >> 8 & 255, z >> 16 & 255, z >> 24 & 255)) AS le FROM p),
m AS (
  SELECT k, n_bytes, size, 44 + size AS n, body,
    '52494646' || le[1] || '57415645666d7420100000000100' || '0100' || le[2] || le[2] || '01000800' || '64617461' || le[3] || body AS media FROM q),
pieces AS (SELECT k, n, unnest(range(n)) AS i, unnest(regexp_extract_all(media, '..')) AS two FROM m),
b AS (SELECT k, n, i, v, g FROM pieces JOIN gear USING (two)),
sums AS (
  SELECT k, sum(v - 128) AS s, sum((v - 128) * (v - 128)) AS q, list(v ORDER BY i) FILTER (i >= n - {UNIT}) AS tail,
    count(*) FILTER ((v < 128) <> (before < 128)) AS turns
  FROM (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY i) AS before FROM b WHERE i >= 44) GROUP BY k),
h2 AS (SELECT k, i, (g + (coalesce(lag(g, 1) OVER w, 0) << 1)) & 4294967295 AS h FROM b WHERE n > {LEAST} WINDOW w AS (PARTITION BY k ORDER BY i)),
h4 AS (SELECT k, i, (h + (coalesce(lag(h, 2) OVER w, 0) << 2)) & 4294967295 AS h FROM h2 WINDOW w AS (PARTITION BY k ORDER BY i)),
h8 AS (SELECT k, i, (h + (coalesce(lag(h, 4) OVER w, 0) << 4)) & 4294967295 AS h FROM h4 WINDOW w AS (PARTITION BY k ORDER BY i)),
h16 AS (SELECT k, i, (h + (coalesce(lag(h, 8) OVER w, 0) << 8)) & 4294967295 AS h FROM h8 WINDOW w AS (PARTITION BY k ORDER BY i)),
h32 AS (SELECT k, i, (h + (coalesce(lag(h, 16) OVER w, 0) << 16)) & 4294967295 AS h FROM h16 WINDOW w AS (PARTITION BY k ORDER BY i)),
marks AS (SELECT k, list(i + 1 ORDER BY i) AS ends FROM h32 WHERE h >> {32 - BITS} = 0 GROUP BY k),
cut AS (
  SELECT k, n, coalesce(ends, []) AS ends, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS chunks FROM m LEFT JOIN marks USING (k)
  UNION ALL
  SELECT k, n, ends, least(pos + {MOST}, n, coalesce(list_filter(ends, lambda z: z >= pos + {LEAST})[1], n)), chunks + 1 FROM cut WHERE n - pos > {LEAST}),
counted AS (SELECT k, chunks + CAST(pos < n AS BIGINT) AS chunks FROM cut WHERE n - pos <= {LEAST}),
made AS (
  SELECT k, n_bytes, size AS payload_bytes, sha256(unhex(body)) AS payload_sha256,
    xor(list_reduce(list_concat([4294967295], tail), lambda c, z: xor(c >> 8, tab[CAST((xor(c, z) & 255) + 1 AS BIGINT)])), 4294967295) AS tail_crc32,
    n AS media_bytes, sha256(unhex(media)) AS media_sha256, s < 0 AS minus, CAST((20000 * abs(s) + size) // (2 * size) AS BIGINT) AS mean,
    sqrt(q / size) AS rms, turns, chunks
  FROM m JOIN sums USING (k) JOIN counted USING (k), remainders)
SELECT doc_id, n_bytes, payload_bytes, payload_sha256, CAST(tail_crc32 AS BIGINT) AS tail_crc32, media_bytes, media_sha256,
  printf('mean=%s%d.%04d rms=%.4f turns=%d chunks=%d', CASE WHEN minus THEN '-' ELSE '' END, mean // 10000, mean % 10000, rms, turns, chunks) AS feature
FROM documents JOIN d ON coalesce(text, '') = x JOIN made USING (k)
"""
