"""Token-id files coded by a static range asymmetric numeral system (rANS).

A segment (up to about four million ids of consecutive documents) has one frequency table, shared by its blocks; a block
of 2**17 ids is coded by itself as 128 interleaved 64-bit states over one stream of 32-bit words.  Checkpoints (all
states and the place in the stream) at the start and middle of a block let its halves be decoded at once; a CRC-32
guards the ids of every block.  Segments are rows of a Parquet table that Spark commits, in ascending doc_id order.

Segment bytes, little-endian: magic `NFR2`, u32 ids, u32 documents, u32 table bytes, zlib table (u32 symbols, then
delta-coded u32 ids and u32 frequencies), a bit for every document (set where it has no id, padded to bytes), i64 doc ids
(0 without one), u32 lengths, then blocks: u32 ids, u32 crc32, u32 words,
u32 checkpoints, per checkpoint u32 step, u32 words before it and 128 u64 states, then the words.

Defined results: a null or empty text is the end id alone; rows with equal or null ids come in any order among themselves
(null first) and may be dealt to several parts; a very long text is a segment of its own; other columns are left out; no
rows, no segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import durable, partitions
from nearfield.llm.tokens import END, encoder

LANES, SCALE, BLOCK, STEP = 128, 18, 1 << 17, 512
SEGMENT = 1 << 22
LOW = np.uint64(1 << 31)


def normalised(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**scale."""
    total = 1 << scale
    f = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    while (d := total - int(f.sum())) != 0:
        big = np.argsort(-f, kind="stable")
        if d > 0:
            f[big[0]] += d
        else:
            room = np.minimum(f[big] - 1, np.maximum(1, f[big] // 2))
            take = np.minimum(room, np.maximum(0, -d - (np.cumsum(room) - room)))
            f[big] -= take
    return f


def _encode(sym: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> list[tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]]:
    """sym: (blocks, steps, lanes) indices.  Words of each block and its checkpoints (step, words before, states)."""
    blocks, steps, lanes = sym.shape
    x = np.full((blocks, lanes), LOW, np.uint64)
    masks, words = np.zeros((steps, blocks, lanes), bool), np.zeros((steps, blocks, lanes), np.uint32)
    states = {}
    limit = np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        s = sym[:, t]
        f, c = freq[s], cum[s]
        m = x >= f << limit
        masks[t], words[t] = m, x.astype(np.uint32)
        x = np.where(m, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + c
        if t % STEP == 0:
            states[t] = x.copy()
    out = []
    for b in range(blocks):
        m = masks[:, b]
        before = np.concatenate([[0], np.cumsum(m.sum(1))])
        out.append((words[:, b][m], [(t, int(before[t]), states[t][b]) for t in sorted(states)]))
    return out


def encode_segment(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    if ids.max(initial=0) < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
        index = np.zeros(int(symbols[-1]) + 1, np.int32)
        index[symbols] = np.arange(len(symbols))
        sym = index[ids]
    else:
        symbols, sym, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq = normalised(counts)
    cum = np.cumsum(freq) - freq
    table = zlib.compress(struct.pack("<I", len(symbols)) + np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    none = np.array([i is None for i in doc_ids], bool)
    named = np.array([i or 0 for i in doc_ids], "<i8")
    out = [b"NFR2", struct.pack("<3I", len(ids), len(doc_ids), len(table)), table, np.packbits(none).tobytes(), named.tobytes(), np.array(lengths, "<u4").tobytes()]
    f, c = freq.astype(np.uint64), cum.astype(np.uint64)
    full = len(ids) // BLOCK
    coded = _encode(sym[: full * BLOCK].reshape(full, BLOCK // LANES, LANES), f, c) if full else []
    if len(ids) % BLOCK:
        rest = sym[full * BLOCK :]
        coded += _encode(np.pad(rest, (0, -len(rest) % LANES)).reshape(1, -1, LANES), f, c)
    for b, (words, marks) in enumerate(coded):
        own = ids[b * BLOCK : (b + 1) * BLOCK]
        out.append(struct.pack("<4I", len(own), zlib.crc32(own.astype("<u4").tobytes()), len(words), len(marks)))
        for t, at, states in marks:
            out += [struct.pack("<2I", t, at), states.astype("<u8").tobytes()]
        out.append(words.astype("<u4").tobytes())
    return b"".join(out)


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, doc ids, which of these are none, and lengths.  All halves of blocks are decoded at once; a wrong checksum is an error."""
    if data[:4] != b"NFR2":
        raise ValueError("not a segment")
    n, docs, size = struct.unpack_from("<3I", data, 4)
    at = 16 + size
    table = zlib.decompress(data[16:at])
    (k,) = struct.unpack_from("<I", table)
    symbols = np.cumsum(np.frombuffer(table, "<u4", k, 4)).astype(np.uint32)
    freq = np.frombuffer(table, "<u4", k, 4 + 4 * k).astype(np.uint64)
    cum = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(k), freq.astype(np.int64))
    none = np.unpackbits(np.frombuffer(data, np.uint8, -(-docs // 8), at), count=docs).astype(bool)
    at += -(-docs // 8)
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    at += 12 * docs
    units, sizes, crcs, words = [], [], [], []
    base = 0
    while at < len(data):
        size, crc, n_words, n_marks = struct.unpack_from("<4I", data, at)
        at += 16
        steps = -(-size // LANES)
        marks = []
        for _ in range(n_marks):
            marks.append((*struct.unpack_from("<2I", data, at), np.frombuffer(data, "<u8", LANES, at + 8)))
            at += 8 + 8 * LANES
        for i, (t, w, states) in enumerate(marks):
            end, _, after = marks[i + 1] if i + 1 < len(marks) else (steps, 0, np.full(LANES, LOW))
            units.append((len(sizes), t, end - t, base + w, states, after))
        words.append(np.frombuffer(data, "<u4", n_words, at))
        at += 4 * n_words
        base += n_words
        sizes.append(size)
        crcs.append(crc)
    out = [np.empty((-(-s // LANES), LANES), np.uint32) for s in sizes]
    stream = np.concatenate([*words, np.zeros(1, np.uint32)]) if words else np.zeros(1, np.uint32)
    mask, scale, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    units.sort(key=lambda u: -u[2])
    x = np.array([u[4] for u in units], np.uint64).reshape(-1, LANES)
    place = np.array([u[3] for u in units], np.int64)
    count = np.array([u[2] for u in units])
    made = np.empty((int(count.max(initial=0)), len(units), LANES), np.int32)
    for t in range(len(made)):
        live = int((count > t).sum())  # units are sorted by length
        y = x[:live]
        slot = y & mask
        s = slots[slot.astype(np.int64)]
        made[t, :live] = s
        y = freq[s] * (y >> scale) + slot - cum[s]
        m = y < LOW
        rank = np.cumsum(m, 1)
        w = stream[np.minimum(place[:live, None] + rank - 1, len(stream) - 1)]
        x[:live] = np.where(m, y << half | w.astype(np.uint64), y)
        place[:live] += rank[:, -1]
    if units and (x != np.array([u[5] for u in units])).any():
        raise ValueError("states do not meet the next checkpoint")
    for u, (b, t, k, *_) in enumerate(units):
        out[b][t : t + k] = symbols[made[:k, u]]
    ids = [o.ravel()[:s] for o, s in zip(out, sizes, strict=True)]
    for i, crc in zip(ids, crcs, strict=True):
        if zlib.crc32(i.astype("<u4").tobytes()) != crc:
            raise ValueError("a block does not match its checksum")
    ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    if len(ids) != n or lengths.sum() != n:
        raise ValueError("a segment is cut off")
    return ids, doc_ids, none, lengths


def write(docs: DataFrame, path: str | None = None, text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Written segments of all documents in ascending doc_id order: part, start (ids of the part before it), n_ids, data.

    path: the tokenizer's file.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(path)
        ids, doc_ids, lengths, have, start = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, doc_ids, lengths, have, start
            data = encode_segment(np.frombuffer(b"".join(ids), "<u4"), doc_ids, lengths)
            out = pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([have], pa.int64()), pa.array([data], pa.binary())], names=["start", "n_ids", "data"])
            start += have
            ids, doc_ids, lengths, have = [], [], [], 0
            return out

        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), enc.each(t.as_py() for t in b.column(1)), strict=True):
                ids.append(raw + END)
                doc_ids.append(i)
                lengths.append(len(raw) // 4 + 1)
                have += lengths[-1]
                if have >= segment:
                    yield flush()
        if have:
            yield flush()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("tie"))
    d = d.repartitionByRange(max(1, partitions(docs.sparkSession)), "doc_id", "tie").sortWithinPartitions("doc_id")
    coded = d.select("doc_id", "text").mapInArrow(run, "start long, n_ids long, data binary")
    return durable(coded.withColumn("part", F.spark_partition_id()), "ids", "none")


def read(segments: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, in any order.  One number a part reaches the driver."""
    sizes = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    first = F.element_at(F.lit(before or [0]).cast("array<bigint>"), F.col("part") + 1)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids, doc_ids, none, lengths = decode_segment(data.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64(), mask=none), pa.array(ends - lengths + start), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select((F.col("start") + first).alias("start"), "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
