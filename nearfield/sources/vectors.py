"""Raw and length-prefixed vector files, neighbor files, generators, and byte codecs of lists.

Readers find a file's size through Spark's `binaryFile` source (metadata only) and read byte ranges in parallel tasks
through its own file API where the path is local or shared, or whole files through Spark otherwise.
Writers make one file of ranges of rows, which tasks write at their places; driver and executors must share its folder.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.plans.durable import durable

KINDS = {"f32": "<f4", "f16": "<f2", "u8": "u1", "i8": "i1", "u32": "<u4"}
PART = 32 << 20


def _local(path: str) -> str | None:
    path = path.removeprefix("file://")
    return path if "://" not in path and os.path.exists(path) else None


def _shape(size: int, head: bytes, dims: int | None, kind: str) -> tuple[int, int, int]:
    """Rows, dimensions and bytes before the body; errors as for a damaged file."""
    width = np.dtype(KINDS[kind]).itemsize
    if dims is None:
        if size < 8:
            raise ValueError("file is too short for a header")
        n, dims = struct.unpack("<II", head[:8])
        if size - 8 != n * dims * width:
            raise ValueError(f"body is {size - 8} bytes, not {n} x {dims} x {width}")
        return n, dims, 8
    if size % width:
        raise ValueError(f"{size} bytes are not a multiple of {width}")
    if size % (width * dims):
        raise ValueError(f"{size} bytes are not a multiple of the stride of {dims} elements")
    return size // (width * dims), dims, 0


def read(spark: SparkSession, path: str, kind: str = "f32", dims: int | None = None) -> DataFrame:
    """(id, vec) with ids by position.  dims: stride of a headerless file; without it the file has a header."""
    dtype, width = KINDS[kind], np.dtype(KINDS[kind]).itemsize
    out = "array<long>" if kind in ("u32",) else "array<float>"

    def rows(first: int, x: np.ndarray):  # noqa: ANN202
        import pyarrow as pa

        values = pa.list_(pa.int64() if out == "array<long>" else pa.float32())
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(x))), pa.array(list(x.astype("i8" if out == "array<long>" else "f4")), values)], names=["id", "vec"])

    if local := _local(path):
        size = os.path.getsize(local)
        with open(local, "rb") as f:
            n, d, skip = _shape(size, f.read(8), dims, kind)
        step = max(1, PART // max(1, d * width))

        def ranges(batches: Iterator) -> Iterator:
            for b in batches:
                for i in b.column(0).to_pylist():
                    m = min(step, n - i * step)
                    with open(local, "rb") as f:
                        f.seek(skip + i * step * d * width)
                        yield rows(i * step, np.frombuffer(f.read(m * d * width), dtype).reshape(m, d))

        parts = -(-n // step)
        return spark.range(0, parts, 1, max(1, parts)).mapInArrow(ranges, f"id long, vec {out}")

    def whole(batches: Iterator) -> Iterator:
        for b in batches:
            for c in b.column(0):
                data = c.as_py()
                n, d, skip = _shape(len(data), data[:8], dims, kind)
                x = np.frombuffer(data, dtype, n * d, skip).reshape(n, d)
                for i in range(0, n, 4096):
                    yield rows(i, x[i : i + 4096])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(whole, f"id long, vec {out}")


def write(df: DataFrame, path: str, kind: str = "f32", header: bool = True, id_: str = "id", vec: str = "vec") -> int:
    """Write rows in id order into one file in a folder that driver and executors share; the number of rows.

    Rows are dealt to ranges of ids, which tasks write at their own places of the file; only each range's row count and
    lengths reach the driver.  A task that runs again writes the same bytes.  The file takes its name when it is whole.
    Equal ids come in any order, null ids first; a missing vector or component, or another length, is an error.
    """
    spark, dtype = df.sparkSession, KINDS[kind]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_).alias("id"), F.col(vec).alias("vec")).repartitionByRange(parts, "id").sortWithinPartitions("id")
    rows = durable(rows.select("vec", F.monotonically_increasing_id().alias("at")), "file")
    length = F.coalesce(F.size("vec"), F.lit(-1))
    found = rows.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"), F.min(length).alias("low"), F.max(length).alias("high")).orderBy("part").collect()
    if any(r["low"] < 0 for r in found):
        raise ValueError("a row has no vector")
    if len({x for r in found for x in (r["low"], r["high"])}) > 1:
        raise ValueError("rows have different lengths")
    n, dims, starts = 0, found[0]["low"] if found else 0, {}
    for r in found:
        starts[r["part"]] = n
        n += r["n"]
    skip, stride = 8 if header else 0, dims * np.dtype(dtype).itemsize
    path = path.removeprefix("file://")
    made = f"{path}.{uuid.uuid4().hex}.part"

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with open(made, "r+b") as f:
            for b in batches:
                values = b.column(0).flatten()
                if values.null_count:
                    raise ValueError("a vector has a missing component")
                x = values.to_numpy(zero_copy_only=False).astype(dtype)
                at = np.array([starts[a >> 33] + (a & (1 << 33) - 1) for a in b.column(1).to_pylist()], np.int64)
                runs = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)] if len(at) else []
                for i, j in zip(runs, runs[1:], strict=False):
                    f.seek(skip + int(at[i]) * stride)
                    f.write(x[i * dims : j * dims].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([len(at)], pa.int64())], names=["n"])

    try:
        with open(made, "wb") as f:
            if header:
                f.write(struct.pack("<II", n, dims))
            f.truncate(skip + n * stride)
        written = rows.mapInArrow(fill, "n long").agg(F.sum("n")).first()[0] or 0
        if written != n:
            raise RuntimeError(f"{written} rows of {n} were written")
        os.replace(made, path)
    finally:
        if os.path.exists(made):
            os.remove(made)
    return n


def convert_f16(spark: SparkSession, source: str, dims: int, target: str) -> int:
    """Headerless f32 to f16 with a header."""
    return write(read(spark, source, "f32", dims), target, "f16")


def read_neighbors(spark: SparkSession, path: str, per_row: int = 100) -> DataFrame:
    """Rows of per_row (i64 id, f64 distance) pairs: qid, rank, id, distance.  Ranges of rows are read by tasks."""
    pair = np.dtype([("id", "<i8"), ("distance", "<f8")])
    path = path.removeprefix("file://")
    n, odd = divmod(os.path.getsize(path), pair.itemsize * per_row)
    if odd:
        raise ValueError("file is not a whole number of rows")
    step = max(1, PART // (pair.itemsize * per_row))

    def ranges(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in b.column(0).to_pylist():
                x = np.fromfile(path, pair, min(step, n - i * step) * per_row, offset=i * step * per_row * pair.itemsize)
                q, r = np.divmod(np.arange(len(x)), per_row)
                columns = [q + i * step, (r + 1).astype("i4"), x["id"].copy(), x["distance"].copy()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "rank", "id", "distance"])

    parts = -(-n // step)
    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(ranges, "qid long, rank int, id long, distance double")


def write_truth(neighbors: DataFrame, path: str) -> int:
    """qid, rank, id as a header and u32 ids, one row a query; distances are dropped."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    return write(neighbors.groupBy(F.col("qid").alias("id")).agg(ids.alias("vec")), path, "u32")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, "u32").select(F.col("id").alias("qid"), F.posexplode("vec").alias("pos", "id")).select("qid", (F.col("pos") + 1).alias("rank"), "id")


def check(path: str, kind: str = "f32") -> dict:
    """Count, dimensions and entry width as the header has them; even tells whether the body fits."""
    path = path.removeprefix("file://")
    with open(path, "rb") as f:
        head = f.read(8)
    if len(head) < 8:
        raise ValueError("file is too short for a header")
    n, d = struct.unpack("<II", head)
    body = os.path.getsize(path) - 8
    return {"count": n, "dimensions": d, "entry_width": body / (n * d) if n * d else 0.0, "even": n * d > 0 and body % (n * d) == 0}


def generate(spark: SparkSession, n: int, dims: int, kind: str = "f32-unit", seed: int = 42, parts: int | None = None) -> DataFrame:
    """n random vectors: f32-unit (uniform in [-1, 1], then length one), i8 or u8.  A vector depends on seed and id only."""
    if kind not in ("f32-unit", "i8", "u8"):
        raise ValueError(f"unknown kind {kind!r}")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids = b.column(0).to_pylist()
            rngs = (np.random.Generator(np.random.PCG64([seed, i])) for i in ids)
            if kind == "f32-unit":
                x = np.array([r.uniform(-1, 1, dims) for r in rngs]).reshape(len(ids), dims)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
            else:
                x = np.array([r.integers(*((-128, 128) if kind == "i8" else (0, 256)), dims) for r in rngs]).reshape(len(ids), dims)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x.astype("f4")), pa.list_(pa.float32()))], names=["id", "vec"])

    return spark.range(0, n, 1, parts or max(1, n // 100_000)).mapInArrow(run, "id long, vec array<float>")


class PostingBlock:
    """Sorted ids and fixed-size vectors as one value: all ids (i64), then all vectors."""

    def __init__(self, width: int, data: bytes = b"") -> None:
        if len(data) % (8 + width):
            raise ValueError("length does not fit the vector size")
        self.width, n = width, len(data) // (8 + width)
        ids = np.frombuffer(data, "<i8", n).tolist()
        self.rows = {i: data[8 * n + k * width : 8 * n + (k + 1) * width] for k, i in enumerate(ids)}
        self.base, self.dirty = data, False

    def get(self, id_: int) -> bytes | None:
        return self.rows.get(id_)

    def insert(self, id_: int, vec: bytes) -> bytes | None:
        """Add or replace; the replaced value."""
        if len(vec) != self.width:
            raise ValueError("wrong vector size")
        old, self.rows[id_], self.dirty = self.rows.get(id_), vec, True
        return old

    def remove(self, id_: int) -> bytes | None:
        old = self.rows.pop(id_, None)
        self.dirty |= old is not None
        return old

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        return iter(sorted(self.rows.items()))

    def __len__(self) -> int:
        return len(self.rows)

    def serialize(self) -> bytes:
        if not self.dirty:
            return self.base
        return np.array(sorted(self.rows), "<i8").tobytes() + b"".join(v for _, v in self)


def posting_blocks(postings: DataFrame, rows: int = 512) -> DataFrame:
    """centroid_id, id, code as blocks of at most `rows` ids: centroid_id, block, data.  No list lands in one row."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("centroid_id").orderBy("id"))
    b = postings.withColumn("block", F.floor((n - 1) / rows).cast("int")).groupBy("centroid_id", "block")
    listed = F.array_sort(F.collect_list(F.struct("id", "code")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for x in batches:
            data = []
            for items in x.column(2).to_pylist():
                data.append(np.array([i["id"] for i in items], "<i8").tobytes() + b"".join(i["code"] for i in items))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(data, pa.binary())], names=["centroid_id", "block", "data"])

    return b.agg(listed.alias("items")).mapInArrow(run, "centroid_id long, block int, data binary")


def encode_edges(edges: Iterable[int]) -> bytes:
    """Sorted, delta-coded signed LEB128."""
    out, last = bytearray(), 0
    for e in sorted(edges):
        v, last = e - last, e
        while True:
            b, v = v & 0x7F, v >> 7
            done = (v == 0 and not b & 0x40) or (v == -1 and b & 0x40)
            out.append(b if done else b | 0x80)
            if done:
                break
    return bytes(out)


def decode_edges(data: bytes) -> list[int]:
    out, value, shift, last = [], 0, 0, 0
    for b in data:
        value |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            last += value - (1 << shift) if b & 0x40 else value
            out.append(last)
            value = shift = 0
    return out
