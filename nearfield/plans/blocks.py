"""Arrow batches of vectors as numpy matrices, and small frames checked before they go to every task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Greatest size of what is sent to every task at once; of queries that are (more go by a grid of blocks), and of a block.
MOST_BYTES, QUERY_BYTES, BLOCK_BYTES = 256 << 20, 32 << 20, 32 << 20
#: Queries that a task works on at once; so many queries or more are worth dealing docs out evenly first.
QUERIES, MANY = 2048, 256


def matrix(column: Any, dtype: str = "f4") -> np.ndarray:  # noqa: ANN401
    """A list<float> column of one length as a matrix."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), dtype)


def codes(column: Any) -> np.ndarray:  # noqa: ANN401
    """A binary column of one length as rows of bytes."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1) if rows else np.empty((0, 0), np.uint8)


def collect_blocks(df: DataFrame, id_: str, vec: str, rows: int = 4096, most: int = MOST_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most `rows` vectors, in id order, one block on the driver at a time."""
    some: list = []
    held = 0
    for r in df.select(F.col(id_).cast("long"), vec).orderBy(id_).toLocalIterator(prefetchPartitions=False):
        some.append(r)
        held += 4 * len(r[1])
        if len(some) == rows or held >= most:
            yield np.array([x[0] for x in some], np.int64), np.array([x[1] for x in some], np.float32)
            some, held = [], 0
    if some:
        yield np.array([x[0] for x in some], np.int64), np.array([x[1] for x in some], np.float32)


def extent(df: DataFrame, vec: str = "vec") -> tuple[int, int]:
    """Rows, and bytes of the longest vector as floats (or of the longest code)."""
    width = F.octet_length(vec) if df.schema[vec].dataType.typeName() == "binary" else 4 * F.size(vec)
    n, most = df.agg(F.count("*"), F.max(width)).first()
    return n, most or 0


def against_all(queries: DataFrame, docs: DataFrame, vec: str, make: Callable[[np.ndarray, np.ndarray], Any], schema: str, most: int = QUERY_BYTES, block: int = BLOCK_BYTES, *, more: str | None = None) -> DataFrame:
    """Every query (id, vec) against every row of docs (id and `vec`), whatever their numbers.

    make(ids, vectors) is the state of at most QUERIES queries; its add(ids, column) takes docs (and may give Arrow tables
    at once), and rows() gives an Arrow table of `schema`.  Queries of up to `most` bytes go to every task; more of them are
    dealt to blocks, as docs are, and every pair of blocks is a task of its own: nothing but two counts reaches the driver
    then.  more: a double column of queries that make() takes as well (null: infinity).
    """
    import pyarrow as pa

    spark = docs.sparkSession
    n, width = extent(queries)

    chosen = queries.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"), *([F.coalesce(F.col(more).cast("double"), F.lit(float("inf"))).alias("more")] if more else []))

    def states(ids: np.ndarray, x: np.ndarray, *rest: np.ndarray) -> list:
        return [make(*(y[at : at + QUERIES] for y in (ids, x, *rest))) for at in range(0, len(ids), QUERIES)]

    if n * width <= most:
        t = chosen.orderBy("id").toArrow()
        shared = spark.sparkContext.broadcast((t.column(0).to_numpy(), matrix(t.column(1)), *([t.column("more").to_numpy()] if more else [])))

        def scan(batches: Iterator) -> Iterator:
            own = states(*shared.value)
            for b in batches:
                for s in own if b.num_rows else ():
                    for t in s.add(b.column(0).to_numpy(), b.column(1)) or ():
                        yield from t.to_batches()
            for s in own:
                yield from s.rows().to_batches()

        docs = docs.select("id", vec)
        return (docs.repartition(max(8, spark.sparkContext.defaultParallelism), "id") if n >= MANY else docs).mapInArrow(scan, schema)
    d, wide = extent(docs, vec)
    across, down = -(-n * width // block), max(1, -(-d * wide // block))
    at = lambda parts, name: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(name)
    every = lambda parts, name: F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)
    left = chosen.select("*", at(across, "i"), every(down, "j"))
    right = docs.select("id", F.col(vec).alias("vec"), at(down, "j"), every(across, "i"))

    def pair(q: pa.Table, x: pa.Table) -> pa.Table:
        q = q.sort_by("id")
        own = states(q.column("id").to_numpy(), matrix(q.column("vec")), *([q.column("more").to_numpy()] if more else [])) if q.num_rows else []
        out = []
        for b in x.to_batches() if own else ():
            for s in own:
                out += s.add(b.column(b.schema.get_field_index("id")).to_numpy(), b.column(b.schema.get_field_index("vec"))) or ()
        return pa.concat_tables([*out, *(s.rows() for s in own)]) if own else make(np.empty(0, np.int64), np.empty((0, 0), np.float32)).rows()

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(pair, schema)


def small(df: DataFrame, id_: str, vec: str, most: int = MOST_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """All of a frame that is small by design (centroids); larger ones are an error."""
    ids, x, held = [], [], 0
    for i, m in collect_blocks(df, id_, vec):
        held += m.nbytes
        if held > most:
            raise ValueError(f"over {most} bytes of {vec}: cluster with larger bounds, or raise the limit")
        ids.append(i)
        x.append(m)
    return (np.concatenate(ids), np.concatenate(x)) if ids else (np.empty(0, np.int64), np.empty((0, 0), np.float32))


def vectors(df: DataFrame, id_: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id LONG, vec ARRAY<FLOAT>), without rows that have no id or vector."""
    c: Column = F.col(vec).cast("array<float>")
    return df.where(F.col(id_).isNotNull() & F.col(vec).isNotNull()).select(F.col(id_).cast("long").alias("id"), c.alias("vec"))
