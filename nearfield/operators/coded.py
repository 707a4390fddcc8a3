"""Search on coded vectors, and rotation of vector frames."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.coding import Coding, coding
from nearfield.functions.rotation import Rotation
from nearfield.functions.similarity import distance
from nearfield.operators import exact
from nearfield.plans.blocks import against_all, codes, matrix
from nearfield.plans.durable import durable
from nearfield.plans.topk import top_k

#: Queries and codes scored at once; what waits to be merged into the k of QS queries.
QS, ROWS, WAITING = 256, 1024, 1 << 18


def encode(vecs: DataFrame, name: str, dims: int, similarity: str = "l2", center: list[float] | None = None) -> DataFrame:
    """vecs: id, vec.  id and code (binary)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = coding(name, dims, similarity, center)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                rows = np.concatenate([c.encode(x[at : at + ROWS]) for at in range(0, len(x), ROWS)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "code"])

    return vecs.select("id", "vec").mapInArrow(run, "id long, code binary")


def decode(coded: DataFrame, name: str, dims: int, similarity: str = "l2", center: list[float] | None = None) -> DataFrame:
    """coded: id, code.  id and vec."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = coding(name, dims, similarity, center)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(c.decode(codes(b.column(1)))), pa.list_(pa.float32()))], names=["id", "vec"])

    return coded.select("id", "code").mapInArrow(run, "id long, vec array<float>")


def rotate(vecs: DataFrame, dims: int, seed: int = 42, back: bool = False) -> DataFrame:
    """vecs: id, vec.  The same, rotated (or rotated back)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        r = Rotation(dims, seed)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(r.backward(x) if back else r.forward(x)), pa.list_(pa.float32()))], names=["id", "vec"])

    return vecs.select("id", "vec").mapInArrow(run, "id long, vec array<float>")


class Nearest:
    """The k nearest codes of all added so far, and how many were scored in full, for each of some queries.

    Distances are made for QS queries and ROWS codes at once, and only those no farther than the k-th found wait (at most
    WAITING, or one block's) to be merged, so that memory is that of the k of every query and little more.
    """

    def __init__(self, qid: np.ndarray, qs: np.ndarray, k: int, coder: Coding, symmetric: bool, self_free: bool) -> None:
        self.qid, self.k, self.coder, self.self_free = qid, k, coder, self_free
        self.parts = [slice(at, min(at + QS, len(qid))) for at in range(0, len(qid), QS)]
        self.symmetric = symmetric
        self.ready = [coder.encode(qs[p]) if symmetric else coder.ready(qs[p]) for p in self.parts]
        self.best = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)) for _ in self.parts]
        self.waiting: list[list] = [[] for _ in self.parts]
        self.most = np.full(len(qid), np.inf)  # the k-th found; no code beyond is among the k
        self.looked = np.zeros(len(qid), np.int64)

    def add(self, ids: np.ndarray, column: Any) -> None:  # noqa: ANN401
        rows = codes(column)
        useful = self.most.copy()
        for at in range(0, len(rows), ROWS):
            some, own = rows[at : at + ROWS], ids[at : at + ROWS]
            opened = None if self.symmetric else self.coder.opened(some)
            for n, (p, q) in enumerate(zip(self.parts, self.ready, strict=True)):
                d, looked = (self.coder.symmetric(q, some), None) if self.symmetric else self.coder.limited(q, opened, useful[p])
                self.looked[p] += len(some) if looked is None else looked.sum(1)
                if self.self_free:
                    d[self.qid[p, None] == own] = np.inf
                if np.isinf(self.most[p]).any() and len(some) >= self.k:
                    self.most[p] = np.fmin(self.most[p], np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
                i, j = np.nonzero(np.isfinite(d) & (d <= self.most[p, None]))
                self.waiting[n].append((i, d[i, j], own[j]))
                if sum(len(w[0]) for w in self.waiting[n]) > WAITING:
                    self._merge(n)
        for n in range(len(self.parts)):
            self._merge(n)

    def _merge(self, n: int) -> None:
        if not self.waiting[n]:
            return
        p = self.parts[n]
        self.best[n] = q, d, _ = exact.first(*(np.concatenate(x) for x in zip(self.best[n], *self.waiting[n], strict=True)), self.k)
        self.waiting[n] = []
        full = np.flatnonzero(np.bincount(q, minlength=p.stop - p.start) == self.k)
        self.most[p][full] = d[np.searchsorted(q, full, "right") - 1]

    def rows(self) -> Any:  # noqa: ANN401
        import pyarrow as pa

        q = np.concatenate([b[0] + p.start for b, p in zip(self.best, self.parts, strict=True)] or [np.empty(0, np.int64)])
        d, i = (np.concatenate([b[n] for b in self.best] or [np.empty(0)]) for n in (1, 2))
        head = np.diff(q, prepend=-1) > 0
        return pa.table([pa.array(self.qid[q]), pa.array(i.astype(np.int64)), pa.array(d), pa.array(np.where(head, self.looked[q], 0))], names=["qid", "id", "distance", "looked"])


def search(queries: DataFrame, coded: DataFrame, k: int, name: str, dims: int, similarity: str = "l2", center: list[float] | None = None, symmetric: bool = False, self_free: bool = False) -> DataFrame:
    """queries: id, vec; coded: id, code.  qid, rank, id, distance (of the code), and looked (documents scored in full).

    Within a task the k-th best distance so far bounds what codings with a cheap first estimate look at in full.
    """
    make = lambda ids, q: Nearest(ids, q, k, coding(name, dims, similarity, center), symmetric, self_free)
    parts = against_all(queries, coded, "code", make, "qid long, id long, distance double, looked long")
    total = parts.withColumn("looked", F.sum("looked").over(Window.partitionBy("qid")))
    return top_k(total, k).select("qid", "rank", "id", "distance", "looked")


def nearest(queries: DataFrame, docs: DataFrame, k: int, n: int, name: str, dims: int, similarity: str = "l2") -> DataFrame:
    """queries, docs: id, vec.  The k nearest docs, found by codes and proven by vectors: qid, rank, id, distance.

    The n nearest by codes are ranked by the vectors, and the k-th distance of these is one that the true k-th can't exceed.
    How many codes would be enough depends on the table, so a check of all vectors within that distance adds what the codes
    have put too far.
    """
    found = rerank(search(queries, encode(docs, name, dims, similarity), n, name, dims, similarity), queries, docs, n, k, similarity)
    bound = found.where(F.col("rank") == k).select(F.col("qid").alias("id"), F.col("distance").alias("most"))
    bound = durable(queries.select("id", "vec").join(bound, "id", "left"), "bound")
    return exact.search(bound, docs, k, similarity, most="most")


def rerank(found: DataFrame, queries: DataFrame, docs: DataFrame, n: int, k: int | None = None, similarity: str = "l2") -> DataFrame:
    """The first n of each query's results again by exact distance, cut to k: qid, rank, id, distance."""
    few = found.where(F.col("rank") <= n).select("qid", "id")
    few = few.join(queries.select(F.col("id").alias("qid"), F.col("vec").alias("q")), "qid").join(docs.select("id", "vec"), "id")
    return top_k(few.select("qid", "id", distance("q", "vec", similarity).alias("distance")), min(n, k or n)).select("qid", "rank", "id", "distance")
