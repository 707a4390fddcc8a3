"""Exhaustive search and ground truth.

search() multiplies blocks of queries with blocks of documents in Python workers, scores every row that may be among the
k by the bound of that product again in double from left to right, keeps k of each task by (distance, id), and merges them
by a window; pairs() scores given pairs in the JVM alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import similarity as sim
from nearfield.plans.blocks import against_all, matrix
from nearfield.plans.topk import top_k

#: Blocks of queries and docs in within(), where a pair of blocks may give as many rows as it has pairs.
PAIR_BYTES = 1 << 20
FOUND = "qid long, id long, distance double"
#: Queries and rows scored at once by a matrix product; pairs scored at once in double.
QS, ROWS, PAIRS = 256, 1024, 1 << 17


def _rough(q: np.ndarray, x: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances by a product in single precision, and a bound of how far they are from those of left_to_right().

    The bound is that of a sum of n products in any order, (n + 8) * 2^-24 * |a||b|, and what may underflow.  NaN: unknown.
    """
    n = q.shape[1]
    nq, nx = (np.sqrt(np.einsum("ij,ij->i", y, y, dtype=np.float64)) for y in (q, x))
    with np.errstate(all="ignore"):
        if kind == "cos":
            q, x = (q / nq[:, None]).astype(np.float32), (x / nx[:, None]).astype(np.float32)
            size = np.ones((len(q), len(x)))
        else:
            size = nq[:, None] * nx[None, :]
        d = (q @ x.T).astype(np.float64)
        off = 1.02 * (n + 8) * 2.0**-24 * size + n * 2.0**-120
        if kind == "l2":
            d = (nq * nq)[:, None] + (nx * nx)[None, :] - 2 * d
            off = 2 * off + 8 * (n + 8) * 2.0**-53 * (nq[:, None] + nx[None, :]) ** 2
        else:
            d = (1 - d) / 2
        d[~np.isfinite(d) | ~np.isfinite(off)] = np.nan
    return d, off


def left_to_right(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """Distances of q[a] and x[b] in double, summed from left to right as similarity.distance() has them."""
    qt, xt = q.T.astype(np.float64), x.T.astype(np.float64)
    out = np.empty(len(a))
    with np.errstate(all="ignore"):
        own = [_fold(t * t) for t in (qt, xt)] if kind == "cos" else None
        for at in range(0, len(a), PAIRS):
            i, j = a[at : at + PAIRS], b[at : at + PAIRS]
            d = np.zeros(len(i))
            for u, v in zip(qt, xt, strict=True):
                d += (u[i] - v[j]) ** 2 if kind == "l2" else u[i] * v[j]
            if own:
                d /= np.sqrt(own[0][i] * own[1][j])
            out[at : at + PAIRS] = d if kind == "l2" else (1.0 - d) / 2
    return out


def _fold(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(rows.shape[1])
    for r in rows:
        out += r
    return out


def first(q: np.ndarray, d: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least of each query by (distance, id), in order."""
    order = np.lexsort((i, d, q))
    q, d, i = q[order], d[order], i[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], d[keep], i[keep]


class Nearest:
    """The k nearest of all rows added so far, for each of some queries; of rows nearer than `most` if that is given.

    Distances are made for QS queries and ROWS documents at once.
    """

    def __init__(self, qid: np.ndarray, qs: np.ndarray, k: int, kind: str, self_free: bool, most: np.ndarray | None = None) -> None:
        self.qid, self.k, self.kind, self.self_free = qid, k, kind, self_free
        self.parts = [(slice(at, min(at + QS, len(qid))), qs[at : at + QS]) for at in range(0, len(qid), QS)]
        self.best = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)) for _ in self.parts]
        self.most = np.full(len(qid), np.inf) if most is None else most.copy()  # no row beyond is among the k

    def add(self, ids: np.ndarray, column: Any) -> None:  # noqa: ANN401
        x = matrix(column)
        for at in range(0, len(x), ROWS):
            for n, (p, qs) in enumerate(self.parts):
                self._add(n, self.qid[p], qs, self.most[p], x[at : at + ROWS], ids[at : at + ROWS])

    def _add(self, n: int, qid: np.ndarray, qs: np.ndarray, most: np.ndarray, part: np.ndarray, own: np.ndarray) -> None:
        k = self.k
        d, off = _rough(qs, part, self.kind)
        free = qid[:, None] != own[None, :] if self.self_free else np.ones(d.shape, bool)
        if len(part) >= k:
            high = np.where(free & ~np.isnan(d), d + off, np.inf)
            most[:] = np.minimum(most, np.partition(high, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(free & ~(d - off > most[:, None]))
        self.best[n] = best = first(*(np.concatenate(y) for y in zip(self.best[n], (i, left_to_right(qs, part, i, j, self.kind), own[j]), strict=True)), k)
        full = np.flatnonzero(np.bincount(best[0], minlength=len(qid)) == k)
        most[full] = np.fmin(most[full], best[1][np.searchsorted(best[0], full, "right") - 1])

    def rows(self) -> Any:  # noqa: ANN401
        import pyarrow as pa

        q = np.concatenate([b[0] + p.start for b, (p, _) in zip(self.best, self.parts, strict=True)] or [np.empty(0, np.int64)])
        d, i = (np.concatenate([b[n] for b in self.best] or [np.empty(0)]) for n in (1, 2))
        return pa.table([pa.array(self.qid[q]), pa.array(i.astype(np.int64)), pa.array(d)], names=["qid", "id", "distance"])


class Within:
    """All rows nearer than `most`, given block by block, for each of some queries."""

    def __init__(self, qid: np.ndarray, qs: np.ndarray, most: float, kind: str) -> None:
        self.qid, self.qs, self.most, self.kind = qid, qs, most, kind

    def add(self, ids: np.ndarray, column: Any) -> Iterator:  # noqa: ANN401
        x = matrix(column)
        for at in range(0, len(x), ROWS):
            for to in range(0, len(self.qid), QS):
                qs, part = self.qs[to : to + QS], x[at : at + ROWS]
                d, off = _rough(qs, part, self.kind)
                i, j = np.nonzero(~(d - off >= self.most))
                d = left_to_right(qs, part, i, j, self.kind)
                near = d < self.most
                yield self._table(to + i[near], ids[at + j[near]], d[near])

    def _table(self, i: np.ndarray, ids: np.ndarray, d: np.ndarray) -> Any:  # noqa: ANN401
        import pyarrow as pa

        return pa.table([pa.array(self.qid[i]), pa.array(ids), pa.array(d)], names=["qid", "id", "distance"])

    def rows(self) -> Any:  # noqa: ANN401
        return self._table(*[np.empty(0, np.int64)] * 2, np.empty(0))


def search(queries: DataFrame, docs: DataFrame, k: int, similarity: str = "l2", self_free: bool = False, most: str | None = None) -> DataFrame:
    """queries, docs: id, vec.  The k nearest docs of each query: qid, rank, id, distance.

    Equal distances go by id.  self_free leaves out the doc with the query's own id.  most: column of queries with a
    distance that the k-th is known not to exceed (null: unknown); docs beyond need not be looked at.
    """
    kind = sim.parse(similarity)
    found = against_all(queries, docs, "vec", lambda ids, q, *bound: Nearest(ids, q, k, kind, self_free, *bound), FOUND, more=most)
    return top_k(found, k).select("qid", "rank", "id", "distance")


def pairs(queries: DataFrame, docs: DataFrame, similarity: str = "l2", on: Column | None = None) -> DataFrame:
    """qid, id, distance of all pairs that meet `on`, in the JVM.  Spark sends the smaller side to every task if it fits."""
    q = queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), *[F.col(c).alias(f"q_{c}") for c in queries.columns if c not in ("id", "vec")])
    joined = q.join(docs, on) if on is not None else q.crossJoin(docs)
    return joined.withColumn("distance", sim.distance("qvec", "vec", similarity)).drop("qvec", "vec")


def ground_truth(queries: DataFrame, docs: DataFrame, k: int, similarity: str = "l2") -> DataFrame:
    """Nearest docs of each query with its own id left out: qid, rank, id, distance."""
    return search(queries, docs, k, similarity, self_free=True)


def within(queries: DataFrame, docs: DataFrame, most: float, similarity: str = "l2") -> DataFrame:
    """All docs nearer than `most`: qid, id, distance.

    A matrix product rules out what its rounding bound allows, and the rest is scored again in double, from left to right.
    Pairs leave a task block by block, so that their number is bounded by disk only.
    """
    kind = sim.parse(similarity)
    return against_all(queries, docs, "vec", lambda ids, q: Within(ids, q, most, kind), FOUND, block=PAIR_BYTES)


def label_vote(neighbors: DataFrame, labels: DataFrame) -> DataFrame:
    """neighbors: qid, id; labels: id, label.  The most frequent label among each query's neighbors (least on a tie)."""
    n = neighbors.join(labels, "id").groupBy("qid", "label").agg(F.count("*").alias("votes"))
    return top_k(n.withColumn("less", -F.col("votes")), 1, order=["less", "label"]).select("qid", "label", "votes")
