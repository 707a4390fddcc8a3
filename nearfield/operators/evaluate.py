"""Recall, depth, coding and distance loss."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.coding import Coding, coding
from nearfield.functions.similarity import block
from nearfield.operators.coded import QS, ROWS
from nearfield.plans.blocks import against_all, matrix
from nearfield.plans.durable import durable


def recall(results: DataFrame, truth: DataFrame, k: int, cut: bool = False) -> DataFrame:
    """qid, recall: share of the first k true neighbors among a query's results.  results, truth: qid, rank, id.

    All results count, however many there are; cut limits them to the first k as well.
    """
    t = truth.where(F.col("rank") <= k).select("qid", "id")
    r = (results.where(F.col("rank") <= k) if cut else results).select("qid", "id").distinct()
    hits = t.join(r, ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    return t.select("qid").distinct().join(hits, "qid", "left").select("qid", (F.coalesce("hits", F.lit(0)) / k).alias("recall"))


def depth(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid, depth: place of the last of the k true neighbors among the results; if one is missing, their number."""
    t = truth.where(F.col("rank") <= k).select("qid", "id", F.lit(1).alias("hit"))
    r = results.join(t, ["qid", "id"], "left").groupBy("qid")
    per = r.agg(F.count("hit").alias("n"), F.max(F.when(F.col("hit") == 1, F.col("rank"))).alias("last"), F.count("*").alias("all"))
    return per.select("qid", F.when(F.col("n") == k, F.col("last")).otherwise(F.col("all")).cast("long").alias("depth"))


def check_k(truth: DataFrame, k: int) -> None:
    width = truth.agg(F.max("rank")).first()[0] or 0
    if k > width:
        raise ValueError(f"k is {k}, but the ground truth holds {width} neighbors a query")


def summarize(recalls: DataFrame, depths: DataFrame) -> DataFrame:
    """One row: mean recall; mean, population deviation and maximum of depth."""
    return recalls.agg(F.avg("recall").alias("recall")).crossJoin(depths.agg(F.avg("depth").alias("depth"), F.stddev_pop("depth").alias("depth_stddev"), F.max("depth").alias("depth_max")))


def coding_loss(vecs: DataFrame, name: str, dims: int, center: list[float] | None = None) -> DataFrame:
    """One row: abs_error, error (sum of L2 norms), magnitude (mean norm), abs_ratio, error_ratio.  Always by Euclidean codes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = coding(name, dims, "l2", center)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                e = x.astype(np.float64) - c.decode(c.encode(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.abs(e).sum(1)), pa.array(np.sqrt(np.square(e).sum(1))), pa.array(np.abs(x).sum(1, dtype=np.float64)), pa.array(np.sqrt(np.square(x.astype(np.float64)).sum(1)))], names=["a", "e", "m", "n"])

    rows = vecs.select("vec").mapInArrow(run, "a double, e double, m double, n double")
    return rows.agg(F.sum("a").alias("abs_error"), F.sum("e").alias("error"), F.avg("n").alias("magnitude"), (F.sum("a") / F.sum("m")).alias("abs_ratio"), (F.sum("e") / F.sum("n")).alias("error_ratio"))


class Errors:
    """Sums over the errors of coded distances: of all pairs, or with `limit`, how many are within it.

    Distances are made for QS queries and ROWS documents at once.
    """

    def __init__(self, qs: np.ndarray, coder: Coding, similarity: str, quantized: bool, limit: float | None) -> None:
        self.coder, self.similarity, self.quantized, self.limit = coder, similarity, quantized, limit
        parts = [qs[at : at + QS] for at in range(0, len(qs), QS)]
        self.parts = [(coder.encode(q) if quantized else coder.ready(q), q.astype(float)) for q in parts]
        self.n, self.absolute, self.squares, self.within = 0, 0.0, 0.0, 0

    def add(self, _: np.ndarray, column: Any) -> None:  # noqa: ANN401
        x = matrix(column)
        for at in range(0, len(x), ROWS):
            some = x[at : at + ROWS].astype(float)
            codes = self.coder.encode(x[at : at + ROWS])
            opened = None if self.quantized else self.coder.opened(codes)
            for ready, q in self.parts:
                d = self.coder.symmetric(ready, codes) if self.quantized else self.coder.score(ready, opened)
                e = np.abs(d - block(q, some, self.similarity))
                self.n, self.absolute, self.squares = self.n + e.size, self.absolute + float(e.sum()), self.squares + float(np.square(e).sum())
                if self.limit is not None:
                    self.within += int((e <= self.limit).sum())

    def rows(self) -> Any:  # noqa: ANN401
        import pyarrow as pa

        return pa.table({"n": [self.n], "absolute": [self.absolute], "squares": [self.squares], "within": [self.within]})


def distance_loss(queries: DataFrame, docs: DataFrame, name: str, dims: int, similarity: str = "l2", center: list[float] | None = None, quantized: bool = False) -> DataFrame:
    """One row over all pairs: n, mae, mse, and the share of errors within 1.96 * 2 root mean squares.

    Tasks give sums, never pairs: a first pass for the mean square, a second counts what is within.
    """

    def sums(limit: float | None) -> DataFrame:
        make = lambda _, q: Errors(q, coding(name, dims, similarity, center), similarity, quantized, limit)
        parts = against_all(queries, docs, "vec", make, "n long, absolute double, squares double, within long")
        return parts.agg(F.sum("n").alias("n"), F.sum("absolute").alias("absolute"), F.sum("squares").alias("squares"), F.sum("within").alias("within"))

    first = sums(None).first()
    if not first["n"]:
        return queries.sparkSession.createDataFrame([(0, None, None, None)], "n long, mae double, mse double, within double")
    mse = first["squares"] / first["n"]
    return sums(1.96 * 2 * mse**0.5).select("n", (F.col("absolute") / F.col("n")).alias("mae"), F.lit(mse).alias("mse"), (F.col("within") / F.col("n")).alias("within"))


def coding_recall(queries: DataFrame, docs: DataFrame, truth: DataFrame, k: int, k_mult: int, name: str, dims: int, similarity: str = "l2", centers: int = 0) -> DataFrame:
    """Recall of an exhaustive search on codes that returns k * k_mult: one row of recall, depth and looked.

    centers: 0 none, 1 the mean, more: k-means centroids, every vector coded around its nearest.
    """
    from nearfield.operators.clustering import KMeansParams, NotConverged, assign, kmeans, mean_vector
    from nearfield.operators.coded import encode, search
    from nearfield.plans.topk import top_k

    if centers <= 1:
        center = [r["mean"] for r in mean_vector(docs).orderBy("pos").collect()] if centers else None
        found = search(queries, encode(docs, name, dims, similarity, center), k * k_mult, name, dims, similarity, center)
    else:
        try:
            c = kmeans(docs, centers, KMeansParams())
        except NotConverged as e:
            c = e.centroids
        at, found = assign(docs, np.arange(len(c)), c), None
        for i, v in enumerate(c):
            own = docs.join(at.where(F.col("centroid_id") == i), "id").select("id", "vec")
            part = search(queries, encode(own, name, dims, similarity, list(v)), k * k_mult, name, dims, similarity, list(v))
            found = part if found is None else found.union(part)
        found = top_k(found.drop("rank"), k * k_mult)
    r, d = recall(found, truth, k), depth(found, truth, k)
    return summarize(r, d).crossJoin(found.select("qid", "looked").distinct().agg(F.sum("looked").alias("looked")))


def search_report(stats: DataFrame) -> DataFrame:
    """One row over per-query rows with seconds, recall and any counters: count, total and greatest time, sums, mean recall."""
    sums = [F.sum(c).alias(c) for c in stats.columns if c not in ("qid", "seconds", "recall")]
    return stats.agg(F.count("*").alias("queries"), F.sum("seconds").alias("total_seconds"), F.max("seconds").alias("max_seconds"), *sums, F.avg("recall").alias("recall"))


def drive(run: Callable[[], DataFrame], truth: DataFrame | None = None, k: int = 10, warmup: int = 1, iterations: int = 1) -> list[dict]:
    """Search again and again: warm-up rounds that count for nothing, then a report of each round.

    run: a new search (qid, rank, id, and any counters, which are those of a query in each of its rows).  A report holds the
    queries, seconds and milliseconds a query of the whole round, the counters' sums over queries, and with ground truth
    recall and depth.
    """
    out = []
    for turn in range(warmup + iterations):
        began = time.perf_counter()
        found = durable(run(), "found")
        seconds = time.perf_counter() - began
        if turn < warmup:
            continue
        counters = [c for c in found.columns if c not in ("qid", "rank", "id", "distance")]
        per = found.groupBy("qid").agg(*[F.max(c).alias(c) for c in counters])
        row = per.agg(F.count("*").alias("queries"), *[F.sum(c).alias(c) for c in counters]).first().asDict()
        row |= {"iteration": turn - warmup, "seconds": round(seconds, 4), "ms_a_query": round(1000 * seconds / max(1, row["queries"]), 3)}
        if truth is not None:
            t = truth.join(found.select("qid").distinct(), "qid", "left_semi")
            row |= summarize(recall(found, t, k), depth(found, t, k)).first().asDict()
        out.append(row)
    return out
