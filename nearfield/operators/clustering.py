"""k-means and its relatives, always by squared Euclidean distance.

Assignment and the sums of an update run on the cluster; centroids are small by design and live on the driver.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.similarity import block
from nearfield.operators.exact import left_to_right
from nearfield.plans.blocks import matrix


@dataclass(frozen=True)
class KMeansParams:
    iters: int = 15
    epsilon: float = 1e-4
    init: str = "random"  # or plusplus
    seed: int = 42


class NotConverged(RuntimeError):
    """Carries the centroids reached."""

    def __init__(self, centroids: np.ndarray) -> None:
        super().__init__("k-means did not converge")
        self.centroids = centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid of each row (the lowest on a tie) and the distance."""
    d = block(x.astype(np.float64), centroids.astype(np.float64))
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def nearest_exactly(x: np.ndarray, centroids: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The same by distances summed from left to right: those that rounding leaves in question are computed again."""
    at, best = np.empty(len(x), np.int64), np.empty(len(x))
    c = centroids.astype(np.float64)
    size = np.square(c).sum(1).max(initial=0)
    for s in range(0, len(x), rows):
        part = x[s : s + rows].astype(np.float64)
        d = block(part, c)
        off = 1e-13 * (part.shape[1] + 8) * (np.square(part).sum(1) + size)
        i, j = np.nonzero(d <= (d.min(1) + off)[:, None])
        e = left_to_right(part, c, i, j, "l2")
        order = np.lexsort((j, e, i))
        first = order[np.searchsorted(i[order], np.arange(len(part)))]
        at[s : s + rows], best[s : s + rows] = j[first], e[first]
    return at, best


def assign(vecs: DataFrame, ids: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """vecs: id, vec.  id, centroid_id, distance."""
    shared = vecs.sparkSession.sparkContext.broadcast((np.asarray(ids), np.asarray(centroids)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cid, c = shared.value
        for b in batches:
            if b.num_rows:
                at, d = nearest_exactly(matrix(b.column(1)), c)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cid[at].astype(np.int64)), pa.array(d)], names=["id", "centroid_id", "distance"])

    return vecs.select("id", "vec").mapInArrow(run, "id long, centroid_id long, distance double")


def mean_vector(vecs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Mean of each component (by group): [group,] pos, mean."""
    group = group or []
    return vecs.select(*group, F.posexplode("vec").alias("pos", "x")).groupBy(*group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def update(vecs: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and counts of the rows nearest to each centroid: one partial sum a task is what is shuffled."""
    shared = vecs.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = shared.value
        total, count = np.zeros(c.shape), np.zeros(len(c), np.int64)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                at, _ = nearest(x, c)
                np.add.at(total, at, x)
                count += np.bincount(at, minlength=len(c))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["c", "n", "s"])

    parts = vecs.select("vec").mapInArrow(run, "c long, n long, s array<double>")
    flat = parts.select("c", "n", F.posexplode("s").alias("pos", "x")).groupBy("c", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    means, counts = centroids.astype(np.float64).copy(), np.zeros(len(centroids), np.int64)
    for r in flat.collect():
        means[r["c"], r["pos"]] = r["x"] / r["n"]
        counts[r["c"]] = r["n"]
    return means, counts


def initial(vecs: DataFrame, k: int, params: KMeansParams = KMeansParams(), sample: int = 20_000) -> np.ndarray:
    """Rows to start from: k first by seeded hash, or k-means++ on a bounded sample in that order."""
    n = k if params.init == "random" else max(k, sample)
    rows = vecs.select("id", "vec").orderBy(F.xxhash64(F.lit(params.seed), "id"), "id").limit(n).collect()
    x = np.array([r["vec"] for r in rows], np.float64)
    return x if params.init == "random" else plusplus(x, k, np.random.default_rng(params.seed))


def plusplus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    picked = [int(rng.integers(len(x)))]
    d = block(x, x[picked])[:, 0]
    while len(picked) < min(k, len(x)):
        total = d.sum()
        i = int(rng.choice(len(x), p=d / total)) if total > 0 else next(i for i in range(len(x)) if i not in picked)
        picked.append(i)
        d = np.minimum(d, block(x, x[i : i + 1])[:, 0])
    return x[picked]


def kmeans(vecs: DataFrame, k: int, params: KMeansParams = KMeansParams(), start: np.ndarray | None = None) -> np.ndarray:
    """Lloyd's algorithm.  Like its model it returns the centroids before the last, converged update."""
    c = initial(vecs, k, params) if start is None else start
    rng = np.random.default_rng(params.seed)
    for _ in range(params.iters):
        new, counts = update(vecs, c)
        for i in np.flatnonzero(counts == 0):
            new[i] = initial(vecs, 1, KMeansParams(seed=int(rng.integers(2**31))))[0]
        if np.square(new - c).sum(1).max(initial=0) < params.epsilon:
            return c
        c = new
    raise NotConverged(c)


def local_kmeans(x: np.ndarray, k: int, params: KMeansParams) -> np.ndarray:
    """Lloyd on rows that fit in memory; the last centroids even if they have not settled."""
    rng = np.random.default_rng(params.seed)
    c = plusplus(x, k, rng) if params.init == "plusplus" else x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(params.iters):
        at, _ = nearest(x, c)
        new = np.zeros_like(c)
        np.add.at(new, at, x)
        n = np.bincount(at, minlength=len(c))
        new = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(c))])
        if np.square(new - c).sum(1).max() < params.epsilon:
            return c
        c = new
    return c


def binary_partition(x: np.ndarray, least: int, iters: int, rng: np.random.Generator) -> np.ndarray:
    """Two centroids that part x, with at least `least` rows on each side wherever rows differ there.

    2-means gives a direction and a border.  If a side has too few rows, the border moves along that direction to the
    nearest place that leaves enough, and the centroids are set out at equal distances from it, so that being nearest to
    one of them is being on its side of the border.
    """
    n = len(x)
    pair = local_kmeans(x, 2, KMeansParams(iters=max(1, iters), init="plusplus", seed=int(rng.integers(2**31))))
    if len(pair) < 2 or not np.abs(pair[1] - pair[0]).max() > 0:  # equal rows: no border parts them
        return np.stack([x[: n // 2].mean(0), x[n // 2 :].mean(0)]) if n > 1 else np.repeat(x, 2, 0)
    sides = np.bincount(nearest(x, pair)[0], minlength=2)
    if sides.min() >= least:
        return pair
    along = pair[1] - pair[0]
    along = along / np.sqrt(along @ along)
    t = np.sort(x @ along)
    steps = np.flatnonzero(np.diff(t) > 1e-12 * max(1.0, np.abs(t).max())) + 1  # rows before a possible border
    if not len(steps):
        return pair
    short = np.maximum(0, least - np.minimum(steps, n - steps))  # rows that the smaller side lacks
    cut = int(steps[np.lexsort((np.abs(steps - sides[0]), short))[0]])
    border, reach = (t[cut - 1] + t[cut]) / 2, (t[cut:].mean() - t[:cut].mean()) / 2
    middle = x.mean(0)
    middle = middle + (border - middle @ along) * along
    return np.stack([middle - reach * along, middle + reach * along])


def prune_small(x: np.ndarray, c: np.ndarray, least: int) -> np.ndarray:
    """Take away the smallest centroid until none has under `least` rows; one always stays."""
    while len(c) > 1:
        n = np.bincount(nearest(x, c)[0], minlength=len(c))
        if n.min() >= least:
            break
        c = np.delete(c, int(n.argmin()), axis=0)
    return c


#: Children of a node and sampled rows that choose them.
BRANCH, SAMPLE = 64, 4096


class Tree:
    """Nodes of a hierarchical clustering; a row belongs to the leaf that it comes to by its nearest child each time."""

    def __init__(self, root: np.ndarray) -> None:
        self.at = [root]  # centroid of a node
        self.children: dict[int, np.ndarray] = {}

    def split(self, node: int, new: np.ndarray) -> None:
        self.children[node] = np.arange(len(self.at), len(self.at) + len(new))
        self.at += list(new)

    def leaves(self) -> list[int]:
        return [n for n in range(len(self.at)) if n not in self.children]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        todo = np.arange(len(x))
        while len(todo):
            todo = todo[np.isin(node[todo], list(self.children))] if self.children else todo[:0]
            order = todo[np.argsort(node[todo], kind="stable")]
            for rows in np.split(order, np.flatnonzero(np.diff(node[order])) + 1) if len(order) else ():
                own = self.children[int(node[rows[0]])]
                node[rows] = own[nearest(x[rows], np.stack([self.at[c] for c in own]))[0]]
        return node


def hierarchical(vecs: DataFrame, least: int, most: int, params: KMeansParams = KMeansParams(), branch: int = BRANCH, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of clusters of about `least` to `most` rows.

    Each round is one scan that counts the leaves of the tree so far, and one that splits every leaf that is too large into
    at most `branch` children, chosen in a task of its own from about `sample` of its rows (in seeded hash order), so that
    no task grows with the table.  A leaf of equal rows can't be split; a warning says how many such are over the bound.
    """
    spark, seed = vecs.sparkSession, params.seed
    root = [r["mean"] for r in mean_vector(vecs).orderBy("pos").collect()]
    if not root:
        return np.empty((0, 0))
    tree, stuck = Tree(np.array(root)), set()
    for turn in itertools.count():
        shared = spark.sparkContext.broadcast(tree)

        def place(batches: Iterator, shared=shared) -> Iterator:  # noqa: ANN001
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.leaf_of(matrix(b.column(1), "f8")))], names=["id", "vec", "node"])

        placed = vecs.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).mapInArrow(place, "id long, vec array<float>, node long")
        sizes = {r["node"]: r["n"] for r in placed.groupBy("node").agg(F.count("*").alias("n")).collect()}
        over = {c: n for c, n in sizes.items() if n > most and c not in stuck}
        if not over:
            break
        about = spark.createDataFrame([(c, min(branch, -(-n // most)), min(1.0, sample / n)) for c, n in over.items()], "node long, k int, share double")
        unit = F.pmod(F.xxhash64(F.lit(seed + turn), "id"), F.lit(1 << 30)) / float(1 << 30)
        rows = placed.join(about, "node").where(unit < F.col("share"))

        def choose(t):  # noqa: ANN001, ANN202
            import pyarrow as pa

            t = t.sort_by("id")
            x, k, c = matrix(t.column("vec"), "f8"), t.column("k")[0].as_py(), t.column("node")[0].as_py()
            low = max(1, int(least * t.column("share")[0].as_py()))
            new = x[:0]
            if k > 2:
                new = prune_small(x, local_kmeans(x, min(k, len(x)), params), low)
            if len(new) < 2 and len(x) > 1:
                new = binary_partition(x, min(low, len(x) // 2), 100, np.random.default_rng([seed, c]))
            new = np.unique(new, axis=0)
            return pa.table({"node": pa.array([c] * len(new), pa.int64()), "vec": pa.array([list(r) for r in new], pa.list_(pa.float64()))})

        fresh: dict[int, list] = {}
        for r in rows.groupBy("node").applyInArrow(choose, "node long, vec array<double>").collect():
            fresh.setdefault(r["node"], []).append(r["vec"])
        for c in sorted(over):
            new = np.array(sorted(fresh.get(c, ())))
            if len(new) > 1:
                tree.split(c, new)
            else:
                stuck.add(c)
    if stuck:
        warnings.warn(f"{len(stuck)} clusters over {most} rows can't be split", stacklevel=2)
    return np.unique(np.array([tree.at[c] for c in tree.leaves() if c in sizes]).astype(np.float32), axis=0)
