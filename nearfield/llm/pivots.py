"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots), chosen farthest first from a sample of the vectors after its mean is taken off, describe each
vector by its nearest pivots in order; the leading ones, as many as the fit asks for, are its description.  Two vectors
are candidates if they share at least `shared` of these.  Inverted lists by (label, pivot) bring candidates together: a
vector is posted under its rarest pivots only, as vectors that share so many must share one of those too.  A list
holds descriptions, not vectors; vectors are fetched only for rows that have a candidate in their list, and every
candidate is verified by cosine in double precision.  A pair is looked at only in the list of its first shared posting.

The fit: pivots grow with the root of the number of vectors, within a bound of bytes.  How many pivots describe a
vector and how many must be shared is measured on the sample: its vectors are turned to exactly the cosine asked for,
towards noise and towards each other, and RECALL of these pairs must share enough.

Equal vectors are one representative with a count.  Long lists are cut into blocks and each pair of blocks is a task
of its own; a block gives link counts and a spanning set of links, never all pairs.

Defined results: every row of the input is a vector of its own and gives one row.  Vectors that are null, empty, zero, or
hold null or non-finite components, and those with a null label, link with nothing; vectors of different lengths never
link.  Rows with a null or a repeated vec_id are compared like all others (equal rows link with each other);
component_id is the smallest id that isn't null, and null where a component has none.  No rows, no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import components, durable

#: Least rows of the sample (it is twice the pivots beyond that), most pivots and most of their bytes, pivots for each
#: root of the vectors, lengths of a description that are tried, share of turned pairs to keep, and rows of a block.
SAMPLE, PIVOTS, PIVOT_BYTES, PER_ROOT, NEAREST, RECALL, BLOCK = 2048, 8192, 64 << 20, 4, (16, 32), 0.995, 512


class Index:
    """Mean, pivots, order of pivots from rare to frequent, length of a description, and pivots that must be shared."""

    def __init__(self, mean: np.ndarray, pivots: np.ndarray, rank: np.ndarray, nearest: int, shared: int) -> None:
        self.mean, self.pivots, self.rank, self.nearest, self.shared = mean, pivots, rank, nearest, shared

    def near(self, x: np.ndarray, k: int | None = None) -> np.ndarray:
        """The k nearest pivots of unit rows, nearest first."""
        k = min(k or self.nearest, len(self.pivots))
        y = centred(x, self.mean)
        cos = y.astype(np.float32) @ self.pivots.T
        top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(cos, top, 1), axis=1, kind="stable"), 1)

    def described(self, x: np.ndarray) -> np.ndarray:
        """Ranks of the nearest pivots, rare ones first."""
        return np.sort(self.rank[self.near(x)], axis=1).astype(np.int32)

    @property
    def posted(self) -> int:
        return min(self.nearest, len(self.pivots)) - self.shared + 1


def units(rows: np.ndarray) -> np.ndarray:
    scale = np.abs(rows).max(1, keepdims=True)
    rows = rows / scale
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Unit rows of x without the mean; a row at the mean itself is zero."""
    y = x - mean
    size = np.sqrt((y * y).sum(1, keepdims=True))
    return np.divide(y, size, out=np.zeros_like(y), where=size > 1e-12)


def farthest_first(rows: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` rows, each the farthest from those before it; equal rows once, and zero rows only if all are."""
    rows = rows[rows.any(1)] if rows.any() else rows[:1]
    kept, worst = [0], rows @ rows[0]
    while len(kept) < min(most, len(rows)):
        i = int(worst.argmin())
        if worst[i] > 1 - 1e-6:
            break
        kept.append(i)
        worst = np.maximum(worst, rows @ rows[i])
    return rows[kept]


def turned(x: np.ndarray, towards: np.ndarray, cosine: float) -> np.ndarray:
    """Unit rows at the given cosine from x, in the direction of the other rows."""
    side = towards - (towards * x).sum(1, keepdims=True) * x
    size = np.sqrt((side * side).sum(1, keepdims=True))
    return cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * np.divide(side, size, out=np.zeros_like(side), where=size > 1e-12)


def fit(sample: np.ndarray, total: int, cosine: float, seed: int = 4) -> Index:
    """sample: distinct vectors of one length; total: how many there are in all."""
    x = units(sample)
    most = max(1, min(math.ceil(PER_ROOT * math.sqrt(total)), PIVOTS, PIVOT_BYTES // (4 * x.shape[1]), len(x)))
    mean = x.mean(0)
    p = farthest_first(centred(x, mean).astype(np.float32), most)
    index = Index(mean, p, np.arange(len(p)), 1, 1)
    rng = np.random.default_rng(seed)
    some = x[rng.permutation(len(x))[:2048]]
    ends = [turned(some, rng.normal(size=some.shape), cosine), turned(some, some[rng.permutation(len(some))], cosine)]
    own, others = index.near(some, max(NEAREST)), [index.near(e, max(NEAREST)) for e in ends]
    for k in NEAREST:
        shared = [(own[:, :k, None] == o[:, None, :k]).sum((1, 2)) for o in others]
        index.nearest = min(k, len(p))
        index.shared = int(max(1, min(np.quantile(s, 1 - RECALL, method="lower") for s in shared)))
        if index.shared > 1:
            break
    often = np.bincount(index.near(x).ravel(), minlength=len(p))
    index.rank = np.argsort(np.argsort(often, kind="stable"), kind="stable")
    return index


def fitted(good: DataFrame, cosine: float) -> dict[int, Index]:
    """good: h, vec.  An index for every vector length of the sample: the distinct vectors first by hash.

    A length that the sample lacks is rare, and its vectors go to one list.  Only sample rows reach the driver.
    """
    total = good.count()
    most = max(SAMPLE, 2 * min(PIVOTS, math.ceil(PER_ROOT * math.sqrt(total))))
    last = good.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return {}
    rows = good.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("vec").alias("vec")).orderBy("h").toArrow().column("vec")
    lengths = np.array(rows.combine_chunks().value_lengths())
    flat = rows.combine_chunks().flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths).tolist():
        at = starts[lengths == n]
        x = flat[at[:, None] + np.arange(n)]
        out[n] = fit(x, math.ceil(total * len(x) / len(lengths)), cosine)
    return out


def candidates(left: np.ndarray, right: np.ndarray, pivot: int, posted: int, shared: int) -> np.ndarray:
    """(row of left, row of right) -> shares enough, and `pivot` is the first posting that both have."""
    codes, at = np.unique(np.concatenate([left.ravel(), right.ravel()]), return_inverse=True)

    def marks(rows: np.ndarray, where: np.ndarray) -> np.ndarray:
        m = np.zeros((len(rows), len(codes)), np.float32)
        m[np.arange(len(rows))[:, None], where] = 1
        return m

    a, b = at[: left.size].reshape(left.shape), at[left.size :].reshape(right.shape)
    ok = marks(left, a) @ marks(right, b).T >= shared
    low = int((codes < pivot).sum())
    if low:
        ok &= marks(left, a[:, :posted])[:, :low] @ marks(right, b[:, :posted])[:, :low].T == 0
    return ok


def links(ok: np.ndarray, ids: np.ndarray, ws: np.ndarray, ids2: np.ndarray | None, ws2: np.ndarray) -> tuple[dict[int, int], set]:
    """Links by vector (with the weight of the other end), and links that join what all of ok joins.  ids2 None: one side."""
    counts: dict[int, int] = {}
    edges: set = set()
    c1, c2 = ok @ ws2, ok.T @ ws
    for i in np.flatnonzero(c1).tolist():
        counts[int(ids[i])] = counts.get(int(ids[i]), 0) + int(c1[i])
    if ids2 is not None:
        for i in np.flatnonzero(c2).tolist():
            counts[int(ids2[i])] = counts.get(int(ids2[i]), 0) + int(c2[i])
    # Spanning links: breadth first over the matrix.
    linked = np.flatnonzero(c1)
    todo = np.zeros(len(ids), bool)
    todo[linked] = True
    todo2 = c2 > 0
    for s in linked.tolist():
        if not todo[s]:
            continue
        todo[s], front = False, [(0, s)]
        while front:
            k, i = front.pop()
            if ids2 is None:
                new = np.flatnonzero(ok[i] & todo)
                todo[new] = False
                front += [(0, j) for j in new.tolist()]
                edges.update((int(ids[i]), int(ids[j])) for j in new.tolist())
                continue
            new = np.flatnonzero(ok[i] & todo2) if k == 0 else np.flatnonzero(ok[:, i] & todo)
            (todo2 if k == 0 else todo)[new] = False
            front += [(1 - k, j) for j in new.tolist()]
            edges.update((int(ids[i]), int(ids2[j])) if k == 0 else (int(ids2[i]), int(ids[j])) for j in new.tolist())
    return counts, edges


def link(vectors: DataFrame, cosine: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vectors: vec_id, embedding, label.  Returns vec_id, n_links, component_id, kept; one row for every row."""
    import pyarrow as pa

    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"))
    good = F.col("label").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(good, F.lit(False))).withColumn("h", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(4), "vec"))
    index = fitted(v.where("ok").select("h", "vec"), cosine)
    shared_index = spark.sparkContext.broadcast(index)

    def describe(batches: Iterator) -> Iterator:
        for b in batches:
            ok, vec = b.column(3).to_numpy(zero_copy_only=False), b.column(1)
            lengths = np.where(ok, np.array(vec.value_lengths().fill_null(0)), 0)
            rows: list = [(None, None)] * b.num_rows
            for n in np.unique(lengths[ok]).tolist():
                at = np.flatnonzero(lengths == n)
                x = units(vec.take(pa.array(at)).flatten().to_numpy().reshape(-1, n))
                i = shared_index.value.get(n)
                near = i.described(x) if i else np.zeros((len(x), 1), np.int32)
                for r, y, d in zip(at.tolist(), x, near, strict=True):
                    rows[r] = (y.tobytes(), d.tobytes())
            names = [f"{n}:{t}" if o else None for n, t, o in zip(lengths.tolist(), b.column(2).to_pylist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.string()), b.column(4), b.column(5), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                names=["vec_id", "list", "h", "h2", "vec", "near"],
            )

    d = v.select("vec_id", "vec", "label", "ok", "h", "h2").mapInArrow(describe, "vec_id long, list string, h long, h2 long, vec binary, near binary")
    d = durable(d.withColumn("row", F.monotonically_increasing_id()), "vec")
    reps = d.where("list is not null").groupBy("list", "h", "h2").agg(F.min("row").alias("id"), F.count("*").alias("w"), F.min("vec_id").alias("low"))
    reps = durable(reps, "reps")
    known = durable(d.where("list is not null").select(F.col("row").alias("id"), "list", "near").join(reps.select("id", "w"), "id"), "near")

    def postings(batches: Iterator) -> Iterator:
        for b in batches:
            lists = b.column(1).to_pylist()
            near = [np.frombuffer(x, np.int32) for x in b.column(2).to_pylist()]
            post = []
            for name, x in zip(lists, near, strict=True):
                i = shared_index.value.get(int(name.split(":", 1)[0]))
                post.append(x[: i.posted if i else 1])
            sizes = [len(p) for p in post]
            at = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            pivot = pa.array(np.concatenate(post) if post else np.empty(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([c.take(at) for c in b.columns] + [pivot], names=["id", "list", "near", "pivot"])

    posted = known.select("id", "list", "near").mapInArrow(postings, "id long, list string, near binary, pivot int")
    sizes = known.select("id", "list", "near").mapInArrow(postings, "id long, list string, near binary, pivot int")
    sizes = sizes.groupBy("list", "pivot").agg(F.count("*").alias("rows")).where("rows > 1")
    posted = posted.join(sizes.select("list", "pivot", F.ceil(F.col("rows") / block).cast("int").alias("n")), ["list", "pivot"])
    posted = posted.withColumn("c", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda x: F.struct(F.least(x, F.col("c")).alias("i"), F.greatest(x, F.col("c")).alias("j")))
    posted = posted.withColumn("ij", F.explode(pairs)).select("list", "pivot", "ij.i", "ij.j", "c", "id", "near")

    def sides(key: tuple, t: pa.Table) -> tuple | None:
        """Rows of both sides and which of their pairs are candidates; the same rows twice inside a block."""
        name, pivot, i, j = (k.as_py() for k in key)
        c = t.column("c").to_numpy()
        left, right = np.flatnonzero(c == i), np.flatnonzero(c == j)
        if not len(left) or not len(right):
            return None
        near = np.frombuffer(b"".join(t.column("near").to_pylist()), np.int32).reshape(t.num_rows, -1)
        known_index = shared_index.value.get(int(name.split(":", 1)[0]))
        posted, shared = (known_index.posted, known_index.shared) if known_index else (1, 1)
        ok = candidates(near[left], near[right], pivot, posted, shared)
        if i == j:
            np.fill_diagonal(ok, False)
        return left, right, ok

    def hopeful(key, t):  # noqa: ANN001, ANN202
        """Rows of a block pair that have a candidate in it."""
        found = sides(key, t)
        if found is None or not found[2].any():
            return t.slice(0, 0).select(["list", "pivot", "i", "j", "c", "id"])
        left, right, ok = found
        at = np.union1d(left[ok.any(1)], right[ok.any(0)])
        return t.take(pa.array(at)).select(["list", "pivot", "i", "j", "c", "id"])

    def compare(key, t):  # noqa: ANN001, ANN202
        counts: dict = {}
        edges: set = set()
        if found := sides(key, t):
            left, right, ok = found
            ids, w = t.column("id").to_numpy(), t.column("w").to_numpy().astype(float)
            x = np.frombuffer(b"".join(t.column("vec").to_pylist()), float).reshape(t.num_rows, -1)
            ok &= x[left] @ x[right].T >= cosine
            same = key[2] == key[3]
            counts, edges = links(ok, ids[left], w[left], None if same else ids[right], w[right])
        a, b = [*counts, *(e[0] for e in edges)], [*[None] * len(counts), *(e[1] for e in edges)]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*counts.values(), *[None] * len(edges)], pa.int64())], names=["a", "b", "n"])

    block_of = ["list", "pivot", "i", "j"]
    live = durable(posted.groupBy(*block_of).applyInArrow(hopeful, "list string, pivot int, i int, j int, c int, id long"), "hopeful")
    whole = live.join(known.select("id", "near", "w"), "id").join(d.select(F.col("row").alias("id"), "vec"), "id")
    found = durable(whole.groupBy(*block_of).applyInArrow(compare, "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    comp = durable(components(found.where("b is not null")).join(reps.select("id", "low"), "id"), "comp")
    lows = comp.groupBy("component").agg(F.min("low").alias("least"))
    comp = comp.select("id", "component").join(lows, "component").select("id", "least", F.lit(True).alias("joined"))
    linked = reps.join(counts, "id", "left").join(comp, "id", "left")
    linked = linked.select("list", "h", "h2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.when(F.col("joined"), F.col("least")).otherwise(F.col("low")).alias("component_id"))
    out = d.where("list is not null").join(linked, ["list", "h", "h2"]).select("vec_id", "n_links", "component_id")
    alone = d.where("list is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Exhaustive: what the index must find.
OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (
  SELECT vec_id AS id, vec_id AS dest FROM embeddings
  UNION
  SELECT r.id, l.b FROM r JOIN l ON r.dest = l.a),
c AS (SELECT id, min(dest) AS component_id FROM r GROUP BY id)
SELECT c.id AS vec_id, (SELECT count(*) FROM l WHERE l.a = c.id) AS n_links, component_id, c.id = component_id AS kept
FROM c
"""
