"""Partitioned (centroid and posting list) index: build, search, insert, rebalance.

An index is a set of frames: centroids(centroid_id, cvec), postings(centroid_id, id, code), raw(id, vec).  Counts per
centroid are derived.  Centroids are small by design and checked when they are collected; postings are not.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.coding import coding
from nearfield.functions.similarity import block
from nearfield.operators import clustering as km
from nearfield.operators.coded import Nearest, rerank
from nearfield.operators.evaluate import recall
from nearfield.operators.exact import left_to_right
from nearfield.operators.exact import search as search_exact
from nearfield.plans.blocks import matrix, small
from nearfield.plans.durable import durable
from nearfield.plans.topk import top_k


@dataclass(frozen=True)
class Config:
    dims: int
    similarity: str = "l2"
    posting_coding: str = "f32"
    rerank_coding: str | None = "f32"
    min_len: int = 192
    max_len: int = 512

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(**json.loads(text))


@dataclass
class Index:
    config: Config
    centroids: DataFrame
    postings: DataFrame
    raw: DataFrame

    def save(self, path: str) -> None:
        """Postings are written in (centroid, id) order, in files by range of centroids: selected lists prune files."""
        spark = self.postings.sparkSession
        self.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
        self.postings.repartitionByRange("centroid_id").sortWithinPartitions("centroid_id", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.raw.write.mode("overwrite").parquet(f"{path}/raw")
        spark.range(1).select(F.lit(self.config.to_json()).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        config = Config.from_json(spark.read.text(f"{path}/meta").first()[0])
        return cls(config, *[spark.read.parquet(f"{path}/{n}") for n in ("centroids", "postings", "raw")])


def empty(spark: SparkSession, config: Config) -> Index:
    """An index with one zero centroid and no vectors."""
    zero = spark.range(1).select(F.col("id").alias("centroid_id"), F.array_repeat(F.lit(0.0).cast("float"), config.dims).alias("cvec"))
    none = spark.createDataFrame([], "centroid_id long, id long, code binary")
    return Index(config, zero, none, spark.createDataFrame([], "id long, vec array<float>"))


def centroid_frame(spark: SparkSession, ids: np.ndarray, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "centroid_id long, cvec array<float>")


def listed(vecs: DataFrame, centroids: DataFrame, config: Config) -> DataFrame:
    """centroid_id, id, code of every vector (id, vec): nearest centroid and code from one pass over the vectors."""
    shared = vecs.sparkSession.sparkContext.broadcast(small(centroids, "centroid_id", "cvec"))

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        ids, c = shared.value
        coder = coding(config.posting_coding, config.dims, config.similarity)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                rows = [r.tobytes() for r in coder.encode(x)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[km.nearest_exactly(x, c)[0]]), b.column(0), pa.array(rows, pa.binary())], names=["centroid_id", "id", "code"])

    return vecs.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "centroid_id long, id long, code binary")


def fill(vecs: DataFrame, centroids: DataFrame, config: Config) -> Index:
    """Every vector to its nearest centroid, exactly."""
    return Index(config, centroids, listed(vecs, centroids, config), vecs.select("id", "vec"))


def bulk_load(vecs: DataFrame, config: Config, params: km.KMeansParams = km.KMeansParams(iters=100)) -> Index:
    """Hierarchical k-means, then assignment of every vector.  vecs: id, vec."""
    x = km.hierarchical(vecs, config.min_len, config.max_len, params=params)
    if not len(x):
        return empty(vecs.sparkSession, config)
    return fill(vecs, centroid_frame(vecs.sparkSession, np.arange(len(x)), x), config)


def stats(centroids: DataFrame, assignments: DataFrame) -> DataFrame:
    """centroid_id and count, with zeros.  assignments: centroid_id, id."""
    n = assignments.groupBy("centroid_id").agg(F.count("*").alias("n"))
    return centroids.select("centroid_id").join(n, "centroid_id", "left").select("centroid_id", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def histogram(counts: DataFrame) -> DataFrame:
    """Number of centroids by size: buckets are exact below 8, then four to a power of two.  low, high, centroids."""
    c = F.col("count")
    exp = F.floor(F.log2(c.cast("double"))).cast("int")
    step = F.call_function("shiftleft", F.lit(1).cast("long"), exp - 2)
    low = F.when(c < 8, c).otherwise(c - c % step)
    high = F.when(c < 8, c).otherwise(c - c % step + step - 1)
    return counts.groupBy(low.cast("long").alias("low"), high.cast("long").alias("high")).agg(F.count("*").alias("centroids"))


def balance(counts: DataFrame, least: int, most: int) -> DataFrame:
    """One row: centroids in, below and above the bounds, the smallest below and the largest above (lowest id on ties)."""
    c = F.col("count")
    return counts.agg(
        F.count_if(c.between(least, most)).alias("in_bounds"), F.count_if(c < least).alias("below"), F.count_if(c > most).alias("above"),
        F.min(F.when(c < least, F.struct("count", "centroid_id")))["centroid_id"].alias("smallest"),
        F.min(F.when(c > most, F.struct((-c).alias("n"), F.col("centroid_id"))))["centroid_id"].alias("largest"),
    )


def rebalance_ops(counts: DataFrame, least: int, most: int) -> DataFrame:
    """centroid_id, op (merge or split) and, for splits, two fresh ids in order of the source's."""
    op = F.when(F.col("count") < least, "merge").when(F.col("count") > most, "split")
    ops = counts.withColumn("op", op).where("op is not null")
    top = counts.agg(F.coalesce(F.max("centroid_id"), F.lit(-1)).alias("top"))
    n = F.row_number().over(Window.partitionBy("op").orderBy("centroid_id"))
    at = ops.crossJoin(F.broadcast(top)).withColumn("n", n)
    fresh = lambda k: F.when(F.col("op") == "split", F.col("top") + 2 * F.col("n") - 1 + k).cast("long")
    return at.select("centroid_id", "count", "op", fresh(0).alias("first_id"), fresh(1).alias("second_id"))


def select_centroids(queries: DataFrame, centroids: DataFrame, counts: DataFrame, top_n: int | None = None, vector_count: int | None = None, similarity: str = "l2") -> DataFrame:
    """qid, centroid_id, rank of the lists to read: the top_n nearest, or the nearest until vector_count is reached.

    The list that crosses the count is read; a centroid without a count holds none.  Centroids are scanned in batches and
    not sent around; for vector_count ever more of the nearest are looked at until every query has its count.
    """
    heads = centroids.select(F.col("centroid_id").alias("id"), F.col("cvec").alias("vec"))
    near = lambda k: search_exact(queries, heads, k, similarity).select("qid", F.col("id").alias("centroid_id"), "rank")
    if top_n is not None:
        return near(top_n)
    k, most = 16, centroids.count()
    while True:
        before = F.sum(F.coalesce("count", F.lit(0))).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
        d = near(k).join(counts, "centroid_id", "left").withColumn("before", F.coalesce(before, F.lit(0)))
        if k >= most:
            break
        reached = d.groupBy("qid").agg(F.sum("count").alias("n")).agg(F.min("n")).first()[0]
        if reached is None or reached >= vector_count:
            break
        k *= 4
    return d.where(F.col("before") < vector_count).select("qid", "centroid_id", "rank")


def parse_selector(text: str) -> dict[str, int]:
    name, _, n = text.partition(":")
    if name not in ("top_n", "vector_count") or not n.isdigit() or int(n) < 1:
        raise ValueError(f"selector {text!r}: top_n:N or vector_count:N")
    return {name: int(n)}


#: Queries of one list that a task takes.
WANTED = 20_000


def search(index: Index, queries: DataFrame, limit: int, selector: str = "top_n:8", num_rerank: int = 0) -> DataFrame:
    """queries: id, vec.  qid, rank, id, distance; lists are read once for all queries, partial top-k per list.

    A list that more than WANTED queries ask for is read by several tasks, each for a part of the queries.
    """
    cfg = index.config
    counts = stats(index.centroids, index.postings)
    chosen = select_centroids(queries, index.centroids, counts, **parse_selector(selector), similarity=cfg.similarity)
    chosen = durable(chosen.select("centroid_id", "qid"), "chosen")
    parts = chosen.groupBy("centroid_id").agg(F.ceil(F.count("*") / WANTED).cast("int").alias("parts"))
    wanted = chosen.join(parts, "centroid_id").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))
    wanted = wanted.join(queries.select(F.col("id").alias("qid"), F.col("vec").alias("q")), "qid").select("centroid_id", "part", "qid", "q")
    read = index.postings.join(parts, "centroid_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("centroid_id", "part", "id", "code")

    def score(key, left, right):  # noqa: ANN001, ANN202
        import pyarrow as pa

        c = coding(cfg.posting_coding, cfg.dims, cfg.similarity)
        best = Nearest(left.column("qid").to_numpy(), matrix(left.column("q")), limit, c, symmetric=False, self_free=False)
        for b in right.select(["id", "code"]).to_batches(max_chunksize=4096) if left.num_rows else ():
            best.add(b.column(0).to_numpy(), b.column(1))
        return best.rows().select(["qid", "id", "distance"])

    hits = wanted.groupBy("centroid_id", "part").cogroup(read.groupBy("centroid_id", "part")).applyInArrow(score, "qid long, id long, distance double")
    best = top_k(hits.groupBy("qid", "id").agg(F.min("distance").alias("distance")), limit)
    if num_rerank and cfg.rerank_coding:
        return rerank(best, queries, index.raw, num_rerank, similarity=cfg.similarity)
    return best.select("qid", "rank", "id", "distance")


def fitted_selector(index: Index, limit: int, least: float = 0.95, most: int = 64) -> str:
    """A top_n selector with which searches of `most` of the index's own vectors, picked by hash, reach that mean recall.

    Recall is measured against brute force over the whole index.  The number of lists doubles until it is reached and is then
    narrowed down to an eighth; where it never is reached, all lists are read.
    """
    picked = durable(index.raw.orderBy(F.xxhash64("id"), "id").limit(most), "picked")
    truth = durable(search_exact(picked, index.raw, limit, index.config.similarity), "truth")

    def enough(n: int) -> bool:
        got = recall(search(index, picked, limit, f"top_n:{n}"), truth, limit).agg(F.avg("recall")).first()[0]
        return got is None or got >= least

    below, n, lists = 0, 1, max(1, index.centroids.count())
    while n < lists and not enough(n):
        below, n = n, 2 * n
    n = min(n, lists)
    while n - below > max(1, n // 8):
        mid = (below + n) // 2
        below, n = (below, mid) if enough(mid) else (mid, n)
    return f"top_n:{n}"


def search_stats(index: Index, queries: DataFrame, selector: str = "top_n:8") -> DataFrame:
    """qid, postings_read, vectors_read."""
    counts = stats(index.centroids, index.postings)
    chosen = select_centroids(queries, index.centroids, counts, **parse_selector(selector), similarity=index.config.similarity)
    return chosen.join(counts, "centroid_id").groupBy("qid").agg(F.count("*").alias("postings_read"), F.sum("count").alias("vectors_read"))


def after_split(x: np.ndarray, old: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Where rows of a split list go: 0 or 1, the nearer of the pair (1 on a tie), or -1, the nearest of all survivors,
    where the old centroid is strictly nearer than both."""
    d = block(x, np.concatenate([pair, old[None]]))
    return np.where(d[:, 2] < d[:, :2].min(1), -1, np.where(d[:, 0] < d[:, 1], 0, 1))


def drawn(x: np.ndarray, own: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The nearest of the fresh centroids where it is strictly nearer than a row's own, or -1."""
    at, d = km.nearest_exactly(x, fresh)
    mine = left_to_right(x, own, np.arange(len(x)), np.arange(len(x)), "l2")
    return np.where(d < mine, at, -1)


def moves(rows: DataFrame, old: dict[int, np.ndarray], after: dict[int, np.ndarray], pairs: dict[int, tuple[int, int]], gone: set[int], fresh: list[int] | None = None) -> DataFrame:
    """rows: id, centroid_id, vec.  id and the list it goes to, for rows that change.

    old: the centroids before; after: those that remain and the fresh ones; pairs: the two fresh ids of a split list; gone:
    all lists that end; fresh: other ids than those of the pairs.  Rows of split lists go by after_split(), those of merged lists to the nearest of all, and rows
    of other lists by drawn() to a fresh centroid.
    """
    fresh = [i for p in pairs.values() for i in p] if fresh is None else fresh
    shared = rows.sparkSession.sparkContext.broadcast((old, np.array(list(after)), np.array(list(after.values()), float), fresh))

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        old_, ids, every, new = shared.value
        news = np.array([every[np.flatnonzero(ids == i)[0]] for i in new]) if new else np.empty((0, 0))
        for b in batches:
            if not b.num_rows:
                continue
            x, at = matrix(b.column(2), "f8"), b.column(1).to_numpy()
            to = at.copy()
            for c in np.unique(at).tolist():
                mine = np.flatnonzero(at == c)
                if c in pairs:
                    pair = np.stack([every[np.flatnonzero(ids == i)[0]] for i in pairs[c]])
                    side = after_split(x[mine], old_[c], pair)
                    to[mine] = np.where(side < 0, -1, np.array(pairs[c])[np.maximum(side, 0)])
                    mine = mine[side < 0]
                if c in gone:
                    if len(mine):
                        to[mine] = ids[km.nearest_exactly(x[mine], every)[0]]
                elif new:
                    side = drawn(x[mine], np.repeat(old_[c][None], len(mine), 0), news)
                    to[mine] = np.where(side < 0, c, np.array(new)[np.maximum(side, 0)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(to)], names=["id", "to"]).filter(pa.array(to != at))

    return rows.select("id", "centroid_id", "vec").mapInArrow(run, "id long, to long")


def split_reassign(vecs: DataFrame, source: int, old: np.ndarray, ids: tuple[int, int], pair: np.ndarray, others: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Where the vectors (id, vec) of one split centroid go: moves() for them alone.  id, centroid_id."""
    after = dict(zip([*ids, *others[0].tolist()], [*pair, *others[1]], strict=True))
    rows = vecs.select("id", F.lit(source).cast("long").alias("centroid_id"), "vec")
    return moves(rows, {source: old}, after, {source: ids}, {source}).select("id", F.col("to").alias("centroid_id"))


def rebalance(index: Index, passes: int = 10, nearby: int = 64, seed: int = 42) -> tuple[Index, list[dict]]:
    """Merge small and split large lists until all are in bounds or `passes` are over.  A report of each pass.

    Phases of a pass: summary; ops; split centroids; reassign the vectors of all sources and move those of lists near new
    centroids that are strictly nearer to one of those (moves()); drop the sources.  A merge is left out where no centroid
    would remain.
    """
    cfg, spark, report = index.config, index.postings.sparkSession, []
    for turn in range(passes):
        counts = stats(index.centroids, index.postings)
        ops = rebalance_ops(counts, cfg.min_len, cfg.max_len).collect()
        summary = balance(counts, cfg.min_len, cfg.max_len).first().asDict()
        report.append(summary | {"splits": sum(o["op"] == "split" for o in ops), "merges": sum(o["op"] == "merge" for o in ops)})
        if not ops:
            break
        ids, x = small(index.centroids, "centroid_id", "cvec")
        sizes = dict(zip(ids.tolist(), x, strict=True))
        splits = [o for o in ops if o["op"] == "split"]
        merges = [o["centroid_id"] for o in ops if o["op"] == "merge"]
        if not splits and len(merges) >= len(ids):
            keep = max(merges, key=lambda c: (next(o["count"] for o in ops if o["centroid_id"] == c), -c))
            merges.remove(keep)
            if not merges:
                break
        located = index.postings.select("id", "centroid_id").join(index.raw, "id")
        pairs_ = _split_pairs(located.where(F.col("centroid_id").isin([o["centroid_id"] for o in splits])), cfg.min_len, seed + turn) if splits else {}
        splits = [o for o in splits if len(pairs_.get(o["centroid_id"], ())) == 2]
        gone = set(merges) | {o["centroid_id"] for o in splits}
        if not gone:
            break
        stay = {c: v for c, v in sizes.items() if c not in gone}
        fresh = {i: v for o in splits for i, v in zip((o["first_id"], o["second_id"]), pairs_[o["centroid_id"]], strict=True)}
        after = stay | fresh
        aid, ax = np.array(list(after)), np.array(list(after.values()), np.float32)
        # What may change: the vectors of sources, and of the lists nearest to each new centroid.
        close: set[int] = set()
        if fresh and stay:
            sid, sx = np.array(list(stay)), np.array(list(stay.values()))
            d = block(np.array(list(fresh.values()), float), sx.astype(float))
            close = set(sid[np.argsort(d, 1, kind="stable")[:, :nearby]].ravel().tolist())
        touched = located.where(F.col("centroid_id").isin(sorted(gone | close)))
        old = {c: sizes[c].astype(float) for c in gone | close}
        by = {o["centroid_id"]: (o["first_id"], o["second_id"]) for o in splits}
        move = moves(touched, old, {c: np.asarray(v, float) for c, v in after.items()}, by, gone)
        postings = index.postings.join(move, "id", "left").select(F.coalesce("to", "centroid_id").alias("centroid_id"), "id", "code")
        index = replace(index, centroids=centroid_frame(spark, aid, ax), postings=durable(postings, "postings"))
    return index, report


def _split_pairs(rows: DataFrame, least: int, seed: int) -> dict[int, np.ndarray]:
    """Two centroids for each list, in parallel tasks.  rows: id, centroid_id, vec."""

    def split(t):  # noqa: ANN001, ANN202
        import pyarrow as pa

        t = t.sort_by("id")
        x, c = matrix(t.column("vec"), "f8"), t.column("centroid_id")[0].as_py()
        low = least if len(x) >= 2 * least else max(1, len(x) // 4)
        new = km.binary_partition(x, low, 100, np.random.default_rng([seed, c]))
        return pa.table({"c": pa.array([c] * len(new), pa.int64()), "n": pa.array(range(len(new)), pa.int32()), "v": pa.array([list(r) for r in new], pa.list_(pa.float64()))})

    out: dict[int, list] = {}
    for r in sorted(rows.groupBy("centroid_id").applyInArrow(split, "c long, n int, v array<double>").collect()):
        out.setdefault(r["c"], []).append(r["v"])
    return {c: np.array(v) for c, v in out.items()}


def insert(index: Index, vecs: DataFrame, overwrite: bool = False, bounds: bool = True) -> tuple[Index, list[dict]]:
    """Add vectors, then rebalance.  An id that is there already is an error, unless overwritten."""
    if vecs.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("an id is given twice")
    if not overwrite and (n := vecs.join(index.postings, "id", "left_semi").count()):
        raise ValueError(f"{n} ids are in the index already")
    old = delete(index, vecs.select("id")) if overwrite else index
    new = listed(vecs, old.centroids, old.config)
    out = replace(old, postings=old.postings.unionByName(new), raw=old.raw.unionByName(vecs.select("id", F.col("vec").cast("array<float>").alias("vec"))))
    return rebalance(out) if bounds else (out, [])


def delete(index: Index, ids: DataFrame) -> Index:
    return replace(index, postings=index.postings.join(ids.select("id"), "id", "left_anti").select("centroid_id", "id", "code"), raw=index.raw.join(ids.select("id"), "id", "left_anti"))


def nearby_reassign(assigned: DataFrame, vecs: DataFrame, centroids: DataFrame, fresh: DataFrame) -> DataFrame:
    """Vectors strictly nearer to a fresh centroid than to their own: id, centroid_id, to; moves() of lists that stay.

    assigned: id, centroid_id; centroids, fresh: centroid_id, cvec."""
    frames = [small(c, "centroid_id", "cvec") for c in (centroids, fresh)]
    old, new = (dict(zip(i.tolist(), x.astype(float), strict=True)) for i, x in frames)
    rows = assigned.join(vecs, "id").select("id", "centroid_id", "vec")
    return moves(rows, old, old | new, {}, set(), list(new)).join(assigned, "id").select("id", "centroid_id", "to")


def delete_depth(assigned: DataFrame, vecs: DataFrame, centroids: DataFrame, beam: int, similarity: str = "l2") -> DataFrame:
    """For each record, the place of its own list among the `beam` centroids nearest to its own vector; null if beyond."""
    heads = centroids.select(F.col("centroid_id").alias("id"), F.col("cvec").alias("vec"))
    near = search_exact(vecs, heads, beam, similarity).select(F.col("qid").alias("id"), F.col("id").alias("centroid_id"), F.col("rank").alias("depth"))
    return assigned.join(near, ["id", "centroid_id"], "left").select("id", "centroid_id", "depth")


def depth_report(depths: DataFrame) -> DataFrame:
    """found, missing, mean, max, p50, p90, p99 of depths; percentiles are values that occur."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by depth)").cast("long").alias(f"p{int(q * 100)}")
    return depths.agg(F.count("depth").alias("found"), F.count_if(F.col("depth").isNull()).alias("missing"), F.avg("depth").alias("mean"), F.max("depth").cast("long").alias("max"), p(0.5), p(0.9), p(0.99))


def diagnose(depths: DataFrame, postings: DataFrame, centroids: DataFrame) -> DataFrame:
    """Why a record was not found: orphaned (its list is gone), search-miss (listed elsewhere), beyond-candidates."""
    missing = depths.where("depth is null").select("id", "centroid_id")
    c = centroids.select("centroid_id", F.lit(True).alias("has_centroid"))
    p = postings.select("id", F.col("centroid_id").alias("listed"))
    why = F.when(F.col("has_centroid").isNull() | F.col("listed").isNull(), "orphaned").when(F.col("listed") != F.col("centroid_id"), "search-miss").otherwise("beyond-candidates")
    return missing.join(c, "centroid_id", "left").join(p, "id", "left").select("id", "centroid_id", why.alias("reason"))


def export_head(index: Index) -> DataFrame:
    """Centroid vectors in order of id."""
    return index.centroids.orderBy("centroid_id").select("centroid_id", F.col("cvec").cast("array<float>").alias("vec"))
