"""Clustering, partitioned index, evaluation on small inputs."""

import numpy as np
import pytest

from nearfield.operators import clustering as km
from nearfield.operators import evaluate
from nearfield.operators import partitioned as P
from nearfield.streaming import ingest


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<float>")


def blobs(sizes, gap=10.0, seed=0):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(size=(n, 2)) * 0.5 + [gap * i, 0] for i, n in enumerate(sizes)]).astype(np.float32)


def test_kmeans_finds_blobs(spark):
    v = frame(spark, blobs([40, 40]))
    try:
        c = km.kmeans(v, 2, km.KMeansParams(init="plusplus", iters=50))
    except km.NotConverged as e:
        c = e.centroids
    assert sorted(np.round(c[:, 0] / 10).astype(int).tolist()) == [0, 1]
    at = [r["centroid_id"] for r in km.assign(v, np.arange(2), c).orderBy("id").collect()]
    assert len(set(at[:40])) == len(set(at[40:])) == 1


def test_binary_partition_is_balanced():
    x = blobs([40, 40]).astype(float)
    c = km.binary_partition(x, 20, 100, np.random.default_rng(1))
    n = np.bincount(km.nearest(x, c)[0], minlength=2)
    assert n.tolist() in ([40, 40],)
    same = km.binary_partition(np.ones((10, 2)), 2, 10, np.random.default_rng(1))
    assert same.shape == (2, 2)


def test_prune_small_keeps_one():
    x = np.zeros((3, 2))
    assert len(km.prune_small(x, np.array([[0.0, 0], [9, 9]]), 5)) == 1


def test_insert_rebalance_conserves_ids(spark):
    x = blobs([5, 40, 200])
    v = frame(spark, x)
    index = P.bulk_load(v.where("id < 120"), P.Config(2, min_len=10, max_len=50))
    index, report = P.insert(index, v.where("id >= 120"))
    assert index.postings.count() == index.postings.select("id").distinct().count() == 245
    assert report
    assert {r["count"] for r in P.stats(index.centroids, index.postings).collect() if r["count"] > 50} == set()
    with pytest.raises(ValueError, match="already"):
        P.insert(index, v.where("id = 3"))
    all_lists = P.search(index, v.where("id < 5"), 3, "top_n:1000")
    from nearfield.operators import exact

    assert {(r["qid"], r["id"]) for r in all_lists.collect()} == {(r["qid"], r["id"]) for r in exact.search(v.where("id < 5"), v, 3).collect()}
    gone = P.delete(index, v.where("id < 5").select("id"))
    assert gone.postings.count() == 240


def test_one_small_cluster_stays(spark):
    v = frame(spark, blobs([4]))
    index = P.bulk_load(v, P.Config(2, min_len=10, max_len=50))
    index, _ = P.rebalance(index)
    assert index.centroids.count() == 1 and index.postings.count() == 4


def test_empty_index_takes_vectors(spark):
    index, _ = P.insert(P.empty(spark, P.Config(2, min_len=1, max_len=30)), frame(spark, blobs([40])))
    assert index.postings.count() == 40


def test_selectors(spark):
    c = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "centroid_id long, cvec array<float>")
    n = spark.createDataFrame([(0, 3), (1, 5), (2, 2), (3, 8)], "centroid_id long, count long")
    q = spark.createDataFrame([(7, [0.0, 0.0])], "id long, vec array<float>")
    pick = lambda **k: sorted(r["centroid_id"] for r in P.select_centroids(q, c, n, **k).collect())
    assert pick(top_n=2) == [0, 1]
    assert pick(vector_count=6) == [0, 1]
    assert pick(vector_count=9) == [0, 1, 2]
    assert P.parse_selector("vector_count:6") == {"vector_count": 6}
    with pytest.raises(ValueError, match="selector"):
        P.parse_selector("nearest:2")


def test_fitted_selector(spark):
    """Far clusters need few lists, vectors without any need many; more neighbors than vectors, or none, read what there is."""
    from nearfield.operators import exact

    rng = np.random.default_rng(4)
    for x, few in ((np.repeat(rng.normal(size=(8, 16)) * 1000, 30, 0) + rng.normal(size=(240, 16)), True), (rng.normal(size=(240, 16)), False)):
        v = frame(spark, x)
        index = P.bulk_load(v, P.Config(16, min_len=5, max_len=40))
        picked = P.fitted_selector(index, 5)
        assert (int(picked.removeprefix("top_n:")) <= 2) == few
        q = v.where("id % 7 = 0")
        r = evaluate.recall(P.search(index, q, 5, picked), exact.search(q, v, 5), 5).agg({"recall": "avg"}).first()[0]
        assert r >= 0.9
    assert P.fitted_selector(index, 500) == f"top_n:{index.centroids.count()}"
    assert P.fitted_selector(P.empty(spark, P.Config(2, min_len=1, max_len=30)), 5) == "top_n:1"


def test_recall_and_depth(spark):
    t = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate([1, 2, 3])], "qid long, rank int, id long")
    for ids, recall, depth in (([9, 1, 2, 3], 1.0, 4), ([9, 1, 2], 2 / 3, 3)):
        r = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(ids)], "qid long, rank int, id long")
        assert evaluate.recall(r, t, 3).first()["recall"] == recall
        assert evaluate.depth(r, t, 3).first()["depth"] == depth
    with pytest.raises(ValueError, match="ground truth"):
        evaluate.check_k(t, 4)


def test_coding_recall_with_centers(spark):
    v = frame(spark, np.random.default_rng(2).normal(size=(120, 16)))
    q = v.where("id < 8")
    from nearfield.operators import exact

    truth = exact.search(q, v, 5)
    for centers in (0, 1, 3):
        r = evaluate.coding_recall(q, v, truth, 5, 2, "tlvq4", 16, centers=centers).first()
        assert r["recall"] > 0.9 and r["looked"] > 0


def test_stream_ingest(spark, tmp_path):
    v, root = frame(spark, blobs([30, 30])), str(tmp_path / "index")
    ingest.start(P.bulk_load(v.where("id < 20"), P.Config(2, min_len=1, max_len=100)), root)
    v.where("id >= 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(v.schema).parquet(str(tmp_path / "in"))
    ingest.ingest(s, root, str(tmp_path / "cp")).awaitTermination()
    assert P.Index.load(spark, f"{root}/v1").postings.count() == 60
    frame(spark, blobs([5]), 100).write.parquet(str(tmp_path / "more"))
    s = spark.readStream.schema(v.schema).parquet(str(tmp_path / "more"))
    ingest.ingest(s, root, str(tmp_path / "other")).awaitTermination()  # batch 0 of another stream goes on from v1
    assert ingest.versions(spark, root)[-1] >= 2 and ingest.latest(spark, root).postings.count() == 65
    assert P.Index.load(spark, f"{root}/v1").postings.count() == 60
    s = spark.readStream.schema(v.schema).parquet(str(tmp_path / "more"))
    with pytest.raises(Exception, match="already"):
        ingest.ingest(s, root, str(tmp_path / "third")).awaitTermination()


def brute_moves(rows, old, after, pairs, gone):
    """The rules, vector by vector."""
    out = {}
    dist = lambda a, b: float(((a - b) ** 2).sum())
    fresh = [i for p in pairs.values() for i in p]
    for i, c, x in rows:
        if c in gone:
            everywhere = min(after, key=lambda k: (dist(x, after[k]), k))
            if c in pairs:
                a, b = pairs[c]
                da, db = dist(x, after[a]), dist(x, after[b])
                out[i] = everywhere if dist(x, old[c]) < min(da, db) else a if da < db else b
            else:
                out[i] = everywhere
        elif fresh:
            best = min(fresh, key=lambda k: (dist(x, after[k]), k))
            if dist(x, after[best]) < dist(x, old[c]):
                out[i] = best
    return {i: c for i, c in out.items() if c != dict((i, c) for i, c, _ in rows)[i]}


def test_moves_against_the_rules(spark):
    """A split, a merge and lists nearby at once: small whole coordinates, so that there are ties."""
    r = np.random.default_rng(7)
    x = r.integers(-6, 7, (300, 2)).astype(float)
    old = {c: v for c, v in enumerate(r.integers(-6, 7, (6, 2)).astype(float))}
    own = [min(old, key=lambda c: (((v - old[c]) ** 2).sum(), c)) for v in x]
    pairs, gone = {2: (10, 11)}, {2, 4}
    after = {c: v for c, v in old.items() if c not in gone} | {10: old[2] + [2, 0], 11: old[2] - [1, 1]}
    rows = [(i, c, v) for i, (c, v) in enumerate(zip(own, x, strict=True))]
    d = spark.createDataFrame([(i, c, v.tolist()) for i, c, v in rows], "id long, centroid_id long, vec array<float>")
    got = {r["id"]: r["to"] for r in P.moves(d, old, after, pairs, gone).collect()}
    want = brute_moves(rows, old, after, pairs, gone)
    assert got == want and len(want) > 30


def test_many_clusters_in_bounded_memory(spark):
    """Over ten thousand clusters: no split sees more than its sample, and no list is left over the bound."""
    x = np.random.default_rng(4).normal(size=(22_000, 3)).astype(np.float32)
    v = frame(spark, x).repartition(4).cache()
    tree = km.hierarchical(v, 1, 2, sample=512)
    assert len(tree) > 10_000
    v.unpersist()


def test_hierarchical_sizes(spark):
    x = blobs([5, 40, 200])
    c = km.hierarchical(frame(spark, x), 10, 50)
    n = np.bincount(km.nearest(x, c)[0], minlength=len(c))
    assert n.sum() == 245 and n.max() <= 60
    with pytest.warns(UserWarning, match="can't be split"):
        assert len(km.hierarchical(frame(spark, np.ones((30, 2))), 2, 5)) == 1


def test_binary_partition_moves_its_border():
    """A far group of three rows: the border is moved until each side has what it needs."""
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(97, 4)), 50 + r.normal(size=(3, 4))])
    for least in (1, 3, 20, 50):
        c = km.binary_partition(x, least, 50, np.random.default_rng(0))
        assert np.bincount(km.nearest(x, c)[0], minlength=2).min() >= least


def test_search_of_a_list_in_parts(spark, monkeypatch):
    v = frame(spark, blobs([50, 50]))
    index = P.bulk_load(v, P.Config(2, min_len=5, max_len=30))
    whole = sorted(map(tuple, P.search(index, v, 3, "top_n:2").collect()))
    monkeypatch.setattr(P, "WANTED", 7)
    assert sorted(map(tuple, P.search(index, v, 3, "top_n:2").collect())) == whole
