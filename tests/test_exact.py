"""Exact search among equal and nearly equal vectors, against all distances in double."""

import numpy as np
import pytest

from nearfield.operators import exact


def brute(x, kind, k, self_free=False):
    a, q = x.astype(float), x[:3].astype(float)
    d, dots, own = np.zeros((3, len(a))), np.zeros((3, len(a))), np.zeros(len(a))
    for b, c in zip(q.T, a.T, strict=True):
        d += (b[:, None] - c[None, :]) ** 2
        dots += b[:, None] * c[None, :]
        own += c * c
    d = {"l2": d, "dot": (1 - dots) / 2, "cos": (1 - dots / np.sqrt(own[:3, None] * own[None, :])) / 2}[kind]
    out = {}
    for q in range(3):
        near = sorted((d[q, i], i) for i in range(len(a)) if not (self_free and i == q))[:k]
        out[q] = [(r + 1, i, e) for r, (e, i) in enumerate(near)]
    return out


@pytest.mark.parametrize("noise", [0, 1e-4])
@pytest.mark.parametrize("kind", ["l2", "dot", "cos"])
def test_copies(spark, kind, noise):
    r = np.random.default_rng(1)
    x = r.normal(size=(2500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = r.permutation(2500)[:900]
    x[near] = x[0] + noise * r.normal(size=(900, 64))
    x = x.astype(np.float32)
    rows = [(int(i), [float(y) for y in x[i]]) for i in r.permutation(2500)]
    v = spark.createDataFrame(rows, "id long, vec array<float>").repartition(3).cache()
    for free in (False, True):
        got: dict = {}
        for t in exact.search(v.where("id < 3"), v, 10, kind, self_free=free).orderBy("qid", "rank").collect():
            got.setdefault(t["qid"], []).append((t["rank"], t["id"], t["distance"]))
        assert got == brute(x, kind, 10, free)


def test_many_queries_go_by_a_grid(spark, monkeypatch):
    """Exact, coded and graph search and distance loss: the same rows by blocks of queries and documents."""
    from nearfield.operators import coded, evaluate, graph
    from nearfield.plans import blocks

    x = np.random.default_rng(5).normal(size=(240, 16)).astype(np.float32)
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, vec array<float>")
    q = v.where("id % 3 = 0")
    c = coded.encode(v, "tlvq4", 16)
    index = graph.build(v, graph.Config(16, nav_coding="f32", beam=32), rows_a_shard=100)
    runs = {
        "exact": lambda: exact.search(q, v, 4, self_free=True), "coded": lambda: coded.search(q, c, 4, "tlvq4", 16).selectExpr("qid", "rank", "id", "round(distance, 9)"),
        "graph": lambda: graph.search(index, q, 4).drop("micros"), "loss": lambda: evaluate.distance_loss(q, v, "tlvq4", 16).selectExpr("n", "round(mae, 9)", "round(mse, 9)", "within"),
    }
    whole = {n: sorted(map(tuple, f().collect())) for n, f in runs.items()}
    monkeypatch.setattr(blocks.against_all, "__defaults__", (100, 2000))
    monkeypatch.setattr(graph, "QUERY_BYTES", 100)
    monkeypatch.setattr(graph, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(blocks, "QUERIES", 7)
    for n, f in runs.items():
        assert sorted(map(tuple, f().collect())) == whole[n], n
    none = v.where("false")
    assert exact.search(none, v, 3).count() == exact.search(q, none, 3).count() == 0


@pytest.mark.parametrize("kind", ["l2", "cos"])
@pytest.mark.parametrize("grid", [False, True])
def test_within(spark, monkeypatch, kind, grid):
    """All pairs under a limit that one pair meets exactly, without a join of pairs in the plan."""
    from nearfield.plans import blocks

    x = np.random.default_rng(8).normal(size=(1500, 16)).astype(np.float32)
    x[200:260] = x[1]
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, vec array<float>")
    pairs = {(r["qid"], r["id"]): r["distance"] for r in exact.pairs(v.where("id < 300"), v, kind).collect()}
    most = sorted(pairs.values())[20_000]
    if grid:
        monkeypatch.setattr(blocks.against_all, "__defaults__", (100, 2000))
        monkeypatch.setattr(exact, "PAIR_BYTES", 30_000)
    found = exact.within(v.where("id < 300"), v, most, kind)
    assert "Join" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    rows = [(r["qid"], r["id"], r["distance"]) for r in found.collect()]
    assert sorted(rows) == sorted((*p, d) for p, d in pairs.items() if d < most)
    assert exact.within(v.where("false"), v, most, kind).count() == exact.within(v, v.where("false"), most, kind).count() == 0
