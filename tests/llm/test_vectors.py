"""The pivot-permutation index against brute force: links and recall, repeated and null ids, extra columns."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from nearfield.llm import pivots


def brute(rows, cosine=0.93):
    """(vec_id, n_links, component_id, kept) of each row, from the rows as they are."""
    ok = [i for i, (_, v, t) in enumerate(rows) if t is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for i in ok:
        for j in ok:
            a, b = (np.array(rows[x][1], np.float32).astype(float) for x in (i, j))
            if i < j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(links[i]), low, r[0] is not None and r[0] == low))
    return Counter(out)


def test_rows_with_repeated_and_null_ids(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(6, 12))
    rows = [(int(i) if i % 7 else None, (base[i % 6] + 0.05 * r.normal(size=12)).tolist(), int(i % 2)) for i in range(40)]
    rows += [(3, base[0].tolist(), 0), (3, base[1].tolist(), 0), (3, base[1].tolist(), 0), (3, base[1].tolist(), 1), (None, None, 0), (None, None, 0)]
    rows += [(None, base[2].tolist(), None), (4, None, 1), (5, [0.0] * 12, 1), (60, [float("inf")] * 12, 1), (61, [], 1), (62, [1.0, 2.0], 1), (63, [1.0, 2.0], 1)]
    wide = [(*x, "x", 1, 2, "y", 5) for x in rows]
    d = spark.createDataFrame(wide, "vec_id long, embedding array<float>, label int, list string, row int, id int, near string, n_links int")
    got = Counter(map(tuple, pivots.link(d).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == brute(rows)
    assert Counter(map(tuple, pivots.link(d, block=3).collect())) == got


def sets(kind, n, r):
    if kind == "isotropic":
        return r.normal(size=(n, 64))
    if kind == "common direction":
        return r.normal(size=(n, 64)) + 2 * r.normal(size=64)
    if kind == "768 components":
        return r.normal(size=(n, 768)) * np.arange(1, 769) ** -0.5 + 0.1 * r.normal(size=768)
    return r.normal(size=(20, 64))[r.integers(0, 20, n)] + 0.5 * r.normal(size=(n, 64))


@pytest.mark.parametrize("kind", ["isotropic", "common direction", "768 components", "clusters"])
def test_recall_of_planted_links(spark, kind):
    """Pairs just above the limit, in vectors that have a common direction or not: at least 0.97 of all links."""
    r = np.random.default_rng(2)
    x = pivots.units(sets(kind, 3000, r))
    planted = pivots.turned(x[:1500], r.normal(size=(1500, x.shape[1])), 0.935)
    every = np.concatenate([x, planted]).astype(np.float32)
    label = np.concatenate([np.arange(3000) % 3, np.arange(1500) % 3])
    d = spark.createDataFrame([(i, v, int(t)) for i, (v, t) in enumerate(zip(every.tolist(), label.tolist(), strict=True))], "vec_id long, embedding array<float>, label int")
    u = pivots.units(every.astype(float))
    ok = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(ok, False)
    got = {q["vec_id"]: q["n_links"] for q in pivots.link(d).collect()}
    assert len(got) == len(every)
    found, want = np.array([got[i] for i in range(len(every))]), ok.sum(1)
    assert want.sum() >= 3000 and (found <= want).all()
    assert found.sum() / want.sum() >= 0.97


def test_fit_asks_for_shared_pivots():
    r = np.random.default_rng(3)
    for kind in ("isotropic", "common direction", "clusters"):
        index = pivots.fit(sets(kind, 2000, r), 100_000, 0.93)
        assert index.shared > 1 and len(index.pivots) > 900
    assert len(pivots.fit(r.normal(size=(2000, 64)), 400, 0.93).pivots) == 80
    same = pivots.fit(np.ones((5, 3)), 5, 0.93)
    assert len(same.pivots) == 1 and same.shared == 1


def test_candidates_are_looked_at_once():
    """Over all lists, each pair that shares enough is a candidate in exactly one."""
    r = np.random.default_rng(4)
    near = np.sort(np.array([r.permutation(14)[:6] for _ in range(60)]), axis=1)
    shared, posted = 3, 4
    seen = np.zeros((60, 60), int)
    for p in range(14):
        at = np.flatnonzero((near[:, :posted] == p).any(1))
        if len(at):
            seen[np.ix_(at, at)] += pivots.candidates(near[at], near[at], p, posted, shared)
    want = np.array([[len(set(a) & set(b)) >= shared for b in near.tolist()] for a in near.tolist()])
    assert (seen == want).all()
