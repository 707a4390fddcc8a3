"""Pruned proximity-graph (Vamana) index.

Graph is one shard in memory: coded vectors, edge lists, one entry point, and the sequential operations on it.  build()
and search() spread shards over the cluster: vectors go to a shard by hash of id, every shard is built in a task of its
own, and a search asks all shards and merges by (distance, id), as a search over segments does.
"""

from __future__ import annotations

import bisect
import json
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.coding import F32, Coding, coding
from nearfield.plans.blocks import BLOCK_BYTES, QUERY_BYTES, extent, matrix
from nearfield.plans.durable import durable
from nearfield.plans.topk import top_k

#: Queries that search a shard together; pairs that a build takes distances of at once.
QS, PAIRS = 256, 1 << 21
#: Fewer deletions go one by one.
FEW = 16
#: Number of shards before they grow, and the rows they grow to before there are more of them.
SHARDS, MOST_ROWS = 256, 50_000


@dataclass(frozen=True)
class Config:
    dims: int
    similarity: str = "l2"
    nav_coding: str = "binary"
    rerank_coding: str | None = "f32"
    max_edges: int = 32
    max_alpha: float = 1.2
    alpha_scale: float = 1.2
    beam: int = 128
    num_rerank: int = 0
    directed: bool = False
    patience_count: int | None = None
    patience_threshold: float = 0.995

    def __post_init__(self) -> None:
        if self.num_rerank and not self.rerank_coding:
            raise ValueError("a rerank budget needs a rerank coding")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(**json.loads(text))


@dataclass
class Stats:
    candidates: int = 0
    added: int = 0
    visited: int = 0
    filtered: int = 0
    skipped: int = 0
    micros: int = 0  # of the search alone, without loading the shard


def prune(edges: list[tuple[float, int]], between: np.ndarray, max_edges: int, max_alpha: float, scale: float) -> list[int]:
    """Indices of the edges to keep, ascending.  edges: (distance, vertex) sorted; between: distances of edge ends.

    An edge goes if a kept, nearer one has (its own distance) / (distance between the ends) over alpha; rounds with a
    larger alpha follow while there is room.  The distances are those of the kept edge, not of the candidate.
    """
    if not edges:
        return []
    own = np.array([d for d, _ in edges])
    kept = [True] + [False] * (len(edges) - 1)
    alpha, n, wide = 1.0, 1, -(-len(edges) // 8)
    with np.errstate(divide="ignore", invalid="ignore"):
        over = own[None, :] / between
    while alpha <= max_alpha and n < max_edges:
        # Bits of what each edge rules out once it is kept, and of what is ruled out so far.
        bits = np.packbits(over > alpha, axis=0, bitorder="little").T.tobytes()
        gone = 0
        for i in range(len(edges)):
            if not kept[i]:
                if gone >> i & 1:
                    continue
                kept[i] = True
                n += 1
                if n >= max_edges:
                    break
            gone |= int.from_bytes(bits[i * wide : (i + 1) * wide], "little")
        if scale <= 1:
            break
        alpha *= scale
    return [i for i, x in enumerate(kept) if x]


class Graph:
    """One shard.  Vectors are numbered rows; ids are the caller's."""

    def __init__(self, config: Config, center: np.ndarray | None = None) -> None:
        self.config = config
        self.nav: Coding = coding(config.nav_coding, config.dims, config.similarity, center)
        self.best: Coding | None = coding(config.rerank_coding, config.dims, config.similarity, center) if config.rerank_coding else None
        self.nav_codes: dict[int, np.ndarray] = {}
        self.best_codes: dict[int, np.ndarray] = {}
        self.edges: dict[int, list[int]] = {}
        self.entry: int | None = None
        self.stats = Stats()
        fine = self._fine()[0]
        #: Whether one coding of plain floats serves navigation and edges; vectors are rows of x then, as the coding opens them.
        self.plain = isinstance(fine, F32) and fine.name == self.nav.name
        self.x = np.empty((0, config.dims))
        self.at: dict[int, int] = {}

    # Vectors

    def put(self, id_: int, vec: np.ndarray) -> None:
        x = np.asarray(vec, np.float32)[None]
        if x.shape[1] != self.config.dims:
            raise ValueError(f"a vector has {x.shape[1]} dimensions, the index {self.config.dims}")
        self.put_all([id_], x)

    def put_all(self, ids: Iterable[int], x: np.ndarray) -> None:
        self.put_codes(list(ids), self.nav.encode(x), self.best.encode(x) if self.best else None)

    def put_codes(self, ids: list[int], nav: np.ndarray, best: np.ndarray | None) -> None:
        self.nav_codes.update(zip(ids, nav, strict=True))
        if self.best:
            self.best_codes.update(zip(ids, best, strict=True))
        if self.plain and ids:
            n = len(self.at)
            for i in ids:
                self.at.setdefault(i, len(self.at))  # of deleted vertices, rows and places stay
            if len(self.at) > len(self.x):
                self.x = np.concatenate([self.x[:n], np.empty((max(n, len(self.at) - n), self.config.dims))])
            self.x[[self.at[i] for i in ids]] = self.nav.opened(nav)

    def _points(self, ids: list[int]) -> np.ndarray:
        return self.x[[self.at[i] for i in ids]]

    def _fine(self) -> tuple[Coding, dict[int, np.ndarray]]:
        """What edges are chosen by: the rerank vectors where there are any."""
        return (self.best, self.best_codes) if self.best else (self.nav, self.nav_codes)

    def distances(self, a: list[int], b: list[int]) -> np.ndarray:
        c, codes = self._fine()
        if not a or not b:
            return np.zeros((len(a), len(b)))
        if self.plain:
            y = self._points(b)
            return c.score(y if a is b else self._points(a), y)
        return c.symmetric(np.stack([codes[i] for i in a]), np.stack([codes[i] for i in b]))

    # Search

    def search(self, q: np.ndarray, keep: Callable[[int], bool] | None = None, seeds: Iterable[int] = (), own: int | None = None, rerank: int | None = None) -> list[tuple[float, int]]:
        """(distance, id) in order.  own: search for that vertex by its code, and never see it."""
        cfg = self.config
        s = self.stats = Stats()
        if self.plain:
            point = self.nav.ready(np.asarray(q, np.float32)[None]) if own is None else self._points([own])
            score = lambda ids: self.nav.score(point, self._points(ids))[0]
        elif own is None:
            qn = np.asarray(q, np.float32)[None]
            score = lambda ids: self.nav.query(qn, np.stack([self.nav_codes[i] for i in ids]))[0]
        else:
            score = lambda ids: self.nav.symmetric(self.nav_codes[own][None], np.stack([self.nav_codes[i] for i in ids]))[0]
        found: list[tuple[float, int]] = []
        visited: set[int] = set()
        seen = set() if own is None else {own}

        def add(ids: list[int]) -> int:
            n = 0
            for d, i in zip(score(ids).tolist() if ids else [], ids, strict=True):
                item = (d, i)
                if len(found) >= cfg.beam and item >= found[-1]:
                    continue
                bisect.insort(found, item)
                del found[cfg.beam :]
                n += 1
            return n

        if self.entry is not None and self.entry not in seen:
            seen.add(self.entry)
            s.added += add([self.entry])
        fresh = [i for i in dict.fromkeys(seeds) if i not in seen and i in self.nav_codes]
        seen.update(fresh)
        s.added += add(fresh)
        calm, known = 0, 0
        while True:
            at = next((x for x in found if x[1] not in visited), None)
            if at is None:
                break
            s.visited += 1
            if keep is None or keep(at[1]):
                visited.add(at[1])
            else:
                found.remove(at)
                s.filtered += 1
            new = []
            for e in self.edges.get(at[1], ()):
                if e not in seen:
                    seen.add(e)
                    if e in self.nav_codes:
                        new.append(e)
                    else:
                        s.skipped += 1
            n = add(new)
            s.added += n
            s.candidates += len(new)
            if cfg.patience_count:
                total = known + n
                calm = calm + 1 if total and known / total >= cfg.patience_threshold else 0
                known = total
                if calm >= cfg.patience_count:
                    break
        n = cfg.num_rerank if rerank is None else rerank
        if n and self.best and found:
            some = [i for _, i in found[:n]]
            c = np.stack([self.best_codes[i] for i in some])
            d = self.best.query(np.asarray(q, np.float32)[None], c)[0] if own is None else self.best.symmetric(self.best_codes[own][None], c)[0]
            return sorted(zip(d.tolist(), some, strict=True))
        return found

    def search_all(self, qs: np.ndarray, rerank: int | None = None) -> list[tuple[list[tuple[float, int]], Stats]]:
        """search() of many queries, with its counters; those of a plain index take every step together."""
        cfg = self.config
        if not self.plain or cfg.patience_count or self.entry is None:
            out = []
            for q in qs:
                began = time.perf_counter()
                found = self.search(q, rerank=rerank)
                self.stats.micros = int(1e6 * (time.perf_counter() - began))
                out.append((found, self.stats))
            return out
        ids = np.array(sorted(self.edges), np.int64)
        n, place = len(ids), {i: p for p, i in enumerate(ids.tolist())}
        wide = max(1, max(map(len, self.edges.values())))
        ends = np.full((n + 1, wide), n)  # n: none
        for i, p in place.items():
            some = [place[e] for e in self.edges[i] if e in place]
            ends[p, : len(some)] = some
        lost = np.array([len(self.edges[i]) for i in ids.tolist()]) - (ends[:n] < n).sum(1)
        x = np.concatenate([self._points(ids.tolist()), np.zeros((1, cfg.dims))])
        long = np.einsum("ij,ij->i", x, x)
        most = cfg.num_rerank if rerank is None else rerank
        out = []
        for at in range(0, len(qs), QS):
            began = time.perf_counter()
            q = self.nav.ready(np.asarray(qs[at : at + QS], np.float32))
            d, i, stats = self._together(q, x, long, ends, lost, place[self.entry])
            each = int(1e6 * (time.perf_counter() - began) / len(q))
            for dist, near, counts in zip(d, i, stats.T.tolist(), strict=True):
                keep = (near < n).nonzero()[0][: most or None]
                out.append((list(zip(dist[keep].tolist(), ids[near[keep]].tolist(), strict=True)), Stats(*counts, micros=each)))
        return out

    def _together(self, q: np.ndarray, x: np.ndarray, long: np.ndarray, ends: np.ndarray, lost: np.ndarray, entry: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances and places of each query's list, nearest first, and the first five counters of Stats."""
        n, beam, l2 = len(x) - 1, self.config.beam, self.nav.similarity == "l2"
        own = np.einsum("ij,ij->i", q, q)

        def score(a: np.ndarray, at: np.ndarray) -> np.ndarray:
            dots = np.matmul(x[at], q[a][:, :, None])[:, :, 0]
            return np.maximum(own[a][:, None] + long[at] - 2 * dots, 0) if l2 else (1 - dots) / 2

        live, stats = np.arange(len(q)), np.zeros((5, len(q)), np.int64)
        d, i, done = np.full((len(q), beam), np.inf), np.full((len(q), beam), n), np.zeros((len(q), beam), bool)
        i[:, 0] = entry
        d[:, :1] = score(live, i[:, :1])
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, [entry, n]] = True
        stats[1] = 1
        while True:
            todo = ~done[live] & (i[live] < n)
            live, todo = live[todo.any(1)], todo[todo.any(1)]
            if not len(live):
                return d, i, stats
            first = todo.argmax(1)
            at = i[live, first]
            done[live, first] = True
            near = ends[at]
            new = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            near = np.where(new, near, n)
            dist = np.concatenate([d[live], np.where(new, score(live, near), np.inf)], 1)
            near, was = np.concatenate([i[live], near], 1), np.concatenate([done[live], np.zeros(new.shape, bool)], 1)
            order = np.argsort(dist, axis=1, kind="stable")
            tied = np.take_along_axis(dist, order, 1)
            tied = np.flatnonzero(((tied[:, 1:] == tied[:, :-1]) & np.isfinite(tied[:, 1:])).any(1))
            order[tied] = np.lexsort((near[tied], dist[tied]), axis=1)
            order = order[:, :beam]
            d[live], i[live], done[live] = (np.take_along_axis(y, order, 1) for y in (dist, near, was))
            stats[0, live] += new.sum(1)
            stats[1, live] += (order >= beam).sum(1) - ((order >= beam) & (i[live] == n)).sum(1)
            stats[2, live] += 1
            stats[4, live] += lost[at]

    # Mutation

    def _prune_list(self, id_: int, ends: list[int]) -> tuple[list[int], list[int]]:
        """Kept ends by distance, and the others."""
        ends = [e for e in ends if e in self.nav_codes]
        if self.plain:
            some = [id_, *ends]
            every = self.distances(some, some)
            own = every[0, 1:]
        else:
            own = self.distances([id_], ends)[0] if ends else np.empty(0)
        at = np.lexsort((ends, own))
        ends, order = [ends[n] for n in at], [(float(own[n]), ends[n]) for n in at]
        if len(ends) <= self.config.max_edges:
            return ends, []
        between = every[np.ix_(at + 1, at + 1)] if self.plain else self.distances(ends, ends)
        kept = set(prune(order, between, self.config.max_edges, self.config.max_alpha, self.config.alpha_scale))
        return [e for i, e in enumerate(ends) if i in kept], [e for i, e in enumerate(ends) if i not in kept]

    def _with_edge(self, src: int, dst: int) -> tuple[list[int], list[int]]:
        """Edges of src with dst added, and what had to be pruned for it."""
        ends = self.edges[src]
        if dst in ends:
            return ends, []
        if len(ends) < self.config.max_edges:
            return [*ends, dst], []
        return self._prune_list(src, [*ends, dst])

    def _drop_edge(self, src: int, dst: int) -> None:
        if src in self.edges:
            self.edges[src] = [e for e in self.edges[src] if e != dst]

    def insert(self, id_: int, vec: np.ndarray, keep: Callable[[int], bool] | None = None) -> None:
        """Search, choose edges, store, add back edges."""
        if id_ in self.edges:
            raise ValueError(f"vertex {id_} is there already")
        found = self.search(vec, keep)
        self.put(id_, vec)
        self._link(id_, found)

    def _link(self, id_: int, found: list[tuple[float, int]]) -> None:
        if not found:
            if self.entry is None or not self.edges:
                self.entry = id_
            self.edges[id_] = []
            return
        ends = [e for _, e in found]
        kept = prune(found, self.distances(ends, ends), self.config.max_edges, self.config.max_alpha, self.config.alpha_scale)
        self.edges[id_] = [ends[i] for i in kept]
        for e in list(self.edges[id_]):
            self.edges[e], gone = self._with_edge(e, id_)
            if not self.config.directed:
                for g in gone:
                    self._drop_edge(g, e)

    def upsert(self, id_: int, vec: np.ndarray, keep: Callable[[int], bool] | None = None) -> None:
        if id_ in self.edges:
            self.delete(id_)
        self.insert(id_, vec, keep)

    def delete(self, id_: int) -> None:
        if id_ not in self.edges:
            raise KeyError(id_)
        ends = self.edges.pop(id_)
        peers = [e for e in ends if e in self.edges]
        near = sorted(zip(self.distances([id_], peers)[0].tolist() if peers else [], peers, strict=True))
        del self.nav_codes[id_]
        self.best_codes.pop(id_, None)
        if self.config.directed:
            self._heal(id_, ends)
        else:
            for e in peers:
                self._drop_edge(e, id_)
            self._cross_link(peers)
        if self.entry == id_:
            self.entry = near[0][1] if near else None

    def _cross_link(self, peers: list[int]) -> None:
        """Join former neighbors of a deleted vertex with their nearest, in both directions or not at all."""
        d = self.distances(peers, peers)
        before = {p: set(self.edges[p]) for p in peers}
        most = max(self.config.max_edges, 2) // 2
        wanted = []
        for i, p in enumerate(peers):
            near = sorted((d[i, j], q) for j, q in enumerate(peers) if j != i)[:most]
            wanted += [(p, q) for _, q in near if q not in before[p]]
        for p, q in wanted:
            self._join(p, q)

    def _join(self, p: int, q: int) -> bool:
        """An edge in both directions, if both ends keep it."""
        a, gone_a = self._with_edge(p, q)
        if q not in a:
            return False
        b, gone_b = self._with_edge(q, p)
        if p not in b:
            return False
        self.edges[p], self.edges[q] = a, b
        for src, gone in ((p, gone_a), (q, gone_b)):
            for g in gone:
                self._drop_edge(g, src)
        return True

    def _heal(self, id_: int, ends: list[int]) -> None:
        """Give vertices within two hops that pointed to id_ up to four of its neighbors instead."""
        reach = dict.fromkeys(e for e in ends if e in self.edges)
        for e in list(reach):
            reach.update(dict.fromkeys(x for x in self.edges[e] if x in self.edges))
        spare = [e for e in ends if e in self.nav_codes]
        for v in reach:
            if id_ not in self.edges[v]:
                continue
            rest = sorted(e for e in self.edges[v] if e != id_)
            new = [e for e in spare if e not in rest and e != v]
            if not any(e not in rest for e in spare):
                continue  # the stale edge stays; searches pass over it
            if new:
                d = self.distances([v], new)[0]
                rest = sorted({*rest, *(e for _, e in sorted(zip(d.tolist(), new, strict=True))[:4])})
            if len(rest) > self.config.max_edges:
                rest = self._prune_list(v, rest)[0]
            self.edges[v] = rest

    # Bulk

    def upsert_all(self, ids: list[int], x: np.ndarray) -> None:
        """upsert() of many, in this order.  Vectors of a plain index are searched for together, at most an eighth of the graph
        at once, and see those before them of their own batch as well."""
        self.delete_all([i for i in ids if i in self.edges])
        at = 0
        while at < len(ids):
            to = at + (max(1, min(QS, len(self.edges) // 8)) if self.plain and self.config.num_rerank == 0 else 1)
            some, part = ids[at:to], x[at:to]
            found = self.search_all(part)
            self.put_all(some, part)
            d = self.distances(some, some) if len(some) > 1 else None
            for n, (i, (near, _)) in enumerate(zip(some, found, strict=True)):
                if n:
                    near = sorted([*near, *zip(d[n, :n].tolist(), some[:n], strict=True)])[: self.config.beam]
                self._link(i, near)
            at = to

    def delete_all(self, ids: list[int]) -> None:
        """delete() of many.  In a plain undirected index, every list that loses ends gets the deleted ones' other ends as
        candidates and is pruned once; what both ends have chosen stays, then what both have room for."""
        gone = {i for i in ids if i in self.edges}
        if not self.plain or self.config.directed or len(gone) < FEW:
            for i in ids:
                if i in self.edges:
                    self.delete(i)
            return
        left = [i for i in self.edges if i not in gone]
        if self.entry in gone:
            self.entry = left[int(np.lexsort((left, self.distances([self.entry], left)[0]))[0])] if left else None
        more: dict[int, dict[int, None]] = {}
        for g in gone:
            reach, seen = [g], {g}  # on through deleted ones until some are left
            while reach and not (peers := [e for r in reach for e in self.edges[r] if e not in gone]):
                reach = [e for r in reach for e in self.edges[r] if e not in seen and not seen.add(e)]
            for p in peers if reach else ():
                more.setdefault(p, {}).update(dict.fromkeys(peers))
        most = self.config.max_edges
        wish = {}
        for p, others in more.items():
            ends = list(dict.fromkeys(e for e in (*self.edges[p], *others) if e != p and e not in gone))
            wish[p] = self._prune_list(p, ends)[0]
        for g in gone:
            del self.edges[g], self.nav_codes[g]
            self.best_codes.pop(g, None)
        sets = {p: set(w) for p, w in wish.items()} | {i: set(self.edges[i]) for i in left if i not in wish}
        for p in left:
            self.edges[p] = [e for e in wish.get(p, self.edges[p]) if p in sets[e]]
        for p, w in wish.items():
            for e in w:
                if p not in sets[e] and len(self.edges[p]) < most and len(self.edges[e]) < most:
                    self.edges[p].append(e)
                    self.edges[e].append(p)
        reached = self.reachable()
        for p in left:
            if p not in reached and any(self._join(p, e) for _, e in self.search(None, own=p)):
                reached = self.reachable()

    def build(self, ids: list[int], x: np.ndarray) -> None:
        """All vectors at once: enter at the vector nearest the mean, insert in id order, prune what is over."""
        order = np.argsort(ids, kind="stable")
        ids, x = [ids[i] for i in order], x[order]
        if not ids:
            return
        self.put_all(ids, x)
        from nearfield.functions.similarity import block

        d = block(x.mean(0, keepdims=True, dtype=np.float64), x.astype(np.float64), self.config.similarity)[0]
        self.entry = ids[int(np.lexsort((ids, d))[0])]
        self.edges[self.entry] = []
        rest = [i for i in ids if i != self.entry]
        found = self._earlier([self.entry, *rest]) if self.plain else (self.search(None, own=i, rerank=self.config.beam if self.best else 0) for i in rest)
        for i, near in zip(rest, found, strict=True):
            self._link(i, near)
        for i in ids:
            if len(self.edges[i]) > self.config.max_edges:
                self.edges[i] = self._prune_list(i, self.edges[i])[0]

    def _earlier(self, ids: list[int]) -> Iterator[list[tuple[float, int]]]:
        """For each but the first, the nearest of those before it, as many as a search would list: by blocks of all distances."""
        beam, names, x = self.config.beam, np.array(ids, np.int64), self._points(ids)
        rows = max(16, PAIRS // len(ids))
        for at in range(1, len(ids), rows):
            to = min(at + rows, len(ids))
            d = self.nav.score(x[at:to], x[:to])
            d[np.arange(to) >= np.arange(at, to)[:, None]] = np.inf
            near = np.argpartition(d, beam - 1, axis=1)[:, :beam] if to > beam else np.broadcast_to(np.arange(to), d.shape)
            dist = np.take_along_axis(d, near, 1)
            for n, (e, p) in enumerate(zip(dist, near, strict=True), at):
                p, e = (y[p < n] for y in (p, e))
                order = np.lexsort((names[p], e))
                yield list(zip(e[order].tolist(), names[p[order]].tolist(), strict=True))

    def reachable(self) -> set[int]:
        seen: set[int] = set() if self.entry is None else {self.entry}
        todo = deque(seen)
        while todo:
            for e in self.edges.get(todo.popleft(), ()):
                if e not in seen and e in self.edges:
                    seen.add(e)
                    todo.append(e)
        return seen


SCHEMA = "shard int, id long, entry boolean, edges array<long>, nav binary, best binary"


@dataclass
class Index:
    """config, and rows of SCHEMA: one a vertex, dealt to `shards` by shard_of()."""

    config: Config
    rows: DataFrame
    center: list[float] | None = field(default=None)
    shards: int = 1


def shard_of(id_: str, shards: int) -> F.Column:
    return F.pmod(F.xxhash64(id_), F.lit(shards)).cast("int")


def _rows(g: Graph, shard: int):  # noqa: ANN202
    import pyarrow as pa

    ids = list(g.edges)
    return pa.table({
        "shard": pa.array([shard] * len(ids), pa.int32()), "id": pa.array(ids, pa.int64()), "entry": pa.array([i == g.entry for i in ids], pa.bool_()),
        "edges": pa.array([g.edges[i] for i in ids], pa.list_(pa.int64())), "nav": pa.array([g.nav_codes[i].tobytes() for i in ids], pa.binary()),
        "best": pa.array([g.best_codes[i].tobytes() if g.best else None for i in ids], pa.binary()),
    })


def restore(config: Config, rows: Iterable[dict], center: np.ndarray | None = None) -> Graph:
    g = Graph(config, center)
    rows = list(rows)
    for r in rows:
        g.edges[r["id"]] = list(r["edges"])
        if r["entry"]:
            g.entry = r["id"]
    codes = lambda c: np.frombuffer(b"".join(r[c] for r in rows), np.uint8).reshape(len(rows), -1)
    if rows:
        g.put_codes([r["id"] for r in rows], codes("nav"), codes("best") if g.best else None)
    return g


def shards_for(n: int, rows_a_shard: int) -> int:
    """Shards of rows_a_shard; beyond SHARDS of them shards grow instead, up to MOST_ROWS, as every query asks all of them."""
    return max(1, min(-(-n // rows_a_shard), SHARDS), -(-n // max(rows_a_shard, MOST_ROWS)))


def build(vecs: DataFrame, config: Config, rows_a_shard: int = 2_000, center: bool = False) -> Index:
    """vecs: id, vec.  As many shards as shards_for() says; one for a small set.  center: code around the mean."""
    shards = shards_for(vecs.count(), rows_a_shard)
    mean = None
    if center:
        from nearfield.operators.clustering import mean_vector

        mean = [r["mean"] for r in mean_vector(vecs).orderBy("pos").collect()]

    def run(key, t):  # noqa: ANN001, ANN202
        g = Graph(config, None if mean is None else np.array(mean))
        g.build(t.column("id").to_pylist(), matrix(t.column("vec")))
        return _rows(g, key[0].as_py())

    rows = vecs.select(shard_of("id", shards).alias("shard"), "id", "vec").repartition(shards, "shard").groupBy("shard").applyInArrow(run, SCHEMA)
    return Index(config, rows, mean, shards)


def mutate(index: Index, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> Index:
    """Delete ids, then insert or replace vectors (id, vec), in id order within each shard of the index."""
    config, center, shards = index.config, index.center, index.shards
    work = None
    for df, kind in ((deletes, "delete"), (upserts, "upsert")):
        if df is not None:
            vec = F.col("vec").cast("array<float>") if kind == "upsert" else F.lit(None).cast("array<float>")
            part = df.select(shard_of("id", shards).alias("shard"), "id", F.lit(kind).alias("kind"), vec.alias("vec"))
            work = part if work is None else work.union(part)
    if work is None:
        return index

    def run(key, old, new):  # noqa: ANN001, ANN202
        g = restore(config, old.to_pylist(), None if center is None else np.array(center))
        rows = sorted(new.to_pylist(), key=lambda r: (r["kind"], r["id"]))
        g.delete_all([r["id"] for r in rows if r["kind"] == "delete"])
        fresh = {r["id"]: r["vec"] for r in rows if r["kind"] == "upsert"}
        if fresh:
            g.upsert_all(list(fresh), np.array(list(fresh.values()), np.float32))
        return _rows(g, key[0].as_py())

    old = index.rows.repartition(shards, "shard").groupBy("shard")
    rows = old.cogroup(work.repartition(shards, "shard").groupBy("shard")).applyInArrow(run, SCHEMA)
    return Index(config, rows, center, shards)


COUNTERS = ("visited", "added", "candidates", "filtered", "skipped", "micros")
FOUND = "qid long, id long, distance double, " + ", ".join(f"{c} long" for c in COUNTERS)


def _ask(g: Graph, ids: np.ndarray, q: np.ndarray, keep, seeds: tuple, rerank: int | None, k: int):  # noqa: ANN001, ANN202
    """The first k of one shard for each query, with the search's counters."""
    import pyarrow as pa

    out: tuple = tuple([] for _ in range(3 + len(COUNTERS)))

    def each() -> Iterator:
        for v in q:
            began = time.perf_counter()
            found = g.search(v, keep, seeds, rerank=rerank)
            g.stats.micros = int(1e6 * (time.perf_counter() - began))
            yield found, g.stats

    for qid, (found, stats) in zip(ids.tolist(), each() if keep or seeds else g.search_all(q, rerank), strict=True):
        counters = [getattr(stats, c) for c in COUNTERS]
        for d, i in found[:k]:
            for o, x in zip(out, (qid, i, d, *counters), strict=True):
                o.append(x)
    kinds = (pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * len(COUNTERS))
    return pa.table([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=["qid", "id", "distance", *COUNTERS])


def search(index: Index, queries: DataFrame, k: int, keep: Callable[[int], bool] | None = None, seeds: Iterable[int] = (), num_rerank: int | None = None) -> DataFrame:
    """queries: id, vec.  qid, rank, id, distance, and the counters of the search in the row's shard.

    visited: vertices expanded; added: taken into the list; candidates: scored; filtered, skipped: left out by keep, not
    there; micros: microseconds that it took.  keep: predicate on ids; vertices that fail are expanded but not returned.  Queries of up to QUERY_BYTES go to
    every shard's task; more of them are dealt to blocks, and a shard is asked once for each block.
    """
    config, center, seeds = index.config, index.center, tuple(seeds)
    load = lambda t: restore(config, t.to_pylist(), None if center is None else np.array(center))
    n, width = extent(queries)
    if n * width <= QUERY_BYTES:
        t = queries.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).orderBy("id").toArrow()
        shared = index.rows.sparkSession.sparkContext.broadcast((t.column(0).to_numpy(), matrix(t.column(1))))
        found = index.rows.repartition(index.shards, "shard").groupBy("shard").applyInArrow(lambda t: _ask(load(t), *shared.value, keep, seeds, num_rerank, k), FOUND)
    else:
        blocks = F.lit(-(-n * width // BLOCK_BYTES))
        every = F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1))).alias("shard")
        left = queries.select(F.col("id").cast("long").alias("qid"), F.col("vec").cast("array<float>").alias("q"), F.pmod(F.xxhash64("id"), blocks).alias("part"), every)
        right = index.rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))

        def pair(q, t):  # noqa: ANN001, ANN202
            return _ask(load(t), q.column("qid").to_numpy(), matrix(q.column("q")) if q.num_rows else np.empty((0, 0)), keep, seeds, num_rerank, k)

        found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(pair, FOUND)
    return top_k(found, k).select("qid", "rank", "id", "distance", *COUNTERS)


def graph_stats(edges: DataFrame) -> DataFrame:
    """edges: id, edges.  vertices, edges, unconnected."""
    return edges.agg(F.count("*").alias("vertices"), F.coalesce(F.sum(F.size("edges")), F.lit(0)).cast("long").alias("edges"), F.count_if(F.size("edges") == 0).alias("unconnected"))


def unreachable(edges: DataFrame, entry: int) -> DataFrame:
    """Ids that a walk from entry does not reach.  edges: id, edges."""
    pairs = edges.select(F.col("id").alias("src"), F.explode("edges").alias("dst")).distinct()
    return edges.select("id").join(_walk(pairs, entry), "id", "left_anti")


def _walk(pairs: DataFrame, entry: int, hops: int = 4) -> DataFrame:
    """All ids reached, `hops` joins a round; recursive SQL here keeps rows it has seen, so that a cycle would never end.

    One written table a round; only whether it grew reaches the driver.
    """
    spark = pairs.sparkSession
    pairs = durable(pairs, "edges")
    seen = durable(spark.range(1).select(F.lit(int(entry)).cast("long").alias("id"), F.lit(0).alias("step")), "seen")
    step = 0
    while True:
        front = found = seen.where(F.col("step") == step).select("id")
        for _ in range(hops):
            front = front.join(pairs, front["id"] == pairs["src"]).select(F.col("dst").alias("id")).distinct()
            found = found.union(front)
        step += 1
        new = found.distinct().join(seen, "id", "left_anti").select("id", F.lit(step).alias("step"))
        seen = durable(seen.union(new), "seen")
        if seen.where(F.col("step") == step).isEmpty():
            return seen.select("id")


def next_id(ids: DataFrame) -> int:
    """One over the largest id; 0 in an empty index."""
    return ids.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]


def lookup(index: Index, id_: int) -> dict | None:
    """Edges, byte lengths and decoded vector of one vertex."""
    r = index.rows.where(F.col("id") == id_).first()
    if r is None:
        return None
    c = coding(index.config.rerank_coding or index.config.nav_coding, index.config.dims, index.config.similarity, index.center)
    raw = np.frombuffer(r["best"] if r["best"] is not None else r["nav"], np.uint8)[None]
    return {"id": id_, "edges": sorted(r["edges"]), "nav_bytes": len(r["nav"]), "best_bytes": len(r["best"] or b""), "vec": c.decode(raw)[0].tolist()}
