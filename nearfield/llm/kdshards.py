"""Sharding by a k-d tree over metadata.

The rows are split again and again at the weighted median (by bytes) along the metadata dimension in which they are
widest, until a leaf holds the target bytes.  A median is found by histograms: each round sums weights in parts of every
open node, narrows the node's range to the part with the median, and stops when that part no longer matters.  Only sums
reach the driver, at most SUMS a round: with more open nodes each has fewer parts.  Coordinates are functions of the text, and ties along a dimension
are ordered by a hash of the text, so equal texts share a place in the order and are never parted.

Law: `bytes`.  Leaves are as near to equal as one group of equal texts allows.  Defined results: a null text weighs one
byte and lies with the empty texts; repeated rows are placed each, together; very long texts weigh what they weigh;
no rows, no result.  A node whose rows all share one place is a leaf even above the target; its missing siblings stay empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import durable, positions

#: Most parts of a node, most sums of a round, and the range of places.
PARTS, SUMS, SPAN = 4096, 1 << 18, 1 << 62
#: A part with at most this share of its node's weight is split no further: the cut is then off by no more.
FINE = 0.0005


class Tree:
    """Nodes in arrays.  An inner node has a dimension, a cut and two children; a row below the cut goes to the first."""

    def __init__(self, weight: int, leaves: int) -> None:
        self.dim, self.cut, self.child = [-1], [0], [0]
        self.weight, self.leaves, self.first = [weight], [leaves], [0]  # leaves still to come from a node, number of the first

    def split(self, node: int, dim: int, cut: int, below: int) -> tuple[int, int]:
        at, left = len(self.dim), self.leaves[node] // 2
        self.dim[node], self.cut[node], self.child[node] = dim, cut, at
        self.dim += [-1, -1]
        self.cut += [0, 0]
        self.child += [0, 0]
        self.weight += [below, self.weight[node] - below]
        self.leaves += [left, self.leaves[node] - left]
        self.first += [self.first[node], self.first[node] + left]
        return at, at + 1

    def walk(self) -> Callable[[np.ndarray], np.ndarray]:
        """places (row, dimension) -> the node that each row has come to."""
        dim, cut, child = (np.array(x, np.int64) for x in (self.dim, self.cut, self.child))

        def run(places: np.ndarray) -> np.ndarray:
            node, todo = np.zeros(len(places), np.int64), np.arange(len(places))
            while len(todo := todo[dim[node[todo]] >= 0]):
                n = node[todo]
                node[todo] = child[n] + (places[todo, dim[n]] >= cut[n])
            return node

        return run


def place(value: Column, low: float, high: float, text_hash: Column) -> Column:
    """Order along a dimension: 26 bits of the scaled value, then 36 of the text's hash."""
    top = (1 << 26) - 1
    scaled = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / ((high - low) or 1.0))) * top).cast("long")
    return F.shiftleft(scaled, 36) + F.shiftrightunsigned(text_hash, 28)


def summed(rows: DataFrame, dims: list[str], per_batch: Callable, names: list[str], keys: int, whole: bool = False) -> list:
    """What per_batch(places, weights) -> columns gives, over all rows, by the first `keys` of them: sums, or for names that
    start with low or high the least and the greatest (whole: all columns are integers)."""
    real = "long" if whole else "double"
    schema = ", ".join(f"{n} {'long' if i < keys else real}" for i, n in enumerate(names))
    how = lambda n: {"low": F.min, "high": F.max}.get(n.rstrip("0123456789"), F.sum)(n).alias(n)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                out = per_batch(np.stack([b.column(i).to_numpy() for i in range(1, b.num_columns)], axis=1), b.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if whole or i < keys else pa.float64()) for i, c in enumerate(out)], names=names)

    found = rows.select("weight", *dims).mapInArrow(run, schema)
    return found.groupBy(*names[:keys]).agg(*map(how, names[keys:])).collect()


def widths(rows: DataFrame, dims: list[str], walk: Callable, nodes: int) -> dict[int, list[float]]:
    """Standard deviation of the places of each node's rows along each dimension; 0 only where all share one place.

    First the ends of each node, then moments within them, so that narrow nodes lose nothing to rounding.
    """
    count = len(dims)

    def ends(places: np.ndarray, weights: np.ndarray) -> list:
        some, at = np.unique(walk(places), return_inverse=True)
        low, high = np.full((len(some), count), SPAN), np.zeros((len(some), count), np.int64)
        np.minimum.at(low, at, places)
        np.maximum.at(high, at, places)
        return [some, *low.T, *high.T]

    got = summed(rows, dims, ends, ["node", *(f"low{d}" for d in range(count)), *(f"high{d}" for d in range(count))], 1, whole=True)
    low, size = np.zeros((nodes, count), np.int64), np.ones((nodes, count), np.int64)
    for r in got:
        low[r["node"]] = [r[f"low{d}"] for d in range(count)]
        size[r["node"]] = [max(1, r[f"high{d}"] - r[f"low{d}"]) for d in range(count)]

    def moments(places: np.ndarray, weights: np.ndarray) -> list:
        node = walk(places)
        some, at = np.unique(node, return_inverse=True)
        x = (places - low[node]) / size[node]
        out = [np.bincount(at).astype(float)]
        for d in range(count):
            out += [np.bincount(at, x[:, d]), np.bincount(at, x[:, d] ** 2)]
        return [some, *out]

    names = ["node", "n", *(f"{m}{d}" for d in range(count) for m in ("s", "q"))]
    out = {}
    for r in summed(rows, dims, moments, names, 1):
        n, node = r["n"], r["node"]
        out[node] = [float(size[node, d]) * max(0.0, r[f"q{d}"] / n - (r[f"s{d}"] / n) ** 2) ** 0.5 for d in range(count)]
    return out


def tree(rows: DataFrame, dims: list[str], leaves: int) -> Tree:
    """rows: weight and, by dimension, a place in 0 to 2**62.  Level by level: all nodes of one at a time."""
    t = Tree(int(rows.agg(F.sum("weight")).first()[0] or 0), leaves)
    open_ = [0] if leaves > 1 else []
    while open_:
        walk = t.walk()
        wide = widths(rows, dims, walk, len(t.dim))
        # node -> [dimension, low, high, weight below low, wanted]; a dimension whose rows share one place can't be cut
        todo = {n: [int(np.argmax(wide[n])), 0, SPAN, 0, t.weight[n] * (t.leaves[n] // 2) / t.leaves[n]] for n in open_ if max(wide.get(n, [0.0])) > 0}
        cuts: dict[int, tuple[int, int, int]] = {}
        while todo:
            parts = max(16, min(PARTS, SUMS // len(todo)))
            size = len(t.dim)
            dim, low, high, step = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), np.ones(size, np.int64)
            for n, (d, lo, hi, _, _) in todo.items():
                dim[n], low[n], high[n], step[n] = d, lo, hi, max(1, -(-(hi - lo) // parts))

            def histogram(places: np.ndarray, weights: np.ndarray, walk=walk, dim=dim, low=low, high=high, step=step) -> list:  # noqa: ANN001
                node = walk(places)
                at = places[np.arange(len(places)), dim[node]]
                some = (high[node] > 0) & (at >= low[node]) & (at < high[node])
                node, at = node[some], at[some]
                part = (at - low[node]) // step[node]
                keys, back = np.unique(node * PARTS + part, return_inverse=True)
                return [keys // PARTS, keys % PARTS, np.bincount(back, weights[some], len(keys))]

            sums: dict[int, list] = {}
            for r in summed(rows, dims, histogram, ["node", "part", "w"], 2):
                sums.setdefault(r["node"], []).append((r["part"], int(r["w"])))
            for n in list(todo):
                d, lo, hi, below, wanted = todo[n]
                for part, w in sorted(sums[n]):
                    if below + w >= wanted:
                        break
                    below += w
                start, end = lo + part * int(step[n]), lo + (part + 1) * int(step[n])
                if step[n] == 1 or w <= FINE * t.weight[n]:
                    down = wanted - below > below + w - wanted  # the nearer end of the part
                    cuts[n] = (d, end, below + w) if down else (d, start, below)
                    del todo[n]
                else:
                    todo[n] = [d, start, end, below, wanted]
        open_ = [c for n, (d, cut, below) in cuts.items() for c in t.split(n, d, cut, below) if t.leaves[c] > 1]
    return t


def shards(docs: DataFrame, leaves: int | None = None, target: int | None = None, text: str = "text") -> DataFrame:
    """docs: doc_id, text.  Returns doc_id, size, text_crc32, shard, slot.  target: bytes of a leaf, if leaves isn't given."""
    raw = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(raw).cast("long")
    d = docs.select(
        F.col("doc_id").cast("long"), (size + 1).alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("_h"),
        F.log2(size + F.lit(1.0)).alias("_length"),
        ((size - F.length(raw)) / F.greatest(size, F.lit(1))).alias("_wide"),
        (F.length(raw) - F.length(F.regexp_replace(raw, "\n", ""))).cast("double").alias("_lines"),
    )
    dims = ["_length", "_wide", "_lines"]
    d = durable(d, "kd")
    r = d.agg(*[F.struct(F.min(x), F.max(x)).alias(x) for x in dims], F.sum("size").alias("size")).first()
    if r["size"] is None:
        return d.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    leaves = leaves or max(1, -(-r["size"] // target))
    d = durable(d.select("doc_id", "size", "text_crc32", F.col("size").alias("weight"), *[place(F.col(x), *map(float, r[x]), F.col("_h")).alias(x) for x in dims]), "kd")
    walk, first = (t := tree(d, dims, leaves)).walk(), np.array(t.first)

    def place_all(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            node = walk(np.stack([b.column(i).to_numpy() for i in range(3, b.num_columns)], axis=1)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(first[node], pa.int32())], names=["doc_id", "size", "text_crc32", "shard"])

    out = d.select("doc_id", "size", "text_crc32", *dims).mapInArrow(place_all, "doc_id long, size long, text_crc32 long, shard int")
    out = positions(out, ["shard", "doc_id"])
    starts = {x["shard"]: x["p"] for x in out.groupBy("shard").agg(F.min("pos").alias("p")).collect()}
    start = F.element_at(F.lit([starts.get(i, 0) for i in range(max(starts) + 1)]).cast("array<bigint>"), F.col("shard") + 1)
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("pos") - start).cast("long").alias("slot"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), leaves=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
