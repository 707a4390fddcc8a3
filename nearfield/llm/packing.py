"""Best-fit packing by a grouping genetic algorithm (GGA).

Documents become token ids with an end id; only longer ones than a sequence are cut, the odd part first.  The pieces
are dealt to shards of a fixed size by hash, and each shard is packed by a GGA: a solution is a set of bins, a crossover
injects whole well-filled bins of one parent into the other, removes the bins that hold the same documents twice, and
places the displaced documents again by best fit.  Every shard is worked on by several islands (Spark tasks); after
each round an island's best solution migrates to the next island of its shard, and in the end the best of a shard is
taken.  A shard that meets the lower bound (its tokens over the capacity, rounded up) is done at once.  What the
shards' emptiest sequences hold is packed again together, so that shards cost next to nothing.

Defined results: a null or empty text is the end id alone; rows that repeat an id give pieces each, numbered as their own
text's; null ids are packed too; no rows, no pieces.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import durable
from nearfield.llm.tokens import END, encoder

CAPACITY, SHARD, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 2048, 8192, 2, 2, 6, 4


class Room:
    """Bins by free space, with the tightest fit found through one integer of bits."""

    def __init__(self, capacity: int) -> None:
        self.by: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0

    def add(self, bin_: int, free: int) -> None:
        self.by[free].append(bin_)
        self.bits |= 1 << free

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least free space of at least size, removed; and that space."""
        m = self.bits >> size
        if not m:
            return None
        free = size + (m & -m).bit_length() - 1
        b = self.by[free].pop()
        if not self.by[free]:
            self.bits &= ~(1 << free)
        return b, free


def best_fit(items: list[int], size: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """bins, with items (longest first) put where they fit tightest."""
    bins = [list(b) for b in bins]
    room = Room(capacity)
    for i, b in enumerate(bins):
        if (free := capacity - sum(size[x] for x in b)) > 0:
            room.add(i, free)
    for x in sorted(items, key=lambda x: -size[x]):
        got = room.take(size[x])
        if got is None:
            got = len(bins), capacity
            bins.append([])
        bins[got[0]].append(x)
        if got[1] > size[x]:
            room.add(got[0], got[1] - size[x])
    return bins


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: the sum of squared fills."""
    return -len(bins), sum((sum(size[x] for x in b) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    fill = [sum(size[x] for x in g) for g in b]
    full = [g for g, f in zip(b, fill, strict=True) if f == capacity] or [b[max(range(len(b)), key=fill.__getitem__)]]
    given = rng.sample(full, max(1, len(full) // 2))
    inside = {x for g in given for x in g}
    kept, loose = [], []
    for g in a:
        if inside.isdisjoint(g):
            kept.append(g)
        else:
            loose += [x for x in g if x not in inside]
    return best_fit(loose, size, given + kept, capacity)


def mutate(bins: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Empty the least full bin and a few others, and place their documents again."""
    order = sorted(range(len(bins)), key=lambda i: sum(size[x] for x in bins[i]))
    gone = {order[0], *rng.sample(range(len(bins)), min(len(bins), 4))}
    loose = [x for i in gone for x in bins[i]]
    rng.shuffle(loose)
    return best_fit(loose, size, [b for i, b in enumerate(bins) if i not in gone], capacity)


def evolve(size: list[int], capacity: int, seeds: list[list[list[int]]], rng: random.Random, generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    """The best solution found from `seeds` and from best fit over shuffled sizes."""
    items = list(range(len(size)))
    bound = -(-sum(size) // capacity)
    key = lambda s: fitness(s, size, capacity)
    pool = [*seeds, best_fit(items, size, [], capacity)]
    best = max(pool, key=key)
    if len(best) <= bound:
        return best
    while len(pool) < population:
        some = set(rng.sample(items, len(items) // 3))
        first = best_fit([x for x in items if x in some], size, [], capacity)
        pool.append(best_fit([x for x in items if x not in some], size, first, capacity))
    for _ in range(generations):
        children = []
        for _ in range(population // 2):
            a, b = rng.sample(pool, 2)
            children.append(mutate(crossover(a, b, size, capacity, rng), size, capacity, rng))
        pool = sorted([*pool, *children], key=key, reverse=True)[:population]
        if len(pool[0]) <= bound:
            break
    return pool[0]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(path)
        for b in batches:
            out: tuple = ([], [], [], [], [])
            for i, raw in zip(b.column(0).to_pylist(), enc.each(t.as_py() for t in b.column(1)), strict=True):
                raw = memoryview(raw + END)
                n, at, k = len(raw) // 4, 0, 0
                while at < n:
                    size = n % capacity or capacity if at == 0 else capacity
                    for o, v in zip(out, (i, k, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])), strict=True):
                        o.append(v)
                    at, k = at + size, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(sizes: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, rounds: int = ROUNDS, seed: int = 8, level: int = 0) -> DataFrame:
    """sizes: uid, length (1 to capacity).  Returns uid, bin long (any numbers), offset long."""
    shards = max(1, -(-sizes.count() // shard))
    s = sizes.select("uid", "length", F.pmod(F.xxhash64(F.lit(seed + level), "uid"), F.lit(shards)).alias("shard"))
    out = _shards(s, capacity, islands, rounds, seed + level)
    named = ["uid", (F.lit(level << 56) + F.col("shard") * 2**22 + F.col("bin")).cast("long").alias("bin"), "offset"]
    if shards == 1:
        return out.select(*named)
    # The emptiest sequence of every shard, again and together, in larger shards so that this ends.
    out = durable(out, "packed")
    fill = out.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    loose = fill.groupBy("shard").agg(F.min_by("bin", F.struct("fill", "bin")).alias("bin"))
    again = durable(out.join(loose, ["shard", "bin"], "left_semi").select("uid", "length"), "loose")
    rest = out.join(loose, ["shard", "bin"], "left_anti").select(*named)
    return rest.union(pack(again, capacity, 2 * shard, islands, rounds, seed, level + 1))


def _shards(s: DataFrame, capacity: int, islands: int, rounds: int, seed: int) -> DataFrame:
    """shard, uid, length, bin, offset: the best solution of each shard."""
    work = s.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("seed_bin", F.lit(None).cast("int"))
    work = work.withColumn("other_bin", F.lit(None).cast("int"))

    def run(key, t):  # noqa: ANN001, ANN202
        import pyarrow as pa

        shard, island, turn = key[0].as_py(), key[1].as_py(), key[2].as_py()
        t = t.sort_by([("length", "ascending"), ("uid", "ascending")])
        size = t.column("length").to_pylist()
        seeds = []
        for name in ("seed_bin", "other_bin"):
            bins: dict[int, list[int]] = {}
            for x, b in enumerate(t.column(name).to_pylist()):
                bins.setdefault(b, []).append(x)
            if None not in bins:
                seeds.append(list(bins.values()))
        best = evolve(size, capacity, seeds, random.Random(f"{seed}:{shard}:{island}:{turn}"))
        at, offset = [0] * len(size), [0] * len(size)
        for i, g in enumerate(best):
            run_ = 0
            for x in g:
                at[x], offset[x] = i, run_
                run_ += size[x]
        score = fitness(best, size, capacity)
        done = len(best) <= -(-sum(size) // capacity)
        n = t.num_rows
        return pa.table({
            "shard": t.column("shard"), "uid": t.column("uid"), "length": t.column("length"), "island": t.column("island"),
            "bin": pa.array(at, pa.int32()), "offset": pa.array(offset, pa.int64()), "bins": pa.array([-score[0]] * n, pa.int32()),
            "fill": pa.array([score[1]] * n, pa.float64()), "done": pa.array([done] * n, pa.bool_()),
        })

    schema = "shard long, uid long, length long, island int, bin int, offset long, bins int, fill double, done boolean"
    cols = ["shard", "uid", "length", "island", "seed_bin", "other_bin"]
    kept = None
    for turn in range(rounds):
        best = durable(work.select(*cols, F.lit(turn).alias("turn")).groupBy("shard", "island", "turn").applyInArrow(run, schema), "island")
        per = best.groupBy("shard", "island").agg(F.first("bins").alias("bins"), F.first("fill").alias("fill"), F.first("done").alias("done"))
        top = per.groupBy("shard").agg(F.min_by("island", F.struct("bins", -F.col("fill"), "island")).alias("island"), F.max("done").alias("all_done"))
        done = top.where("all_done" if turn < rounds - 1 else "true").select("shard", "island")
        got = best.join(done, ["shard", "island"]).select("shard", "uid", "length", "bin", "offset")
        kept = got if kept is None else kept.union(got)
        left = best.join(top.where("not all_done").select("shard"), "shard")
        if turn == rounds - 1 or left.isEmpty():
            break
        came = left.select("shard", "uid", ((F.col("island") + 1) % islands).alias("island"), F.col("bin").alias("other_bin"))
        work = left.withColumnRenamed("bin", "seed_bin").join(came, ["shard", "uid", "island"])
    return kept


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    p = durable(pieces(docs, path, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    b = pack(p.select("uid", "length"), capacity)
    return p.join(b, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
