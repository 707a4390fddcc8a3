"""MinHash-style near-duplicates by SetSketch registers.

Words are runs of bytes that are not ASCII white space, A-Z lower-cased; a document's set holds its distinct shingles of
k words (with fewer words, all of them as one).  Each of 128 registers keeps the truncated logarithm, to base 1.001, of
the smallest of exponentially distributed hash values: registers of a union are the larger of each pair, and two
registers agree about as often as the sets' Jaccard similarity.  Bands of four register values propose pairs, a joint
maximum-likelihood estimate from the registers passes over hopeless ones, and every other pair is confirmed on full sets.

Equal sets are one class.  Confirmation goes in two steps, so that large groups never need all their pairs: first every
class against the smallest id of each of its bands; then, in bands that still hold several components, classes of
different components against each other, in blocks: registers alone tell which rows of a band have a hopeful partner in
it, and only these rows' texts are fetched.  A band's blocks are few and grow with it, so that a row goes to a bounded
number of them, up to a size that a task can hold.  A pair is looked at in the first band it shares only, what a block has
linked is one component from then on, and only links that join components leave it.

Shingles are named by 64-bit hashes and equal sets by two 64-bit sums of these.  Defined results: null, empty and blank
texts have an empty set and link with nothing; a row with a null id is returned alone with a null component; rows that
repeat an id are each judged by their own text, and sets named by the same smallest id are one node; no rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import components, durable

REGISTERS, BAND, BASE, RATE, TOP = 128, 4, 1.001, 20.0, 65_534
#: Rows of a block; the blocks of a kind that a band is cut into before its blocks grow instead; bytes of the largest block.
BLOCK, GRID, HELD = 1024, 4, 32 << 20
#: Bytes of a row that has no text: registers and numbers.
ROW = 2 * REGISTERS + 64
_RNG = np.random.Generator(np.random.PCG64(20_240_501))
_BYTE = _RNG.integers(1, 2**64, 256, np.uint64)
_ODD = _RNG.integers(0, 2**31, REGISTERS, np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _RNG.integers(0, 2**32, REGISTERS, np.uint32)
_STEP = 0x9E3779B97F4A7C15 & ~7 | 3  # 3 modulo 8
_UNSTEP = pow(_STEP, -1, 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), base, np.uint64)]).cumprod(dtype=np.uint64)[:n]


_UP, _DOWN = _powers(_STEP, 1 << 10), _powers(_UNSTEP, 1 << 10)


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if n > len(_UP):
        size = 1 << (n - 1).bit_length()
        _UP, _DOWN = _powers(_STEP, size), _powers(_UNSTEP, size)
    return _UP, _DOWN


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of data."""
    data = data.lower()
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    ink = (b != 32) & ((b < 9) | (b > 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ink, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _table(len(b) + 1)
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=run[1:])
    return _mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    w = word_hashes((text or "").encode())
    n = min(k, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, np.uint64(n))
    for j in range(n):
        h = _mix(h + w[j : len(w) - n + 1 + j])
    return np.unique(h)


def registers(sets: list[np.ndarray], chunk: int = 2048) -> np.ndarray:
    """(set, register) -> values from 0 (empty) to TOP + 1."""
    low = np.full((len(sets), REGISTERS), 2**32 - 1, np.uint32)
    for i, s in enumerate(sets):
        h = (s >> np.uint64(32)).astype(np.uint32)
        for a in range(0, len(h), chunk):
            x = (h[a : a + chunk, None] ^ _XOR) * _ODD
            low[i] = np.minimum(low[i], x.min(0))
    return truncate(low, np.array([len(s) for s in sets]))


def truncate(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    u = (low.astype(np.float64) + 0.5) / 2.0**32
    k = np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE))
    return np.where(n[:, None] > 0, np.clip(k, 0, TOP + 1), 0).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 101)


def estimate(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of rows of a and b, given set sizes, at the greatest joint likelihood on a grid."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = (na / np.maximum(na + nb, 1))[:, None]
    v = 1 - u
    j = np.minimum(_GRID[None, :], np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12)))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = np.maximum(p(u - v * j), 1e-9), np.maximum(p(v - u * j), 1e-9)
    score = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(np.maximum(1 - up - down, 1e-9))
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """doc_id, n (set size), s1 and s2 (which name the set), regs (binary), size (bytes of the text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            sets = [shingles(t.as_py(), k) for t in b.column(1)]
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            regs = registers(sets)
            with np.errstate(over="ignore"):
                s1 = [int(s.sum(dtype=np.uint64)) - 2**63 for s in sets]
                s2 = [int(_mix(s + np.uint64(99)).sum(dtype=np.uint64)) - 2**63 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary()), size],
                names=["doc_id", "n", "s1", "s2", "regs", "size"],
            )

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, regs binary, size long")


def bands(classes: DataFrame) -> DataFrame:
    """(band, key, id) of every band of four registers."""
    wide = 2 * BAND
    at = F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1))
    key = F.transform(at, lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * wide + 1, F.lit(wide))))
    return classes.select("id", F.posexplode(key).alias("band", "key"))


def confirm(pairs: DataFrame, texts: DataFrame, k: int, least: int) -> DataFrame:
    """Those of pairs (a, b) with 100 * intersection >= least * union, by full sets.  texts: id, text."""
    want = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    mine = durable(texts.join(want, "id", "left_semi"), "texts")
    # The leaf's text first: the center's, which many pairs share, is then joined without moving once for each.
    both = pairs.join(mine.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = both.join(mine.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last: tuple = (None, None)
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x = x.as_py()
                if last[0] != x:
                    last = (x, shingles(x, k))
                s, t = last[1], shingles(y.as_py(), k)
                inter = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(inter > 0 and 100 * inter >= least * (len(s) + len(t) - inter))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def classes_of(s: DataFrame) -> DataFrame:
    """One row per different non-empty set: id (the smallest), n, s1, s2, regs, size (of the longest text)."""
    one = s.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2")
    return one.agg(F.min("doc_id").alias("id"), F.min("regs").alias("regs"), F.max("size").alias("size"))


def near_duplicates(docs: DataFrame, k: int = 5, least: int = 80, text: str = "text") -> DataFrame:
    """docs: doc_id, text.  Returns doc_id, n_shingles, component_id, kept."""
    s = durable(sketches(docs, k, text), "sketch")
    c = durable(classes_of(s), "class")
    b = bands(c)
    full = b.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first")
    b = durable(b.join(full, "key"), "bands")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text"))
    stars = b.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    stars = durable(hopeful(stars, c, least), "stars")
    edges = durable(confirm(stars, texts, k, least), "edges")
    comp = durable(components(edges), "comp")
    comp = components(edges.union(durable(residual(b, c, comp, texts, k, least), "more")))
    named = c.join(comp, "id", "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("component_id"))
    out = s.join(named, ["n", "s1", "s2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


#: A pair goes on to confirmation if its estimate is at most so far below the limit: over six standard errors at 0.8.
MARGIN = 0.22


def hopeful(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose estimate isn't hopeless."""
    c = classes.select("id", "n", "regs")
    both = pairs.join(c.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
    both = both.join(c.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for x in batches:
            if not x.num_rows:
                continue
            regs = [np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5)]
            est = estimate(regs[0], x.column(2).to_numpy(), regs[1], x.column(3).to_numpy())
            yield x.select([0, 1]).filter(pa.array(est >= least / 100 - MARGIN))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def shared_counts(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of a sorted set with each of others."""
    ends = np.cumsum([len(o) for o in others])
    x = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, x), len(one) - 1)] == x
    return np.diff(np.concatenate([[0], np.cumsum(hit)[ends - 1]]))


class Pairs:
    """The rows of a pair of blocks and which of their pairs are still hopeful, judged by registers and set sizes."""

    def __init__(self, key: tuple, t, least: int) -> None:  # noqa: ANN001
        self.least, self.inside, self.band = least, key[1].as_py() == key[2].as_py(), t.column("band")[0].as_py()
        c, self.ids, self.n, comp = (t.column(x).to_numpy() for x in ("c", "id", "n", "component"))
        self.comp = comp.copy()
        self.regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        self.left, self.right = np.flatnonzero(c == key[1].as_py()), np.flatnonzero(c == key[2].as_py())

    def partners(self, r: int) -> np.ndarray:
        ids, n, regs, other = self.ids, self.n, self.regs, self.right
        other = other[(ids[other] > ids[r]) if self.inside else (ids[other] != ids[r])]
        other = other[self.comp[other] != self.comp[r]]
        other = other[100 * np.minimum(n[other], n[r]) >= self.least * np.maximum(n[other], n[r])]
        if len(other):
            bands_ = regs.view(np.uint64)
            other = other[(bands_[other] == bands_[r]).argmax(1) == self.band]
        if len(other):  # registers agree about as often as J
            other = other[(regs[other] == regs[r]).sum(1) >= REGISTERS * (self.least / 100 - MARGIN)]
        if len(other):
            est = estimate(np.broadcast_to(regs[r], (len(other), REGISTERS)), np.full(len(other), n[r]), regs[other], n[other])
            other = other[est >= self.least / 100 - MARGIN]
        return other


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """Those of rows (key, id, component, bytes and more) whose key has several components, without bytes, with c, the block
    that a row is in, and ij, the pairs of its key's blocks that it goes to.

    Rows of a key's largest component need not meet each other.  Where there are more than fit one block, they are dealt to
    `own` blocks that follow the `other` blocks of the rest, and go to each pair with one of those; the rest meet all.
    """
    n, size = F.count("*").alias("n"), F.sum("bytes").alias("bytes")
    sizes = rows.groupBy("key", "component").agg(n, size).groupBy("key").agg(F.max(F.struct("n", "component", "bytes")).alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts"))
    blocks = lambda n, size: F.greatest(F.least(F.ceil(n / block), F.lit(GRID)), F.ceil(size / HELD)).cast("int")
    few = (F.col("n") <= block) & (F.col("bytes") <= HELD)
    own = F.when(few, 0).otherwise(blocks(F.col("most.n"), F.col("most.bytes")))
    other = F.when(few, 1).otherwise(blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")))
    sizes = sizes.where("parts > 1").select("key", F.when(~few, F.col("most.component")).alias("large"), own.alias("own"), other.alias("other"))
    large, h = F.coalesce(F.col("component") == F.col("large"), F.lit(False)), F.xxhash64("id")
    at = rows.drop("bytes").join(sizes, "key")
    at = at.withColumn("c", F.when(large, F.col("other") + F.pmod(h, F.col("own"))).otherwise(F.pmod(h, F.col("other"))).cast("int"))
    every = F.sequence(F.lit(0), F.col("other") + F.when(large, F.lit(0)).otherwise(F.col("own")) - 1)
    ij = F.transform(every, lambda x: F.struct(F.least(x, F.col("c")).alias("i"), F.greatest(x, F.col("c")).alias("j")))
    return at.withColumn("ij", ij).drop("large", "own", "other")


def residual(b: DataFrame, classes: DataFrame, comp: DataFrame, texts: DataFrame, k: int, least: int, block: int = BLOCK) -> DataFrame:
    """Confirmed links (a, b) of classes that share a band but were in different components: enough to join all that links."""
    at = b.join(comp.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    at = durable(dealt(at.select("key", "band", "id", "component", F.lit(ROW).alias("bytes")), block), "mixed")
    full = classes.select("id", "n", "regs", "size").join(at, "id").withColumn("ij", F.explode("ij"))
    full = full.select("key", "ij.i", "ij.j", "band", "c", "id", "n", "component", "regs", "size")

    def hopeful_rows(key, t):  # noqa: ANN001, ANN202
        import pyarrow as pa

        p, live = Pairs(key, t, least), set()
        for r in p.left.tolist():
            other = p.partners(r).tolist()
            if other:
                live.update((r, *other))
        return t.take(pa.array(sorted(live), pa.int64())).select(lasting)

    def compare(key, t):  # noqa: ANN001, ANN202
        import pyarrow as pa

        p, text, sets = Pairs(key, t, least), t.column("text"), {}
        out: list[tuple[int, int]] = []

        def shingled(r: int) -> np.ndarray:
            if r not in sets:
                sets[r] = shingles(text[r].as_py(), k)
            return sets[r]

        for r in p.left.tolist():
            other = p.partners(r)
            for s in range(0, len(other), 64):
                some = other[s : s + 64]
                some = some[p.comp[some] != p.comp[r]]
                if not len(some):
                    continue
                own = shingled(r)
                sizes = np.array([len(shingled(o)) for o in some.tolist()])
                both = shared_counts(own, [shingled(o) for o in some.tolist()])
                for o in some[(both > 0) & (100 * both >= least * (len(own) + sizes - both))].tolist():
                    if p.comp[o] != p.comp[r]:
                        out.append((int(p.ids[r]), int(p.ids[o])))
                        p.comp[p.comp == p.comp[o]] = p.comp[r]
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    lasting = ["key", "band", "id", "n", "component", "regs", "size"]
    live = full.groupBy("key", "i", "j").applyInArrow(hopeful_rows, "key long, band int, id long, n long, component long, regs binary, size long")
    # A row may have partners in several blocks; its text goes to as many as the bytes of its band's hopeful texts ask for.
    live = durable(live, "hopeful").distinct().withColumn("bytes", F.col("size") + ROW).drop("size")
    live = dealt(live, block).join(texts, "id").withColumn("ij", F.explode("ij"))
    live = live.select("key", "ij.i", "ij.j", "band", "c", "id", "n", "component", "regs", "text")
    return live.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 3, 85)


def _sql(k: int, least: int, source: str = "documents") -> str:
    """Shingles by a 64-bit hash of their words; sets of equal content once, as pairs of different sets are what costs."""
    words = ", ".join(f"w[i + {j}]" for j in range(k))
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM {source}),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [hash(w)]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: hash({words})))) END AS g FROM d),
o AS (SELECT min(doc_id) AS id, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
u AS (SELECT id, n, unnest(g) AS x FROM o),
i AS (
  SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.id < b.id
  WHERE 100 * least(a.n, b.n) >= {least} * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
e AS (SELECT a, b FROM i WHERE 100 * n >= {least} * (na + nb - n)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT id, id AS dest FROM o UNION SELECT r.id, l.b FROM r JOIN l ON r.dest = l.a),
c AS (SELECT g, min(dest) AS component_id FROM r JOIN o ON o.id = r.id GROUP BY g)
SELECT doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       doc_id = coalesce(component_id, doc_id) AS kept
FROM s LEFT JOIN c ON s.g = c.g
"""


OP7_SQL = _sql(3, 85)
