"""Language identification by prediction by partial matching (PPM).

For every language a tree of byte contexts of orders 0 to 3 is counted on a bounded sample of labelled rows and then
frozen.  A byte that the longest known context has seen costs -log2(n / (n + d)) bits, n being the context's count and d
the number of its different followers; otherwise an escape of -log2(d / (n + d)) bits is paid and the next shorter
context is asked, down to a uniform 1/256.  The exact code length of a text under each tree decides.  Small trees are
flattened into one automaton (longest context of any language -> row of costs), so that scoring is array lookups; larger
ones stay sorted lists of counted contexts, which are searched once for every different four bytes of a batch.  Both
give the same code lengths, and no context is left out.

Defined results: null text, empty text and text without a letter give `und` and score 0; ties go to the language first
by name; with no labelled row at all every text is `und`; repeated rows are scored each; other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ORDER = 3


@dataclass
class Tree:
    """One language's contexts: by order, codes and counts of grams, and of each context its total and different followers."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # byte -> symbol, 0 for bytes never seen
    size: int  # symbols
    trees: list[Tree]
    state: np.ndarray | None = None  # three symbols -> longest known context; None: the trees are searched
    cost: np.ndarray | None = None  # (state * size + symbol, language) -> bits; a last row of zeros


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in sorted keys, and whether it is there."""
    at = np.searchsorted(keys, wanted)
    there = at < len(keys)
    there[there] = keys[at[there]] == wanted[there]
    return at, there


def gram_bits(tree: Tree, grams: np.ndarray, a: int, order: int = ORDER) -> np.ndarray:
    """Bits of the last symbol of each gram after the `order` symbols before it, from the shortest context up."""
    p = np.full(len(grams), 1 / 256)
    for k in range(order + 1):
        keys, total, kinds = tree.contexts[k]
        at, known = _find(keys, grams // a % a**k)
        at = at[known]
        place, seen = _find(tree.grams[k][0], grams[known] % a ** (k + 1))
        count = np.where(seen, tree.grams[k][1][np.where(seen, place, 0)], 0) if len(place) else place
        whole = total[at] + kinds[at]
        p[known] = np.where(count > 0, count / whole, p[known] * (kinds[at] / whole))
    return -np.log2(p)


def fit(texts: dict[str, list[bytes]], cells: int = 12_000_000) -> Model:
    """texts: whole labelled texts by language.  cells: costs that an automaton may hold; larger models are searched."""
    langs = sorted(texts)
    if not langs:
        return Model([], np.zeros(256, np.int32), 1, [])
    seen = np.zeros(256, bool)
    seen[32] = True
    for t in (t for x in texts.values() for t in x):
        seen[np.frombuffer(t, np.uint8)] = True
    code = np.zeros(256, np.int64)
    code[seen] = np.arange(1, seen.sum() + 1)
    a = int(seen.sum()) + 1

    def tree(own: list[bytes]) -> Tree:
        flat = [code[np.frombuffer(b"   " + t, np.uint8)] for t in own]
        grams, contexts = [], []
        for n in range(1, ORDER + 2):  # n symbols of which the last is in the text itself
            rows = []
            for x in flat:
                k, at = len(x) - 3, np.zeros(len(x) - 3, np.int64)
                for j in range(n):
                    at = at * a + x[3 - n + 1 + j : 3 - n + 1 + j + k]
                rows.append(at)
            g, count = np.unique(np.concatenate(rows), return_counts=True) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))
            keys, first, kinds = np.unique(g // a, return_index=True, return_counts=True)
            grams.append((g, count))
            contexts.append((keys, np.add.reduceat(count, first) if len(first) else first, kinds))
        return Tree(grams, contexts)

    trees = [tree(texts[g]) for g in langs]
    known = [np.unique(np.concatenate([t.contexts[k][0] for t in trees])) for k in range(ORDER + 1)]
    known[0] = np.zeros(1, np.int64)
    model = Model(langs, code.astype(np.int32), a, trees)
    if sum(map(len, known)) * a * len(langs) <= cells:
        model.state, model.cost = _automaton(trees, known, a)
        model.trees = []
    return model


def _automaton(trees: list[Tree], known: list[np.ndarray], a: int) -> tuple[np.ndarray, np.ndarray]:
    """known: sorted contexts of any language by order.  A context that a language lacks costs what its suffix does."""
    first = np.cumsum([0, *map(len, known)])
    cost = np.zeros((first[-1] * a + 1, len(trees)), np.float32)
    for j, t in enumerate(trees):
        for k in range(ORDER + 1):
            grams = (known[k][:, None] * a + np.arange(a)).ravel()
            cost[first[k] * a : first[k + 1] * a, j] = gram_bits(t, grams, a, k)
    state = np.zeros((a, a, a), np.int32)
    for k in range(1, ORDER + 1):
        c = known[k]
        at = tuple(c // a**i % a for i in range(k - 1, -1, -1))
        state[(..., *at)] = np.arange(first[k], first[k] + len(c), dtype=np.int32)
    return state.ravel(), cost


def code_lengths(model: Model, texts: list[bytes], chunk: int = 1 << 20) -> np.ndarray:
    """(text, language) -> bits of the whole text.  Works on at most `chunk` bytes (or one piece of a text) at a time."""
    out = np.zeros((len(texts), len(model.langs)))
    run: list[bytes] = []
    whose: list[int] = []
    have = 0

    def flush() -> None:
        nonlocal have
        if run:
            x = model.code[np.frombuffer(b"".join(run), np.uint8)]
            at = (x[:-3] * model.size + x[1:-2]) * model.size + x[2:-1]
            if model.cost is not None:
                cost, at = model.cost, model.state[at].astype(np.int64) * model.size + x[3:]
            else:
                grams, at = np.unique(at.astype(np.int64) * model.size + x[3:], return_inverse=True)
                cost = np.stack([*(gram_bits(t, grams, model.size) for t in model.trees)], axis=1)
                cost = np.concatenate([cost, np.zeros((1, cost.shape[1]))])
            starts = np.cumsum([0, *map(len, run)])[:-1]
            for d in (-3, -2, -1):  # the three bytes of history before a piece cost nothing
                at[starts[1:] + d + 0] = len(cost) - 1
            bits = np.add.reduceat(cost[at], starts, axis=0, dtype=np.float64)
            np.add.at(out, whose, bits)
        run.clear(), whose.clear()
        have = 0

    for i, t in enumerate(texts):
        for s in range(0, len(t), chunk):
            run.append((b"   " if s == 0 else t[s - 3 : s]) + t[s : s + chunk])
            whose.append(i)
            have += len(run[-1])
            if have >= chunk:
                flush()
    flush()
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and its posterior probability (equal priors) of each text."""
    raw = [t.encode() if t and any(map(str.isalpha, t)) else b"" for t in texts]
    if not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    bits = code_lengths(model, raw)
    best = bits.argmin(1)
    with np.errstate(under="ignore"):
        score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
    return (
        [model.langs[b] if r else "und" for b, r in zip(best, raw, strict=True)],
        [float(s) if r else 0.0 for s, r in zip(score, raw, strict=True)],
    )


def sample(labelled: DataFrame, docs_per_lang: int = 400, most_chars: int = 65_536) -> dict[str, list[bytes]]:
    """Whole labelled texts by language: the docs_per_lang first by hash of doc_id, but for those over most_chars.

    This is the bound on what reaches the driver: rows, also where ids repeat.  labelled: doc_id, text, lang (not null).
    The ids are ranked without the texts, and only those whose hash is among the first of about four times as many as are
    wanted (all of a language where that was too few); only the chosen ids' texts are read.
    """
    spark = labelled.sparkSession
    h = F.md5(F.col("doc_id").cast("string"))
    ids = labelled.where("lang is not null").select("lang", "doc_id", h.alias("_h"), (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 2.0**32).alias("_u"))
    sizes = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    picked: set = set()
    todo = {g: min(1.0, 4 * docs_per_lang / n) for g, n in sizes.items()}
    while todo:
        few = ids.join(F.broadcast(spark.createDataFrame(list(todo.items()), "lang string, _share double")), "lang").where("_u < _share")
        ranked = few.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(f"_r <= {docs_per_lang}")
        rows = ranked.select("lang", "doc_id").collect()
        got = Counter(r["lang"] for r in rows)
        short = {g for g, u in todo.items() if u < 1 and got[g] < min(docs_per_lang, sizes[g])}
        picked |= {r["doc_id"] for r in rows if r["lang"] not in short}
        todo = dict.fromkeys(sorted(short), 1.0)
    out: dict[str, list[bytes]] = {}
    if picked:
        rows = labelled.where(F.col("doc_id").isin(sorted(picked)) & F.col("lang").isNotNull() & (F.length("text") <= most_chars))
        order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", F.xxhash64("text"))
        rows = rows.withColumn("_r", F.row_number().over(order)).where(f"_r <= {docs_per_lang}")
        for r in sorted(rows.select("lang", "doc_id", "text").collect(), key=lambda r: (r[0], r[1], r[2])):
            out.setdefault(r["lang"], []).append(r["text"].encode())
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with columns `pred` and `score` (which replace any of these names)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (pred, score)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            langs, scores = predict(shared.value, batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, pred, score])

    return docs.select(*keep).mapInArrow(run, schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame) -> Model:
    """Fitted on documents that aren't held out; only text and lang of those are looked at."""
    return fit(sample(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), trained(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")
