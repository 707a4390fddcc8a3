"""Command line: `python -m nearfield.cli GROUP COMMAND ...`.

Indexes are folders.  Vector files have a header unless --dims says they don't.  Every command that changes an index
writes a new folder or Parquet table and so is durable when it returns.
"""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.similarity import parse as parse_similarity
from nearfield.operators import coded, evaluate, exact, graph
from nearfield.operators import partitioned as P
from nearfield.plans.durable import durable
from nearfield.sources import vectors as files


def session() -> SparkSession:
    return SparkSession.builder.appName("nearfield").getOrCreate()


def load(spark: SparkSession, a: argparse.Namespace, name: str = "vectors") -> DataFrame:
    """Rows [start, start + count) of a vector file or of a Parquet table (id, vec)."""
    path = getattr(a, name)
    v = spark.read.parquet(path) if path.endswith(".parquet") else files.read(spark, path, a.kind, a.dims)
    start, count = getattr(a, "start", 0) or 0, getattr(a, "count", None)
    return v.where(F.col("id") >= start) if count is None else v.where(F.col("id").between(start, start + count - 1))


def show(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), default=str))


def report(run: Callable[[], DataFrame], a: argparse.Namespace, spark: SparkSession) -> None:
    """Search output: the rows, or with --iterations or a ground-truth file a line for every round of the driver."""
    truth = None
    if a.recall_k and a.neighbors:
        truth = files.read_truth(spark, a.neighbors)
        evaluate.check_k(truth, a.recall_k)
    if truth is None and not a.iterations:
        show(run().orderBy("qid", "rank"))
        return
    for row in evaluate.drive(run, truth, a.recall_k or 0, a.warmup, a.iterations or 1):
        print(json.dumps(row))


def drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# flat


def flat_init(spark: SparkSession, a: argparse.Namespace) -> None:
    spark.range(1).select(F.lit(json.dumps({"dims": a.dimensions, "similarity": parse_similarity(a.similarity), "coding": a.coding})).alias("value")).coalesce(1).write.text(f"{a.index}/meta")


def _meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def flat_insert(spark: SparkSession, a: argparse.Namespace) -> None:
    """Ids that are in the index already are replaced; an index is rewritten only then."""
    m, path = _meta(spark, a.index), f"{a.index}/codes"
    new = coded.encode(load(spark, a), m["coding"], m["dims"], m["similarity"])
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        old = spark.read.parquet(path)
        if not old.join(new.select("id"), "id", "left_semi").isEmpty():
            durable(old.join(new.select("id"), "id", "left_anti").select("id", "code").union(new), "codes").write.mode("overwrite").parquet(path)
            return
    new.write.mode("append").parquet(path)


def flat_search(spark: SparkSession, a: argparse.Namespace) -> None:
    m = _meta(spark, a.index)
    rows = spark.read.parquet(f"{a.index}/codes")
    report(lambda: coded.search(load(spark, a, "queries"), rows, a.k, m["coding"], m["dims"], m["similarity"]), a, spark)


# spann


def _config(a: argparse.Namespace) -> P.Config:
    return P.Config(a.dimensions, parse_similarity(a.similarity), a.coding, None if a.rerank_coding == "none" else a.rerank_coding, a.min_len, a.max_len)


def spann_bulk(spark: SparkSession, a: argparse.Namespace) -> None:
    P.bulk_load(load(spark, a), _config(a)).save(a.index)


def spann_init(spark: SparkSession, a: argparse.Namespace) -> None:
    P.empty(spark, _config(a)).save(a.index)


def spann_insert(spark: SparkSession, a: argparse.Namespace) -> None:
    index, passes = P.insert(P.Index.load(spark, a.index), load(spark, a), a.overwrite)
    index.save(a.target)
    print(json.dumps(passes))


def spann_search(spark: SparkSession, a: argparse.Namespace) -> None:
    index = P.Index.load(spark, a.index)

    def run() -> DataFrame:
        q = load(spark, a, "queries")
        found = P.search(index, q, a.k, a.selector, a.num_rerank)
        return found.join(P.search_stats(index, q, a.selector), "qid") if a.iterations or a.recall_k else found

    report(run, a, spark)


def spann_stats(spark: SparkSession, a: argparse.Namespace) -> None:
    i = P.Index.load(spark, a.index)
    n = P.stats(i.centroids, i.postings)
    show(P.balance(n, i.config.min_len, i.config.max_len))
    show(P.histogram(n).orderBy("low"))


def spann_export(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write(P.export_head(P.Index.load(spark, a.index)), a.output, header=False, id_="centroid_id")


def spann_rebalance(spark: SparkSession, a: argparse.Namespace) -> None:
    index, passes = P.rebalance(P.Index.load(spark, a.index), a.passes)
    index.save(a.target)
    print(json.dumps(passes))


def spann_delete_sim(spark: SparkSession, a: argparse.Namespace) -> None:
    i = P.Index.load(spark, a.index)
    d = P.delete_depth(i.postings.select("id", "centroid_id"), i.raw, i.centroids, a.beam, i.config.similarity)
    show(P.depth_report(d))
    show(P.diagnose(d, i.postings, i.centroids).groupBy("reason").count())


def index_drop(spark: SparkSession, a: argparse.Namespace) -> None:
    drop(spark, a.index)


# vamana


def _graph_config(a: argparse.Namespace) -> graph.Config:
    return graph.Config(a.dimensions, parse_similarity(a.similarity), a.coding, None if a.rerank_coding == "none" else a.rerank_coding, a.max_edges, a.max_alpha, a.alpha_scale, a.beam, directed=a.directed)


def save_graph(index: graph.Index, path: str) -> None:
    index.rows.write.mode("overwrite").parquet(f"{path}/rows")
    meta = json.dumps({"config": index.config.to_json(), "center": index.center, "shards": index.shards})
    index.rows.sparkSession.range(1).select(F.lit(meta).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_graph(spark: SparkSession, path: str) -> graph.Index:
    m = _meta(spark, path)
    return graph.Index(graph.Config.from_json(m["config"]), spark.read.parquet(f"{path}/rows"), m["center"], m["shards"])


def vamana_bulk(spark: SparkSession, a: argparse.Namespace) -> None:
    save_graph(graph.build(load(spark, a), _graph_config(a), a.rows_a_shard, a.center), a.index)


def vamana_init(spark: SparkSession, a: argparse.Namespace) -> None:
    save_graph(graph.Index(_graph_config(a), spark.createDataFrame([], graph.SCHEMA)), a.index)


def vamana_insert(spark: SparkSession, a: argparse.Namespace) -> None:
    save_graph(graph.mutate(load_graph(spark, a.index), load(spark, a)), a.target)


def vamana_search(spark: SparkSession, a: argparse.Namespace) -> None:
    keep = (lambda i: i < a.record_limit) if a.record_limit is not None else None
    index = load_graph(spark, a.index)
    report(lambda: graph.search(index, load(spark, a, "queries"), a.k, keep, num_rerank=a.num_rerank), a, spark)


def vamana_lookup(spark: SparkSession, a: argparse.Namespace) -> None:
    print(json.dumps(graph.lookup(load_graph(spark, a.index), a.id)))


def vamana_reachability(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = load_graph(spark, a.index).rows
    for e in rows.where("entry").select("shard", "id").collect():
        lost = graph.unreachable(rows.where(F.col("shard") == e["shard"]).select("id", "edges"), e["id"])
        print(json.dumps({"shard": e["shard"], "unreachable": lost.count(), "sample": [r[0] for r in lost.orderBy(F.xxhash64("id")).limit(10).collect()]}))


# others


def same_file(a: str, b: str) -> bool:
    """Whether two paths are one file, however they are written."""
    real = lambda p: p if "://" in p.removeprefix("file://") else os.path.realpath(p.removeprefix("file://"))
    return real(a) == real(b)


def neighbors(spark: SparkSession, a: argparse.Namespace) -> None:
    """The query's own id is left out only if both files are the same."""
    q = load(spark, a, "queries")
    q = q if a.query_limit is None else q.where(F.col("id") < a.query_limit)
    found = exact.search(q, load(spark, a), a.k, a.similarity, self_free=same_file(a.queries, a.vectors))
    files.write_truth(found, a.output)


def q_loss(spark: SparkSession, a: argparse.Namespace) -> None:
    v = load(spark, a)
    show(evaluate.coding_loss(v, a.coding, len(v.first()["vec"])))


def q_distance_loss(spark: SparkSession, a: argparse.Namespace) -> None:
    v, q = load(spark, a), load(spark, a, "queries")
    show(evaluate.distance_loss(q, v, a.coding, len(v.first()["vec"]), a.similarity, quantized=a.quantized))


def q_recall(spark: SparkSession, a: argparse.Namespace) -> None:
    v, q = load(spark, a), load(spark, a, "queries")
    truth = files.read_truth(spark, a.neighbors)
    evaluate.check_k(truth, a.recall_k)
    show(evaluate.coding_recall(q, v, truth, a.recall_k, a.k_mult, a.coding, len(v.first()["vec"]), a.similarity, a.centers))


def q_rotate(spark: SparkSession, a: argparse.Namespace) -> None:
    v = load(spark, a)
    files.write(coded.rotate(v, len(v.first()["vec"]), a.seed), a.output)


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write(files.generate(spark, a.n, a.dimensions, a.type, a.seed), a.output, {"f32-unit": "f32"}.get(a.type, a.type), header=False)


def convert_f16(spark: SparkSession, a: argparse.Namespace) -> None:
    files.convert_f16(spark, a.vectors, a.dims, a.output)


def convert_neighbors(spark: SparkSession, a: argparse.Namespace) -> None:
    files.write_truth(files.read_neighbors(spark, a.vectors, a.per_row), a.output)


def check(spark: SparkSession, a: argparse.Namespace) -> None:
    print(json.dumps(files.check(a.vectors, a.kind)))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="nearfield")
    groups = top.add_subparsers(dest="group", required=True)

    def arg(*names: str, **k: object) -> tuple:
        return names, k

    index, vecs, queries, out = arg("--index", required=True), arg("--vectors", required=True), arg("--queries", required=True), arg("--output", required=True)
    span = [arg("--start", type=int, default=0), arg("--count", type=int)]
    target = arg("--target", required=True, help="folder of the new version")
    sim = arg("--similarity", default="l2")
    code = arg("--coding", default="f32")
    found = [arg("--k", type=int, default=10), arg("--recall-k", type=int), arg("--neighbors"), arg("--warmup", type=int, default=0), arg("--iterations", type=int)]
    made = [arg("--dimensions", type=int, required=True), sim, code, arg("--rerank-coding", default="f32")]
    lists = [*made, arg("--min-len", type=int, default=192), arg("--max-len", type=int, default=512)]
    edges = [*made, arg("--max-edges", type=int, default=32), arg("--max-alpha", type=float, default=1.2), arg("--alpha-scale", type=float, default=1.2), arg("--beam", type=int, default=128), arg("--directed", action="store_true")]
    commands = {
        "flat": {
            "init-index": (flat_init, [index, arg("--dimensions", type=int, required=True), sim, code]), "drop-index": (index_drop, [index]),
            "insert-vectors": (flat_insert, [index, vecs, *span]), "search": (flat_search, [index, queries, *found]),
        },
        "spann": {
            "bulk-load": (spann_bulk, [index, vecs, *span, *lists]), "init-index": (spann_init, [index, *lists]),
            "insert-vectors": (spann_insert, [index, target, vecs, *span, arg("--overwrite", action="store_true")]),
            "search": (spann_search, [index, queries, *found, arg("--selector", default="top_n:8"), arg("--num-rerank", type=int, default=0)]),
            "centroid-stats": (spann_stats, [index]), "export-head": (spann_export, [index, out]),
            "rebalance": (spann_rebalance, [index, target, arg("--passes", type=int, default=10)]),
            "delete-sim": (spann_delete_sim, [index, arg("--beam", type=int, default=64)]), "drop-index": (index_drop, [index]),
        },
        "vamana": {
            "bulk-load": (vamana_bulk, [index, vecs, *span, *edges, arg("--center", action="store_true"), arg("--rows-a-shard", type=int, default=50_000)]),
            "search": (vamana_search, [index, queries, *found, arg("--record-limit", type=int), arg("--num-rerank", type=int)]),
            "init-index": (vamana_init, [index, *edges]), "drop-index": (index_drop, [index]), "lookup": (vamana_lookup, [index, arg("--id", type=int, required=True)]),
            "insert": (vamana_insert, [index, target, vecs, *span]), "check-reachability": (vamana_reachability, [index]),
        },
        "quantization": {
            "loss": (q_loss, [vecs, code]), "distance-loss": (q_distance_loss, [vecs, queries, code, sim, arg("--quantized", action="store_true")]),
            "recall": (q_recall, [vecs, queries, code, sim, arg("--neighbors", required=True), arg("--recall-k", type=int, default=10), arg("--k-mult", type=int, default=1), arg("--centers", type=int, default=0)]),
            "rotate": (q_rotate, [vecs, out, arg("--seed", type=int, default=42)]),
        },
        "data": {
            "convert-f16": (convert_f16, [vecs, out]), "convert-neighbors": (convert_neighbors, [vecs, out, arg("--per-row", type=int, default=100)]), "check": (check, [vecs]),
        },
        "compute-neighbors": (neighbors, [vecs, queries, out, sim, arg("--k", type=int, default=100), arg("--query-limit", type=int)]),
        "generate": (generate, [out, arg("--n", type=int, required=True), arg("--dimensions", type=int, required=True), arg("--type", default="f32-unit"), arg("--seed", type=int, default=42)]),
    }
    common = [arg("--kind", default="f32", choices=sorted(files.KINDS)), arg("--dims", type=int, help="stride of headerless files")]

    def put(p: argparse.ArgumentParser, f: object, args: list) -> None:
        for names, k in [*args, *common]:
            p.add_argument(*names, **k)
        p.set_defaults(run=f)

    for name, what in commands.items():
        g = groups.add_parser(name)
        if isinstance(what, tuple):
            put(g, *what)
        else:
            subs = g.add_subparsers(dest="command", required=True)
            for c, (f, args) in what.items():
                put(subs.add_parser(c), f, args)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or session(), a)


if __name__ == "__main__":
    main()
