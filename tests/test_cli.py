"""Every command once, on a small file."""

import json

from nearfield.cli import main


def test_commands(spark, tmp_path, capsys):
    d = str(tmp_path)
    run = lambda *a: main(list(a), spark)
    run("generate", "--output", f"{d}/v", "--n", "80", "--dimensions", "8")
    run("compute-neighbors", "--vectors", f"{d}/v", "--queries", f"{d}/v", "--dims", "8", "--output", f"{d}/t", "--k", "10", "--query-limit", "6")
    run("data", "check", "--vectors", f"{d}/t")
    assert json.loads(capsys.readouterr().out) == {"count": 6, "dimensions": 10, "entry_width": 4.0, "even": True}
    run("data", "convert-f16", "--vectors", f"{d}/v", "--dims", "8", "--output", f"{d}/h")
    run("quantization", "rotate", "--vectors", f"{d}/h", "--kind", "f16", "--output", f"{d}/r")
    run("quantization", "loss", "--vectors", f"{d}/v", "--dims", "8", "--coding", "tlvq8")
    assert json.loads(capsys.readouterr().out)["error_ratio"] < 0.01
    run("flat", "init-index", "--index", f"{d}/flat", "--dimensions", "8", "--coding", "tlvq4")
    run("flat", "insert-vectors", "--index", f"{d}/flat", "--vectors", f"{d}/v", "--dims", "8")
    run("flat", "search", "--index", f"{d}/flat", "--queries", f"{d}/v", "--dims", "8", "--k", "20", "--recall-k", "5", "--neighbors", f"{d}/t")
    assert json.loads(capsys.readouterr().out.splitlines()[0])["recall"] > 0.9
    run("spann", "bulk-load", "--index", f"{d}/s", "--vectors", f"{d}/v", "--dims", "8", "--dimensions", "8", "--min-len", "4", "--max-len", "30", "--count", "60")
    run("spann", "insert-vectors", "--index", f"{d}/s", "--target", f"{d}/s2", "--vectors", f"{d}/v", "--dims", "8", "--start", "60")
    capsys.readouterr()
    run("spann", "search", "--index", f"{d}/s2", "--queries", f"{d}/v", "--dims", "8", "--selector", "vector_count:80", "--k", "1", "--num-rerank", "3")
    assert len(capsys.readouterr().out.splitlines()) >= 80
    run("spann", "centroid-stats", "--index", f"{d}/s2")
    run("spann", "export-head", "--index", f"{d}/s2", "--output", f"{d}/head")
    run("spann", "delete-sim", "--index", f"{d}/s2")
    run("vamana", "bulk-load", "--index", f"{d}/g", "--vectors", f"{d}/v", "--dims", "8", "--dimensions", "8", "--count", "60")
    run("vamana", "insert", "--index", f"{d}/g", "--target", f"{d}/g2", "--vectors", f"{d}/v", "--dims", "8", "--start", "60")
    capsys.readouterr()
    run("vamana", "check-reachability", "--index", f"{d}/g2")
    assert json.loads(capsys.readouterr().out)["unreachable"] == 0
    run("vamana", "lookup", "--index", f"{d}/g2", "--id", "70")
    assert json.loads(capsys.readouterr().out)["edges"]
    run("vamana", "search", "--index", f"{d}/g2", "--queries", f"{d}/v", "--dims", "8", "--record-limit", "10", "--k", "2")
    assert {json.loads(x)["id"] < 10 for x in capsys.readouterr().out.splitlines()} == {True}
    run("vamana", "search", "--index", f"{d}/g2", "--queries", f"{d}/v", "--dims", "8", "--k", "9", "--recall-k", "5", "--neighbors", f"{d}/t", "--warmup", "1", "--iterations", "2")
    rounds = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [r["iteration"] for r in rounds] == [0, 1]
    assert all(r["recall"] > 0.9 and r["ms_a_query"] > 0 and r["visited"] > 0 and r["queries"] >= 80 for r in rounds)
    run("spann", "search", "--index", f"{d}/s2", "--queries", f"{d}/v", "--dims", "8", "--k", "5", "--iterations", "1")
    assert json.loads(capsys.readouterr().out)["vectors_read"] > 80
    run("flat", "insert-vectors", "--index", f"{d}/flat", "--vectors", f"{d}/v", "--dims", "8", "--count", "10")
    assert spark.read.parquet(f"{d}/flat/codes").count() == spark.read.parquet(f"{d}/flat/codes").select("id").distinct().count() >= 80
    run("spann", "drop-index", "--index", f"{d}/s")
    assert not (tmp_path / "s").exists()
