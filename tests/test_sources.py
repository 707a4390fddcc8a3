"""Files, byte codecs, store."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.sources import vectors as files
from nearfield.sources.store import Conflict, NotFound, OutOfOrder, Store


def test_prefixed_and_raw_files(spark, tmp_path):
    x = np.arange(20, dtype="<f4").reshape(5, 4)
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id long, vec array<float>")
    path = str(tmp_path / "a.bin")
    assert files.write(v, path) == 5
    assert [r["vec"] for r in files.read(spark, path).orderBy("id").collect()] == x.tolist()
    assert files.check(path) == {"count": 5, "dimensions": 4, "entry_width": 4.0, "even": True}
    raw = str(tmp_path / "b.bin")
    files.write(v, raw, header=False)
    assert [r["vec"] for r in files.read(spark, raw, dims=4).orderBy("id").collect()] == x.tolist()
    half = str(tmp_path / "c.bin")
    assert files.convert_f16(spark, raw, 4, half) == 5
    assert [r["vec"] for r in files.read(spark, half, "f16").orderBy("id").collect()] == x.tolist()
    (tmp_path / "bad").write_bytes(b"1234567")
    with pytest.raises(ValueError, match="header"):
        files.read(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="multiple"):
        files.read(spark, str(tmp_path / "bad"), dims=1)


def test_files_are_written_by_many_tasks(spark, tmp_path):
    """Shuffled rows, gaps and repeats among the ids; nothing is left of a file that can't be whole."""
    r = np.random.default_rng(5)
    ids = r.permutation(np.repeat(np.arange(0, 3000, 3), r.integers(1, 3, 1000)))
    v = spark.createDataFrame([(int(i), [float(i), -1.0, 0.5]) for i in ids], "id long, vec array<float>").repartition(7)
    assert files.write(v, str(tmp_path / "many")) == len(ids)
    got = [x["vec"][0] for x in files.read(spark, str(tmp_path / "many")).orderBy("id").collect()]
    assert got == sorted(map(float, ids))
    assert files.write(v.where("false"), str(tmp_path / "none")) == 0
    assert files.check(str(tmp_path / "none"))["count"] == 0
    for bad, message in (([1.0], "lengths"), (None, "no vector"), ([1.0, None, 2.0], "missing component")):
        with pytest.raises(Exception, match=message):
            files.write(v.union(spark.createDataFrame([(None, bad)], v.schema)), str(tmp_path / "bad"))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["many", "none"]


def test_neighbors_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART", 100)
    pair = np.dtype([("id", "<i8"), ("distance", "<f8")])
    x = np.array([(i, i / 8) for i in range(51)], pair)
    x.tofile(tmp_path / "n")
    got = files.read_neighbors(spark, str(tmp_path / "n"), 3).orderBy("qid", "rank").collect()
    assert [tuple(r) for r in got] == [(i // 3, i % 3 + 1, i, i / 8) for i in range(51)]
    with pytest.raises(ValueError, match="whole number"):
        files.read_neighbors(spark, str(tmp_path / "n"), 2)


def test_neighbors(spark, tmp_path):
    pair = np.dtype([("id", "<i8"), ("distance", "<f8")])
    np.array([(5, 0.5), (6, 0.75), (7, 0.1), (8, 0.2)], pair).tofile(tmp_path / "n")
    n = files.read_neighbors(spark, str(tmp_path / "n"), 2)
    assert [tuple(r) for r in n.orderBy("qid", "rank").collect()] == [(0, 1, 5, 0.5), (0, 2, 6, 0.75), (1, 1, 7, 0.1), (1, 2, 8, 0.2)]
    assert files.write_truth(n, str(tmp_path / "t")) == 2
    assert [tuple(r) for r in files.read_truth(spark, str(tmp_path / "t")).orderBy("qid", "rank").collect()] == [(0, 1, 5), (0, 2, 6), (1, 1, 7), (1, 2, 8)]


def test_generate(spark):
    a, b = (sorted(map(tuple, files.generate(spark, 20, 4, seed=s, parts=p).select("id").collect())) for s, p in ((1, 1), (1, 3)))
    assert a == b
    x = np.array([r["vec"] for r in files.generate(spark, 50, 4, "u8").collect()])
    assert x.min() >= 0 and x.max() <= 255


@settings(max_examples=50)
@given(st.sets(st.integers(-(2**40), 2**40)))
def test_edges_round_trip(ids):
    assert files.decode_edges(files.encode_edges(ids)) == sorted(ids)


def test_posting_block():
    b = files.PostingBlock(2)
    assert len(b) == 0 and b.serialize() == b""
    for i in (5, -3, 9):
        assert b.insert(i, bytes([i & 255, 1])) is None
    assert b.insert(5, b"zz") == bytes([5, 1])
    assert [i for i, _ in b] == [-3, 5, 9]
    c = files.PostingBlock(2, b.serialize())
    assert list(c) == list(b) and not c.dirty and c.get(5) == b"zz" and c.get(6) is None
    assert c.remove(9) == bytes([9, 1]) and c.remove(9) is None
    with pytest.raises(ValueError, match="length"):
        files.PostingBlock(2, b"123")


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.create("t", "k long, v string", {"a": 1})
    row = lambda *r: spark.createDataFrame(r, "k long, v string")
    with s.begin() as t:
        t.set("t", row((3, "c"), (1, "a"), (2, "b")))
    old = s.version()
    with s.begin() as t:
        assert t.meta("t") == {"a": 1}
        assert t.get("t", 2) == {"k": 2, "v": "b"} and t.get("t", 9) is None
        assert t.largest_key("t") == 3
        t.set("t", row((2, "B")))
        t.remove("t", row((1, "")).select("k"))
        assert t.get("t", 2)["v"] == "B"
        with pytest.raises(NotFound):
            t.remove("t", row((77, "")).select("k"))
    with s.begin(old) as t:
        assert [r["k"] for r in t.scan("t", ordered=True).collect()] == [1, 2, 3]
        assert [r["k"] for r in t.scan("t", 1, 3, False, True, ordered=True).collect()] == [2, 3]
        with pytest.raises(ValueError, match="bound"):
            t.scan("t", 3, 1)
    with pytest.raises(RuntimeError, match="stop"), s.begin() as t:
        t.set("t", row((50, "x")))
        raise RuntimeError("stop")
    a, b = s.begin(), s.begin()
    a.set("t", row((7, "x")))
    b.set("t", row((8, "y")))
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert sorted(r["k"] for r in s.begin().scan("t").collect()) == [2, 3, 7]
    assert s.statistics("t").first()["rows"] == 3
    s.bulk_load("u", row((1, "a"), (2, "b")), ordered=True)
    with pytest.raises(ValueError, match="exists"):
        s.bulk_load("u", row((1, "a")))
    with pytest.raises(OutOfOrder):
        s.bulk_load("w", row((2, "a"), (1, "b")).coalesce(1), ordered=True)
    s.drop("u")
    assert s.tables() == ["t"]
    with pytest.raises(NotFound):
        s.drop("u")
    s.drop("u", force=True)


def test_store_times(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.create("t", "k long, v string")
    row = lambda *r: spark.createDataFrame(r, "k long, v string")
    first = s.time()
    a = s.begin()
    a.set("t", row((1, "a")))
    a.commit(time=10)
    b = s.begin()
    b.set("t", row((1, "b")))
    with pytest.raises(ValueError, match="not after"):
        b.commit(time=10)
    b.commit(time=20)
    assert first < s.time(s.version() - 1) == 10 and s.time() == 20
    at = lambda t: [r["v"] for r in s.begin(time=t).scan("t").collect()]
    assert at(first) == [] and at(10) == at(19) == ["a"] and at(20) == at(99) == ["b"]
    with pytest.raises(NotFound):
        s.begin(time=-1)
    s.set_timestamps(oldest=12, stable=15)
    assert s.timestamps() == {"oldest": 12, "stable": 15} and s.time() == 21
    with pytest.raises(ValueError, match="oldest"):
        s.begin(time=11)
    with pytest.raises(ValueError, match="already"):
        s.set_timestamps(stable=14)
    with pytest.raises(ValueError, match="after stable"):
        s.set_timestamps(oldest=16)
    assert not [f for f in (tmp_path / "s" / "manifest").iterdir() if f.name.endswith(".tmp")]


def test_a_crash_before_the_rename_leaves_the_last_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.create("t", "k long, v string")
    (tmp_path / "s" / "manifest" / "0123.tmp").write_text("{half")
    assert s.tables() == ["t"] and s.version() == 1
