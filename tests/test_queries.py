"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


from nearfield.queries import ORACLE, QUERIES  # noqa: E402

@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = db.sql(ORACLE[name])
    assert cols == sorted(want.columns)
    rows = want.select(",".join(f'"{c}"' for c in cols)).fetchall()
    assert sorted(tuple(map(plain, r)) for r in df.select(*cols).collect()) == sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_without_sql(spark, name):
    """Rows of a search: ten for every query, by rising distance; one row of recall; sizes of lists that hold all ids."""
    rows = QUERIES[name](spark, SF).collect()
    if "rank" in rows[0]:
        assert len(rows) == 100 and {r["qid"] for r in rows} == set(range(0, 500, 50))
        by = sorted(rows, key=lambda r: (r["qid"], r["rank"]))
        assert all(a["distance"] <= b["distance"] for a, b in zip(by, by[1:], strict=False) if a["qid"] == b["qid"])
    elif "recall" in rows[0]:
        assert rows[0]["recall"] > (0.5 if name in ("tlvq1_knn", "quiver_knn") else 0.8)
    else:
        assert sum(r["count"] for r in rows) == 500


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_of_the_loaded_index(spark):
    """Every fiftieth vector against brute force over all."""
    truth, found = ({(r["qid"], r["id"]) for r in QUERIES[name](spark, SF).collect()} for name in ("exact_knn_l2", "bulk_load_search"))
    assert len(truth & found) >= 0.9 * len(truth)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
