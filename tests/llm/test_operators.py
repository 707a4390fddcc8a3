"""Training-data operators on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from nearfield.llm import ans, common, kdshards, langid, media, mixing, packing, pivots, setsketch, urlfilter, warc
from nearfield.llm.queries import ORACLE, QUERIES
from nearfield.llm.tokens import encoder

EN = "the cat sat on the mat and the dog ran to the house of that man with the hat and then it was over for them"
DE = "der Hund und die Katze saßen auf der Matte und dann lief der Mann nicht mehr zu dem Haus mit der Uhr und schlief"


def texts():
    out = [None, "", " \n ", "123", EN, DE, EN, EN + " x", "é" * 5000, " ".join(f"w{i}" for i in range(6000)), EN.upper()]
    out += [f"{EN} {' '.join(f'k{i}{j}' for j in range(i))}" for i in range(20)]
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    t = texts()
    rows = [(i, x, "de" if x == DE else ("en" if x and "the" in x else None), f"s{i % 4}" if i % 5 else None, len(x or ""), "extra", 9) for i, x in enumerate(t)]
    rows.append(rows[4])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, bin int").write.parquet(f"{d}/documents.parquet")
    big = "<p>" + "x" * 2000
    pages = [(1, "http://A.example.org/es/1?x", big), (2, "https://example.org/en/12#a", big), (3, None, None), (4, "no scheme", ""), (5, "ftp://com/fr/", "y" * 90_000), (6, "http://b.com/de/2", "short"), (7, "http://x.net", "short"), (8, "http://", "é" * 40_000), (9, "http://notexample.org/es/", big), (5, "ftp://com/fr/", "y" * 90_000), (None, "http://org/", "z" * 3000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    r = np.random.default_rng(0)
    base = r.normal(size=(8, 16))
    vec = [(base[i % 8] + 0.03 * r.normal(size=16)).tolist() for i in range(80)]
    emb = [(i, v, i % 8 % 3) for i, v in enumerate(vec)] + [(90, vec[0], 0), (91, None, 0), (92, [0.0] * 16, 0), (93, vec[1], None), (94, [float("nan")] * 16, 0), (95, [*vec[0][:15], None], 0), (96, [1.0, 2.0], 0), (97, [], 0)]
    spark.createDataFrame(emb, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(spark, tables, tmp_path_factory):
    d = tmp_path_factory.mktemp("none")
    for t in ("documents", "pages", "embeddings"):
        spark.read.parquet(f"{tables}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    return str(d)


def docs(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op2_mix_water_filling", "op3_media_chunks", "op6_warc_segments", "op9_bloom_cascade"])
def test_sql(spark, tables, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, tables)
    cols = sorted(df.columns)
    want = c.sql(ORACLE[name]).select(",".join(f'"{x}"' for x in cols)).fetchall()
    assert Counter(map(str, map(tuple, df.select(*cols).collect()))) == Counter(map(str, want))


def test_language(spark, tables):
    rows = {r["doc_id"]: r for r in langid.op1(spark, tables).collect()}
    assert len(rows) == len(texts())
    for i, t in enumerate(texts()):
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (rows[i]["lang_pred"] == "und") == (not any(map(str.isalpha, t or "")))
        assert 0 <= rows[i]["score"] <= 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_language_of_held_out_documents(spark):
    """The label of every document is found from its text; held-out labels are never looked at."""
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in langid.op1(spark, sf).collect() if r["held_out"] and label[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(rows) > 200
    assert sum(r["lang_pred"] == label[r["doc_id"]] for r in rows) >= 0.99 * len(rows)


def brute_language(texts, t):
    """Smallest code length by counting contexts in dictionaries, and its share of the probability."""
    import math

    bits = {}
    for g, own in texts.items():
        seen = defaultdict(Counter)
        for x in own:
            y = b"   " + x
            for i in range(3, len(y)):
                for k in range(4):
                    seen[y[i - k : i], k][y[i]] += 1
        y, bits[g] = b"   " + t, 0.0
        for i in range(3, len(y)):
            p = 1.0
            for k in (3, 2, 1, 0):
                if c := seen.get((y[i - k : i], k)):
                    whole = sum(c.values()) + len(c)
                    if c[y[i]]:
                        p *= c[y[i]] / whole
                        break
                    p *= len(c) / whole
            else:
                p /= 256
            bits[g] -= math.log2(p)
    best = min(sorted(bits), key=bits.get)
    return best, 1 / sum(2.0 ** max(-1000.0, bits[best] - b) for b in bits.values())


def test_language_against_brute_force(spark, tables):
    learned = defaultdict(list)
    for r in docs(spark, tables).collect():
        if r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            learned[r["lang"]].append(r["text"].encode())
    rows = {r["doc_id"]: r for r in langid.op1(spark, tables).collect()}
    for i, t in enumerate(texts()):
        if any(map(str.isalpha, t or "")) and len(t) < 6000:
            lang, score = brute_language(learned, t.encode())
            assert rows[i]["lang_pred"] == lang and rows[i]["score"] == pytest.approx(score, abs=1e-4)


def test_sample_is_bounded_where_ids_repeat(spark):
    d = spark.range(500).selectExpr("id % 2 AS doc_id", "concat('text ', id) AS text", "if(id % 5 = 0, 'a', 'b') AS lang")
    got = langid.sample(d, docs_per_lang=7)
    assert {g: len(x) for g, x in got.items()} == {"a": 7, "b": 7}
    assert langid.sample(d, docs_per_lang=7) == got


def test_mix_properties(spark, tables):
    d = docs(spark, tables).select("doc_id", mixing.words(mixing.F.col("text")).alias("size"), "source")
    rows = mixing.mix(d).collect()
    assert len(rows) == len(texts()) + 1
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 1
    assert sorted(map(str, mixing.mix(d).collect())) == sorted(map(str, rows))


def test_media(spark, tables):
    """Against a file written by the standard library, and features in plain Python; chunks from the store's own lists."""
    import io
    import math
    import wave
    from decimal import ROUND_HALF_UP, Decimal

    d = docs(spark, tables)
    recipe = common.durable(media.recipes(d))
    trained = media.dictionary(d)
    stored = {r["digest"]: r for r in media.store(d, recipe, trained).collect()}
    lists = {r["media"].hex(): r["digests"] for r in recipe.collect()}
    assert any(lists.values())
    assert set(stored) == {x for m, y in lists.items() for x in (y or [bytes.fromhex(m)])}
    assert any(r["part"] for r in stored.values()) and any(r["whole"] for r in stored.values())
    rows = media.op3(spark, tables).collect()
    assert len(rows) == len(texts()) + 1
    for r in rows:
        raw = (texts()[r["doc_id"]] or "").encode()
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest())
        file = io.BytesIO()
        with wave.open(file, "wb") as w:
            w.setnchannels(1), w.setsampwidth(1), w.setframerate(media.RATE), w.writeframes(data)
        made = file.getvalue()
        assert (r["media_bytes"], r["media_sha256"]) == (len(made), hashlib.sha256(made).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(data[-64:])
        x = [b - 128 for b in data]
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        n = len(lists[r["media_sha256"]] or "1")
        mean, rms = (Decimal(v).quantize(Decimal("0.0001"), ROUND_HALF_UP) for v in (sum(x) / len(x), math.sqrt(sum(b * b for b in x) / len(x))))
        assert r["feature"] == f"mean={mean} rms={rms} turns={turns} chunks={n}"


def test_media_with_a_lost_or_wrong_chunk(spark, tables):
    d = docs(spark, tables)
    recipe = common.durable(media.recipes(d))
    stored = media.store(d, recipe)
    with pytest.raises(Exception, match="can't be rebuilt"):
        media.read_back(stored.where("whole").union(stored.where("not whole").orderBy("digest").offset(1)), recipe).collect()
    with pytest.raises(Exception, match="does not match its digest"):
        wrong = stored.withColumn("digest", media.F.expr("if(whole, overlay(digest placing X'00' from 1), digest)"))
        media.read_back(wrong, recipe).collect()


def test_near_vectors(spark, tables):
    rows = {r["vec_id"]: r for r in pivots.op4(spark, tables).collect()}
    emb = {r["vec_id"]: r for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()}
    ok = {i: np.array(r["embedding"], float) for i, r in emb.items() if r["label"] is not None and r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])}
    want = {i: [j for j, y in ok.items() if j != i and emb[i]["label"] == emb[j]["label"] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93] for i, x in ok.items()}
    assert set(rows) == set(emb)
    for i, r in rows.items():
        assert r["n_links"] == len(want.get(i, []))
        seen, todo = {i}, [i]
        while todo:
            for j in want.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert r["component_id"] == min(seen) and r["kept"] == (i == min(seen))


def test_long_lists_are_cut_into_blocks(spark, tables):
    e = spark.read.parquet(f"{tables}/embeddings.parquet")
    assert sorted(map(tuple, pivots.link(e, block=5).collect())) == sorted(map(tuple, pivots.link(e).collect()))


def ids_of(text):
    return np.frombuffer(encoder().whole(text or "") + bytes(4), "<u4")


def test_token_files(spark, tables):
    d = docs(spark, tables)
    for segment in (100, ans.SEGMENT):
        rows = sorted(ans.read(ans.write(d, segment=segment)).collect(), key=lambda r: r["start"])
        at = 0
        assert [r["doc_id"] for r in rows] == sorted([*range(len(texts())), 4])
        for r in rows:
            i = ids_of(texts()[r["doc_id"]])
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(i), zlib.crc32(i.tobytes()))
            at += len(i)


def test_token_files_with_null_and_extreme_ids(spark):
    """Most rows share an id or have none; the smallest integer is an id like others."""
    rows = [(None, f"n {i}") for i in range(40)] + [(5, f"five {i}") for i in range(40)] + [(-(2**63), "low"), (2**63 - 1, None)]
    d = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, start int, tie int")
    got = sorted(ans.read(ans.write(d, segment=50)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 40 + [-(2**63)] + [5] * 40 + [2**63 - 1]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x := ids_of(t)), zlib.crc32(x.tobytes())) for i, t in rows)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False)) and got[0]["start"] == 0


def test_warc_files(spark, tables, tmp_path):
    a = warc.write(spark.read.parquet(f"{tables}/pages.parquet"), segment=1000)
    data = b"".join(r["record"] for r in a.orderBy("at").collect())
    (tmp_path / "a.warc").write_bytes(data)
    found = warc.read(warc.files(spark, str(tmp_path))).collect()
    assert len(found) == 11
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    for r in found:
        i = re.search(r"page:(\w+):", r["id"])[1]
        i = None if i == "None" else int(i)
        assert r["payload_digest"] == hashlib.sha1((html[i] or "").encode()).hexdigest()
        assert r["payload"] is None or r["payload"] == (html[i] or "").encode()


def test_warc_records_of_equal_rows(spark):
    """Every record has an id of its own, every revisit refers to a record that is there, also where rows repeat."""
    big, small = "<p>" + "ab " * 9000, "tiny"
    rows = [(1, "http://a", big)] * 150 + [(2, "http://a", big)] * 3 + [(2, "http://b", big), (1, "http://c", big), (3, None, small), (3, None, small), (4, "u", "q" * 1500), (None, "u", big), (None, "u", big)]
    d = spark.createDataFrame([(*r, "k", 7, 1) for r in rows], "page_id long, url string, html string, key string, n int, copies int")
    a = warc.write(d, segment=4000)
    heads = [h for r in a.collect() for h, _ in warc.parse(r["record"])]
    ids = [h["warc-record-id"] for h in heads]
    assert len(ids) == len(set(ids))
    assert {h["warc-refers-to"] for h in heads if "warc-refers-to" in h} <= {h["warc-record-id"] for h in heads if h["warc-type"] == "response"}
    found = warc.read(a).collect()
    got = Counter((r["type"], re.search(r"page:(\w+):", r["id"])[1], r["payload_digest"]) for r in found)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == {("revisit", "1", sha(big)): 151, ("response", "2", sha(big)): 4, ("response", "3", sha(small)): 2, ("response", "4", sha("q" * 1500)): 1, ("response", "None", sha(big)): 2}


def brute_groups(rows, k, least):
    sets = {i: s for i, t in rows if (s := shingle_set(t, k))}
    seen: dict = {i: i for i, _ in rows}

    def root(i):
        while seen[i] != i:
            i = seen[i]
        return i

    keys = list(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                seen[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}, {i: len(sets.get(i, ())) for i, _ in rows}


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("k", "least"), [(3, 85), (5, 80)])
def test_near_documents(spark, tables, k, least):
    groups, sizes = brute_groups(list(enumerate(texts())), k, least)
    rows = setsketch.near_duplicates(docs(spark, tables).select("doc_id", "text"), k, least).collect()
    assert len(rows) == len(texts()) + 1
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == (sizes[r["doc_id"]], groups[r["doc_id"]])


def test_bands_of_several_components_in_small_blocks(spark, monkeypatch):
    """Chains of near copies, whose ends are far apart: no link is lost, however small the blocks are."""
    import random

    r = random.Random(8)
    rows, n = [], 0
    for _ in range(3):
        words = [f"w{r.randrange(10**6)}" for _ in range(60)]
        for _ in range(40):
            words = words[:]
            words[r.randrange(60)] = f"w{r.randrange(10**6)}"
            rows.append((n, " ".join(words)))
            n += 1
    r.shuffle(rows)
    groups, _ = brute_groups(rows, 3, 85)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(setsketch.residual, "__defaults__", (3,))
    got = {r["doc_id"]: r["component_id"] for r in setsketch.near_duplicates(d, 3, 85).collect()}
    assert got == groups


def test_rows_of_a_large_group_go_to_few_blocks(spark, monkeypatch):
    """Near copies just below the limit, which stay apart: a row's copies don't grow with the group, and no link is lost."""
    import random

    r, most, counted = random.Random(5), {}, []
    written = setsketch.durable

    def count(df, tag="t", *more):
        out = written(df, tag, *more)
        if tag == "hopeful":
            counted.append(out.groupBy("key", "id").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(setsketch, "durable", count)
    monkeypatch.setattr(setsketch.residual, "__defaults__", (3,))
    for m in (40, 120):
        base, rows = [f"w{r.randrange(10**6)}" for _ in range(120)], []
        for i in range(m):
            words = base[:]
            for at in r.sample(range(120), 2 if i % 10 else 1 + i % 4):
                words[at] = f"w{r.randrange(10**6)}"
            rows.append((i, " ".join(words)))
        groups, _ = brute_groups(rows, 3, 90)
        assert 10 < len(set(groups.values())) < m
        got = {x["doc_id"]: x["component_id"] for x in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
        assert got == groups
        most[m] = counted.pop()
    assert max(most.values()) <= 8


def test_components(spark):
    e = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = dict(map(tuple, common.components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(31)} | {90: 90, 95: 90, 100: 90}


def test_packing(spark, tables):
    d = docs(spark, tables)
    rows = packing.packed(d).collect()
    check_packing(rows, [*enumerate(texts()), (4, texts()[4])])
    p = common.durable(packing.pieces(d).withColumn("uid", packing.F.monotonically_increasing_id()))
    few = packing.pack(p.select("uid", "length"), shard=8).join(p, "uid").collect()
    assert len(few) == len(rows)
    used = Counter()
    for r in few:
        used[r["bin"]] += r["length"]
    assert max(used.values()) <= 2048


def check_packing(rows, given, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in by.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity
    want = Counter()
    total = 0
    for i, t in given:
        ids = ids_of(t)
        total += len(ids)
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) % capacity or capacity) if k == 0 else capacity
            want[i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at, k = at + n, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert len(by) <= -(-total // capacity) + 2


def test_cascade_is_exact_with_tiny_filters(spark):
    from pyspark.sql import functions as F

    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key like '%7'")
    c = urlfilter.Cascade(listed, universe, bits=2, later_bits=3)
    assert len(c.levels) > 2
    assert universe.where(c.has(F.col("key"))).count() == listed.count()
    none = urlfilter.Cascade(listed.where("false"), universe)
    assert universe.where(none.has(F.col("key"))).count() == 0


def test_rules_of_any_list(spark, tables):
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    assert {r["rule"] for r in urlfilter.judge(pages, rules=()).collect()} == {None}
    got = {r["page_id"]: r["rule"] for r in urlfilter.judge(pages).collect()}
    wide = pages.withColumn("key", pages["url"]).withColumn("keys", pages["url"]).withColumn("new", pages["url"]).withColumn("page", pages["url"]).withColumn("rule", pages["url"])
    some = urlfilter.judge(wide)
    assert some.columns == ["page_id", "url", "html", "key", "keys", "new", "page", "host", "path", "rule", "verdict"]
    assert {r["page_id"]: r["rule"] for r in some.collect()} == got and all(r["key"] == r["url"] == r["page"] for r in some.collect())
    assert got[1] == "example.org/es/" and got[2] == "example.org/en/1" and got[9] == "org/" and got[6] == "com/de/" and got[5] == "com/fr/" and got[8] is None


def test_more_rules_than_a_filter_holds(spark):
    """Rules in parts, three verdicts, hosts and paths of every length, against looking at every rule of a url."""
    import random

    r = random.Random(6)
    rules = [(f"{a}.{b}", p, v) for a in "abcdefgh" for b in ("org", "com", "x.net") for p in ("/", "/a", "/ab/", "/b/c") if (v := r.choice(["allow", "block", "review", None]))]
    rules += [("org", "", "review"), ("x.net", "/a", "block"), ("x.net", "/a", "allow")]
    urls = [f"http://{'.'.join(r.choices('abcdefghwz', k=r.randrange(1, 4)))}.{r.choice(['org', 'com', 'x.net', 'net'])}{r.choice(['', '/', '/a', '/ab/', '/ab/c', '/b/cd', '/q'])}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    verdict = {}
    for h, p, v in sorted(rules, key=lambda x: x[2]):
        verdict[h + p] = v
    for most in (7, 100_000):
        for q in urlfilter.judge(pages, table, "none", bits=3, most=most).collect():
            fits = [h + p for h, p, _ in rules if (q["host"] == h or q["host"].endswith("." + h)) and q["path"].startswith(p)]
            best = max(fits, key=len, default=None)
            assert q["rule"] == best and q["verdict"] == verdict.get(best, "none")


def test_shards(spark, tables):
    rows = kdshards.op10(spark, tables).collect()
    assert len(rows) == len(texts()) + 1
    by, where = defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts()[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
        by[r["shard"]].append(r["slot"])
        where[t].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(len(s) == 1 for s in where.values())
    assert set(by) <= set(range(8))


def places(rows):
    """Place of each text along length, width and lines, in whole numbers, from the definition."""
    import math

    import xxhash

    raw = [(t or "").encode() for t in rows]
    value = [[math.log2(len(r) + 1.0) for r in raw], [(len(r) - len(r.decode())) / max(len(r), 1) for r in raw], [float(r.count(b"\n")) for r in raw]]
    top = (1 << 26) - 1
    out = []
    for v in value:
        low, high = min(v), max(v)
        scaled = [math.floor(min(1.0, max(0.0, (x - low) / ((high - low) or 1.0))) * top) for x in v]
        out.append([(s << 36) + (xxhash.xxh64_intdigest(r, seed=42) >> 28) for s, r in zip(scaled, raw, strict=True)])
    return np.array(out, float).T, np.array([len(r) + 1 for r in raw], float)


@pytest.mark.parametrize("kind", ["fixture", "many"])
def test_shards_are_a_tree_of_weighted_medians(spark, tables, kind):
    """Every split of the numbers in halves is a cut along the widest dimension, at the median but for one text's weight."""
    import random

    r = random.Random(9)
    given = [*texts(), texts()[4]] if kind == "fixture" else ["é" * r.randrange(9) + "x" * int(10 ** r.uniform(0, 3)) + "\n" * r.choice([0, 0, 0, 5]) for _ in range(3000)]
    d = docs(spark, tables).select("text") if kind == "fixture" else spark.createDataFrame([(t,) for t in given], "text string")
    d = d.select(mixing.F.monotonically_increasing_id().alias("doc_id"), "text")
    text = {q["doc_id"]: q["text"] for q in d.collect()}
    rows = kdshards.shards(d, leaves=8).collect()
    where, size = places([text[q["doc_id"]] for q in rows])
    shard = np.array([q["shard"] for q in rows])
    cuts = 0

    def look(at, first, leaves):
        nonlocal cuts
        if leaves == 1 or len(np.unique(where[at], axis=0)) < 2:
            assert (shard[at] == shard[at][0]).all()
            return
        left = at & (shard < first + leaves // 2)
        dim = int(np.argmax(where[at].std(0)))
        right = at & ~left
        if left.any() and right.any():
            assert where[left, dim].max() < where[right, dim].min()
            cuts += 1
        group = Counter()
        for w, s in zip(where[at, dim], size[at], strict=True):
            group[w] += s
        assert abs(size[left].sum() - size[at].sum() * (leaves // 2) / leaves) <= max(max(group.values()), 0.001 * size[at].sum())
        for side, start, n in ((left, first, leaves // 2), (right, first + leaves // 2, leaves - leaves // 2)):
            if side.any():
                look(side, start, n)

    look(np.ones(len(rows), bool), 0, 8)
    assert cuts >= 4


def test_many_shards(spark):
    """A thousand leaves: few parts a node in each round, and every leaf near the target."""
    from pyspark.sql import functions as F

    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w "), F.col("id")), (F.col("id") % 13 + 1).cast("int")).alias("text"))
    n = [r["n"] for r in kdshards.shards(d, leaves=700).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(n) == 700 and max(n) < 1.5 * sum(n) / 700


def test_shards_are_near_equal(spark):
    from pyspark.sql import functions as F

    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("é "), "id"), (F.col("id") % 37 + 1).cast("int")).alias("text"))
    n = [r["n"] for r in kdshards.shards(d, leaves=8).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(n) == 8 and max(n) < 1.02 * min(n)
    small = kdshards.shards(d, target=sum(n) // 5).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(small) == 6


def test_pipeline(spark, tables, empty):
    import corpus_pipeline as C

    d = docs(spark, tables)
    named = C.language(spark, d, tables)
    assert named.columns == d.columns
    assert {r["doc_id"] for r in named.collect()} == {i for i, t in enumerate(texts()) if any(map(str.isalpha, t or ""))}
    kept = C.near_dedup(spark, named, tables)
    rows = [(i, t) for i, t in enumerate(texts()) if any(map(str.isalpha, t or ""))]
    groups, _ = brute_groups(rows, 5, 80)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if groups[i] == i}
    mixed = C.mix(spark, kept, tables)
    assert mixed.columns == d.columns
    sized = kept.select("doc_id", mixing.words(kept["text"]).alias("size"), "source")
    want = Counter({r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(sized).collect() if r["size"] and r["doc_id"] != 4})
    got = Counter(r["doc_id"] for r in mixed.collect() if r["doc_id"] != 4)
    assert got == +want
    packed = C.pack(spark, common.durable(mixed), tables).collect()
    check_packing(packed, [(r["doc_id"], r["text"]) for r in mixed.collect()])
    assert C.run(spark, tables).count() == len(packed)
    assert C.run(spark, empty).count() == 0


def test_near_dedup_goes_by_row(spark):
    import corpus_pipeline as C

    one, two = (" ".join(f"{w}{i}" for i in range(30)) for w in "ab")
    other, third = (" ".join(f"{w}{i}" for i in range(30)) for w in "cd")
    rows = [(1, one), (2, one), (2, two), (3, other), (3, other), (None, other), (None, third), (None, third), (4, ""), (5, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, C.near_dedup(spark, d, "").collect()), key=repr)
    assert got == sorted([(1, one), (2, two), (3, other), (None, third), (4, ""), (5, None)], key=repr)


def test_stages_keep_rows_and_columns_of_any_name(spark):
    """Names that the stages use themselves, equal rows and null ids: no value is replaced, no row's words are lost."""
    import corpus_pipeline as C

    names = ["_n", "_k", "_times", "_id", "_size", "_source", "_row", "_group", "_lang", "_score", "row", "doc", "size", "target", "taken", "lang_pred", "score", "times", "sid", "n", "_tie"]
    some = [" ".join(f"{w}{i}" for i in range(20)) for w in ("ka", "lo", "mi", "nu", "pe")]
    rows = [(i if i % 3 else None, t, "en" if i % 2 else None, f"s{i % 2}") for i, t in enumerate(some * 8)]
    d = spark.createDataFrame([(*r, *(f"{n}{k}" for n in names)) for k, r in enumerate(rows)], ", ".join(["doc_id long, text string, lang string, source string", *(f"`{n}` string" for n in names)]))
    own = {r["_n"]: tuple(r[n] for n in names) for r in d.collect()}
    named = C.language(spark, d, "").collect()
    assert len(named) == len(rows) and {r["lang"] for r in named} == {"en"}
    kept = C.near_dedup(spark, d, "").collect()
    assert len(kept) == len(some) and all(r["doc_id"] is not None for r in kept)
    mixed = C.mix(spark, d, "").collect()
    words = Counter(r["source"] for r in mixed)
    want = {r["source"]: r["target"] for r in mixing.mix(d.select("doc_id", mixing.words(mixing.F.col("text")).alias("size"), "source")).collect()}
    for s, n in words.items():
        assert abs(20 * n - want[s]) <= 20
    for out in (named, kept, mixed):
        assert all(tuple(r[n] for n in names) == own[r["_n"]] for r in out)
        assert all(list(r.asDict()) == d.columns for r in out)


def test_mix_of_many_rows_under_one_id(spark):
    """A third of all rows without an id: their words are cut in one place, exactly."""
    d = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "id % 7 AS size", "if(id % 5 = 0, 'a', 'b') AS source", "id AS extra")
    rows = mixing.mix(d).collect()
    assert len(rows) == 3000 and Counter(r["doc_id"] for r in rows)[None] == 1000
    for s in "ab":
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        whole = mine[0]["target"] // mine[0]["source_size"]
        assert sum(0 < r["taken"] - whole * r["size"] < r["size"] for r in mine) <= 1


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Rounds of clamping, as the definition has them."""
    from fractions import Fraction

    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    clamped: set = set()
    while True:
        left, among = sum(sizes.values()) - epochs * sum(sizes[s] for s in clamped), sum(weight[s] for s in order if s not in clamped)
        over = {s for s in order if s not in clamped and Fraction(left * weight[s], among) > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in clamped else float(Fraction(left * weight[s], among)) for s in order}
        clamped |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_against_rounds_of_clamping(spark, seed):
    import random

    r = random.Random(seed)
    sizes = {f"s{i}": int(10 ** r.uniform(0, 5)) for i in range(40)} | {None: 17}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r["source"] for r in got} == set(want)
    assert all(r["target"] == pytest.approx(want[r["source"]], rel=1e-12) for r in got)
    assert any(r["target"] == 3 * r["source_size"] for r in got)


def test_language_without_labels_keeps_documents(spark):
    import corpus_pipeline as C

    d = spark.createDataFrame([(1, "some words", None), (2, "\n 12 \nß", None), (3, "12 -", None), (4, None, None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in C.language(spark, d, "").collect()) == [1, 2]
