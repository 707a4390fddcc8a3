"""URL rules by a Bloom filter cascade, in DataFrame and SQL functions only.

A rule is (host, path, verdict); it fits a url if its host is the url's or a parent domain of it and the url's path
starts with its path, and the longest fitting rule decides.  A url's possible keys are therefore each host suffix with
each path prefix of a length that some rule has.  The first level of the cascade is a Bloom filter of the listed keys;
the second holds the keys of the whole corpus that pass the first without being listed; the third the listed keys that
pass the second; and so on until a level lets nothing wrong through.  Over this key universe the answer of the cascade
is exact, so membership needs no join: the filters are literals in the plan.

Every verdict has a cascade of its own, so the rule's verdict is membership too.  Filters are literals of checked size:
longer lists than `most` keys are dealt to parts by hash, and the pages pass over one part's cascades after the other.  The
keys that pass a first level are written once; where they are more than `most`, that level is made larger and built again.

rules: (host, path, verdict) as tuples or as a DataFrame with these columns.  Defined results: null urls and urls without `://` have empty host
and path; an empty host fits no rule; equal rules count once, and of rules with one key `block` wins; repeated rows
are judged each; no rows, no result.  A url that no rule fits gets the default verdict.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import durable

#: Fixed values of the contract: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All (host suffix + path prefix) strings of the url that a rule could be, longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffix = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", F.slice(labels, i, n)))
    cut = [F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]
    one = lambda s: F.filter(F.transform(F.array(*cut), lambda p: F.concat(s, p)), lambda x: x.isNotNull())
    every = F.array_distinct(F.flatten(F.transform(F.filter(suffix, lambda s: s != ""), one)))
    by = lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0).cast("int")
    return F.array_sort(every, by)


class Level:
    """One Bloom filter: words of 64 bits, as literals."""

    def __init__(self, words: list[int], hashes: int, salt: int) -> None:
        self.words, self.hashes, self.salt = words, hashes, salt

    @staticmethod
    def bits(key: Column, size: int, hashes: int, salt: int) -> list[Column]:
        a, b = (F.shiftrightunsigned(F.xxhash64(F.lit(s), key), 8) for s in (salt, salt + 1))
        return [(a + F.shiftrightunsigned(b, 8) * i) % size for i in range(hashes)]

    @classmethod
    def build(cls, listed: DataFrame, size: int, hashes: int, salt: int) -> Level:
        """listed: key.  At most size / 64 words reach the driver, however many keys there are."""
        at = listed.select(F.explode(F.array(*cls.bits(F.col("key"), size, hashes, salt))).alias("at"))
        word = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("m"))
        words = [0] * (size // 64)
        for r in word.collect():
            words[r["w"]] = r["m"]
        return cls(words, hashes, salt)

    def has(self, key: Column) -> Column:
        array = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to one literal
        test = lambda at: F.getbit(F.element_at(array, (F.floor(at / 64) + 1).cast("int")), (at % 64).cast("int")) == 1
        return reduce(lambda x, y: x & y, [test(at) for at in self.bits(key, 64 * len(self.words), self.hashes, self.salt)])


def _size(n: int, bits: float) -> int:
    return 64 * max(1, math.ceil(n * bits / 64))


class Cascade:
    """Exact membership of listed keys among all keys of a universe."""

    def __init__(self, listed: DataFrame, universe: DataFrame, bits: float = 12, later_bits: float = 8, most: int = 100_000) -> None:
        """listed, universe: key.  Only the few keys that pass the first level are held against the list."""
        self.levels: list[Level] = []
        listed = durable(listed.distinct(), "listed")
        n = listed.count()
        if n > most:
            raise ValueError(f"{n} listed keys: deal them to parts")
        salt = 1
        while n:
            first = Level.build(listed, _size(n, bits), max(1, round(bits * math.log(2))), salt)
            wrong = durable(universe.where(first.has(F.col("key"))).select("key").distinct().join(listed, "key", "left_anti"), "wrong")
            n = wrong.count()
            if n <= most:
                self.levels.append(first)
                break
            n, bits = listed.count(), bits + 6
        right = listed
        while n:  # wrong: keys that pass every level so far but should not
            salt += 2
            level = Level.build(wrong, _size(n, later_bits), max(1, round(later_bits * math.log(2))), salt)
            self.levels.append(level)
            right, wrong = wrong, durable(right.where(level.has(F.col("key"))).select("key").distinct(), "wrong")
            n = wrong.count()

    def has(self, key: Column) -> Column:
        """In level 1 and not (in level 2 and not (in level 3 ...))."""
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.has(key) & ~out
        return out


#: Verdicts that rules may have: each costs a cascade, and a scan of the urls to build it.
VERDICTS = 16


def judge(pages: DataFrame, rules: tuple | DataFrame = RULES, default: str = "allow", url: str = "url", bits: float = 12, most: int = 100_000) -> DataFrame:
    """pages with host, path, rule, verdict (which replace any of these names)."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    key = F.concat("host", "path")
    given = durable(rules.groupBy(key.alias("key")).agg(F.max("verdict").alias("verdict"), F.collect_set(F.length("path")).alias("lengths")), "rules")
    about = given.agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("lengths")))).alias("lengths"), F.count_distinct("verdict").alias("v")).first()
    if about["v"] > VERDICTS:
        raise ValueError(f"{about['v']} different verdicts; at most {VERDICTS}")
    names = {"host", "path", "rule", "verdict"}
    own = [F.col(f"`{c}`") for c in pages.columns if c not in names]
    host, path = host_path(F.col(f"`{url}`"))
    every = keys(host, path, about["lengths"][::-1])
    out = pages.select(F.struct(*own).alias("page"), host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), every.alias("keys"))
    parts = max(1, -(-about["n"] // most))
    at = F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(parts))
    for part in range(parts if about["n"] else 0):
        mine = given.where(at == part)
        universe = pages.select(F.explode(every).alias("key")).where(at == part)
        cascades = {r[0]: Cascade(mine.where(F.col("verdict") == r[0]).select("key"), universe, bits, most=most) for r in mine.select("verdict").distinct().orderBy("verdict").collect()}
        here = lambda x: F.pmod(F.xxhash64(F.lit(7), x), F.lit(parts)) == part  # noqa: B023, E731
        any_ = lambda x: reduce(lambda a, b: a | b, [c.has(x) for c in cascades.values()], F.lit(False))  # noqa: B023, E731
        found = F.get(F.filter("keys", (lambda x: here(x) & any_(x)) if parts > 1 else any_), F.lit(0))
        out = out.withColumn("new", found)
        better = F.coalesce(F.length("new") > F.length("rule"), F.col("new").isNotNull() & F.col("rule").isNull())
        said = reduce(lambda c, v: c.when(cascades[v].has(F.col("new")), v), cascades, F.when(F.lit(False), F.lit("")))
        out = out.withColumn("verdict", F.when(better, said).otherwise(F.col("verdict"))).withColumn("rule", F.when(better, F.col("new")).otherwise(F.col("rule")))
        if parts > 1:
            out = durable(out.drop("new"), "judged")
    return out.select("page.*" if own else F.lit(1), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
p AS MATERIALIZED (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(x, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, s, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                            ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (
  SELECT n, h || s AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(h || s) DESC) AS k
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON p.n = f.n AND f.k = 1
"""
