"""Mixing sources to target weights by capped water-filling.

Every source asks for its share of all words by weight; a source whose share exceeds `epochs` times its own words is
clamped there and the excess goes to the others in proportion to their weights, until no source is above its clamp.
A source's target is then met by whole repetitions of all its documents and a fractional one: documents in a seeded
hash order up to the words still wanted, the last of them in part.

Defined results: a null source is a source of its own and comes last; null and empty texts have size 0 and are taken 0
times; every row is mixed by itself, repeated ones too, and rows with null ids as well.  Documents that tie in the hash
order have the same id and are told apart by size; rows equal in both are interchangeable.  Other columns, whatever their
names, pass through `mixed`.  Without rows the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.llm.common import durable, positions, running

WEIGHTS = (5, 2, 1)
EPOCHS = 3


def words(text: Column) -> Column:
    """Number of maximal runs of bytes that are not ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes: source, source_size.  Adds sid (rank of the source, null last) and target.

    Sources are clamped in the order of limit to weight, so one running sum finds the first that the rest of the words,
    poured by weight, don't overfill; it and all after it are poured.  Exact integers until the last division.
    """
    s = positions(sizes, [F.col("source").asc_nulls_last()], "sid")
    w = F.element_at(F.lit(list(weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("long")
    s = s.withColumn("weight", w).withColumn("limit", F.col("source_size") * epochs)
    s = running(s, [F.col("limit") / F.col("weight"), "sid"], {"clamped": "limit", "passed": "weight"})
    whole = s.agg(F.sum("source_size"), F.sum("weight")).first()
    left, among = F.lit(whole[0] or 0) - F.col("clamped"), F.lit(whole[1] or 0) - F.col("passed")
    wide = lambda c: c.cast("decimal(38,0)")
    fits = wide(F.col("weight")) * wide(left) <= wide(F.col("limit")) * wide(among)
    first = s.where(fits).agg(F.min("passed").alias("at"), F.min_by(left, "passed").alias("left"), F.min_by(among, "passed").alias("among")).first()
    clamped = F.col("limit").cast("double")
    poured = (F.col("weight") * F.lit(first["left"])).cast("double") / F.lit(first["among"]).cast("double") if first["among"] else clamped
    return s.select("source", "source_size", "sid", F.when(F.col("passed") >= F.lit(first["at"]), poured).otherwise(clamped).alias("target"))


def hashed(rows: DataFrame, seed: str) -> DataFrame:
    """rows (doc_id and more) with the seeded hash _h and its first 8 and next 12 bits."""
    rows = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("_b1", F.conv(F.substring("_h", 1, 2), 16, 10).cast("int"))
    return rows.withColumn("_b2", F.conv(F.substring("_h", 3, 3), 16, 10).cast("int"))


def cuts(sized: DataFrame, seed: str, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """sized: written rows of doc_id, size, source.  One row a source: where its seeded order is cut.

    The cut is found without bringing a source together: words are summed by the first 8 bits of the hash, then within the
    one part that holds the cut by the next 12.
    """
    by = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    by = by.withColumn("whole", whole)
    left = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long")
    by = durable(by.withColumn("left", left), "mix")

    def cut(rows: DataFrame, bucket: str, wanted: str, n: int) -> DataFrame:
        """The part of each source where its running sum reaches what is wanted, and what is wanted of it."""
        sums = rows.groupBy("sid", bucket).agg(F.sum("size").alias("n"), F.max(wanted).alias("w"))
        before = F.sum("n").over(Window.partitionBy("sid").orderBy(bucket)) - F.col("n")
        at = sums.withColumn("before", before).where("before < w and before + n >= w")
        return at.select("sid", F.col(bucket).alias(f"at{n}"), (F.col("w") - F.col("before")).alias(f"w{n}"))

    d = hashed(sized, seed)
    d = d.join(by.select(F.col("source").alias("_source"), "sid", "left"), d["source"].eqNullSafe(F.col("_source")))
    first = durable(cut(d, "_b1", "left", 1), "mix")
    inside = d.join(first, "sid").where("_b1 = at1")
    by = by.join(first, "sid", "left").join(cut(inside, "_b2", "w1", 2), "sid", "left")
    return durable(by.select(F.col("source").alias("_source"), "sid", "source_size", "target", "whole", "at1", "at2", "w2"), "mix")


def mixed(docs: DataFrame, doc_id: Column, size: Column, source: Column, seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, sized: DataFrame | None = None) -> DataFrame:
    """sized: doc_id, size and source of docs, if they are written already.  Columns: doc (a struct of all of docs), doc_id, size, source, source_size, target, taken.

    A row's place before or after its source's cut is read off its own hash; only rows whose 20 bits are the cut's own are
    put in order, by ranges.  Rows with their texts are joined to one row a source, and otherwise stay where they are.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), doc_id.cast("long").alias("doc_id"), size.alias("size"), source.alias("source"))
    by = cuts(sized or durable(rows.select("doc_id", "size", "source"), "sizes"), seed, weights, epochs)
    d = hashed(rows, seed)
    d = d.join(by, d["source"].eqNullSafe(F.col("_source")))
    here = F.coalesce((F.col("_b1") == F.col("at1")) & (F.col("_b2") == F.col("at2")), F.lit(False))
    before = (F.col("_b1") < F.col("at1")) | ((F.col("_b1") == F.col("at1")) & (F.col("_b2") < F.col("at2")))
    out = ["doc", "doc_id", "size", "source", "source_size", "target"]
    taken = lambda x: (F.col("whole") * F.col("size") + x).cast("long").alias("taken")
    last = running(d.where(here), ["sid", "_h", "doc_id", "size"], {"_run": "size"})
    start = last.groupBy("sid").agg(F.min("_run").alias("_start"))
    last = last.join(start, "sid")
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("w2") - (F.col("_run") - F.col("_start"))))
    rough = F.when(F.coalesce(before, F.lit(False)), F.col("size")).otherwise(0)
    return d.where(~here).select(*out, taken(rough)).union(last.select(*out, taken(part)))


def mix(docs: DataFrame, seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """docs: doc_id, size, source.  Returns doc_id, size, source, source_size, target, taken."""
    sized = durable(docs.select("doc_id", "size", "source"), "sizes")
    found = mixed(sized, F.col("doc_id"), F.col("size"), F.col("source"), seed, weights, epochs, sized)
    return found.select("doc_id", "size", "source", "source_size", "target", "taken")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs.select("doc_id", words(F.col("text")).alias("size"), "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k,
         CAST(sum(source_size) OVER () AS BIGINT)
           - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS num,
         CAST(sum(w) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS den
  FROM s),
f AS (SELECT num, den, k FROM o WHERE w * num <= 3 * source_size * den ORDER BY k LIMIT 1),
t AS (
  SELECT o.source, o.source_size,
         CASE WHEN f.k IS NULL OR o.k < f.k THEN CAST(3 * o.source_size AS DOUBLE)
              ELSE CAST(o.w * f.num AS DOUBLE) / CAST(f.den AS DOUBLE) END AS target
  FROM o LEFT JOIN f ON true),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
v AS (SELECT *, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) AS part FROM u),
r AS (
  SELECT d.doc_id, d.size, v.source_size, v.target, v.whole, v.part,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS run
  FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + least(size, greatest(0, part - run)) AS BIGINT) AS taken
FROM r
"""
