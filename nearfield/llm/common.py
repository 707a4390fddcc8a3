"""Shared pieces of the training-data operators: durable tables, gapless positions, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.plans.durable import durable, scratch_root

__all__ = ["components", "durable", "partitions", "positions", "running", "scratch_root"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positions(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """df (made durable) with column `name`: each row's gapless position from 0 in the given order.

    One range shuffle; only one row count per partition reaches the driver.  Equal keys get any order, and may be dealt
    to several partitions.
    """
    n = max(1, partitions(df.sparkSession))
    keys = [*(F.col(c) if isinstance(c, str) else c for c in order), F.col("_tie")]
    part = df.withColumn("_tie", F.monotonically_increasing_id())
    part = part.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie")
    part = durable(part.withColumn("_mid", F.monotonically_increasing_id()), "pos")
    sizes = {
        r["p"]: r["n"]
        for r in part.groupBy(F.shiftright("_mid", 33).alias("p")).agg(F.count("*").alias("n")).collect()
    }
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    at = F.element_at(F.lit(starts or [0]).cast("array<bigint>"), (F.shiftright("_mid", 33) + 1).cast("int"))
    return part.withColumn(name, at + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid")


def running(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """df (made durable) with, by name, the sum of a long column over all rows before a row in the given order.

    Ranges of rows are summed by themselves, so no task holds more than one; only their totals reach the driver.
    """
    n = max(1, partitions(df.sparkSession))
    keys = [*(F.col(c) if isinstance(c, str) else c for c in order), F.col("_tie")]
    part = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys)
    part = durable(part.withColumn("_range", F.spark_partition_id()), "sums")
    totals = {r[0]: r for r in part.groupBy("_range").agg(*[F.sum(c).alias(name) for name, c in sums.items()]).collect()}
    before = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    for name, c in sums.items():
        starts, total = [], 0
        for i in range(max(totals, default=-1) + 1):
            starts.append(total)
            total += (totals[i][name] or 0) if i in totals else 0
        start = F.element_at(F.lit(starts or [0]).cast("array<bigint>"), F.col("_range") + 1)
        part = part.withColumn(name, start + F.coalesce(F.sum(c).over(before), F.lit(0)))
    return part.drop("_range", "_tie")


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(id, component) of every end of an edge: component is the smallest id reachable.

    Alternating large-star and small-star rounds; each round is a written table, and only its row count and a
    checksum reach the driver.  Null ends and loops are dropped.
    """
    e = (
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    e, seen = durable(e, "cc"), None
    for _ in range(most):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = durable(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
        )
        e = durable(small.distinct(), "cc")
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
