"""Top-k by (distance, id): Spark keeps k rows of each group on both sides of the shuffle (WindowGroupLimit)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds the 1-based place in the group; -0.0 counts as 0.0 and NaN comes last."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def top_k(df: DataFrame, k: int, group: list[str] = ["qid"], order: list[str] = ["distance", "id"]) -> DataFrame:  # noqa: B006
    return ranked(df, group, order).where(F.col("rank") <= k)
