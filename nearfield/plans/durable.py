"""Cutting lineage with a written table in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where that is unset in local mode (tests), a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="nearfield-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = f"file://{folder}"
    return _OWN[app]


def durable(df: DataFrame, tag: str = "t", codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/nearfield-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
