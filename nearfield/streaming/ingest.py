"""Micro-batch ingest into a stored partitioned index: each batch is one insert and one new version of the folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators import partitioned as P


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders v<n> whose index is whole: the meta file is the last that is written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at) if s.isDirectory()]
    whole = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "meta/_SUCCESS"))
    return sorted(int(p.getName()[1:]) for p in names if p.getName()[:1] == "v" and p.getName()[1:].isdigit() and whole(p))


def latest(spark: SparkSession, path: str) -> P.Index:
    return P.Index.load(spark, f"{path}/v{versions(spark, path)[-1]}")


def ingest(stream: DataFrame, path: str, checkpoint: str, rebalance: bool = True, overwrite: bool = False) -> StreamingQuery:
    """stream: id, vec.  A batch adds to the newest version under path and is the next one.

    A version notes which stream (checkpoint) and batch it came from, so a batch that is run again after its version was
    finished changes nothing, and a new checkpoint folder goes on from the newest version.  As in insert(), an id that
    a batch holds twice or that is in the index is an error, unless overwritten.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = versions(spark, path)
        source = f"{checkpoint}#{epoch}"
        if any(spark.read.text(f"{path}/v{n}/source").first()[0] == source for n in at[-1:]):
            return
        index = P.Index.load(spark, f"{path}/v{at[-1]}")
        _save(P.insert(index, batch, overwrite=overwrite, bounds=rebalance)[0], f"{path}/v{at[-1] + 1}", source)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _save(index: P.Index, path: str, source: str) -> None:
    spark = index.postings.sparkSession
    spark.range(1).select(F.lit(source).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/source")
    index.save(path)


def start(index: P.Index, path: str) -> None:
    """Version 0, which the first batch adds to."""
    _save(index, f"{path}/v0", "start")
