"""Versioned key-value tables on Parquet: snapshots, transactions, point and range reads, bulk load.

A table is a folder of immutable snapshots; a manifest (one small JSON file per version) names the snapshot of every
table at that version, with the commit's time and the global timestamps.  A commit writes the new snapshots, then the next
manifest under a name of its own, and last renames it, which fails if the version is there already: of two writers that
started from one version the second gets Conflict, and a crash leaves no half-written version.

Times are integers that only rise.  A commit takes the time it is given or one after the last.  Readers may ask for the
newest version at or before a time.  The global timestamps are `oldest`, before which no reader may ask, and `stable`.
"""

from __future__ import annotations

import bisect
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NotFound(KeyError):
    pass


class Conflict(RuntimeError):
    pass


class OutOfOrder(ValueError):
    pass


class Store:
    def __init__(self, spark: SparkSession, path: str, create: bool = True) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._fs.exists(self._p(f"{self.path}/manifest")):
            if not create:
                raise NotFound(path)
            self._fs.mkdirs(self._p(f"{self.path}/manifest"))
            self._commit(-1, {}, 0, {})

    # Manifests

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._p(f"{self.path}/manifest")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        return max(self.versions(), default=-1)

    def _read(self, version: int) -> dict:
        rows = self.spark.read.text(f"{self.path}/manifest/{version:012d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def manifest(self, version: int | None = None) -> dict:
        """Entry of each table."""
        return self._read(self.version() if version is None else version)["tables"]

    def _commit(self, parent: int, tables: dict, time: int | None, marks: dict | None) -> int:
        """The version after parent.  time, marks: None for one after the last, and for the marks as they are."""
        last = self._read(parent) if parent >= 0 else {"time": -1, "marks": {}}
        if time is not None and time <= last["time"]:
            raise ValueError(f"time {time} is not after {last['time']}")
        body = {"tables": tables, "time": last["time"] + 1 if time is None else time, "marks": last["marks"] if marks is None else marks}
        folder = f"{self.path}/manifest"
        own, final = self._p(f"{folder}/{uuid.uuid4().hex}.tmp"), self._p(f"{folder}/{parent + 1:012d}.json")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(body), "utf-8"))
        out.close()
        sc = self.spark.sparkContext
        rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = sc._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration()).rename(own, final, how)
        except Exception as e:
            self._fs.delete(own, False)
            raise Conflict(f"version {parent + 1} exists") from e
        return parent + 1

    # Time

    def time(self, version: int | None = None) -> int:
        """When a version (the newest) was committed."""
        return self._read(self.version() if version is None else version)["time"]

    def timestamps(self) -> dict[str, int]:
        """oldest and stable, where they are set."""
        return self._read(self.version())["marks"]

    def set_timestamps(self, oldest: int | None = None, stable: int | None = None) -> None:
        """Timestamps never go back, and oldest is never after stable."""
        v = self.version()
        now = self._read(v)
        marks = dict(now["marks"])
        for name, t in (("oldest", oldest), ("stable", stable)):
            if t is not None:
                if t < marks.get(name, t):
                    raise ValueError(f"{name} is {marks[name]} already")
                marks[name] = t
        if "stable" in marks and marks.get("oldest", marks["stable"]) > marks["stable"]:
            raise ValueError("oldest would be after stable")
        self._commit(v, now["tables"], None, marks)

    def version_at(self, time: int) -> int:
        """The newest version committed at or before a time; times only rise, so half of the rest is left each step."""
        if time < self.timestamps().get("oldest", time):
            raise ValueError(f"time {time} is before the oldest")
        every = self.versions()
        n = bisect.bisect_right(every, time, key=lambda v: self._read(v)["time"])
        if not n:
            raise NotFound(f"no version at time {time}")
        return every[n - 1]

    def begin(self, at: int | None = None, time: int | None = None) -> Transaction:
        """at: read that version, time: the newest at that time (one on an old version can't commit changes)."""
        if time is not None:
            at = self.version_at(time)
        return Transaction(self, self.version() if at is None else at)

    def tables(self) -> list[str]:
        return sorted(self.manifest())

    def create(self, name: str, schema: str, meta: dict | None = None) -> None:
        """schema: columns, of which the first is the key."""
        with self.begin() as t:
            t.create(name, schema, meta)

    def drop(self, name: str, force: bool = False) -> None:
        with self.begin() as t:
            t.drop(name, force)

    def bulk_load(self, name: str, df: DataFrame, meta: dict | None = None, ordered: bool = False) -> None:
        """df into a new table, sorted by key.  ordered: the key column must rise already, or it is an error."""
        key = df.columns[0]
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise OutOfOrder("a key is given twice")
        if ordered:
            at = df.select(key, F.monotonically_increasing_id().alias("_n"))
            from pyspark.sql.window import Window

            part = F.shiftright("_n", 33)
            inside = at.withColumn("_l", F.lag(key).over(Window.partitionBy(part).orderBy("_n")))
            ends = at.groupBy(part.alias("p")).agg(F.min(key).alias("a"), F.max(key).alias("b")).orderBy("p").collect()
            if inside.where(F.col("_l") >= F.col(key)).limit(1).count() or any(x["b"] >= y["a"] for x, y in zip(ends, ends[1:], strict=False)):
                raise OutOfOrder("keys do not rise")
        with self.begin() as t:
            t.create(name, df.schema.simpleString()[7:-1].replace(":", " "), meta, df)

    def checkpoint(self) -> int:
        """Everything committed is durable already; the version."""
        return self.version()

    def statistics(self, name: str) -> DataFrame:
        """One row: rows, smallest and largest key, bytes and files of the snapshot."""
        with self.begin() as t:
            df = t.scan(name)
            path = t.base[name]["snapshot"]
            s = self._fs.getContentSummary(self._p(f"{self.path}/{path}"))
            return df.agg(F.count("*").alias("rows"), F.min(df.columns[0]).alias("low"), F.max(df.columns[0]).alias("high"), F.lit(s.getLength()).alias("bytes"), F.lit(s.getFileCount()).alias("files"))


@dataclass
class Transaction:
    """Reads one version; changes are seen by itself at once and by others after commit.  Left without commit by an
    error, it is rolled back."""

    store: Store
    version: int
    base: dict = field(init=False)
    changed: dict = field(default_factory=dict)
    over: bool = False

    def __post_init__(self) -> None:
        self.base = self.store.manifest(self.version)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if not self.over:
            self.commit() if kind is None else self.rollback()

    def _entry(self, name: str) -> dict:
        if name not in self.base:
            raise NotFound(name)
        return self.base[name]

    def create(self, name: str, schema: str, meta: dict | None = None, rows: DataFrame | None = None) -> None:
        if name in self.base:
            raise ValueError(f"table {name} exists")
        df = rows if rows is not None else self.store.spark.createDataFrame([], schema)
        self.base[name] = {"schema": schema, "meta": meta or {}}
        self._put(name, df)

    def drop(self, name: str, force: bool = False) -> None:
        if name not in self.base and not force:
            raise NotFound(name)
        self.base.pop(name, None)
        self.changed[name] = None

    def meta(self, name: str) -> dict:
        return self._entry(name)["meta"]

    def _put(self, name: str, df: DataFrame) -> None:
        path = f"data/{name}-{uuid.uuid4().hex}"
        key = df.columns[0]
        df.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{self.store.path}/{path}")
        self.base[name] = self.base[name] | {"snapshot": path}
        self.changed[name] = path

    def scan(self, name: str, low: object = None, high: object = None, include_low: bool = True, include_high: bool = False, ordered: bool = False) -> DataFrame:
        """Rows with keys between the bounds; the bounds reach the Parquet scan."""
        e = self._entry(name)
        df = self.store.spark.read.schema(e["schema"]).parquet(f"{self.store.path}/{e['snapshot']}")
        k = F.col(df.columns[0])
        if low is not None and high is not None and low > high:
            raise ValueError("the lower bound is above the upper")
        if low is not None:
            df = df.where(k >= F.lit(low) if include_low else k > F.lit(low))
        if high is not None:
            df = df.where(k <= F.lit(high) if include_high else k < F.lit(high))
        return df.orderBy(k) if ordered else df

    def get(self, name: str, key: object) -> dict | None:
        df = self.scan(name)
        r = df.where(F.col(df.columns[0]) == F.lit(key)).first()
        return r.asDict() if r else None

    def largest_key(self, name: str) -> object:
        df = self.scan(name)
        return df.agg(F.max(df.columns[0])).first()[0]

    def set(self, name: str, rows: DataFrame) -> None:
        """Insert or replace by key: anti-join and union."""
        old = self.scan(name)
        self._put(name, old.join(rows, old.columns[0], "left_anti").select(*old.columns).unionByName(rows.select(*old.columns)))

    def remove(self, name: str, keys: DataFrame) -> None:
        """Keys that are not there are an error."""
        old = self.scan(name)
        key = old.columns[0]
        if (n := keys.join(old, key, "left_anti").count()):
            raise NotFound(f"{n} keys")
        self._put(name, old.join(keys.select(key), key, "left_anti").select(*old.columns))

    def commit(self, time: int | None = None) -> int:
        """time: of the commit, after that of the version before."""
        if not self.changed:
            self.over = True
            return self.version
        try:
            done = self.store._commit(self.version, self.base, time, None)
        except Conflict:
            self.rollback()
            raise
        self.over = True
        return done

    def rollback(self) -> None:
        self.over = True
        for path in self.changed.values():
            if path:
                self.store._fs.delete(self.store._p(f"{self.store.path}/{path}"), True)
