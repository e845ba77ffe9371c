"""Keyed state between runs: merge, delete, stage and commit, retention, guards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path


def merge_rows(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: columns that ``new`` brings and that are not NULL overwrite, all others stay.

    ``new`` should hold a key once; rows with a NULL key are dropped. Columns
    only ``new`` has are ignored: the base's schema is kept.
    """
    cols = [c for c in new.columns if c in base.columns and c != key]
    n = new.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *(F.col(c).alias(f"_n_{c}") for c in cols))
    j = base.where(F.col(key).isNotNull()).join(n, F.col(key) == F.col("_key"), "full_outer")
    return j.select(*(F.coalesce(F.col(key), F.col("_key")).alias(c) if c == key else F.coalesce(f"_n_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns))


def conform(df: DataFrame, schema) -> DataFrame:
    """Projects to a schema: missing columns are NULL, additional ones go."""
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def delete_rows(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_anti")


def newest(df: DataFrame, order: str, ident: str, keep: int = 1000) -> DataFrame:
    """The ``keep`` newest rows, ties to the smaller ident: a top-k, no full sort."""
    return df.orderBy(F.desc_nulls_last(order), ident).limit(keep)


def insert_new(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key ``base`` does not hold, one a key: what an insert that may be repeated still has to add."""
    return new.where(F.col(key).isNotNull()).dropDuplicates([key]).join(base.select(key), key, "left_anti")


def check_dimension(stored: DataFrame, vector: str, dims: int, acknowledged: bool = False) -> bool:
    """Must a vector table be made anew for vectors of ``dims``? Refuses where that would drop vectors, unless acknowledged."""
    other = stored.where(F.size(vector) != dims).limit(1).count() > 0
    if other and not acknowledged:
        raise ValueError(f"stored vectors do not have {dims} dimensions")
    return other


def stale_outputs(existing: DataFrame, active: DataFrame, name: str) -> DataFrame:
    """Names of outputs that no active item has any more."""
    return existing.select(name).distinct().join(active.select(name).distinct(), name, "left_anti")


def append_events(events: DataFrame, path: str) -> None:
    """Adds events to a run report, JSON lines in a folder; what is there, broken or not, stays as it is."""
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events of a run report; lines that are no valid event are left out."""
    rows = spark.read.schema(schema + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("_broken is null").drop("_broken")


class StagedTable:
    """Write-audit-publish: runs write to staging, a commit swaps the pointer to it.

    A reader sees the last committed version; an aborted run leaves nothing but
    a staging folder. Versions older than ``keep`` commits are removed.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.seen = int((self.versions() or ["-1"])[-1])

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs, path

    def versions(self) -> list[str]:
        """Numbers of the committed versions, oldest first."""
        fs, path = self._fs()
        log = path(f"{self.root}/_commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(log)) if fs.exists(log) else []

    def _folder(self, version: str) -> str:
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/_commits/{version}"))
        try:
            return f"{self.root}/{self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        done = self.versions()
        self.seen = int(done[-1]) if done else -1
        return self.spark.read.parquet(self._folder(done[-1])) if done else None

    def stage(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}")
        return name

    def commit(self, name: str) -> None:
        """Makes a staged version the next after the one last read; fails if another writer has made it meanwhile."""
        fs, path = self._fs()
        out = fs.create(path(f"{self.root}/_commits/{self.seen + 1:012d}"), False)  # one file a number: the second writer fails
        out.write(bytearray(name.encode()))
        out.close()
        self.seen += 1
        if int(self.versions()[-1]) != self.seen:  # others went on and have cleared this number
            fs.delete(path(f"{self.root}/_commits/{self.seen:012d}"), False)
            raise RuntimeError("the table has newer versions")
        for old in self.versions()[: -self.keep]:
            drop_path(self.spark, self._folder(old))
            fs.delete(path(f"{self.root}/_commits/{old}"), False)

    def publish(self, df: DataFrame, smallest: float = 0.5, guard_from: int = 100) -> int:
        """Stages, refuses a result that shrinks a table of ``guard_from`` rows and more below ``smallest`` of it, commits."""
        name = self.stage(df)
        n = self.spark.read.parquet(f"{self.root}/{name}").count()
        old = self.read()
        before = old.count() if old is not None else 0
        if before >= guard_from and n < smallest * before:
            drop_path(self.spark, f"{self.root}/{name}")
            raise ValueError(f"{n} rows would replace {before}")
        self.commit(name)
        return n
