"""Session factory, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def get_spark(app: str = "florilege", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A UTC session with adaptive execution; cluster settings win over the defaults here."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "florilege.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables; a file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The run's own folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset on
    a local master (tests) a temporary folder is taken. On a cluster such a
    folder would be another one on every machine, so that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
            spark.sparkContext.setCheckpointDir(base)
        _ROOTS[app] = f"{base.rstrip('/')}/florilege-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, _ROOTS[app])
    return _ROOTS[app]


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a written intermediate table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session is gone; the cluster's own retention applies
        pass


def stash(df: DataFrame) -> DataFrame:
    """Cuts lineage by a written table in the shared folder; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._florilege_path = path
    return out


def unstash(*dfs: DataFrame) -> None:
    """Frees tables written by ``stash`` once nothing reads them any more."""
    for df in dfs:
        if path := getattr(df, "_florilege_path", None):
            drop_path(df.sparkSession, path)
