"""Incremental forms: seen-key filtering, keyed merge and event windows as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import StagedTable, merge_rows
from ..session import shared_root


def stream_table(spark: SparkSession, sf_dir: str, name: str, files: int = 1, parts: int = 3) -> DataFrame:
    """One of the given tables as a stream of its files, ``files`` a micro-batch; a table of one file is first dealt over ``parts``."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    if len(table.inputFiles()) == 1:
        path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        table.repartition(parts).write.parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream: DataFrame, each, checkpoint: str) -> None:
    """Runs the stream over all that is there now; the checkpoint makes a restart go on where it ended."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def first_seen(stream: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """The first row (by ``order``) of every key, kept as a staged table that every micro-batch merges into.

    A batch is thinned to one row a key, compared with the table and published
    as a whole, so a failed batch leaves the last version. NULL keys are left out.
    """
    spark = stream.sparkSession
    state = StagedTable(spark, f"{shared_root(spark)}/{name}")

    def each(batch: DataFrame, _: int) -> None:
        best = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))
        old = state.read()
        if old is not None:
            best = old.unionByName(best).groupBy(key).agg(F.min(order).alias(order))
        state.commit(state.stage(best))

    drain(stream, each, f"{shared_root(spark)}/{name}-checkpoint")
    out = state.read()
    return out if out is not None else stream.sparkSession.createDataFrame([], stream.select(key, order).schema)


def merged_stream(stream: DataFrame, key: str, columns: list[str], order: str, name: str) -> DataFrame:
    """Latest values of every key: an upsert per micro-batch, later rows (by ``order``) overwrite."""
    spark = stream.sparkSession
    state = StagedTable(spark, f"{shared_root(spark)}/{name}")

    def each(batch: DataFrame, _: int) -> None:
        top = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *columns)).alias("t")).select(key, *(F.col(f"t.{c}").alias(c) for c in [order, *columns]))
        old = state.read()
        if old is not None:
            late = top.join(old.select(key, F.col(order).alias("_o")), key, "left").where(F.col("_o").isNull() | (F.col(order) >= F.col("_o"))).drop("_o")
            top = merge_rows(old, late, key)
        state.commit(state.stage(top))

    drain(stream, each, f"{shared_root(spark)}/{name}-checkpoint")
    return state.read()


def windowed_counts(stream: DataFrame, time: str, kind: str, value: str, name: str, width: str = "1 day", late: str = "31 days") -> DataFrame:
    """(start, kind, n, total) per tumbling window of event time with a watermark; an extension, batch jobs have no windows."""
    spark = stream.sparkSession
    out = f"{shared_root(spark)}/{name}"
    agg = stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    rows = agg.select(F.col("window.start").alias("start"), kind, "n", "total")
    state = StagedTable(spark, out)

    def each(batch: DataFrame, _: int) -> None:
        old = state.read()
        if old is not None:
            batch = old.join(batch.select("start", kind), ["start", kind], "left_anti").unionByName(batch)
        state.commit(state.stage(batch))

    q = rows.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return state.read()
