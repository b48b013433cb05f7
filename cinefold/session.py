"""Session and table helpers shared by the library, the bench and the tests."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def local_session(cores: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library's plans are written for."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cinefold")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixture tables, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which is the cluster's ``spark.checkpoint.dir``.

    A temporary folder is made only where none is named and all tasks run in this process' machine; on a cluster, where
    other machines wouldn't see it, that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cinefold-checkpoint-"))
    return context.getCheckpointDir()


def settled(frame: DataFrame) -> DataFrame:
    """The rows, written to the session's checkpoint folder and cut off from their lineage."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint()


@contextmanager
def small_batches(spark: SparkSession, size: int = 16 << 20) -> Iterator[None]:
    """Python gets about so many bytes at a time in what runs inside, which must be at once; the session's own bound comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ranked(rows: DataFrame, order: str, name: str) -> DataFrame:
    """The rows with their place, from 0, in the order of a column; equal values are in any order.

    Rows are dealt by ranges of the column and numbered inside each; what lies before a range comes from the ranges'
    counts, one row each, so no task has all rows.
    """
    dealt = settled(rows.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1
    out = dealt.withColumn("_place", inside).join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    return out.withColumn(name, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")
