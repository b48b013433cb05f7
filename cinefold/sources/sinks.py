"""Sinks: matrices, text rows, skip-if-there appends and stream logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_matrix(matrix: DataFrame, path: str) -> None:
    """A matrix as (i, j, value) Parquet, in place of what was there."""
    matrix.select("i", "j", "value").write.mode("overwrite").parquet(path)


def write_rows(rows: DataFrame, array: str, length: int, path: str) -> None:
    """An array column as comma-separated files, one line a row."""
    rows.select(*[F.get(array, F.lit(k)).alias(f"c{k}") for k in range(length)]).write.mode("overwrite").csv(path)


def append_missing(rows: DataFrame, keys: list[str], path: str) -> None:
    """Append the rows whose keys the table at the path hasn't got yet; the table is begun if it isn't there."""
    spark: SparkSession = rows.sparkSession
    try:
        there = spark.read.parquet(path).select(*keys).distinct()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        rows.write.parquet(path)
        return
    rows.join(there, keys, "left_anti").write.mode("append").parquet(path)


def log_line(action: Column, ts: Column) -> Column:
    """A session log's line: action, the mark, and the time to microseconds."""
    return F.concat(action, F.lit("-&-"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends (action, ts) rows to text files, each micro-batch once."""
    out = stream.select(log_line(F.col("action"), F.col("ts")).alias("value"))
    return out.writeStream.format("text").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
