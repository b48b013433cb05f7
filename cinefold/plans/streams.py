"""Queries on logs, from the table and replayed as a stream, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.session import checkpoint_folder, table
from cinefold.streaming import intervals

#: Actions that open a phase, those that close one, and how late an event may be.
OPENS, CLOSES, LATE = {"click": "looking", "purchase": "buying", "signup": "joining"}, ["error"], "1 hour"


def _log(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("action"))


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("key", "phase", *[F.unix_micros(F.col(c).cast("timestamp_ltz")).alias(c) for c in ("opened", "closed")])


def log_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' phases between the events that open and close them."""
    return _told(intervals.between(_log(table(spark, sf_dir, "events")), OPENS, CLOSES))


def log_intervals_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the events replayed as a stream, up to its watermark; written to a shared folder and read again."""
    folder, before = f"{checkpoint_folder(spark)}/intervals-{uuid.uuid4().hex}", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", intervals.STORE)
    try:
        stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
        found = intervals.streamed(_log(stream), OPENS, CLOSES, LATE)
        found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return _told(spark.read.schema(found.schema).parquet(f"{folder}/rows"))


QUERIES = {f.__name__: f for f in (log_intervals, log_intervals_streamed)}

_PHASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{p}'" for a, p in OPENS.items()) + " END"
_BETWEEN = f"""
    SELECT key, phase, opened, closed FROM (SELECT user_id AS key, {_PHASE} AS phase, epoch_us(ts) AS opened, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS closed
        FROM events WHERE event_type IN ({', '.join(f"'{a}'" for a in [*OPENS, *CLOSES])})) WHERE phase IS NOT NULL AND closed IS NOT NULL"""
ORACLE_SQL = {
    "log_intervals": _BETWEEN,
    "log_intervals_streamed": f"""{_BETWEEN} AND closed < (SELECT max(epoch_us(ts)) FROM events WHERE event_type IN ({', '.join(f"'{a}'" for a in [*OPENS, *CLOSES])})) - 3600000000""",
}
