"""Intervals of a stream that comes in several batches, out of order, against those of the table."""

from __future__ import annotations

from datetime import datetime, timedelta

from cinefold.streaming import intervals

OPENS, CLOSES = {"start": "on", "turn": "other"}, ["stop"]


def test_stream_in_batches_equals_the_table(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [
        [("a", 1, at(0), "start"), ("a", 3, at(20), "stop"), ("b", 4, at(5), "start"), ("c", 5, at(7), "stop"), (None, 6, at(8), "start"), ("a", 7, None, "start")],
        [("a", 2, at(10), "turn"), ("b", 8, at(40), "noise"), ("b", 9, at(50), "start"), ("b", 10, at(50), "stop")],  # an event before one seen already, and a tie
        [("a", 11, at(400), "start"), ("d", 12, at(390), "start"), ("b", 13, at(380), "turn"), ("b", 14, at(385), "stop")],
        [("a", 15, at(800), "noise"), ("a", 16, at(401), "start"), ("z", 17, at(900), "stop")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "key string, id long, ts timestamp, action string").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    table = spark.read.parquet(str(tmp_path / "log"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", intervals.STORE)
    try:
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        found = intervals.streamed(stream, OPENS, CLOSES, "1 hour")
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(map(tuple, spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()))
    wanted = sorted(map(tuple, intervals.between(table, OPENS, CLOSES).collect()))
    assert got == wanted and len(wanted) == 6
    assert ("a", "on", at(0), at(10)) in got and ("b", "on", at(50), at(50)) in got


def test_no_rows(spark):
    none = spark.createDataFrame([], "key string, id long, ts timestamp, action string")
    assert intervals.between(none, OPENS, CLOSES).count() == 0
