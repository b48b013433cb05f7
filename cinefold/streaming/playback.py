"""Stream-shaped operators: playback ticks, sound cues, demand-driven extension and commands that change state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ticks(spark: SparkSession, frames: int, per_second: int = 30) -> DataFrame:
    """(timestamp, tick, frame) from the rate source; frames start over after the last."""
    source = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return source.select("timestamp", F.col("value").alias("tick"), F.pmod("value", F.lit(frames)).alias("frame"))


def cues(played: DataFrame, sounds: DataFrame) -> DataFrame:
    """Played frames with the sound that is due at them: a stream joined with a fixed table (frame, sound)."""
    return played.join(sounds, "frame")


def extended(played: DataFrame, ready: Callable[[], int], extend: Callable[[int], None], checkpoint: str, low_water: int = 2):
    """A query that asks for more frames whenever a batch has come within ``low_water`` frames of what is ready."""

    def check(batch: DataFrame, _: int) -> None:
        last = batch.agg(F.max("frame")).first()[0]
        if last is not None and ready() - last <= low_water:
            extend(last)

    return played.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _follow(rows: pd.DataFrame, last: int, ramp: list[float]) -> list[tuple]:
    """(t, from, to, weight) for commands in time order: each moves smoothly from the class before it to its own."""
    out = []
    for at, wanted in zip(rows["ts"], rows["command"], strict=True):
        for step, weight in enumerate([*ramp, 1.0]):
            out.append((at, step, last, int(wanted), weight))
        last = int(wanted)
    return out


def commands(stream: DataFrame, delay: int = 8, rest: int = 0) -> DataFrame:
    """(key, ts, step, before, after, weight) for a stream of (key, ts, command): the ramp that each command starts.

    A key's state is the class it was sent to last, at first ``rest``.
    """
    x = [(i + 1) / (delay + 1) for i in range(delay)]
    ramp = [v**3 * (v * (v * 6 - 15) + 10) for v in x]
    key = dict(stream.dtypes)["key"]

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else rest
        rows = pd.concat(list(batches)).sort_values("ts")
        out = _follow(rows, last, ramp)
        state.update((int(rows["command"].iloc[-1]),))
        yield pd.DataFrame([(name[0], *r) for r in out], columns=["key", "ts", "step", "before", "after", "weight"])

    schema = f"key {key}, ts timestamp, step int, before int, after int, weight double"
    return stream.groupBy("key").applyInPandasWithState(step, schema, "last int", "append", "NoTimeout")


def kinematics(steps: DataFrame, top: float = 1.0, decay: float = 0.9) -> DataFrame:
    """(key, t, speed, heading) from (key, t, accel, turn, dt): speed is clamped, braking is twice as strong as
    accelerating, and without acceleration the speed decays. One key's steps are one ordered unit."""
    key = dict(steps.dtypes)["key"]

    def unit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t")
        speed = heading = 0.0
        out = []
        for t, accel, turn, dt in zip(part["t"], part["accel"], part["turn"], part["dt"], strict=True):
            if accel:
                speed += accel * dt * (2 if accel * speed < 0 else 1)
            else:
                speed *= decay
            speed = max(-top, min(top, speed))
            heading += turn * dt
            out.append((part["key"].iloc[0], t, speed, heading))
        return pd.DataFrame(out, columns=["key", "t", "speed", "heading"])

    return steps.groupBy("key").applyInPandas(unit, f"key {key}, t long, speed double, heading double")
