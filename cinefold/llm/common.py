"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.session import checkpoint_folder, settled

#: A word: a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


shared_folder = checkpoint_folder


def cut(frame: DataFrame) -> DataFrame:
    """The rows, written to the session's checkpoint folder and cut off from their lineage."""
    return settled(frame)


#: The setting that bounds what is handed to Python at a time, and the bytes that the operators ask for.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Hand at most about so many bytes at a time to Python, which bounds its memory by one batch or one text.

    It changes no result. A lazy result needs the bound when it runs, so the session keeps it; operators that run their
    Python work at once use ``bounded`` instead.
    """
    if _bytes(spark.conf.get(_BATCH)) > size:
        spark.conf.set(_BATCH, f"{size}b")


@contextmanager
def bounded(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """``small_batches`` for what runs inside; the session's own bound comes back."""
    before = spark.conf.get(_BATCH)
    small_batches(spark, size)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def _bytes(value: str) -> int:
    """A size setting in bytes; without a bound, as negative values are, more than any."""
    number = value.lower().rstrip("bkmgt ")
    unit = value[len(number) :].strip().lower()[:1]
    size = int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    return size if size > 0 else 1 << 62


def n_words(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
