"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import bounded, cut, small_batches

#: Byte classes whose shares of a text are statistics.
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c",
    "stop": b".,;:'\"()-",
    "loud": b"!?",
    "mark": b"#$%&*+/<=>@[\\]^_`{|}~",
}
NAMES = (*_CLASSES, "words", "word length", "long words", "bare words", "repeats", "common", "same lines", "sentences")
#: Weight of the pooled diagonal in each class's covariance, and what is added to a standardised variance.
SHRINKAGE, RIDGE = 0.2, 1e-3
#: Bytes and words that damp the shares and rates of short texts.
FEW_BYTES, FEW_WORDS = 40, 8

_MEMBER = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _MEMBER[list(_bytes), _i] = 1


def statistics(text: str) -> list[float]:
    """A whole text's statistics, shares on a logarithmic scale; an empty text has those of no words."""
    data = text.encode()
    n = max(1, len(data))
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _MEMBER / (n + FEW_BYTES)
    words = data.split()
    many, damped = max(1, len(words)), len(words) + FEW_WORDS
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    bare = sum(c for w, c in counts.items() if w.isascii() and not w.isalpha())
    rates = [
        sum(map(eq, words, words[1:])) / damped,
        max(0, max(counts.values(), default=0) - 1) / damped,
        (len(lines) - len(set(lines))) / (len(lines) + 2),
        (data.count(b". ") + data.count(b".\n") + data.endswith(b".")) / damped,
    ]
    logs = np.log(np.array([*shares, bare / damped, *rates]) + 0.002)
    long = sum(c for w, c in counts.items() if len(w) > 20) / damped
    return [*logs[:7].tolist(), float(np.log1p(len(words))), float(np.log1p(n / many)), float(np.log(long + 0.002)), *logs[7:].tolist()]


def measured(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, x) of every row, x as an array of the statistics."""

    @F.pandas_udf("array<double>")
    def x(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([statistics(t) for t in batch])

    return docs.select(F.col(ident).alias("id"), x(F.coalesce(F.col(text), F.lit(""))).alias("x"))


class Model(NamedTuple):
    """Means, inverse Cholesky factors and log constants of classes 0 and 1, in standardised statistics."""

    centre: np.ndarray
    spread: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.spread
        log = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(rows: DataFrame, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Model:
    """The model of rows (label 0 or 1, x): every row counts, through sums per task that are added up by class.

    A class without rows takes the pooled moments and the prior of half a row; no rows at all give a score of 0.5.
    """
    d = len(NAMES)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if len(batch):
                x, label = np.array(batch["x"].tolist()), batch["label"].to_numpy()
                for c in (0, 1):
                    own = x[label == c]
                    total[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pd.DataFrame({"label": [0, 1], "sums": [*total.tolist()]})

    parts = rows.mapInPandas(moments, "label int, sums array<double>")
    sums = parts.select("label", F.posexplode("sums").alias("at", "value")).groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in sums:
        total[r["label"], r["at"]] = r["value"]
    n, first, second = total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d)
    every = max(1.0, n.sum())
    centre = first.sum(axis=0) / every
    spread = np.sqrt(np.maximum(np.diag(second.sum(axis=0)) / every - centre**2, 1e-6))
    means, factors, constants = np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        mean, own = (first[c] / n[c], second[c] / n[c]) if n[c] else (centre, second.sum(axis=0) / every)
        cov = (own - np.outer(mean, mean)) / np.outer(spread, spread)
        cov = (1 - shrinkage) * cov + shrinkage * np.eye(d) + ridge * np.eye(d)
        lower = np.linalg.cholesky((cov + cov.T) / 2 if n.sum() else np.eye(d))
        means[c], factors[c] = (mean - centre) / spread, np.linalg.inv(lower)
        constants[c] = np.log((n[c] + 0.5) / (n.sum() + 1)) - np.log(np.diag(lower)).sum()
    return Model(centre, spread, means, factors, constants)


def held_out(ident: Column) -> Column:
    """Whether a row is left out of training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(ident.cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality", shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> DataFrame:
    """(id, held_out, score, predicted) of every row; score near 1 where label 1 is likelier.

    The classes' moments come from all rows with a label 0 or 1 that aren't held out; ids and labels that are null or
    something else train nothing, and ids labelled twice count twice. Texts are read once, for the statistics. Null
    texts count as empty; repeated rows are scored alike; other columns aren't looked at; an empty table gives no rows.
    """
    with bounded(docs.sparkSession):
        known = cut(measured(docs, ident, text))
    taught = labels.select(F.col(ident).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    model = fit(known.join(taught, "id").select("label", "x"), shrinkage, ridge)

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(batch.tolist()).reshape(len(batch), len(NAMES))))

    scored = known.select("id", held_out(F.col("id")).alias("held_out"), score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that the model takes for label 1, with their own columns; texts are read twice and never shuffled."""
    taught = labels.select(F.col(ident).alias("id"), F.col(options.get("label", "quality")).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    small_batches(docs.sparkSession)
    model = fit(measured(docs, ident, text).join(taught, "id").select("label", "x"), options.get("shrinkage", SHRINKAGE), options.get("ridge", RIDGE))

    @F.pandas_udf("boolean")
    def fine(batch: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in batch]).reshape(len(batch), len(NAMES))
        return pd.Series(model.score(x) >= 0.5)

    return docs.where(fine(F.coalesce(F.col(text), F.lit(""))))
