"""Weights, densities and ramps as column expressions."""

from __future__ import annotations

from math import log, pi

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def smoothstep(delay: int) -> Column:
    """An array of ``delay`` samples of 6x^5 - 15x^4 + 10x^3 at i / (delay + 1), both ends left out."""
    at = lambda i: i / float(delay + 1)
    return F.transform(F.sequence(F.lit(1), F.lit(delay)), lambda i: at(i) * at(i) * at(i) * (at(i) * (at(i) * 6 - 15) + 10))


def toggle(ramp: Column, before: Column, after: Column) -> Column:
    """Mixes of two weights along a ramp."""
    return F.transform(ramp, lambda r: before + r * (after - before))


def log_gaussian(x: list[Column], mean: list[float], covariance: list[list[float]], normalised: bool = True) -> Column:
    """The log density; the inverse and the determinant are taken on the driver."""
    inverse = np.linalg.inv(np.asarray(covariance, float))
    gaps = [c - m for c, m in zip(x, mean, strict=True)]
    form = sum((float(inverse[i, j]) * gaps[i] * gaps[j] for i in range(len(x)) for j in range(len(x)) if (i, j) != (0, 0)), float(inverse[0, 0]) * gaps[0] * gaps[0])
    constant = -0.5 * (len(x) * log(2 * pi) + float(np.linalg.slogdet(np.asarray(covariance, float))[1])) if normalised else 0.0
    return constant - 0.5 * form


def minus_log_gaussian(x: list[Column], mean: list[float], covariance: list[list[float]], normalised: bool = True) -> Column:
    return -log_gaussian(x, mean, covariance, normalised)


def gaussian(x: list[Column], mean: list[float], covariance: list[list[float]], normalised: bool = True) -> Column:
    return F.exp(log_gaussian(x, mean, covariance, normalised))


def sharpened(x: Column) -> Column:
    """2 / (1 + exp(-5x)) - 1."""
    return 2 / (1 + F.exp(-5 * x)) - 1


def multi_object_score(scores: Column, a: float = 2.0, b: float = 2.5) -> Column:
    """exp(-mean of (a * (largest - score))**b over the others); 1 for a single score."""
    most = F.array_max(scores)
    gaps = F.transform(scores, lambda s: F.pow(a * (most - s), F.lit(b)))
    n = F.greatest(F.size(scores) - 1, F.lit(1))
    return F.exp(-F.aggregate(gaps, F.lit(0.0), lambda x, y: x + y) / n)


def colour_wheel() -> list[tuple[int, int, int]]:
    """The 55 hues of the flow wheel of Baker et al. (2007): six ramps between neighbouring pure colours.

    Fixed values: the numbers of hues of the ramps.
    """
    ramps = ((15, (255, None, 0), 1), (6, (None, 255, 0), -1), (4, (0, 255, None), 1), (11, (0, None, 255), -1), (13, (None, 0, 255), 1), (6, (255, 0, None), -1))
    out = []
    for n, base, way in ramps:
        for i in range(n):
            level = int(255 * i / n)
            out.append(tuple((level if way > 0 else 255 - level) if c is None else c for c in base))
    return out
