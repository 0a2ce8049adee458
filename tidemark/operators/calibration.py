"""Calibration of scores: isotonic levels drawn towards the mean, a sigmoid by Newton's method, and the choice between them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators import regression

#: Rows below which a sigmoid stands in for isotonic levels.
LEAST_ROWS = 300
#: Bounds of a calibrated probability.
EPSILON = 1e-6


@dataclass(frozen=True)
class Level:
    """Least score, rows, events, and the probability that its scores get."""

    low: float
    n: int
    k: int
    value: float


def pooled_blocks(blocks: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """(least score, rows, events) of the blocks of the isotonic fit, from finer ones in the order of scores; equal rates are one block."""
    out: list[tuple[float, int, int]] = []
    for low, n, k in blocks:
        while out and out[-1][2] * n >= k * out[-1][1]:
            low, n, k = out[-1][0], out[-1][1] + n, out[-1][2] + k
            out.pop()
        out.append((low, n, k))
    return out


def isotonic_blocks(rows: DataFrame, score: str, label: str) -> list[tuple[float, int, int]]:
    """The blocks of the isotonic fit of a 0/1 label.

    Counts of each score are dealt by ranges of the score; each partition pools its own and the driver pools what is left: pooling
    neighbours in any order gives the same blocks.  A partition leaves few of them, about the cube root of its scores.
    """
    at = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("k"))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[float, int, int]] = []
        for b in batches:
            held = pooled_blocks(held + list(zip(b["s"].tolist(), b["n"].tolist(), b["k"].tolist())))
        yield pd.DataFrame(held, columns=["s", "n", "k"])

    parts = at.repartitionByRange(width, "s").sortWithinPartitions("s").mapInPandas(run, "s double, n long, k long")
    return pooled_blocks(sorted(tuple(r) for r in parts.collect()))


def shrunk_levels(blocks: list[tuple[float, int, int]], strength: float) -> list[Level]:
    """The blocks' rates drawn towards the mean as if ``strength`` rows of it came with each, then pooled to rise again."""
    n, k = sum(b[1] for b in blocks), sum(b[2] for b in blocks)
    base = k / max(n, 1)
    drawn = [(b[2] + strength * base) / (b[1] + strength) for b in blocks]
    return [Level(b[0], b[1], b[2], v) for b, v in zip(blocks, kernels.pool_adjacent([(v, float(b[1])) for v, b in zip(drawn, blocks)]))]


def stepped(score: Column, levels: list[Level]) -> Column:
    """The value of the last level at or below the score, as each level is what rows were seen to do; below all of them the first."""
    lows, values = F.array(*[F.lit(x.low) for x in levels]), F.array(*[F.lit(x.value) for x in levels])
    place = F.size(F.filter(lows, lambda low: low <= score))
    return F.when(score.isNotNull(), F.least(F.greatest(F.element_at(values, F.greatest(place, F.lit(1))), F.lit(EPSILON)), F.lit(1 - EPSILON)))


def interpolated(score: Column, blocks: list[tuple[float, float, float]]) -> Column:
    """Isotonic prediction between the ends (low, high, rate) of the blocks, straight lines between blocks, flat beyond the ends."""
    knots = [(x, v) for low, high, v in blocks for x in dict.fromkeys((low, high))]
    xs, vs = F.array(*[F.lit(float(x)) for x, _ in knots]), F.array(*[F.lit(float(v)) for _, v in knots])
    at = F.size(F.filter(xs, lambda x: x <= score))
    x0, x1, v0, v1 = F.element_at(xs, at), F.get(xs, at), F.element_at(vs, at), F.get(vs, at)
    return F.when(at == 0, F.lit(float(knots[0][1]))).when(at == len(knots), F.lit(float(knots[-1][1]))).otherwise(v0 + (score - x0) * (v1 - v0) / (x1 - x0))


def method_for(n: int, k: int, least: int = LEAST_ROWS) -> str:
    """Isotonic levels where there are rows enough, else a sigmoid, nothing where only one outcome was seen."""
    return "identity" if k in (0, n) else "isotonic" if n >= least else "sigmoid"


def fitted(rows: DataFrame, score: str, label: str, method: str) -> tuple[str, Column]:
    """(method, expression of the calibrated score), by the rows given."""
    x = F.col(score).cast("double")
    if method == "identity":
        return method, x
    if method == "sigmoid":
        (fit,) = regression.newton(rows, [regression.Problem([x], ridge=1e-6)], label)
        return method, 1 / (1 + F.exp(-(F.lit(fit[0]) + F.lit(fit[1]) * x)))
    blocks = isotonic_blocks(rows, score, label)
    lows = [b[0] for b in blocks]
    inner = F.size(F.filter(F.array(*[F.lit(v) for v in lows]), lambda v: v <= x))
    tops = {r.at: r.high for r in rows.where(x.isNotNull() & F.col(label).isNotNull()).groupBy(inner.alias("at")).agg(F.max(x).alias("high")).collect()}  # a row a block
    return method, interpolated(x, [(b[0], tops[i + 1], b[2] / b[1]) for i, b in enumerate(blocks)])


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
