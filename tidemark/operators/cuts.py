"""Search for two cuts of a score that part rows into three grades, and what chance alone would find.

Rows are counted once, by period and by how many cuts of a grid their score reaches; the search and its null are on these
counts.  Labels permuted inside a period fall on its cells as a multivariate hypergeometric draw, so that a permutation costs
the same whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import kernels

#: Cuts that are tried, and rows that a grade must have.
GRID = [round(0.02 + 0.005 * i, 4) for i in range(60)]
LEAST_ROWS = 150


@lru_cache(maxsize=200_000)
def interval(k: int, n: int) -> tuple[float, float]:
    """Clopper and Pearson's 95 % interval, remembered: the pairs of cuts share many grades."""
    return kernels.exact_interval(k, n)



@dataclass(frozen=True)
class Found:
    """The cuts, by number, the counts of the three grades, and the least distance between their intervals."""

    cuts: tuple[int, int]
    n: tuple[int, ...]
    k: tuple[int, ...]
    separation: float


def counts(rows: DataFrame, score: str, label: str, period: str, grid: list[float] = GRID) -> tuple[list, np.ndarray, np.ndarray]:
    """(periods, n, k): rows and events by period and number of cuts reached; at most one row a cell comes to the driver."""
    reached = F.size(F.filter(F.array(*[F.lit(c) for c in grid]), lambda c: c <= F.col(score)))
    cells = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(period).alias("period"), reached.alias("at")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("k")).collect()
    periods = sorted({r["period"] for r in cells})
    n, k = np.zeros((len(periods), len(grid) + 1), np.int64), np.zeros((len(periods), len(grid) + 1), np.int64)
    for r in cells:
        n[periods.index(r["period"]), r["at"]], k[periods.index(r["period"]), r["at"]] = r["n"], r["k"]
    return periods, n, k


def search(n: np.ndarray, k: np.ndarray, least: int = LEAST_ROWS) -> Found | None:
    """The pair of cuts of the widest distance between neighbouring intervals.

    Every grade has ``least`` rows, rates rise strictly over all rows and in every period, and the exact 95 % intervals of the grades
    do not meet.  Of equal distances the pair of the least cuts stands.  Intervals lie further apart than rates never, so they are
    worked out by falling distance of rates, until no rate can beat the best.
    """
    a, b = np.triu_indices(n.shape[1] - 1, 1)

    def graded(x: np.ndarray) -> np.ndarray:
        below = np.cumsum(x, axis=1)
        one, two = below[:, a], below[:, b]
        return np.stack((one, two - one, below[:, -1:] - two))

    sizes, events = graded(n), graded(k)
    with np.errstate(invalid="ignore", divide="ignore"):
        rates = events / sizes
        pooled = events.sum(axis=1) / sizes.sum(axis=1)
    good = (sizes.sum(axis=1) >= least).all(axis=0) & (np.diff(pooled, axis=0) > 0).all(axis=0) & (np.diff(rates, axis=0) > 0).all(axis=(0, 1))
    gap = np.diff(pooled, axis=0).min(axis=0)
    best: tuple | None = None
    for p in sorted(np.flatnonzero(good), key=lambda p: (-gap[p], p)):
        if best is not None and gap[p] < best[0]:
            break
        own_n, own_k = (tuple(int(v) for v in x.sum(axis=1)[:, p]) for x in (sizes, events))
        ends = [interval(k_, n_) for k_, n_ in zip(own_k, own_n)]
        apart = min(ends[1][0] - ends[0][1], ends[2][0] - ends[1][1])
        if apart > 0 and (best is None or (apart, -p) > (best[0], -best[1])):
            best = (apart, int(p), own_n, own_k)
    return None if best is None else Found((int(a[best[1]]), int(b[best[1]])), best[2], best[3], float(best[0]))


def permuted(n: np.ndarray, k: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """The events by cell after the labels of each period are permuted among its rows."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.multivariate_hypergeometric(own, int(events.sum()), method="marginals") for own, events in zip(n, k)])


def null(spark: SparkSession, n: np.ndarray, k: np.ndarray, draws: int = 200, seed: int = 42, least: int = LEAST_ROWS) -> DataFrame:
    """(draw, separation) of the same search on permuted labels; null where it finds no cuts.  Draws are dealt to tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [search(n, permuted(n, k, (seed, int(d))), least) for d in batch["id"]]
            yield pd.DataFrame({"draw": batch["id"], "separation": [None if f is None else f.separation for f in found]}).astype({"separation": "float64"})

    return spark.range(0, draws, 1, min(draws, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInPandas(run, "draw long, separation double").select("draw", F.nanvl("separation", F.lit(None).cast("double")).alias("separation"))
