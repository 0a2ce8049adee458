"""Two-factor tail-loss simulation, spread over tasks by names."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Losses are summed as whole numbers of this part of a unit, so that a sum does not hang on the order of its terms.
PART = 10_000


def _drawer(rho_between: float, rho_within: float, draws: int, seed: int) -> Callable[..., np.ndarray]:
    """A function of one name's row: its losses in all draws, in parts.

    The common factor has the seed alone, a name's own factor the seed and its id: any task, and a task run again, draws the same numbers.
    """
    normal = NormalDist()
    z = np.random.default_rng(seed).standard_normal(draws)
    grid = np.linspace(-9, 9, 4001)
    table = np.array([normal.cdf(x) for x in grid])
    own, share, rest = np.sqrt(1 - rho_within), np.sqrt(rho_between), np.sqrt(max(rho_within - rho_between, 0.0))

    def losses(row) -> np.ndarray:
        rng = np.random.default_rng([seed, int(row.id)])
        cut = normal.inv_cdf(min(max(row.p, 1e-9), 1 - 1e-9))
        p = np.interp((cut - share * z - rest * rng.standard_normal(draws)) / own, grid, table)
        return np.rint(rng.binomial(int(row.borrowers), p) * (row.exposure * row.lgd / row.borrowers * PART)).astype(np.int64)

    return losses


def totals(names: DataFrame, rho_between: float, rho_within: float, draws: int, seed: int = 7) -> DataFrame:
    """(draw, loss) for every draw: the sum over all ``names`` (id, p, borrowers, exposure, lgd).

    A task adds up its names before the shuffle, so a row a draw and task moves, however many names there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        losses, total = _drawer(rho_between, rho_within, draws, seed), np.zeros(draws, np.int64)
        for batch in batches:
            for row in batch.itertuples():
                total += losses(row)
        yield pd.DataFrame({"draw": np.arange(draws), "parts": total})

    wanted = names.select("id", "p", "borrowers", "exposure", "lgd")
    return wanted.mapInPandas(run, "draw long, parts long").groupBy("draw").agg((F.sum("parts") / PART).alias("loss"))


def tail(names: DataFrame, rho_between: float, rho_within: float, draws: int, level: float = 0.99, seed: int = 7) -> DataFrame:
    """(mean, var, es) of the total loss."""
    every = totals(names, rho_between, rho_within, draws, seed)
    var = every.agg(F.avg("loss").alias("mean"), F.percentile("loss", level).alias("var"))
    return every.crossJoin(F.broadcast(var)).groupBy("mean", "var").agg(F.avg(F.when(F.col("loss") >= F.col("var"), F.col("loss"))).alias("es"))


def contributions(names: DataFrame, rho_between: float, rho_within: float, draws: int, level: float = 0.99, seed: int = 7) -> DataFrame:
    """(name, contribution): the mean loss of each name in the draws at or beyond the quantile; they add up to the shortfall.

    A second pass over the names with the same draws: what the driver holds between the two is the numbers of the tail's draws.
    """
    every = totals(names, rho_between, rho_within, draws, seed)
    var = every.agg(F.percentile("loss", level).alias("var"))
    bad = np.array(sorted(r.draw for r in every.crossJoin(F.broadcast(var)).where("loss >= var").select("draw").collect()), np.int64)  # at most ``draws`` numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        losses = _drawer(rho_between, rho_within, draws, seed)
        for batch in batches:
            yield pd.DataFrame({"name": batch.id, "contribution": [losses(row)[bad].sum() / PART / len(bad) for row in batch.itertuples()]})

    return names.select("id", "p", "borrowers", "exposure", "lgd").mapInPandas(run, "name long, contribution double")


def quantile_errors(every: DataFrame, levels: list[float]) -> DataFrame:
    """(level, quantile, standard_error) of ``every`` draw's loss.

    The number of draws below a quantile has the deviation sqrt(n q (1 - q)), so the order statistics as far on either side of it are
    two of the quantile's standard errors apart: no second simulation and no resampling.
    """
    n = every.count()
    out = []
    for q in levels:
        step = math.sqrt(q * (1 - q) / max(n, 1))
        out += [q, max(q - step, 0.0), min(q + step, 1.0)]
    found = every.agg(F.percentile("loss", F.array(*[F.lit(q) for q in out])).alias("v"))
    rows = F.array(*[F.struct(F.lit(q).alias("level"), F.element_at("v", 3 * i + 1).alias("quantile"), ((F.element_at("v", 3 * i + 3) - F.element_at("v", 3 * i + 2)) / 2).alias("standard_error")) for i, q in enumerate(levels)])
    return found.select(F.explode(rows).alias("r")).select("r.*")
