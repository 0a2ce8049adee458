"""Resampling of blocks: Poisson weights from a hash, and all draws of a few blocks with how often each comes."""

from __future__ import annotations

from itertools import combinations_with_replacement
from math import factorial, prod

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Poisson(1) up to 5, as cumulated chances.
_POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]


def poisson_weight(*keys: Column | str) -> Column:
    """How often a block comes in a draw, from a hash of block and draw: the same in any partitioning."""
    u = F.xxhash64(*keys).bitwiseAND(0xFFFFFF) / float(0x1000000)
    return sum((F.when(u >= c, 1).otherwise(0) for c in _POISSON), F.lit(0))


def in_draws(rows: DataFrame, block: str, draws: int) -> DataFrame:
    """``rows`` once for each draw that holds their block, with its weight ``w``; meant to be aggregated at once."""
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", poisson_weight(block, "draw")).where("w > 0")


def all_draws(blocks: int) -> list[tuple[tuple[int, ...], int]]:
    """Every draw with replacement of as many of ``blocks`` blocks, in any order, and in how many orders it comes."""
    out = []
    for picked in combinations_with_replacement(range(blocks), blocks):
        out.append((picked, factorial(blocks) // prod(factorial(picked.count(i)) for i in set(picked))))
    return out


def weighted_quantile(values: np.ndarray, times: np.ndarray, q: float) -> float:
    """The linear quantile of the list that has each value as often as ``times`` says."""
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(times[order])
    at = q * (int(upto[-1]) - 1)
    low = int(np.floor(at))
    pick = lambda i: float(values[np.searchsorted(upto, i, side="right")])
    return pick(low) + (at - low) * (pick(min(low + 1, int(upto[-1]) - 1)) - pick(low))
