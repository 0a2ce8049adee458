"""Window operators over an entity-by-period panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(key: str, period: str):
    return Window.partitionBy(key).orderBy(period)


def guarded_lag(value: str, key: str, period: str) -> Column:
    """The previous row's value if that row is the period just before."""
    w = by(key, period)
    return F.when(F.lag(period).over(w) == F.col(period) - 1, F.lag(value).over(w))


def run_id(key: str, period: str, df: DataFrame, name: str = "run") -> DataFrame:
    """The number of a row's stretch of consecutive periods within its key."""
    w = by(key, period)
    gap = F.when(F.col(period) - F.lag(period).over(w) == 1, 0).otherwise(1)
    return df.withColumn("__gap", gap).withColumn(name, F.sum("__gap").over(w)).drop("__gap")


def running_max(value: str, key: str, period: str) -> Column:
    """The maximum so far; unknown where the row's own value is."""
    return F.when(F.col(value).isNotNull(), F.max(value).over(by(key, period).rowsBetween(Window.unboundedPreceding, 0)))


def rolling(value: str, key: str, run: str, period: str, size: int = 3, least: int = 2) -> tuple[Column, Column, Column]:
    """(mean, deviation, slope) of the last rows of a run; unknown with fewer than ``least`` values."""
    w = Window.partitionBy(key, run).orderBy(period).rowsBetween(1 - size, 0)
    enough = F.count(value).over(w) >= least
    return F.when(enough, F.avg(value).over(w)), F.when(enough, F.stddev_samp(value).over(w)), F.when(enough, F.regr_slope(F.col(value), F.col(period)).over(w))


def average_rank_share(value: str, *keys: str) -> Column:
    """Rank with ties averaged over the number of known values; unknown stays unknown."""
    w = Window.partitionBy(*keys)
    mid = F.rank().over(w.orderBy(F.asc_nulls_last(value))) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2
    return F.when(F.col(value).isNotNull(), mid / F.count(value).over(w))


def group_key(fine: str, coarse: str, period: str, least: int) -> Column:
    """The fine group where it has ``least`` rows that period, else the coarse one."""
    return F.when(F.count("*").over(Window.partitionBy(period, fine)) >= least, F.col(fine)).otherwise(F.col(coarse))


def group_quantiles(df: DataFrame, keys: list[str], quantiles: dict[str, tuple[str, float]], pool: Column | None = None) -> DataFrame:
    """``df`` with exact quantiles of its group, taken over the pool only: {name: (column, q)}.

    An aggregate joined back, so that no group is held in one window.
    """
    pool = F.lit(True) if pool is None else pool
    table = df.groupBy(*keys).agg(*[F.percentile(F.when(pool, F.col(c)), q).alias(name) for name, (c, q) in quantiles.items()])
    return df.join(table, keys, "left")


def winsorized(df: DataFrame, keys: list[str], columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """The columns clipped to their group's quantiles."""
    wanted = {f"__{c}_{s}": (c, q) for c in columns for s, q in (("low", low), ("high", high))}
    out = group_quantiles(df, keys, wanted)
    out = out.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"__{c}_low")), F.col(f"__{c}_high"))) for c in columns})
    return out.drop(*wanted)


def streak(df: DataFrame, flag: Column, key: str, period: str, name: str) -> DataFrame:
    """How many rows in succession, up to this one, the flag holds; unknown flags start anew and stay unknown."""
    w = by(key, period)
    held = df.withColumn("__flag", flag).withColumn("__block", F.sum(F.when(F.coalesce(F.col("__flag"), F.lit(False)), 0).otherwise(1)).over(w))
    inside = Window.partitionBy(key, "__block").orderBy(period)
    count = F.sum(F.when(F.col("__flag"), 1).otherwise(0)).over(inside)
    return held.withColumn(name, F.when(F.col("__flag").isNotNull(), count)).drop("__flag", "__block")
