"""Joins with the guards that entity panels need."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import cut


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def guarded_left_join(left: DataFrame, right: DataFrame, exact: list[str], loose: list[str], values: list[str], owner: str, left_owner: str | None = None) -> DataFrame:
    """Values of ``right`` by the exact keys, else by the looser keys where these name one owner only, on the left too where ``left_owner`` is given.

    ``right`` is reduced to one row a key first, so the join keeps the rows of ``left``.  ``matched_by`` tells which level gave the values.
    """
    by_exact = right.groupBy(*exact).agg(*[F.max(v).alias(f"__e_{v}") for v in values], F.lit(True).alias("__e"))
    by_loose = right.groupBy(*loose).agg(*[F.max(v).alias(f"__l_{v}") for v in values], F.count_distinct(owner).alias("__owners")).where("__owners = 1").drop("__owners").withColumn("__l", F.lit(True))
    out = left.join(by_exact, exact, "left").join(by_loose, loose, "left")
    loosely = F.coalesce(F.col("__l"), F.lit(False))
    if left_owner is not None:
        alone = left.groupBy(*loose).agg(F.count_distinct(left_owner).alias("__own")).where("__own = 1").drop("__own").withColumn("__alone", F.lit(True))
        out = out.join(alone, loose, "left")
        loosely = loosely & F.coalesce(F.col("__alone"), F.lit(False))
    by = F.when(F.col("__e"), "exact").when(loosely, "loose").otherwise("none")
    picked = {v: F.when(F.col("__e"), F.col(f"__e_{v}")).when(loosely, F.col(f"__l_{v}")) for v in values}
    return out.withColumns({**picked, "matched_by": by}).select(*left.columns, *values, "matched_by")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], tolerance: Column | float | None = None) -> DataFrame:
    """For each left row the latest right row of its key with right_time <= left_time, within a tolerance.

    One shuffle: both sides are united and the last right row is carried forward; (key, right_time) is expected to be unique
    on the right, else the greatest values win.
    """
    carried = F.struct(F.col(right_time).alias("t"), *[F.col(v) for v in values])
    r = right.select(key, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), carried.alias("__r"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"))
    l_ = left.select(F.col(key), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    w = Window.partitionBy(key).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    out = r.unionByName(l_).withColumn("__last", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    ok = F.col("__last").isNotNull()
    if tolerance is not None:
        ok = ok & (F.col("__t") - F.col("__last.t") <= tolerance)
    return out.select("__l.*", *[F.when(ok, F.col(f"__last.{v}")).alias(v) for v in values], F.when(ok, F.col("__last.t")).alias(f"matched_{right_time}"))


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The union of two sources with the first one's row where both have a key."""
    both = first.withColumn("__p", F.lit(0)).unionByName(second.withColumn("__p", F.lit(1)))
    return best_row(both, keys, [F.asc("__p")]).drop("__p")


def drift(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(deleted, added, modified, same) counts of two snapshots by natural key."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.xxhash64(*rest).alias("__o"))
    n = new.select(*keys, F.xxhash64(*rest).alias("__n"))
    both = o.join(n, keys, "full")
    return both.agg(
        F.count_if(F.col("__n").isNull()).alias("deleted"),
        F.count_if(F.col("__o").isNull()).alias("added"),
        F.count_if(F.col("__o") != F.col("__n")).alias("modified"),
        F.count_if(F.col("__o") == F.col("__n")).alias("same"),
    )


def next_period(left: DataFrame, right: DataFrame, key: str, period: str) -> DataFrame:
    """Left rows beside the same key's row of the following period; rows without one are dropped."""
    return left.join(right.withColumn(period, F.col(period) - 1), [key, period])


def greedy_pairs(closed: DataFrame, opened: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """One-to-one pairs of a closing and an opening of the same key within low..high days, smallest gap first.

    ``closed`` has id, day; ``opened`` has id, day.  The join is by key and stretch of high - low days, so that only pairs of neighbouring stretches are
    made.  Each round takes the pairs that are first by (gap's size, ids) for both their ends and drops the others of these
    ends, which gives what taking one pair after another gives.
    """
    width = high - low + 1
    stretch = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / width)
    c = closed.select(*keys, F.col("id").alias("closed_id"), F.col("day").alias("closed_day"))
    c = c.withColumn("__stretch", F.explode(F.array_distinct(F.array(stretch(F.date_add("closed_day", low)), stretch(F.date_add("closed_day", high))))))
    o = opened.select(*keys, F.col("id").alias("opened_id"), F.col("day").alias("opened_day")).withColumn("__stretch", stretch(F.col("opened_day")))
    pairs = c.join(o, [*keys, "__stretch"]).withColumn("gap", F.date_diff("opened_day", "closed_day"))
    pairs = pairs.where((F.col("gap").between(low, high)) & (F.col("closed_id") != F.col("opened_id")))
    left = cut(pairs.select(*keys, "closed_id", "opened_id", "gap").distinct())
    order = [F.abs("gap"), "closed_id", "opened_id", "gap"]
    out = []
    while not out or not left.isEmpty():
        ranked = left.withColumn("__c", F.row_number().over(Window.partitionBy(*keys, "closed_id").orderBy(*order)))
        ranked = ranked.withColumn("__o", F.row_number().over(Window.partitionBy(*keys, "opened_id").orderBy(*order)))
        taken = cut(ranked.where("__c = 1 and __o = 1").drop("__c", "__o"))
        out.append(taken)
        left = cut(left.join(taken, [*keys, "closed_id"], "left_anti").join(taken, [*keys, "opened_id"], "left_anti"))
    found = functools.reduce(DataFrame.unionByName, out)
    return found.select(F.col("closed_id").cast("long").alias("closed_id"), F.col("opened_id").cast("long").alias("opened_id"), "gap")
