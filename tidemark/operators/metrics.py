"""Statistics of scores against outcomes, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import ranked, running, value_table


def auc_ks(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auc, ks): Mann-Whitney AUC with ties at one half and the Kolmogorov-Smirnov distance."""
    t = value_table(df, score, label)
    below = F.col("cum_neg") - F.col("neg")
    totals = t.agg(F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg"))
    t = t.crossJoin(F.broadcast(totals))  # one row
    return t.agg(
        (F.sum(F.col("pos") * (below + F.col("neg") / 2)) / F.max(F.col("__pos") * F.col("__neg"))).alias("auc"),
        F.max(F.abs(F.col("cum_pos") / F.col("__pos") - F.col("cum_neg") / F.col("__neg"))).alias("ks"),
    )


def auc_and_lift(df: DataFrame, keys: list[str], score: str, label: str, share: float = 0.1) -> DataFrame:
    """(*keys, n, auc, lift) of each group from one order of all groups' scores; ties count one half in the AUC, and at the lift's edge by their share of it."""
    at = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    t = running(at, [*[F.asc(k) for k in keys], F.asc(score)], {"cum": F.col("n"), "cum_pos": F.col("pos")})
    totals = t.groupBy(*keys).agg(F.max("cum").alias("end"), F.max("cum_pos").alias("end_pos"), F.sum("n").alias("__n"), F.sum("pos").alias("__pos"))
    t = t.join(F.broadcast(totals), keys)  # a row a group
    neg = F.col("n") - F.col("pos")
    below = F.col("cum") - F.col("cum_pos") - neg - (F.col("end") - F.col("end_pos") - F.col("__n") + F.col("__pos"))
    top = F.greatest(F.lit(1), F.floor(F.col("__n") * share))
    part = F.least(F.greatest((top - (F.col("end") - F.col("cum"))) / F.col("n"), F.lit(0.0)), F.lit(1.0))
    return t.groupBy(*keys).agg(
        F.max("__n").alias("n"),
        F.try_divide(F.sum(F.col("pos") * (below + neg / 2)), F.max(F.col("__pos") * (F.col("__n") - F.col("__pos")))).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * part) / F.max(top), F.max(F.col("__pos") / F.col("__n"))).alias("lift"),
    )


def top_share(df: DataFrame, order: list[Column], share: float) -> DataFrame:
    """The rows of the first max(1, floor(n * share)) in a total order, with ``rank`` and ``k``."""
    placed = ranked(df, order)
    k = placed.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("k"))
    return placed.crossJoin(F.broadcast(k)).where("rank <= k")


def lift(df: DataFrame, score: str, label: str, tie: str, share: float = 0.1) -> DataFrame:
    """(k, precision_at_k, base_rate, lift) of the rows of highest score."""
    best = top_share(df, [F.desc(score), F.asc(tie)], share).agg(F.max("k").alias("k"), F.avg(F.col(label).cast("double")).alias("precision_at_k"))
    return best.crossJoin(df.agg(F.avg(F.col(label).cast("double")).alias("base_rate"))).withColumn("lift", F.col("precision_at_k") / F.col("base_rate"))


def binned(df: DataFrame, score: str, edges: list[float]) -> DataFrame:
    """``df`` with ``bin``: how many inner edges are at or below the score."""
    return df.withColumn("bin", sum((F.when(F.col(score) >= e, 1).otherwise(0) for e in edges[1:]), F.lit(0)))


def quantile_edges(df: DataFrame, score: str, bins: int) -> list[float]:
    """Inner edges of equal-count bins, repeats removed: a handful of numbers on the driver."""
    found = df.agg(F.percentile(score, F.array(*[F.lit(i / bins) for i in range(1, bins)]))).first()[0] or []
    return sorted(set(found))


def calibration_table(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate) over bins of equal width."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_score"))) / F.sum("n")).alias("ece"))


def stability_index(reference: DataFrame, actual: DataFrame, score: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """(bin, n_ref, n_act, part): population stability by reference quantiles; shares are floored, parts of fewer than 20 reference or 10 actual rows unknown."""
    edges = [float("-inf"), *quantile_edges(reference, score, bins)]
    count = lambda d, name: binned(d, score, edges).groupBy("bin").agg(F.count("*").alias(name))
    every = reference.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bin"))
    t = every.join(count(reference, "n_ref"), "bin", "left").join(count(actual, "n_act"), "bin", "left").fillna(0, ["n_ref", "n_act"])
    totals = t.agg(F.sum("n_ref").alias("r"), F.sum("n_act").alias("a"))
    e, a = (F.greatest(F.col(x) / F.col(y), F.lit(floor)) for x, y in (("n_ref", "r"), ("n_act", "a")))
    return t.crossJoin(F.broadcast(totals)).select("bin", "n_ref", "n_act", F.when((F.col("r") >= 20) & (F.col("a") >= 10), (a - e) * F.log(a / e)).alias("part"))


def transition_matrix(history: DataFrame, key: str, period: str, grade: str) -> DataFrame:
    """(from_grade, to_grade, n, share): moves to the following period; leaving is a grade of its own."""
    after = history.select(key, (F.col(period) - 1).alias(period), F.col(grade).alias("to_grade"))
    last = history.agg(F.max(period).alias("__last"))
    moved = history.crossJoin(F.broadcast(last)).where(F.col(period) < F.col("__last")).join(after, [key, period], "left")
    t = moved.groupBy(F.col(grade).alias("from_grade"), F.coalesce("to_grade", F.lit("exit")).alias("to_grade")).agg(F.count("*").alias("n"))
    totals = t.groupBy("from_grade").agg(F.sum("n").alias("__n"))
    return t.join(totals, "from_grade").select("from_grade", "to_grade", "n", (F.col("n") / F.col("__n")).alias("share"))
