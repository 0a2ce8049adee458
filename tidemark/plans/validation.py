"""Validation of scores on the labelled panel: baselines, folds, groups, exact tests, resampling and permutation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators import windows as W
from tidemark.operators.ordered import cut
from tidemark.plans.base import query, r6
from tidemark.plans.events import FLOWS, flows
from tidemark.plans.labels import LABELLED, labelled
from tidemark.plans.portfolio import FINDINGS, findings


def baselines(spark, sf_dir):
    """Labelled rows with two scores that need no training: the rank of contract ends, and what fired beside how severe it is."""
    x = labelled(spark, sf_dir).where("healthy_at_t and label is not null")
    x = x.withColumn("single", F.round(F.coalesce(W.average_rank_share("end_rate", "year"), F.lit(0.5)), 6))
    return x.withColumn("persistence", F.round(0.5 * F.col("n_events") / 3 + 0.5 * F.col("single"), 8))


BASELINES = f"""{LABELLED}, h AS (SELECT * FROM x WHERE healthy_at_t AND label IS NOT NULL),
 k AS (SELECT *, round(coalesce(CASE WHEN end_rate IS NOT NULL THEN (rank() OVER (PARTITION BY year ORDER BY end_rate NULLS LAST) + (count(*) OVER (PARTITION BY year, end_rate) - 1) / 2.0) / count(end_rate) OVER (PARTITION BY year) END, 0.5), 6) AS single FROM h),
 s AS (SELECT *, round(0.5::DOUBLE * n_events / 3 + 0.5 * single, 8) AS persistence FROM k)"""


@query(f"WITH {BASELINES} SELECT brand_id, year, label, single, persistence FROM s")
def baseline_scores(spark, sf_dir):
    return baselines(spark, sf_dir).select("brand_id", "year", "label", "single", "persistence")


def _top(x, share: float = 0.1):
    """Rows with ``top``: the first max(1, floor(n * share)) of each year by score, ties by id."""
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("persistence"), "brand_id"))
    n = F.count("*").over(Window.partitionBy("year"))
    return x.withColumn("top", place <= F.greatest(F.lit(1), F.floor(n * share)))


TOP = f"{BASELINES}, t AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY persistence DESC, brand_id) <= greatest(1, floor(count(*) OVER (PARTITION BY year) * 0.1)) AS top FROM s)"


@query(f"WITH {TOP}, y AS (SELECT year, count(*) AS n, avg(label) AS base, avg(label) FILTER (top) AS prec FROM t GROUP BY 1) SELECT count(*) AS folds, CAST(sum(n) AS BIGINT) AS n, round(avg(prec / nullif(base, 0)), 6) AS macro_lift, round(avg(base), 6) AS macro_base FROM y")
def macro_lift(spark, sf_dir):
    y = _top(baselines(spark, sf_dir)).groupBy("year").agg(F.count("*").alias("n"), F.avg("label").alias("base"), F.avg(F.when(F.col("top"), F.col("label"))).alias("prec"))
    return y.agg(F.count("*").alias("folds"), F.sum("n").alias("n"), r6(F.avg(F.col("prec") / F.nullif("base", F.lit(0.0))), "macro_lift"), r6(F.avg("base"), "macro_base"))


@query(f"WITH {TOP} SELECT name, count(*) AS n, round(avg(CAST(top AS INT)), 6) AS recall FROM (SELECT top, unnest([CASE WHEN ev_store THEN 'store' END, CASE WHEN ev_sales THEN 'sales' END, CASE WHEN ev_contract THEN 'contract' END, CASE WHEN label = 1 THEN 'any' END]) AS name FROM t) WHERE name IS NOT NULL GROUP BY 1")
def label_decomposition(spark, sf_dir):
    """Recall among the top rows for each kind of event."""
    kinds = F.array_compact(F.array(*[F.when(F.col(f"ev_{k}"), k) for k in ("store", "sales", "contract")], F.when(F.col("label") == 1, "any")))
    return _top(baselines(spark, sf_dir)).select("top", F.explode(kinds).alias("name")).groupBy("name").agg(F.count("*").alias("n"), r6(F.avg(F.col("top").cast("int")), "recall"))


@query(f"WITH {BASELINES}, pl AS (SELECT *, row_number() OVER (ORDER BY persistence DESC, brand_id, year) AS rk, count(*) OVER () AS n FROM s) SELECT year, count(*) AS n_rows, round(count(*) * 1.0 / max(n), 6) AS share, round(count(*) FILTER (rk <= greatest(1, floor(n * 0.1))) * 1.0 / max(greatest(1, floor(n * 0.1))), 6) AS share_of_top FROM pl GROUP BY 1")
def pool_bias(spark, sf_dir):
    """Whether a year's share of the pooled top rows is its share of all rows."""
    from tidemark.operators.ordered import ranked

    x = ranked(baselines(spark, sf_dir).select("year", "brand_id", "persistence"), [F.desc("persistence"), F.asc("brand_id"), F.asc("year")])
    n = F.broadcast(x.agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.floor(F.count("*") * 0.1)).alias("k")))
    return x.crossJoin(n).groupBy("year").agg(F.count("*").alias("n_rows"), r6(F.count("*") / F.max("n"), "share"), r6(F.count_if(F.col("rank") <= F.col("k")) / F.max("k"), "share_of_top"))


@query(f"WITH {BASELINES}, m AS (SELECT *, min(year) OVER (PARTITION BY brand_id) < year AS known FROM s) SELECT known, count(*) AS n, round(avg(label), 6) AS base_rate, round(avg((persistence - label) * (persistence - label)), 6) AS brier FROM m GROUP BY 1")
def known_and_new(spark, sf_dir):
    x = baselines(spark, sf_dir).withColumn("known", F.min("year").over(Window.partitionBy("brand_id")) < F.col("year"))
    off = F.col("persistence") - F.col("label")
    return x.groupBy("known").agg(F.count("*").alias("n"), r6(F.avg("label"), "base_rate"), r6(F.avg(off * off), "brier"))


@query(f"""WITH {LABELLED}, b AS (SELECT mid, year, count(*) AS r, count(*) FILTER (n_end * 2 > n_stores) AS k FROM x GROUP BY 1, 2), c AS (SELECT mid, sum(r * (r - 1) / 2.0::DOUBLE) AS pairs, sum(k) * 1.0::DOUBLE / sum(r) AS p, sum(k * (k - 1) / 2.0::DOUBLE) / sum(r * (r - 1) / 2.0::DOUBLE) AS p11 FROM b WHERE r >= 2 GROUP BY 1)
 SELECT count(*) AS strata, round(sum(pairs), 6) AS pairs, round(sum(pairs * (p11 - p * p) / (p * (1 - p))) / sum(pairs), 6) AS correlation FROM c WHERE pairs >= 200 AND p > 0 AND p < 1""")
def stratified_correlation(spark, sf_dir):
    """Event correlation averaged over strata by their pairs; strata of few pairs or without variation are left out."""
    b = labelled(spark, sf_dir).groupBy("mid", "year").agg(F.count("*").alias("r"), F.count_if(F.col("n_end") * 2 > F.col("n_stores")).alias("k")).where("r >= 2")
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    c = b.groupBy("mid").agg(pairs("r").alias("pairs"), (F.sum("k") / F.sum("r")).alias("p"), (pairs("k") / pairs("r")).alias("p11")).where("pairs >= 200 and p > 0 and p < 1")
    p = F.col("p")
    return c.agg(F.count("*").alias("strata"), r6(F.sum("pairs"), "pairs"), r6(F.sum(F.col("pairs") * (F.col("p11") - p * p) / (p * (1 - p))) / F.sum("pairs"), "correlation"))


@query(f"""WITH {FINDINGS}, k AS (SELECT brand_id, year, category, sign, CASE WHEN sign = 'risk' THEN max(weight) + 0.35 * (sum(weight) - max(weight)) ELSE min(weight) + 0.35 * (sum(weight) - min(weight)) END AS part FROM w GROUP BY 1, 2, 3, 4),
 cm AS (SELECT brand_id, year, 30 * tanh(sum(part) / 30) AS component FROM k GROUP BY 1, 2) SELECT brand_id, year, round(least(greatest(50 + component, 0), 100), 6) AS watch_score, CASE WHEN component >= 15 THEN 'High' WHEN component >= 5 THEN 'Medium' ELSE 'Low' END AS level FROM cm""")
def watch_score(spark, sf_dir):
    """A score of 0 to 100 around 50 from findings alone, and its level."""
    k = findings(spark, sf_dir).groupBy("brand_id", "year", "category", "sign").agg(F.sum("weight").alias("s"), F.max("weight").alias("hi"), F.min("weight").alias("lo"))
    peak = F.when(F.col("sign") == "risk", F.col("hi")).otherwise(F.col("lo"))
    c = k.withColumn("part", peak + 0.35 * (F.col("s") - peak)).groupBy("brand_id", "year").agg((30 * F.tanh(F.sum("part") / 30)).alias("component"))
    level = F.when(F.col("component") >= 15, "High").when(F.col("component") >= 5, "Medium").otherwise("Low")
    return c.select("brand_id", "year", r6(F.least(F.greatest(50 + F.col("component"), F.lit(0.0)), F.lit(100.0)), "watch_score"), level.alias("level"))


#: Poisson(1) up to five, for resampling weights (fixed values).
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
DRAWS = 200


#: The eight hex digits from which on a weight grows; digits of the same case are in order as text, so that no number is read from them.
_STEPS = [f"{math.ceil(c * 4294967296):08x}" for c in POISSON]


def _in_draws(x: DataFrame, key: str) -> DataFrame:
    """``x`` once for each draw ``b`` with its Poisson weight ``w`` from the hash of key and draw, without those of none: any task draws the same.

    The hash is made inside the exploded list, once a row and draw: a filter or a sum over cases would make it anew for each mention.
    """
    drawn = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda b: F.struct(b.alias("b"), F.substring(F.md5(F.concat(key, b.cast("string"))), 1, 8).alias("u")))
    x = x.repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("d", F.explode(drawn))
    x = x.select("*", F.col("d.b").alias("b"), F.col("d.u").alias("u")).where(F.col("u") >= _STEPS[0])
    return x.withColumn("w", sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in _STEPS), F.lit(0))).drop("d", "u", key)


_W = " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in POISSON)


def _lift_sql(score: str) -> str:
    """Each draw's lift of a score: the weighted rate among the first tenth of the weight, over that of all; rows of one score share its place."""
    return f"""SELECT b, sum(y * least(greatest((top - before) / n, 0), 1)) / any_value(top) / (any_value(yy) / any_value(nn)) AS lift FROM (SELECT *, sum(n) OVER (PARTITION BY b) AS nn, sum(y) OVER (PARTITION BY b) AS yy, greatest(1, floor(sum(n) OVER (PARTITION BY b) * 0.1)) AS top,
 coalesce(sum(n) OVER (PARTITION BY b ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT b, {score} AS v, CAST(sum(w) AS DOUBLE) AS n, CAST(sum(w * label) AS DOUBLE) AS y FROM w GROUP BY 1, 2 HAVING sum(w) > 0)) WHERE yy > 0 GROUP BY b"""


@query(f"""WITH {BASELINES}, d AS (SELECT b, label, single, persistence, CAST('0x' || substr(md5(CAST(brand_id AS VARCHAR) || ':' || CAST(year AS VARCHAR) || ':' || CAST(b AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM s, (SELECT unnest(range({DRAWS})) AS b)),
 w AS (SELECT *, {_W} AS w FROM d), m AS (SELECT b, p.lift - q.lift AS gain FROM ({_lift_sql("persistence")}) p JOIN ({_lift_sql("single")}) q USING (b))
 SELECT count(*) AS draws, round(quantile_cont(gain, 0.025), 6) AS low, round(avg(gain), 6) AS mean, round(quantile_cont(gain, 0.975), 6) AS high, round(avg(CAST(gain > 0 AS INT)), 6) AS win_rate FROM m""")
def paired_bootstrap(spark, sf_dir):
    """The gain of one score over another in lift, over draws that both share: weights add up by draw and score, no resampled table."""
    x = baselines(spark, sf_dir).select("label", "single", "persistence", F.concat(F.concat_ws(":", "brand_id", "year"), F.lit(":")).alias("key"))
    w = _in_draws(x, "key")
    # both scores of a row at once: of rows of the same two scores only the sums are needed, so that a weight is drawn once
    w = cut(w.groupBy("b", "single", "persistence").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("label")).alias("y")))

    def lifts(score: str):
        v = w.groupBy("b", F.col(score).alias("v")).agg(F.sum("w").cast("double").alias("n"), F.sum("y").cast("double").alias("y"))
        own = Window.partitionBy("b")
        before = F.coalesce(F.sum("n").over(own.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        v = v.withColumns({"before": before, "nn": F.sum("n").over(own), "yy": F.sum("y").over(own)}).withColumn("top", F.greatest(F.lit(1.0), F.floor(F.col("nn") * 0.1)))
        share = F.least(F.greatest((F.col("top") - F.col("before")) / F.col("n"), F.lit(0.0)), F.lit(1.0))
        return v.where("yy > 0").groupBy("b", "top", "nn", "yy").agg(F.sum(F.col("y") * share).alias("k")).select("b", (F.col("k") / F.col("top") / (F.col("yy") / F.col("nn"))).alias(score))

    m = lifts("persistence").join(lifts("single"), "b").select((F.col("persistence") - F.col("single")).alias("gain"))
    return m.agg(F.count("*").alias("draws"), r6(F.percentile("gain", 0.025), "low"), r6(F.avg("gain"), "mean"), r6(F.percentile("gain", 0.975), "high"), r6(F.avg((F.col("gain") > 0).cast("int")), "win_rate"))


@query(f"""WITH {BASELINES}, a AS (SELECT year, label, row_number() OVER (PARTITION BY year ORDER BY md5('7:' || CAST(brand_id AS VARCHAR)), brand_id) AS place FROM s), b AS (SELECT year, persistence, row_number() OVER (PARTITION BY year ORDER BY brand_id) AS place FROM s)
 SELECT year, count(*) AS n, round(avg((persistence - label) * (persistence - label)), 6) AS null_brier FROM a JOIN b USING (year, place) GROUP BY 1""")
def block_permutation(spark, sf_dir):
    """Squared error against labels that are permuted inside each year by a seeded hash."""
    x = baselines(spark, sf_dir).select("brand_id", "year", "label", "persistence")
    by = lambda *o: F.row_number().over(Window.partitionBy("year").orderBy(*o)).alias("place")
    a = x.select("year", "label", by(F.md5(F.concat(F.lit("7:"), F.col("brand_id").cast("string"))), "brand_id"))
    b = x.select("year", "persistence", by("brand_id"))
    off = F.col("persistence") - F.col("label")
    return a.join(b, ["year", "place"]).groupBy("year").agg(F.count("*").alias("n"), r6(F.avg(off * off), "null_brier"))


@query()
def exact_rate_table(spark, sf_dir):
    """(n_events, n, k, rate, low, high, p_above): rates with Clopper-Pearson intervals and the binomial probability of as many events at the overall rate."""
    x = labelled(spark, sf_dir).where("label is not null and prev_stores is not null")
    t = x.groupBy("n_events").agg(F.count("*").alias("n"), F.sum("label").alias("k")).crossJoin(F.broadcast(x.agg(F.avg("label").alias("base"))))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            low, high = zip(*map(kernels.exact_interval, b.k, b.n)) if len(b) else ((), ())
            above = [1 - kernels.binomial_cdf(k - 1, n, p) for k, n, p in zip(b.k, b.n, b.base)]
            yield pd.DataFrame({"n_events": b.n_events, "n": b.n, "k": b.k, "rate": b.k / b.n, "low": low, "high": high, "p_above": above})

    return t.mapInPandas(exact, "n_events int, n long, k long, rate double, low double, high double, p_above double")


#: Closings that a comparison needs, openings in the base, and the level of the test (fixed values).
LEAST_EVENTS, LEAST_BASE, ALPHA = 3, 10, 0.05


def alarm(before: Column, after: Column, base_before: Column, base_after: Column) -> Column:
    """worse, better, same or hold: the exact binomial test of the later closings among all, given the two bases."""

    @F.pandas_udf("double")
    def above(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(c) else 1 - kernels.binomial_cdf(int(a) - 1, int(b), c) for a, b, c in zip(k, n, p)], dtype="float64")

    n = before + after
    thin = (base_before < LEAST_BASE) | (base_after < LEAST_BASE) | (n < LEAST_EVENTS)
    p = F.when(~thin, base_after / (base_before + base_after))  # thin bases may add up to zero
    up, down = above(after, n, p), above(before, n, 1 - p)
    worse = after * base_before > before * base_after
    return F.when(thin, "hold").when(worse & (up <= ALPHA), "worse").when(~worse & (down <= ALPHA), "better").otherwise("same")


@query()
def closure_alarm(spark, sf_dir):
    """(user_id, before, after, signal): closings of the later half of the days against the earlier half."""
    f = flows(spark, sf_dir)
    mid = F.broadcast(f.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.date_add("a", F.floor(F.date_diff("b", "a") / 2).cast("int")).alias("mid")))
    late = F.col("day") > F.col("mid")
    t = f.crossJoin(mid).groupBy("user_id").agg(
        F.sum(F.when(~late, F.col("n_close")).otherwise(0)).alias("before"), F.sum(F.when(late, F.col("n_close")).otherwise(0)).alias("after"), (LEAST_BASE + F.sum(F.when(~late, F.col("n_open")).otherwise(0))).alias("b0"), (LEAST_BASE + F.sum(F.when(late, F.col("n_open")).otherwise(0))).alias("b1")
    )
    return t.select("user_id", "before", "after", "b0", "b1", alarm(F.col("before"), F.col("after"), F.col("b0"), F.col("b1")).alias("signal"))


@query(f"""WITH {FLOWS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM f) SELECT user_id, CASE WHEN count(*) >= 18 THEN round(avg(n_close) FILTER (rn <= 12) - avg(n_close) FILTER (rn BETWEEN 13 AND 24), 6) END AS change,
 round(regr_slope(n_close, -rn) / nullif(avg(n_close), 0), 6) AS relative_slope FROM r GROUP BY 1""")
def period_change(spark, sf_dir):
    """The mean of the last twelve periods less that of the twelve before, and the slope relative to the mean."""
    r = flows(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day"))))
    c, n = F.col("n_close").cast("double"), F.col("rn")
    change = F.avg(F.when(n <= 12, c)) - F.avg(F.when(n.between(13, 24), c))
    return r.groupBy("user_id").agg(r6(F.when(F.count("*") >= 18, change), "change"), r6(F.regr_slope(c, -n.cast("double")) / F.nullif(F.avg(c), F.lit(0.0)), "relative_slope"))
