"""Models by time split, calibration and resampling."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators import metrics as M
from tidemark.plans.base import query, r6
from tidemark.plans.labels import labelled
from tidemark.plans.statistics import scored

FEATURES = ["growth", "sales_growth", "end_rate", "n_stores", "prev_stores", "n_events"]


def sample(spark, sf_dir):
    x = labelled(spark, sf_dir).where("healthy_at_t and label is not null")
    return x.select("brand_id", "year", F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in FEATURES])


def folds(spark, sf_dir, model):
    """Expanding folds: all years before one are learned from, that one is scored; (brand_id, year, label, p)."""
    x = sample(spark, sf_dir).cache()
    years = sorted(r.year for r in x.select("year").distinct().collect())  # a handful
    out = None
    for year in years[2:]:
        before, now = x.where(F.col("year") < year), x.where(F.col("year") == year)
        imputed = Imputer(strategy="median", inputCols=FEATURES, outputCols=[f"i_{c}" for c in FEATURES]).fit(before)
        vector = VectorAssembler(inputCols=[f"i_{c}" for c in FEATURES], outputCol="raw")
        scaler = StandardScaler(withMean=True, inputCol="raw", outputCol="features").fit(vector.transform(imputed.transform(before)))
        ready = lambda d: scaler.transform(vector.transform(imputed.transform(d)))
        fold = model.fit(ready(before)).transform(ready(now)).select("brand_id", "year", "label", vector_to_array("probability")[1].alias("p"))
        out = fold if out is None else out.unionByName(fold)
    return out


@query()
def logistic_walkforward(spark, sf_dir):
    return folds(spark, sf_dir, LogisticRegression(regParam=0.01))


@query()
def gbt_walkforward(spark, sf_dir):
    return folds(spark, sf_dir, GBTClassifier(maxDepth=3, maxIter=10, seed=7))


@query()
def isotonic_shrunk(spark, sf_dir):
    """(level, n, rate, shrunk, fitted): rates of 100 score levels drawn towards the mean, then pooled to rise."""
    s = scored(spark, sf_dir)
    levels = s.groupBy(F.floor(F.col("p") * 100).cast("int").alias("level")).agg(F.count("*").alias("n"), F.sum("y").alias("k")).orderBy("level").collect()  # at most 101
    base, strength = sum(r.k for r in levels) / max(1, sum(r.n for r in levels)), 20.0
    shrunk = [(r.k + strength * base) / (r.n + strength) for r in levels]
    fitted = kernels.pool_adjacent([(v, r.n + strength) for v, r in zip(shrunk, levels)])
    rows = [(r.level, r.n, r.k / r.n, float(v), float(f)) for r, v, f in zip(levels, shrunk, fitted)]
    return spark.createDataFrame(rows, "level int, n long, rate double, shrunk double, fitted double")


@query()
def bootstrap_ci(spark, sf_dir):
    """The 95 % interval of the rate among high scores, from 200 Poisson resamples: one aggregate, no resampled table."""
    s = scored(spark, sf_dir).where("p >= 0.5")
    draws = 200
    cuts = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]  # Poisson(1) up to 5
    count = lambda u: sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    long = s.select("id", "y", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    w = count(F.xxhash64("id", "b").bitwiseAND(0xFFFFFF) / float(0x1000000))
    means = long.withColumn("w", w).groupBy("b").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m"))
    return means.agg(r6(F.percentile("m", 0.025), "low"), r6(F.avg("m"), "mean"), r6(F.percentile("m", 0.975), "high"))


@query()
def fold_discrimination(spark, sf_dir):
    """AUC and Kolmogorov-Smirnov distance of the pooled walk-forward scores."""
    return M.auc_ks(logistic_walkforward(spark, sf_dir), "p", "label")


@query()
def asset_correlations(spark, sf_dir):
    """The asset correlation that gives each segment's joint event rate."""
    from tidemark.plans.statistics import pair_event_correlation

    rows = [(r.mid, kernels.asset_correlation(r.p, r.p11)) for r in pair_event_correlation(spark, sf_dir).collect()]  # a row a segment
    return spark.createDataFrame(rows, "mid string, asset_correlation double")
