"""Evidence on scores: attributions, calibrators by one rule, the search for cuts with its null, resampled intervals, clustered regression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators import attribution, calibration, cuts, metrics, regression, resample, simulate
from tidemark.operators.ordered import cut, ranked
from tidemark.plans.assessment import FEATURES, split
from tidemark.plans.base import query, r6, table
from tidemark.plans.labels import labelled
from tidemark.plans.portfolio import _names
from tidemark.plans.validation import BASELINES, baselines

#: Rows of the mean that come with each isotonic level, draws of a bootstrap, pairs that a stratum must have, folds of brands.
STRENGTH, DRAWS, LEAST_PAIRS, FOLDS = 20.0, 200, 200, 5
#: Bounds of a served probability.
FLOOR, CAP = 0.0003, 0.99


@query()
def top_attributions(spark, sf_dir):
    """(brand_id, year, feature, shap_value, feature_value): what drove each score of the test year, by boosted trees of the years before it."""
    x = labelled(spark, sf_dir).where("healthy_at_t and label is not null").select("brand_id", "year", F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in FEATURES])
    x = cut(split(x))
    train = x.where("split != 'test'")
    filled = Imputer(strategy="median", inputCols=FEATURES, outputCols=FEATURES).fit(train)
    model = GBTClassifier(maxDepth=4, maxIter=12, seed=7).fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(filled.transform(train)))
    return attribution.attributed(filled.transform(x.where("split = 'test'")), attribution.leaves(model), ["brand_id", "year"], FEATURES)


def _calibrated(spark, sf_dir):
    """Baseline scores with ``p``, the shrunk isotonic step of the persistence score, and the levels."""
    x = cut(baselines(spark, sf_dir).select("brand_id", "year", "label", "single", "persistence"))
    levels = calibration.shrunk_levels(calibration.isotonic_blocks(x, "persistence", "label"), STRENGTH)
    return x.withColumn("p", calibration.stepped(F.col("persistence"), levels)), levels


@query()
def score_levels(spark, sf_dir):
    """(low, n, events, value): the levels of the shrunk isotonic fit and what each score from ``low`` on gets."""
    _, levels = _calibrated(spark, sf_dir)
    return spark.createDataFrame([(x.low, x.n, x.k, x.value) for x in levels], "low double, n long, events long, value double")


def _grades(spark, found, extra: dict):
    """A row a grade of a search's result; one row of nulls where there are no cuts."""
    kinds = "grade int, low double, n long, events long, rate double, ci_low double, ci_high double, separation double" + "".join(f", {k} {t}" for k, (t, _) in extra.items())
    more = tuple(v for _, v in extra.values())
    if found is None:
        return spark.createDataFrame([(None,) * 8 + more], kinds)
    lows = [0.0, *(cuts.GRID[i] for i in found.cuts)]
    rows = [(g + 1, lows[g], n, k, k / n if n else None, *(cuts.interval(k, n) if n else (None, None)), found.separation, *more) for g, (n, k) in enumerate(zip(found.n, found.k))]
    return spark.createDataFrame(rows, kinds)


@query()
def cut_search(spark, sf_dir):
    """The two cuts of the calibrated score whose grades lie furthest apart, with the grades' rates and exact intervals."""
    x, _ = _calibrated(spark, sf_dir)
    _, n, k = cuts.counts(x, "p", "label", "year")
    return _grades(spark, cuts.search(n, k), {})


@query()
def cut_null(spark, sf_dir):
    """(draws, found, separation, null_max, null_p95, p_value): the same search on labels permuted inside each year, and how often chance does as well."""
    x, _ = _calibrated(spark, sf_dir)
    _, n, k = cuts.counts(x, "p", "label", "year")
    best = cuts.search(n, k)
    own = F.lit(None if best is None else best.separation).cast("double")
    t = cuts.null(spark, n, k, DRAWS).agg(F.count("*").alias("draws"), F.count("separation").alias("found"), own.alias("separation"), r6(F.max("separation"), "null_max"), r6(F.percentile("separation", 0.95), "null_p95"), F.count_if(F.col("separation") >= own).alias("as_good"))
    return t.select("draws", "found", r6("separation", "separation"), "null_max", "null_p95", r6(F.when(own.isNotNull(), (F.col("as_good") + 1) / (F.col("draws") + 1)), "p_value"))


@query()
def cut_out_of_time(spark, sf_dir):
    """The procedure on trial: levels and cuts from all years but the last, graded on the last."""
    x = cut(baselines(spark, sf_dir).select("year", "label", "persistence"))
    last = x.agg(F.max("year")).first()[0]
    levels = calibration.shrunk_levels(calibration.isotonic_blocks(x.where(F.col("year") < last), "persistence", "label"), STRENGTH)
    x = x.withColumn("p", calibration.stepped(F.col("persistence"), levels))
    years, n, k = cuts.counts(x, "p", "label", "year")
    best = cuts.search(n[:-1], k[:-1])
    if best is None:
        return _grades(spark, None, {"year": ("int", int(last)), "monotone": ("boolean", None)})
    edges = [0, best.cuts[0] + 1, best.cuts[1] + 1, n.shape[1]]
    own_n, own_k = ([int(v[-1, a:b].sum()) for a, b in zip(edges, edges[1:])] for v in (n, k))
    rates = [b / a if a else math.nan for a, b in zip(own_n, own_k)]
    ends = [cuts.interval(b, a) if a else (math.nan, math.nan) for a, b in zip(own_n, own_k)]
    apart = min(ends[1][0] - ends[0][1], ends[2][0] - ends[1][1])
    return _grades(spark, cuts.Found(best.cuts, tuple(own_n), tuple(own_k), apart), {"year": ("int", int(last)), "monotone": ("boolean", bool(rates[0] < rates[1] < rates[2]))})


@query()
def calibrated_scores(spark, sf_dir):
    """(model, split, method, n, base_rate, brier, log_loss, distinct_scores): three scores calibrated on the validation year by one rule, so that none is judged on its raw scale.

    Isotonic levels from 300 rows on, else a sigmoid; bounded; ties broken by the rank of the raw score, at most 1e-5.
    """
    x = cut(split(baselines(spark, sf_dir).withColumns({"growth_score": F.round(-F.coalesce("growth", F.lit(0.0)), 6)}).select("brand_id", "year", "label", "single", "persistence", "growth_score")))
    valid = x.where("split = 'valid'")
    n, k = valid.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    method = calibration.method_for(n, k)
    total, out = x.count(), None
    for name in ("persistence", "single", "growth_score"):
        _, p = calibration.fitted(valid, name, "label", method)
        y = ranked(x.withColumn("p", F.least(F.greatest(p, F.lit(FLOOR)), F.lit(CAP))), [F.asc(name), F.asc("brand_id"), F.asc("year")])
        y = y.withColumn("p", F.least(F.col("p") + F.col("rank") / F.lit(float(max(total, 1))) * 1e-5, F.lit(1.0)))
        loss = -F.avg(F.when(F.col("label") == 1, F.log("p")).otherwise(F.log(1 - F.col("p"))))
        t = y.groupBy("split").agg(F.count("*").alias("n"), r6(F.avg("label"), "base_rate"), r6(F.avg((F.col("p") - F.col("label")) * (F.col("p") - F.col("label"))), "brier"), r6(loss, "log_loss"), F.count_distinct("p").alias("distinct_scores"))
        t = t.select(F.lit(name).alias("model"), "split", F.lit(method).alias("method"), "n", "base_rate", "brier", "log_loss", "distinct_scores")
        out = t if out is None else out.unionByName(t)
    return out


LIFTS = f"""{BASELINES}, lr AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY persistence DESC, brand_id) AS rm, row_number() OVER (PARTITION BY year ORDER BY single DESC, brand_id) AS rs, greatest(1, floor(count(*) OVER (PARTITION BY year) * 0.1)) AS kk FROM s),
 lf AS (SELECT year, avg(label) FILTER (rm <= kk) / nullif(avg(label), 0) AS lm, avg(label) FILTER (rs <= kk) / nullif(avg(label), 0) AS ls FROM lr GROUP BY 1)"""


@query(f"""WITH RECURSIVE {LIFTS}, dr AS (SELECT 0 AS depth, 0::DOUBLE AS a, 0::DOUBLE AS b, 0 AS m UNION ALL SELECT depth + 1, a + coalesce(lm, 0), b + coalesce(ls, 0), m + CAST(lm IS NOT NULL AS INT) FROM dr, lf WHERE depth < (SELECT count(*) FROM lf)),
 dl AS (SELECT round(a / m - b / m, 12) AS delta FROM dr WHERE depth = (SELECT count(*) FROM lf) AND m > 0)
 SELECT count(*) AS draws, round(avg(delta), 6) AS mean_delta, round(quantile_cont(delta, 0.025), 6) AS ci_low, round(quantile_cont(delta, 0.975), 6) AS ci_high, round(avg(CAST(delta > 0 AS INT)), 6) AS p_win FROM dl""")
def year_block_lift(spark, sf_dir):
    """Persistence against the single score by the mean of the years' lifts, over every draw of years with replacement; a year drawn twice counts as two folds."""
    x = baselines(spark, sf_dir).select("brand_id", "year", "label", "single", "persistence")
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("year")) * 0.1))
    first = lambda c: F.row_number().over(Window.partitionBy("year").orderBy(F.desc(c), "brand_id")) <= k
    x = x.withColumns({"main": first("persistence"), "plain": first("single")})
    base = F.nullif(F.avg("label"), F.lit(0.0))
    lifts = x.groupBy("year").agg((F.avg(F.when(F.col("main"), F.col("label"))) / base).alias("main"), (F.avg(F.when(F.col("plain"), F.col("label"))) / base).alias("plain")).orderBy("year").collect()  # a row a year
    deltas, times = [], []
    for picked, m in resample.all_draws(len(lifts)):
        own = [lifts[i] for i in picked if lifts[i]["main"] is not None]
        if own:
            deltas.append(round(sum(r["main"] for r in own) / len(own) - sum(r["plain"] for r in own) / len(own), 12))
            times.append(m)
    d, m = np.array(deltas), np.array(times, np.int64)
    if not len(d):
        return spark.createDataFrame([(0, None, None, None, None)], "draws long, mean_delta double, ci_low double, ci_high double, p_win double")
    row = (int(m.sum()), float((d * m).sum() / m.sum()), resample.weighted_quantile(d, m, 0.025), resample.weighted_quantile(d, m, 0.975), float(m[d > 0].sum() / m.sum()))
    return spark.createDataFrame([row], "draws long, mean_delta double, ci_low double, ci_high double, p_win double").select("draws", *[r6(c, c) for c in ("mean_delta", "ci_low", "ci_high", "p_win")])


def market_blocks(spark, sf_dir):
    """(supplier, year, r, k): in how many nations a supplier sold, and in how many of them over a third of its lines came back."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.year("l_shipdate").alias("year"), (F.col("l_returnflag") == "R").cast("int").alias("back"))
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    b = x.groupBy(F.col("l_suppkey").alias("supplier"), "year", "c_nationkey").agg((F.avg("back") > 1 / 3).cast("int").alias("bad"))
    return b.groupBy("supplier", "year").agg(F.count("*").alias("r"), F.sum("bad").alias("k"))


def correlations(sums, by: list[str]):
    """(by, rho_event, rho_asset) from weighted pair sums (r, k, pairs, both) of strata: means weighted by pairs, over strata of LEAST_PAIRS or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p, p11 = b["k"] / b["r"], b["both"] / b["pairs"]
            yield b[by + ["pairs"]].assign(rho_event=(p11 - p * p) / (p * (1 - p)), rho_asset=[kernels.asset_correlation(x, y) for x, y in zip(p, p11)])

    kept = sums.where((F.col("pairs") >= LEAST_PAIRS) & (F.col("k") > 0) & (F.col("k") < F.col("r"))).select(*by, *[F.col(c).cast("double").alias(c) for c in ("r", "k", "pairs", "both")])
    schema = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in by) + ", pairs double, rho_event double, rho_asset double"
    mean = lambda c: (F.sum(F.col("pairs") * F.col(c)) / F.sum("pairs")).alias(c)
    return kept.mapInPandas(run, schema).groupBy(*by).agg(mean("rho_event"), mean("rho_asset"))


def pair_sums(blocks, keys: list[str]):
    """Sums of (r, k, pairs, both) by ``keys`` of blocks with a weight ``w``: pairs are counted, never listed."""
    r, k, w = F.col("r"), F.col("k"), F.col("w")
    return blocks.groupBy(*keys).agg(F.sum(w * r).alias("r"), F.sum(w * k).alias("k"), F.sum(w * r * (r - 1) / 2).alias("pairs"), F.sum(w * k * (k - 1) / 2).alias("both"))


@query()
def asset_correlation_interval(spark, sf_dir):
    """(control, rho_event, rho_asset and their 95 % intervals, draws): all years in one stratum, or each its own, by resampling whole suppliers."""
    b = cut(market_blocks(spark, sf_dir))
    both = F.explode(F.array(F.struct(F.lit("none").alias("control"), F.lit(0).alias("stratum")), F.struct(F.lit("year").alias("control"), F.col("year").alias("stratum"))))
    strata = lambda d: d.withColumn("s", both).select("*", "s.*")
    point = correlations(pair_sums(strata(b.withColumn("w", F.lit(1))), ["control", "stratum"]).withColumn("draw", F.lit(-1)), ["control", "draw"])
    # a draw's sums by year come first; the single stratum is their sum
    sums = pair_sums(resample.in_draws(b, "supplier", DRAWS), ["draw", "year"])
    sums = strata(sums).groupBy("control", "draw", "stratum").agg(*[F.sum(c).alias(c) for c in ("r", "k", "pairs", "both")])
    drawn = correlations(sums, ["control", "draw"])
    ends = drawn.groupBy("control").agg(*[r6(F.percentile(f"rho_{m}", q), f"{m}_{e}") for m in ("event", "asset") for q, e in ((0.025, "low"), (0.975, "high"))], F.count("rho_asset").alias("draws"))
    return point.select("control", r6("rho_event", "rho_event"), r6("rho_asset", "rho_asset")).join(ends, "control", "left")


def logit(p):
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(q / (1 - q))


@query()
def risk_evidence(spark, sf_dir):
    """Whether a brand's risk tells more than the internal score: its odds ratio with errors robust to brands, and the gain in AUC on folds of whole brands."""
    x = baselines(spark, sf_dir).select("brand_id", "label", "single", logit(F.col("persistence")).alias("risk"))
    means = x.agg(F.avg("single").alias("ms"), F.stddev_pop("single").alias("ss"), F.avg("risk").alias("mr"), F.stddev_pop("risk").alias("sr"))
    scaled = lambda c, m, s: (F.col(c) - F.col(m)) / F.when(F.col(s) > 0, F.col(s)).otherwise(1.0)
    x = cut(x.crossJoin(F.broadcast(means)).select("brand_id", F.col("label").cast("double").alias("label"), scaled("single", "ms", "ss").alias("z"), scaled("risk", "mr", "sr").alias("zr"), "risk", F.pmod(F.xxhash64("brand_id"), F.lit(FOLDS)).cast("int").alias("fold")))
    whole = regression.Problem([F.col("z"), F.col("zr")])
    (beta,) = regression.newton(x, [whole], "label")
    cov, groups = regression.cluster_covariance(x, whole, beta, "label", "brand_id")
    b, se = float(beta[2]), math.sqrt(max(cov[2, 2], 0.0))
    p = 2 * kernels.normal_cdf(-abs(b / se)) if se > 0 else None
    # all folds and both models in each pass; then the AUC inside each fold
    sets = {"base": [F.col("z")], "with_risk": [F.col("z"), F.col("risk")]}
    problems = {(name, f): regression.Problem(cols, F.col("fold") != f, 1.0) for name, cols in sets.items() for f in range(FOLDS)}
    fits = dict(zip(problems, regression.newton(x, list(problems.values()), "label")))
    own = {name: F.coalesce(*[F.when(F.col("fold") == f, regression.chance(problems[name, f], fits[name, f])) for f in range(FOLDS)]) for name in sets}
    long = x.select("fold", "label", F.explode(F.array(*[F.struct(F.lit(name).alias("model"), e.alias("s")) for name, e in own.items()])).alias("e")).select("fold", "label", "e.*")
    means = {r["model"]: r["auc"] for r in metrics.auc_and_lift(long, ["model", "fold"], "s", "label").groupBy("model").agg(F.avg("auc").alias("auc")).collect()}  # two rows
    gains = {name: means.get(name) for name in sets}
    gain = None if None in gains.values() else gains["with_risk"] - gains["base"]
    row = (b, se, math.exp(b), math.exp(b - 1.96 * se), math.exp(b + 1.96 * se), p, groups, gains["base"], gains["with_risk"], gain)
    names = ["beta", "se", "odds_ratio", "or_low", "or_high", "p_value", "clusters", "auc_base", "auc_with_risk", "gain"]
    out = spark.createDataFrame([row], ", ".join(f"{n} {'long' if n == 'clusters' else 'double'}" for n in names))
    return out.select(*[n if n == "clusters" else r6(n, n) for n in names])


@query()
def tail_errors(spark, sf_dir):
    """(level, quantile, standard_error): quantiles of the simulated loss with their simulation error."""
    return simulate.quantile_errors(simulate.totals(_names(spark, sf_dir), 0.05, 0.4, 20_000), [0.95, 0.99, 0.999])


#: Cuts of grades and the features that a cohort must have.
BANDS, NEEDED = [0.035, 0.06], ["end_rate", "n_events", "n_stores"]


def strict(cohort, wanted: list[str]):
    """The keys and features of a cohort that a model was fitted on; a missing one is an error, others are dropped."""
    missing = [c for c in wanted if c not in cohort.columns]
    if missing:
        raise ValueError(f"the cohort lacks {missing}")
    return cohort.select("brand_id", "year", *wanted)


@query()
def cohort_scores(spark, sf_dir):
    """(brand_id, year, p, grade, shown): the last two cohorts, each scored by the model fitted on the years before both; the grade by its calibrated step, the shown value kept inside its grade's band."""
    x = labelled(spark, sf_dir).where("healthy_at_t").withColumn("end_rate", F.coalesce("end_rate", F.lit(0.0)))
    x = cut(x.select("brand_id", "year", F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in NEEDED]))
    last = x.agg(F.max("year")).first()[0]
    train = x.where((F.col("year") < last - 1) & F.col("label").isNotNull())
    moments = train.agg(*[F.avg(c) for c in NEEDED], *[F.stddev_pop(c) for c in NEEDED]).first()
    m = len(NEEDED)
    scaled = [(F.col(c) - moments[i]) / (moments[m + i] or 1.0) for i, c in enumerate(NEEDED)]
    problem = regression.Problem(scaled, ridge=1.0)
    (beta,) = regression.newton(train, [problem], "label")
    raw = regression.chance(problem, beta)
    levels = calibration.shrunk_levels(calibration.isotonic_blocks(train.withColumn("raw", raw), "raw", "label"), STRENGTH)
    out = None
    for year in (last - 1, last):
        cohort = strict(x.where(F.col("year") == year), NEEDED).withColumn("p", raw)
        step = calibration.stepped(F.col("p"), levels)
        grade = F.when(step < BANDS[0], 0).when(step < BANDS[1], 1).otherwise(2)
        low, high = F.get(F.array(*map(F.lit, [0.0, *BANDS])), grade), F.get(F.array(*map(F.lit, [*[b - 1e-6 for b in BANDS], 1.0])), grade)
        cohort = cohort.select("brand_id", "year", r6("p", "p"), (grade + 1).alias("grade"), r6(F.least(F.greatest(F.col("p"), low), high), "shown"))
        out = cohort if out is None else out.union(cohort)
    return out


#: Groups of features, each stage with those before it.
GROUPS = [("size", ["n_stores"]), ("history", ["prev_stores"]), ("growth", ["growth"]), ("sales", ["sales_growth"]), ("events", ["end_rate", "n_events"])]


@query()
def feature_ablation(spark, sf_dir):
    """(stage, group, n_features, split, n, auc, lift): what each group of features adds to a logistic model of those before it; all stages are fitted in the same passes."""
    names = [c for _, group in GROUPS for c in group]
    x = split(labelled(spark, sf_dir).where("healthy_at_t and label is not null").select("brand_id", "year", F.col("label").cast("double").alias("label"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names]))
    x = cut(x)
    train = x.where("split = 'train'")
    moments = train.agg(*[F.avg(c) for c in names], *[F.stddev_pop(c) for c in names]).first()
    scaled = [(F.col(c) - moments[i]) / (moments[len(names) + i] or 1.0) for i, c in enumerate(names)]
    sizes = [sum(len(g) for _, g in GROUPS[: k + 1]) for k in range(len(GROUPS))]
    problems = [regression.Problem(scaled[:m], ridge=1.0) for m in sizes]
    fits = regression.newton(train, problems, "label")
    stages = F.array(*[F.struct(F.lit(k + 1).alias("stage"), F.lit(g).alias("group"), F.lit(sizes[k]).alias("n_features"), regression.chance(problems[k], fits[k]).alias("s")) for k, (g, _) in enumerate(GROUPS)])
    long = x.where("split != 'train'").select("split", "label", F.explode(stages).alias("e")).select("split", "label", "e.*")
    out = metrics.auc_and_lift(long, ["stage", "group", "n_features", "split"], "s", "label")
    return out.select("stage", "group", "n_features", "split", "n", r6("auc", "auc"), r6("lift", "lift"))
