"""Attributions, calibrators, cuts, resampling and regression against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators import attribution, calibration, cuts, regression, resample, simulate
from tidemark.plans import evidence

NAMES = list("abcdef")


@pytest.fixture(scope="module")
def boosted(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 6)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] - 0.5 * x[:, 4] + rng.normal(size=400) > 0).astype(float)
    rows = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, " + ", ".join(f"{n} double" for n in NAMES) + ", label double").repartition(3)
    ready = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    return rows, ready, GBTClassifier(maxDepth=4, maxIter=6, seed=2).fit(ready), x


def expectation(node, x, known):
    """A tree's expectation when the features of ``known`` are known, by its nodes."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    split, left, right = node.split(), node.leftChild(), node.rightChild()
    if split.featureIndex() in known:
        return expectation(left if x[split.featureIndex()] <= split.threshold() else right, x, known)
    a, b = left.impurityStats().count(), right.impurityStats().count()
    return (a * expectation(left, x, known) + b * expectation(right, x, known)) / (a + b)


def test_attributions_are_shapley_values(spark, boosted):
    rows, ready, model, x = boosted
    found = attribution.leaves(model)
    roots = [(t._call_java("rootNode"), w) for t, w in zip(model.trees, model.treeWeights)]
    for r in x[:4]:
        worth = {s: sum(w * expectation(root, r, s) for root, w in roots) for n in range(7) for s in itertools.combinations(range(6), n)}
        want = [sum(math.factorial(len(s)) * math.factorial(5 - len(s)) / 720 * (worth[tuple(sorted((*s, f)))] - worth[s]) for n in range(6) for s in itertools.combinations([i for i in range(6) if i != f], n)) for f in range(6)]
        assert attribution.base_value(found) == pytest.approx(worth[()], abs=1e-12)
        assert attribution.shapley(found, r[None])[0] == pytest.approx(want, abs=1e-12)
    margins = {r.id: -0.5 * math.log(1 / r.probability[1] - 1) for r in model.transform(ready).collect()}
    sums = attribution.attributed(rows, found, ["id"], NAMES).groupBy("id").agg(F.sum("shap_value").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == 400 and all(r.n == 6 and r.s == pytest.approx(margins[r.id] - attribution.base_value(found), abs=1e-9) for r in sums)
    two = attribution.attributed(rows, found, ["id"], NAMES, 2).where("id = 7").collect()
    all_of = sorted(zip(-np.abs(attribution.shapley(found, x[7:8])[0]), range(6)))[:2]
    assert sorted(r.feature for r in two) == sorted(NAMES[i] for _, i in all_of)


def every_pair(rows, least):
    """The search on rows, pair by pair."""
    best, year, p, label = None, *(np.array(c) for c in zip(*rows))
    for i, a in enumerate(cuts.GRID):
        for j, b in list(enumerate(cuts.GRID))[i + 1 :]:
            grades = [(p < a), (p >= a) & (p < b), p >= b]
            size, event = ([int(x.sum()) for x in part] for part in (grades, [label[g] for g in grades]))
            if min(size) < least or not all((g & (year == y)).any() for y in set(year) for g in grades):
                continue
            rising = lambda r: r[0] < r[1] < r[2]
            if not rising([e / s for e, s in zip(event, size)]) or not all(rising([label[g & (year == y)].mean() for g in grades]) for y in set(year)):
                continue
            ends = [kernels.exact_interval(e, s) for e, s in zip(event, size)]
            apart = min(ends[1][0] - ends[0][1], ends[2][0] - ends[1][1])
            if apart > 0 and (best is None or apart > best[0]):
                best = (apart, (i, j), tuple(size), tuple(event))
    return best


def scores(seed, n=900, slope=1.5):
    rng = random.Random(seed)
    rows = [(rng.choice((2001, 2002)), round(rng.choice((0.03, 0.05, 0.1, 0.12, 0.2, 0.29)) + rng.random() / 50, 4)) for _ in range(n)]
    return [(y, p, int(rng.random() < slope * p)) for y, p in rows]


def test_cut_search_equals_every_pair(spark):
    hits = 0
    for seed, n, slope in ((1, 900, 1.5), (2, 900, 2.5), (3, 1500, 2.0), (4, 300, 0.2)):
        rows = scores(seed, n, slope)
        frame = spark.createDataFrame([*rows, (2001, None, 1), (2001, 0.1, None)], "year int, p double, label int").repartition(3)
        years, counted, events = cuts.counts(frame, "p", "label", "year")
        found, want = cuts.search(counted, events, 60), every_pair(rows, 60)
        assert years == [2001, 2002] and int(counted.sum()) == n
        assert (found is None) == (want is None)
        if found:
            hits += 1
            assert (found.cuts, found.n, found.k) == want[1:] and found.separation == pytest.approx(want[0], abs=1e-12)
    assert hits >= 2


def test_permuted_counts_are_those_of_permuted_rows(spark):
    n, k = np.array([[3, 2, 1], [1, 0, 2]]), np.array([[1, 1, 0], [1, 0, 1]])
    cells, events = [0, 0, 0, 1, 1, 2], 2
    exact = Counter()
    for chosen in itertools.combinations(range(6), events):
        exact[tuple(sum(cells[i] == c for i in chosen) for c in range(3))] += 1 / math.comb(6, events)
    drawn = Counter(tuple(cuts.permuted(n, k, (9, d))[0]) for d in range(4_000))
    assert drawn.keys() == exact.keys() and all(abs(drawn[c] / 4_000 - exact[c]) < 0.03 for c in exact)
    assert all((cuts.permuted(n, k, (1, d)).sum(axis=1) == k.sum(axis=1)).all() and (cuts.permuted(n, k, (1, d)) <= n).all() for d in range(50))
    rows = scores(2, 900, 2.5)
    frame = spark.createDataFrame(rows, "year int, p double, label int")
    _, counted, own = cuts.counts(frame, "p", "label", "year")
    found = cuts.null(spark, counted, own, 40, 42, 60).collect()
    again = [cuts.search(counted, cuts.permuted(counted, own, (42, d)), 60) for d in range(40)]
    assert {r.draw: r.separation for r in found} == {d: None if f is None else f.separation for d, f in enumerate(again)}
    assert sum(r.separation is None for r in found) > 30


def test_levels_and_sigmoid(spark):
    rng = np.random.default_rng(6)
    s = np.round(rng.random(700), 3)
    y = (rng.random(700) < s**2).astype(int)
    frame = spark.createDataFrame([*zip(s.tolist(), y.tolist()), (None, 1), (0.5, None)], "s double, y int").repartition(4)
    values = sorted(set(s))
    fine = [(v, float((s == v).sum())) for v in values]
    iso = kernels.pool_adjacent([(y[s == v].mean(), w) for v, w in fine])
    blocks = calibration.isotonic_blocks(frame, "s", "y")
    want = {}
    for v, r in zip(values, iso):
        want.setdefault(round(r, 12), []).append(v)
    assert [b[0] for b in blocks] == [v[0] for v in want.values()] and [round(b[2] / b[1], 12) for b in blocks] == list(want)
    # every prediction of the levels is a value that rows were seen to have, and rises
    levels = calibration.shrunk_levels(blocks, 20.0)
    assert [x.value for x in levels] == sorted(x.value for x in levels) and sum(x.n * x.value for x in levels) == pytest.approx(sum((b[2] + 20 * y.mean()) / (b[1] + 20) * b[1] for b in blocks))
    probe = [-1.0, 0.0, *rng.random(30).tolist(), 1.0, 2.0]
    got = {r.s: r.v for r in spark.createDataFrame([(p,) for p in probe], "s double").select("s", calibration.stepped(F.col("s"), levels).alias("v")).collect()}
    for p in probe:
        below = [x.value for x in levels if x.low <= p] or [levels[0].value]
        assert got[p] == min(max(below[-1], 1e-6), 1 - 1e-6)
    # interpolation between the blocks' ends, as isotonic predictors do
    method, p = calibration.fitted(frame, "s", "y", calibration.method_for(700, int(y.sum())))
    knots = np.array([(v, r) for r, vs in want.items() for v in sorted({vs[0], vs[-1]})])
    got = spark.createDataFrame([(v,) for v in probe], "s double").select("s", p.alias("p")).collect()
    assert method == "isotonic" and all(r.p == pytest.approx(np.interp(r.s, knots[:, 0], knots[:, 1]), abs=1e-9) for r in got)
    assert [calibration.method_for(*a) for a in ((299, 5), (300, 5), (500, 0), (0, 0), (9, 9))] == ["sigmoid", "isotonic", "identity", "identity", "identity"]
    # a sigmoid as plain Newton steps find it
    beta, x = np.zeros(2), np.column_stack([np.ones(700), s])
    for _ in range(30):
        q = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + np.diag([0, 1e-6]), x.T @ (y - q) - np.array([0, 1e-6]) * beta)
    method, p = calibration.fitted(frame.where("s is not null and y is not null"), "s", "y", "sigmoid")
    got = spark.createDataFrame([(0.1,), (0.9,)], "s double").select("s", p.alias("p")).collect()
    assert all(r.p == pytest.approx(1 / (1 + math.exp(-beta[0] - beta[1] * r.s)), abs=1e-8) for r in got)


def test_clustered_regression(spark):
    rng = np.random.default_rng(7)
    g = rng.integers(0, 40, 600)
    x = rng.normal(size=(600, 2)) + rng.normal(size=40)[g][:, None]
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.3 * x[:, 0] - 0.8 * x[:, 1] - 1)))).astype(float)
    frame = spark.createDataFrame([(int(c), *map(float, r), float(t)) for c, r, t in zip(g, x, y)], "g int, a double, b double, y double").repartition(5)
    both, some = regression.Problem([F.col("a"), F.col("b")]), regression.Problem([F.col("b")], F.col("g") >= 10, 1.0)
    fits = regression.newton(frame, [both, some], "y")

    def plain(m, t, ridge):
        m, beta = np.column_stack([np.ones(len(m)), m]), np.zeros(m.shape[1] + 1)
        pen = np.diag([0.0] + [ridge] * (len(beta) - 1))
        for _ in range(60):
            p = 1 / (1 + np.exp(-m @ beta))
            beta = beta + np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + pen, m.T @ (t - p) - pen @ beta)
        p = 1 / (1 + np.exp(-m @ beta))
        return beta, m, p

    beta, m, p = plain(x, y, 0.0)
    assert fits[0] == pytest.approx(beta, abs=1e-8)
    assert fits[1] == pytest.approx(plain(x[g >= 10][:, 1:], y[g >= 10], 1.0)[0], abs=1e-8)
    u = m * (y - p)[:, None]
    sums = np.stack([u[g == c].sum(axis=0) for c in sorted(set(g))])
    bread = np.linalg.inv(m.T @ (m * (p * (1 - p))[:, None]))
    cov, groups = regression.cluster_covariance(frame, both, fits[0], "y", "g")
    n = len(set(g))
    assert groups == n and cov == pytest.approx(bread @ sums.T @ sums @ bread * n / (n - 1), rel=1e-6)


def test_block_weights_are_resampled_rows(spark):
    rng = random.Random(8)
    rows = [(s, y, r := rng.randrange(2, 25), rng.randrange(0, r + 1)) for s in range(30) for y in (1, 2, 3)]
    frame = spark.createDataFrame(rows, "supplier int, year int, r long, k long").repartition(4)
    drawn = resample.in_draws(frame, "supplier", 4).select("draw", "supplier", "w").distinct().collect()
    got = {r.draw: r for r in evidence.correlations(evidence.pair_sums(resample.in_draws(frame, "supplier", 4), ["draw", "year"]), ["draw"]).collect()}
    for d in range(4):
        again = [row for r in drawn if r.draw == d for row in rows if row[0] == r.supplier for _ in range(r.w)]
        total = event = asset = 0.0
        for year in (1, 2, 3):
            own = [r for r in again if r[1] == year]
            pairs = sum(r[2] * (r[2] - 1) / 2 for r in own)
            p, p11 = sum(r[3] for r in own) / sum(r[2] for r in own), sum(r[3] * (r[3] - 1) / 2 for r in own) / pairs
            total, event, asset = total + pairs, event + pairs * (p11 - p * p) / (p * (1 - p)), asset + pairs * kernels.asset_correlation(p, p11)
        assert got[d].rho_event == pytest.approx(event / total, abs=1e-9) and got[d].rho_asset == pytest.approx(asset / total, abs=1e-9)
    weights = [r.w for r in spark.range(20_000).select(resample.poisson_weight("id").alias("w")).collect()]
    assert abs(np.mean(weights) - 1) < 0.03 and abs(np.var(weights) - 1) < 0.05


def test_all_draws_of_blocks():
    for blocks in (1, 2, 3, 4):
        listed = Counter(tuple(sorted(p)) for p in itertools.product(range(blocks), repeat=blocks))
        assert dict(resample.all_draws(blocks)) == dict(listed)
    values = np.array([3.0, -1.0, 2.5, 2.5])
    times = np.array([2, 3, 1, 5])
    for q in (0.0, 0.025, 0.3, 0.5, 0.975, 1.0):
        assert resample.weighted_quantile(values, times, q) == pytest.approx(np.quantile(np.repeat(values, times), q))


def test_error_of_a_quantile(spark):
    losses = np.random.default_rng(9).lognormal(size=8_000)
    rows = simulate.quantile_errors(spark.createDataFrame([(float(v),) for v in losses], "loss double"), [0.9, 0.95]).collect()
    rng = np.random.default_rng(10)
    for r in rows:
        boots = [np.quantile(losses[rng.integers(0, 8_000, 8_000)], r.level) for _ in range(600)]
        assert r.quantile == pytest.approx(np.quantile(losses, r.level)) and r.standard_error == pytest.approx(np.std(boots, ddof=1), rel=0.15)


def test_cohorts_are_scored_by_the_fitted_model(spark):
    rows = evidence.cohort_scores(spark, "/root/testdata/sf0.001").collect()
    years = sorted({r.year for r in rows})
    assert len(years) == 2 and years[1] == years[0] + 1 and len({r.p for r in rows}) > 3
    ends = [0.0, *evidence.BANDS, 1.0]
    assert all(ends[r.grade - 1] <= r.shown <= ends[r.grade] and (r.shown == r.p or r.shown in (ends[r.grade - 1], round(ends[r.grade] - 1e-6, 6))) for r in rows)
    whole = spark.createDataFrame([(1, 2000, 0.1, 1.0, 2.0, 9)], "brand_id long, year int, end_rate double, n_events double, n_stores double, extra int")
    assert evidence.strict(whole, evidence.NEEDED).columns == ["brand_id", "year", *evidence.NEEDED]
    with pytest.raises(ValueError):
        evidence.strict(whole.drop("n_events"), evidence.NEEDED)


def test_auc_and_lift_by_group(spark):
    from tidemark.operators import metrics

    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(2), round(rng.random(), 1), rng.randrange(2)) for _ in range(300)] + [("c", 0, 0.5, 1), ("a", 0, None, 1)]
    got = {(r.g, r.h): r for r in metrics.auc_and_lift(spark.createDataFrame(rows, "g string, h int, s double, y int").repartition(3), ["g", "h"], "s", "y").collect()}
    for key in {r[:2] for r in rows}:
        own = [(s, y) for g, h, s, y in rows if (g, h) == key and s is not None]
        pairs = [(a > b) + 0.5 * (a == b) for a, y in own if y for b, z in own if not z]
        assert got[key].n == len(own) and (got[key].auc == pytest.approx(sum(pairs) / len(pairs)) if pairs else got[key].auc is None)
        top, left, hit = max(1, len(own) // 10), max(1, len(own) // 10), 0.0
        for s in sorted({s for s, _ in own}, reverse=True):
            at = [y for t, y in own if t == s]
            hit += sum(at) * min(1.0, max(0, left) / len(at))
            left -= len(at)
        assert got[key].lift == pytest.approx(hit / top / (sum(y for _, y in own) / len(own)))
