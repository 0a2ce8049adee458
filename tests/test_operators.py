"""Operators against hand-made cases and plain Python."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr, kernels
from tidemark.operators import joins, metrics, simulate, windows
from tidemark.operators.ordered import ranked, running


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_money_dates_and_flags(spark):
    df = spark.createDataFrame([("(1,200)",), ("△30",), ("12.5%",), ("₩1,000",), ("x",), (None,)], "s string")
    assert values(df, expr.money(F.col("s"))) == [(-1200.0,), (-30.0,), (12.5,), (1000.0,), (None,), (None,)]
    years = spark.createDataFrame([("2023",), ("20230501",), ("2023-05-01",), ("45047",), ("abc",), ("",)], "s string")
    assert values(years, expr.origination_year(F.col("s"))) == [(2023,), (2023,), (2023,), (2023,), (None,), (None,)]
    flags = spark.createDataFrame([("Y",), ("n",), ("예",), ("아니오",), ("",), ("1,200",), ("29",), ("모름",)], "s string")
    assert values(flags, expr.outcome(F.col("s"), 30)) == [(1,), (0,), (1,), (0,), (None,), (1,), (0,), (None,)]


def test_shown_percent_keeps_below_the_cut(spark):
    df = spark.createDataFrame([(0.04999,), (0.05,), (0.0321,)], "p double")
    assert values(df, expr.shown_percent(F.col("p"), [0.05])) == [(4.9,), (5.0,), (3.2,)]


def test_guarded_join_uses_the_loose_key_only_if_it_names_one_owner(spark):
    left = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "q")], "brand string, corp string")
    right = spark.createDataFrame([("a", "x", 1.0), ("a", "w", 2.0), ("b", "k", 3.0)], "brand string, corp string, fee double")
    out = joins.guarded_left_join(left, right, ["brand", "corp"], ["brand"], ["fee"], "corp")
    assert sorted(values(out, "brand", "corp", "fee", "matched_by"), key=str) == [("a", "x", 1.0, "exact"), ("a", "y", None, "none"), ("b", "z", 3.0, "loose"), ("c", "q", None, "none")]


def test_asof_join_takes_the_grade_visible_at_origination(spark):
    history = spark.createDataFrame([("A", 2022, "FS1"), ("A", 2023, "FS3"), ("A", 2024, "FS3"), ("B", 2023, "FS2"), ("B", 2024, "FS2"), ("C", 2022, "FS3")], "brand string, year int, grade string")
    loans = spark.createDataFrame([(1, "A", 2024), (2, "A", 2025), (3, "A", 2023), (4, "B", 2024), (5, "A", 2027), (6, "C", 2024)], "id int, brand string, orig int").withColumn("seen", F.col("orig") - 2)
    out = joins.asof_join(loans, history, "brand", "seen", "year", ["grade"], 1)
    assert sorted(values(out, "id", "grade")) == [(1, "FS1"), (2, "FS3"), (3, None), (4, None), (5, "FS3"), (6, "FS3")]


def test_guarded_lag_and_runs(spark):
    df = spark.createDataFrame([("a", 2019, 1), ("a", 2020, 2), ("a", 2022, 3), ("a", 2023, 4)], "k string, y int, v int")
    out = windows.run_id("k", "y", df.withColumn("p", windows.guarded_lag("v", "k", "y")))
    assert sorted(values(out, "y", "p", "run")) == [(2019, None, 1), (2020, 1, 1), (2022, None, 2), (2023, 3, 2)]


def test_average_rank_share_is_pandas_rank(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 60), "v": rng.integers(0, 8, 60).astype(float)})
    pdf.loc[::7, "v"] = None
    df = spark.createDataFrame([(i, int(r.g), None if np.isnan(r.v) else float(r.v)) for i, r in enumerate(pdf.itertuples())], "i int, g int, v double")
    got = dict(values(df.withColumn("s", windows.average_rank_share("v", "g")), "i", "s"))
    want = pdf.groupby("g").v.rank(pct=True)
    assert all((got[i] is None and np.isnan(want[i])) or got[i] == pytest.approx(want[i]) for i in range(60))


def test_values_after_a_year_do_not_change_features_up_to_it(spark):
    rows = [("a", y, float(y % 4 + 1)) for y in range(2015, 2024)] + [("b", y, float(y % 3 + 2)) for y in range(2016, 2024)]
    df = spark.createDataFrame(rows, "k string, y int, v double")

    def features(d):
        x = windows.run_id("k", "y", d)
        mean, _, slope = windows.rolling("v", "k", "run", "y")
        x = x.select("k", "y", "v", windows.guarded_lag("v", "k", "y").alias("lag"), mean.alias("mean"), slope.alias("slope"), windows.average_rank_share("v", "y").alias("share"))
        return sorted(values(windows.winsorized(x, ["y"], ["v"]).where("y <= 2020"), "k", "y", "v", "lag", "mean", "slope", "share"))

    assert features(df) == features(df.withColumn("v", F.when(F.col("y") > 2020, F.col("v") * 50 - 7).otherwise(F.col("v"))))


def test_ranks_and_totals_over_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert all(r.rank == r.v + 1 for r in ranked(df, [F.asc("v")]).collect())
    assert all(r.t == r.v * (r.v + 1) // 2 for r in running(df, [F.asc("v")], {"t": F.col("v")}).collect())


def test_auc_and_ks(spark):
    rng = np.random.default_rng(3)
    p, y = np.round(rng.random(300), 1), rng.integers(0, 2, 300)
    row = metrics.auc_ks(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int"), "p", "y").first()
    pos, neg = p[y == 1], p[y == 0]
    assert row.auc == pytest.approx(((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2))
    assert row.ks == pytest.approx(max(abs((pos <= t).mean() - (neg <= t).mean()) for t in np.unique(p)))


def test_greedy_pairs_match_once_and_the_nearest_first(spark):
    day = datetime.date
    closed = spark.createDataFrame([(1, "a", day(2024, 1, 10)), (2, "a", day(2024, 1, 20))], "id long, k string, day date")
    opened = spark.createDataFrame([(7, "a", day(2024, 1, 21)), (8, "a", day(2024, 4, 25))], "id long, k string, day date")
    assert values(joins.greedy_pairs(closed, opened, ["k"], -30, 90), "closed_id", "opened_id", "gap") == [(2, 7, 1)]


def test_greedy_pairs_of_one_key_are_not_all_listed(spark):
    rng, start = np.random.default_rng(5), datetime.date(2015, 1, 1)
    side = lambda first: [(first + i, "a", start + datetime.timedelta(int(d))) for i, d in enumerate(rng.integers(0, 3000, 120))]
    c, o = side(0), side(1000)
    used, want = set(), []
    for _, i, j, gap in sorted((abs((y - x).days), i, j, (y - x).days) for i, _, x in c for j, _, y in o if -30 <= (y - x).days <= 90):
        if i not in used and j not in used:
            used |= {i, j}
            want.append((i, j, gap))
    schema = "id long, k string, day date"
    got = joins.greedy_pairs(spark.createDataFrame(c, schema), spark.createDataFrame(o, schema), ["k"], -30, 90)
    assert sorted(values(got, "closed_id", "opened_id", "gap")) == sorted(want)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()


def test_kernels():
    for p, rho in [(0.1, 0.15), (0.4, 0.42), (0.25, 0.05)]:
        assert kernels.asset_correlation(p, kernels.joint_default(p, rho)) == pytest.approx(rho, abs=1e-4)
    assert kernels.exact_interval(3, 10) == pytest.approx((0.0667, 0.6525), abs=1e-4)
    assert kernels.binomial_cdf(2, 5, 0.5) == pytest.approx(0.5)
    assert kernels.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857, abs=1e-4)
    assert kernels.pool_adjacent([(1, 1), (3, 1), (2, 1)]) == [1, 2.5, 2.5]


def test_simulation_repeats_and_adds_up(spark):
    names = pd.DataFrame({"id": range(5), "p": [0.05, 0.1, 0.2, 0.02, 0.15], "borrowers": 40, "exposure": 100.0, "lgd": 0.45})
    draws, d = 8_000, spark.createDataFrame(names)
    a, b = simulate.tail(d, 0.02, 0.4, draws).first(), simulate.tail(d.repartition(3), 0.02, 0.4, draws).first()
    assert a == b
    assert a["mean"] == pytest.approx((names.p * names.exposure * names.lgd).sum(), rel=0.06)
    free = simulate.tail(d, 0.0, 0.0, draws).first()
    assert a["var"] > free["var"]
    parts = sum(r.contribution for r in simulate.contributions(d, 0.02, 0.4, draws).collect())
    assert parts == pytest.approx(a["es"])


def test_alarm_is_the_exact_binomial_test(spark):
    from tidemark.plans import validation

    rows = [(2, 12, 40, 40), (2, 2, 40, 40), (12, 1, 60, 60), (0, 3, 5, 40), (0, 3, 18, 18), (0, 2, 40, 40)]
    df = spark.createDataFrame(rows, "a int, b int, x int, y int")
    got = [r[0] for r in df.select(validation.alarm(*map(F.col, "abxy"))).collect()]

    def expected(a, b, x, y):
        n, p = a + b, y / (x + y)
        above = lambda k, q: sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k, n + 1))
        if min(x, y) < 10 or n < 3:
            return "hold"
        worse = b * x > a * y
        return "worse" if worse and above(b, p) <= 0.05 else "better" if not worse and above(a, 1 - p) <= 0.05 else "same"

    assert got == [expected(*r) for r in rows] == ["worse", "same", "better", "hold", "same", "hold"]


def test_exact_rates_hold_their_rate(spark):
    from tidemark.plans.registry import QUERIES

    for r in QUERIES["exact_rate_table"](spark, "/root/testdata/sf0.001").collect():
        assert 0 <= r.low <= r.rate <= r.high <= 1 and 0 <= r.p_above <= 1
        tail = lambda p: sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k, r.n + 1))
        assert r.k == 0 or tail(r.low) == pytest.approx(0.025, abs=1e-6)
    s = QUERIES["sibling_contrast"](spark, "/root/testdata/sf0.001").first()
    a, b, c, d = s.k_with, s.n_with - s.k_with, s.k_without, s.n_without - s.k_without
    way = lambda x: math.comb(a + b, x) * math.comb(c + d, a + c - x) / math.comb(a + b + c + d, a + c)
    assert s.p_value == pytest.approx(sum(way(x) for x in range(max(0, a - d), min(a + b, a + c) + 1) if way(x) <= way(a) * (1 + 1e-7)), abs=1e-5)


def test_tiers_of_search(spark):
    from tidemark.operators import retrieval

    korean = retrieval.tiered_search(spark.createDataFrame([("BBQ 비비큐",), ("비비큐1호",), ("큐",)], "name string"), spark.createDataFrame([("bhc비비큐",), ("x큐",)], "wanted string"))
    assert {tuple(r) for r in korean.collect()} == {("bhc비비큐", "BBQ 비비큐", 3), ("bhc비비큐", "비비큐1호", 3)}
    names = spark.createDataFrame([(n,) for n in ("bluecoffee", "coffee", "cafe", "coffeehouse", "코끼리커피", "cobyee", "", None)], "name string")
    wanted = spark.createDataFrame([(w,) for w in ("coffee", "blue", "커피", "coxxee", "zzz", "", None)], "wanted string")
    got = {tuple(r) for r in retrieval.tiered_search(names, wanted).collect()}
    assert got == {("coffee", "coffee", 0), ("blue", "bluecoffee", 1), ("커피", "코끼리커피", 1), ("coxxee", "coffee", 4), ("coxxee", "cobyee", 4)}


def test_names_terms_and_dates(spark):
    df = spark.createDataFrame([("카페(구) ㈜ 별*", "Tue, 01 Oct 2024 09:00:00 +0900", 12345.0, "ab abc"), ("()", "x", 42.0, None)], "n string, d string, m double, t string")
    got = values(df.select(expr.search_term(F.col("n")).alias("n"), expr.mail_date(F.col("d")).alias("d"), expr.amount_text(F.col("m")).alias("m"), expr.replaced(F.col("t"), {"ab": "abc", "abc": "X"}).alias("t")), "n", "d", "m", "t")
    assert got == [("카페 별", datetime.date(2024, 10, 1), "123.5억원", "abc X"), (None, None, "42백만원", None)]
    assert expr.ascii_names(["a b", "가", "a b", "ok_1"]) == ["au0020b", "uAC00", "au0020b_2", "ok_1"]


def test_alarm_holds_where_the_bases_add_up_to_nothing(spark):
    from tidemark.plans.validation import alarm

    rows = [(4, 5, -7, 7), (4, 5, 0, 0), (None, 5, None, 60), (1, 30, 100, 100), (30, 1, 100, 100), (5, 5, 100, 100)]
    df = spark.createDataFrame(rows, "b long, a long, b0 long, b1 long")
    assert values(df, alarm(F.col("b"), F.col("a"), F.col("b0"), F.col("b1"))) == [("hold",), ("hold",), ("same",), ("worse",), ("better",), ("same",)]


def test_rows_in_draws_have_the_weight_of_their_hash(spark):
    import hashlib

    from tidemark.plans.validation import DRAWS, POISSON, _in_draws

    got = {(r.v, r.b): r.w for r in _in_draws(spark.createDataFrame([(7, "3:1995:"), (8, "4:1995:")], "v int, key string"), "key").collect()}
    share = lambda key, b: int(hashlib.md5(f"{key}{b}".encode()).hexdigest()[:8], 16) / 4294967296
    wanted = {(v, b): sum(share(key, b) >= c for c in POISSON) for v, key in ((7, "3:1995:"), (8, "4:1995:")) for b in range(DRAWS)}
    assert got == {k: w for k, w in wanted.items() if w}
