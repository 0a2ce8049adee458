"""Assessment of scores: discrimination, calibration and its choice, exact tests, alarms, time splits and cohorts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.functions.expr import graded
from tidemark.operators import metrics as M
from tidemark.operators import windows as W
from tidemark.operators.ordered import cut, ranked
from tidemark.plans.base import FULL, full_panel, query, r6, table
from tidemark.plans.labels import LABELLED, labelled
from tidemark.plans.portfolio import EXPOSURES, exposures
from tidemark.plans.statistics import SCORED, scored
from tidemark.plans.validation import ALPHA, BASELINES, LEAST_BASE, LEAST_EVENTS, alarm, baselines


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS rk, greatest(1, floor(count(*) OVER () * 0.1)) AS k FROM s), v AS (SELECT p, sum(y) AS a, count(*) AS n FROM s GROUP BY 1), c AS (SELECT *, sum(a) OVER w AS tp, sum(n) OVER w AS m FROM v WINDOW w AS (ORDER BY p DESC)),
 q AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS ar, y FROM s)
 SELECT count(*) AS n, round(avg(y), 6) AS base_rate, round(avg(y) FILTER (rk <= k) / avg(y), 6) AS lift, round(avg(y) FILTER (rk <= k), 6) AS precision, (SELECT round(sum(a * tp / m) / sum(a), 6) FROM c) AS pr_auc, (SELECT round((sum(ar) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) FROM q) AS roc_auc,
 round(avg((p - y) * (p - y)), 6) AS brier FROM r""")
def full_metric_row(spark, sf_dir):
    """Lift and precision of the top tenth, areas under both curves, Brier score, number and base rate."""
    s = scored(spark, sf_dir)
    v = M.value_table(s, "p", "y")
    totals = F.broadcast(v.agg(F.sum("pos").alias("every_pos"), F.sum("neg").alias("every_neg")))
    # at and above a score: the total less what is below
    tp, fp = F.col("every_pos") - F.col("cum_pos") + F.col("pos"), F.col("every_neg") - F.col("cum_neg") + F.col("neg")
    area = v.crossJoin(totals).agg((F.sum(F.col("pos") * tp / (tp + fp)) / F.max("every_pos")).alias("pr_auc"))
    best = M.lift(s, "p", "y", "id").select("lift", "precision_at_k", "base_rate")
    off = F.col("p") - F.col("y")
    whole = s.agg(F.count("*").alias("n"), F.avg(off * off).alias("brier"))
    one = whole.crossJoin(best).crossJoin(area).crossJoin(M.auc_ks(s, "p", "y").select("auc"))  # one row each
    return one.select("n", r6("base_rate", "base_rate"), r6("lift", "lift"), r6("precision_at_k", "precision"), r6("pr_auc", "pr_auc"), r6("auc", "roc_auc"), r6("brier", "brier"))


@query(f"""WITH {SCORED}, g AS (SELECT DISTINCT x FROM (SELECT unnest(quantile_cont(p, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1])) AS x FROM s)), n AS (SELECT count(*) AS n FROM g), b AS (SELECT least(greatest((SELECT count(*) FROM g WHERE x <= p) - 1, 0), n - 2) AS bin, p, y FROM s, n)
 SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS rate FROM b GROUP BY 1""")
def reliability_bins(spark, sf_dir):
    """Bins between the distinct deciles, open on the right, the last one closed."""
    s = scored(spark, sf_dir)
    edges = sorted(set(s.agg(F.percentile("p", F.array(*[F.lit(i / 10) for i in range(11)]))).first()[0] or []))  # eleven numbers
    at = F.least(F.greatest(sum((F.when(F.col("p") >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1, F.lit(0)), F.lit(max(0, len(edges) - 2)))
    return s.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("p"), "mean_score"), r6(F.avg("y"), "rate"))


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rk, count(*) OVER () AS n FROM s), b AS (SELECT greatest(ceil((rk - 1) * 10.0 / (n - 1)), 1) - 1 AS bin, count(*) AS n, sum(y) AS o, sum(p) AS e FROM r GROUP BY 1), x AS (SELECT sum((o - e) * (o - e) / (e * (1 - e / n))) AS x, count(*) - 2 AS df FROM b)
 SELECT round(x, 4) AS chi2, df, round(exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6), 6) AS p_value FROM x""")
def hosmer_lemeshow_test(spark, sf_dir):
    """The statistic over ten bins of equal ranks, and its chi-square tail of eight degrees of freedom in closed form."""
    x = ranked(scored(spark, sf_dir), [F.asc("p"), F.asc("id")])
    at = F.greatest(F.ceil((F.col("rank") - 1) * 10.0 / (F.col("n") - 1)), F.lit(1)) - 1
    b = x.crossJoin(F.broadcast(x.agg(F.count("*").alias("n")))).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("o"), F.sum("p").alias("e"))
    t = b.agg(F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / (F.col("e") * (1 - F.col("e") / F.col("n")))).alias("x"), (F.count("*") - 2).alias("df"))
    half = F.col("x") / 2
    return t.select(F.round("x", 4).alias("chi2"), "df", r6(F.exp(-half) * (1 + half + half * half / 2 + half * half * half / 6), "p_value"))


@query("""WITH x AS (SELECT quality AS gold, CAST(n_chars > 800 AS INT) AS pred FROM documents JOIN labels USING (doc_id)), g AS (SELECT DISTINCT gold AS class FROM x), f AS (SELECT class, (SELECT count(*) FROM x WHERE gold = class AND pred = class) AS tp, (SELECT count(*) FROM x WHERE gold = class) AS s, (SELECT count(*) FROM x WHERE pred = class) AS p FROM g)
 SELECT round(avg(2.0 * tp / (p + s)), 6) AS macro_f1, round(max(2.0 * tp / (p + s)) FILTER (class = 1), 6) AS binary_f1, round(sum(tp) * 1.0 / (SELECT count(*) FROM x), 6) AS accuracy FROM f""")
def macro_f1(spark, sf_dir):
    """The mean F1 of the classes that the gold labels have, that of the positive class, and accuracy."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    cells = d.groupBy(F.col("quality").alias("gold"), (F.col("n_chars") > 800).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    right = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    by_gold = cells.groupBy(F.col("gold").alias("class")).agg(F.sum(right).alias("tp"), F.sum("n").alias("s"))
    f = by_gold.join(cells.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("p")), "class", "left").fillna(0, ["p"])
    f1 = 2 * F.col("tp") / (F.col("p") + F.col("s"))
    return f.agg(r6(F.avg(f1), "macro_f1"), r6(F.max(F.when(F.col("class") == 1, f1)), "binary_f1"), r6(F.sum("tp") / F.sum("s"), "accuracy"))


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS rk, greatest(1, round_even(count(*) OVER () * 0.1, 0)) AS k FROM s), t AS (SELECT * FROM r WHERE rk <= k) SELECT CAST(max(k) AS BIGINT) AS k, round(avg(y), 6) AS precision, round(min(p), 6) AS cut FROM t""")
def top_rounded(spark, sf_dir):
    """The top tenth with its number rounded half to even."""
    r = ranked(scored(spark, sf_dir), [F.desc("p"), F.asc("id")])
    r = r.crossJoin(F.broadcast(r.agg(F.greatest(F.lit(1), F.bround(F.count("*") * 0.1, 0)).cast("long").alias("k"))))
    return r.where("rank <= k").agg(F.max("k").alias("k"), r6(F.avg("y"), "precision"), r6(F.min("p"), "cut"))


@query(f"""WITH {LABELLED}, y AS (SELECT CASE WHEN prev_stores IS NULL THEN 'unassessable' WHEN n_events >= 2 THEN 'watch' ELSE 'healthy' END AS state, n_events, year, label FROM x WHERE label IS NOT NULL), t AS (SELECT state, n_events, count(*) AS n, CAST(sum(label) AS BIGINT) AS k FROM y GROUP BY 1, 2),
 v AS (SELECT state, n_events, min(r) AS lowest, max(r) AS highest, count(*) AS years FROM (SELECT state, n_events, year, avg(label) AS r FROM y GROUP BY 1, 2, 3 HAVING count(*) >= 20) GROUP BY 1, 2) SELECT t.*, round(k * 1.0 / n, 6) AS rate, round(lowest, 6) AS lowest, round(highest, 6) AS highest, years FROM t LEFT JOIN v USING (state, n_events)""")
def watch_rates(spark, sf_dir):
    """Rates by state and number of events, and their range over years of twenty rows or more."""
    x = labelled(spark, sf_dir).where("label is not null")
    state = F.when(F.col("prev_stores").isNull(), "unassessable").when(F.col("n_events") >= 2, "watch").otherwise("healthy")
    yearly = x.groupBy(state.alias("state"), "n_events", "year").agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    r = F.when(F.col("n") >= 20, F.col("k") / F.col("n"))
    t = yearly.groupBy("state", "n_events").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.min(r).alias("lo"), F.max(r).alias("hi"), F.nullif(F.count(r), F.lit(0)).alias("years"))
    return t.select("state", "n_events", "n", "k", r6(F.col("k") / F.col("n"), "rate"), r6("lo", "lowest"), r6("hi", "highest"), "years")


@query(f"""WITH {EXPOSURES}, c AS (SELECT unnest(['FS1', 'FS2', 'FS3', 'none']) AS grade, unnest([1, 2, 3, 4]) AS place), g AS (SELECT *, CASE WHEN p < 0.32 THEN 'FS1' WHEN p < 0.34 THEN 'FS2' ELSE 'FS3' END AS grade, id % 3 = 0 AS bad FROM x)
 SELECT c.grade, CAST(place AS INTEGER) AS place, count(id) AS n, count(*) FILTER (bad) AS k, round(count(*) FILTER (bad) * 1.0 / nullif(count(id), 0), 6) AS rate, count(DISTINCT nation) AS brands, round(sum(exposure) FILTER (bad) / nullif(sum(exposure), 0), 6) AS by_amount FROM c LEFT JOIN g ON g.grade = c.grade GROUP BY 1, 2""")
def rate_table(spark, sf_dir):
    """Rates of defaults by grade in a fixed order, empty grades too, by number and by amount."""
    g = exposures(spark, sf_dir).select("id", "nation", "exposure", graded(F.col("p"), [0.32, 0.34], ["FS1", "FS2", "FS3"]).alias("grade"), (F.col("id") % 3 == 0).alias("bad"))
    t = g.groupBy("grade").agg(F.count("*").alias("n"), F.count_if("bad").alias("k"), F.count_distinct("nation").alias("brands"), F.sum(F.when(F.col("bad"), F.col("exposure"))).alias("b"), F.sum("exposure").alias("e"))
    order = spark.createDataFrame([("FS1", 1), ("FS2", 2), ("FS3", 3), ("none", 4)], "grade string, place int")
    x = order.join(t, "grade", "left").fillna(0, ["n", "k", "brands"])
    return x.select("grade", "place", "n", "k", r6(F.try_divide(F.col("k"), F.col("n")), "rate"), "brands", r6(F.try_divide(F.col("b"), F.col("e")), "by_amount"))


@query("""WITH l AS (SELECT l_suppkey AS brand, count(*) AS n, count(*) FILTER (l_returnflag = 'R' AND l_tax > 0.06) AS k, arg_max(l_linestatus, l_shipdate::VARCHAR || lpad(l_orderkey::VARCHAR, 12, '0') || l_linenumber || lpad(l_partkey::VARCHAR, 12, '0')) AS last FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY k DESC, n, brand) AS place FROM l WHERE k > 0) SELECT brand, n, k, round(k * 1.0 / n, 6) AS rate, place FROM r WHERE place <= 20""")
def brand_defaults(spark, sf_dir):
    """The brands of most defaults."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("brand")).agg(F.count("*").alias("n"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.06)).alias("k")).where("k > 0")
    return ranked(t, [F.desc("k"), F.asc("n"), F.asc("brand")], "place").where("place <= 20").select("brand", "n", "k", r6(F.col("k") / F.col("n"), "rate"), "place")


_SIBS = f"""{LABELLED}, m AS (SELECT x.*, c_nationkey AS hq FROM x JOIN customer ON c_custkey = brand_id WHERE prev_stores IS NOT NULL), o AS (SELECT *, count(*) OVER (PARTITION BY hq, year) - 1 AS sibs, sum(CAST(n_events >= 2 AS INT)) OVER (PARTITION BY hq, year) - CAST(n_events >= 2 AS INT) AS hit FROM m),
 z AS (SELECT count(*) FILTER (hit > 0) AS n_with, coalesce(sum(label) FILTER (hit > 0), 0)::BIGINT AS k_with, count(*) FILTER (hit = 0) AS n_without, coalesce(sum(label) FILTER (hit = 0), 0)::BIGINT AS k_without FROM o WHERE sibs > 0 AND label IS NOT NULL)"""


@query(f"""WITH {_SIBS}, h AS (SELECT z.*, unnest(range(greatest(0, k_with + k_without - n_without), least(n_with, k_with + k_without) + 1)) AS a FROM z),
 d AS (SELECT *, exp(lgamma(n_with + 1) - lgamma(a + 1) - lgamma(n_with - a + 1) + lgamma(n_without + 1) - lgamma(k_with + k_without - a + 1) - lgamma(n_without - k_with - k_without + a + 1) - lgamma(n_with + n_without + 1) + lgamma(k_with + k_without + 1) + lgamma(n_with + n_without - k_with - k_without + 1)) AS pr FROM h)
 SELECT n_with, k_with, n_without, k_without, round(least(1, sum(pr) FILTER (pr <= (1 + 1e-7) * own)), 6) AS p_value FROM (SELECT d.*, max(CASE WHEN a = k_with THEN pr END) OVER () AS own FROM d) GROUP BY 1, 2, 3, 4""")
def sibling_contrast(spark, sf_dir):
    """Labels of brands with a sibling of the same headquarters and year in trouble against those without, by Fisher's exact test.

    The siblings' events are the group's less the brand's own: one window, no self-join.
    """
    hq = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("brand_id"), F.col("c_nationkey").alias("hq"))
    x = labelled(spark, sf_dir).where("prev_stores is not null").join(hq, "brand_id")
    own, w = (F.col("n_events") >= 2).cast("int"), Window.partitionBy("hq", "year")
    x = x.withColumns({"sibs": F.count("*").over(w) - 1, "hit": F.sum(own).over(w) - own}).where("sibs > 0 and label is not null")
    with_, label = F.col("hit") > 0, F.col("label").cast("long")
    t = x.agg(F.count_if(with_).alias("n_with"), F.coalesce(F.sum(F.when(with_, label)), F.lit(0)).alias("k_with"), F.count_if(~with_).alias("n_without"), F.coalesce(F.sum(F.when(~with_, label)), F.lit(0)).alias("k_without"))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p_value=[round(kernels.fisher_two_sided(int(r.k_with), int(r.n_with - r.k_with), int(r.k_without), int(r.n_without - r.k_without)), 6) for r in b.itertuples()])

    return t.mapInPandas(exact, "n_with long, k_with long, n_without long, k_without long, p_value double")


def yearly(spark, sf_dir):
    """(id, year, closes, opens, active): returned and other lines of a supplier's year are closings and openings; active counts from 60 on."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("year")).agg(F.count_if(F.col("l_returnflag") == "R").alias("closes"), F.count_if(F.col("l_returnflag") == "A").alias("opens"))
    return t.withColumn("active", 60 + F.sum(F.col("opens") - F.col("closes")).over(W.by("id", "year")))


YEARLY = "y AS (SELECT l_suppkey AS id, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) FILTER (l_returnflag = 'R') AS closes, count(*) FILTER (l_returnflag = 'A') AS opens FROM lineitem GROUP BY 1, 2), b AS (SELECT *, CAST(60 + sum(opens - closes) OVER (PARTITION BY id ORDER BY year) AS BIGINT) AS active FROM y)"


@query(f"""WITH {YEARLY} SELECT id, year, closes, active, coalesce(closes >= 20 AND closes >= 0.3 * lag(active) OVER (PARTITION BY id ORDER BY year), false) AS bulk FROM b""")
def bulk_closures(spark, sf_dir):
    """Periods with twenty closings or more that are thirty percent or more of what was active the period before, by brand."""
    before = F.lag("active").over(W.by("id", "year"))
    return yearly(spark, sf_dir).select("id", "year", "closes", "active", F.coalesce((F.col("closes") >= 20) & (F.col("closes") >= 0.3 * before), F.lit(False)).alias("bulk"))


_MONTHS = """m AS (SELECT l_suppkey AS id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) FILTER (l_returnflag = 'R') AS closes, count(*) FILTER (l_returnflag = 'A') AS opens FROM lineitem GROUP BY 1, 2),
 g AS (SELECT id, CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-10-01', INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT DISTINCT id FROM m)), f AS (SELECT id, month, coalesce(closes, 0) AS closes, coalesce(opens, 0) AS opens FROM g LEFT JOIN m USING (id, month)),
 s AS (SELECT *, sum(closes) OVER (PARTITION BY id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3, 60 + sum(opens - closes) OVER (PARTITION BY id ORDER BY month) AS active, row_number() OVER (PARTITION BY id ORDER BY month) AS rn FROM f),
 v AS (SELECT *, lag(c3, 12) OVER w AS before, lag(active, 3) OVER w AS base1, lag(active, 15) OVER w AS base0, bool_or(closes >= 20 AND closes >= 0.3 * a1) OVER (PARTITION BY id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bulk FROM (SELECT *, lag(active) OVER (PARTITION BY id ORDER BY month) AS a1 FROM s) WINDOW w AS (PARTITION BY id ORDER BY month))"""


def months(spark, sf_dir):
    """The dense grid of suppliers and complete months with three-month closings, those of a year before and both bases."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.trunc("l_shipdate", "month").alias("month"), "l_returnflag")
    m = li.groupBy("id", "month").agg(F.count_if(F.col("l_returnflag") == "R").alias("closes"), F.count_if(F.col("l_returnflag") == "A").alias("opens"))
    grid = li.select("id").distinct().select("id", F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-10-01").cast("date"), F.expr("interval 1 month"))).alias("month"))
    w = Window.partitionBy("id").orderBy("month")
    s = grid.join(m, ["id", "month"], "left").fillna(0, ["closes", "opens"])
    s = s.withColumns({"c3": F.sum("closes").over(w.rowsBetween(-2, 0)), "active": 60 + F.sum(F.col("opens") - F.col("closes")).over(w)})
    flag = F.coalesce((F.col("closes") >= 20) & (F.col("closes") >= 0.3 * F.lag("active").over(w)), F.lit(False))
    s = s.withColumns({"before": F.lag("c3", 12).over(w), "base1": F.lag("active", 3).over(w), "base0": F.lag("active", 15).over(w), "flag": flag})
    return s.withColumn("bulk", F.bool_or("flag").over(w.rowsBetween(-2, 0)))


@query(f"""WITH {_MONTHS} SELECT id, CAST(month AS VARCHAR) AS month, CAST(c3 AS BIGINT) AS closes, CAST(before AS BIGINT) AS before, CASE WHEN before IS NULL THEN 'hold' WHEN c3 > before THEN 'worse' WHEN c3 < before THEN 'better' ELSE 'same' END AS direction FROM v""")
def monthly_year_on_year(spark, sf_dir):
    """Closings of three months against the same months of the year before, on complete months."""
    d = F.when(F.col("before").isNull(), "hold").when(F.col("c3") > F.col("before"), "worse").when(F.col("c3") < F.col("before"), "better").otherwise("same")
    return months(spark, sf_dir).select("id", F.col("month").cast("string").alias("month"), F.col("c3").alias("closes"), "before", d.alias("direction"))


_TAIL = "least(1, list_sum(list_transform(range({k}::BIGINT, {n}::BIGINT + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p})))))"


@query(f"""WITH {_MONTHS}, t AS (SELECT *, c3 + before AS n, base1 * 1.0 / (base0 + base1) AS p FROM v WHERE month = DATE '2001-10-01'),
 d AS (SELECT *, base0 < {LEAST_BASE} OR base1 < {LEAST_BASE} OR n < {LEAST_EVENTS} AS thin FROM t), u AS (SELECT *, CASE WHEN NOT thin THEN {_TAIL.format(k="c3", n="n", p="p")} END AS up, CASE WHEN NOT thin THEN {_TAIL.format(k="before", n="n", p="(1 - p)")} END AS down FROM d)
 SELECT id, CAST(c3 AS BIGINT) AS closes, CAST(before AS BIGINT) AS before, CASE WHEN bulk THEN 'check' WHEN thin THEN 'hold' WHEN c3 * base0 > before * base1 AND up <= {ALPHA} THEN 'worse' WHEN NOT c3 * base0 > before * base1 AND down <= {ALPHA} THEN 'better' ELSE 'same' END AS signal FROM u""")
def monthly_alarm(spark, sf_dir):
    """The last month's alarm: an exact binomial test of three months' closings against a year before given both bases; a bulk closure is to be checked first."""
    t = months(spark, sf_dir).where("month = date'2001-10-01'")
    signal = F.when(F.col("bulk"), "check").otherwise(alarm(F.col("before"), F.col("c3"), F.col("base0"), F.col("base1")))
    return t.select("id", F.col("c3").alias("closes"), "before", signal.alias("signal"))


@query(f"""WITH {LABELLED}, y AS (SELECT * FROM x WHERE label IS NOT NULL AND healthy_at_t), t AS (SELECT *, dense_rank() OVER (ORDER BY year DESC) AS back FROM y), z AS (SELECT *, CASE back WHEN 1 THEN 'test' WHEN 2 THEN 'valid' ELSE 'train' END AS split FROM t)
 SELECT split, is_new, count(*) AS n, CAST(sum(label) AS BIGINT) AS k, min(year) AS first_year, max(year) AS last_year FROM (SELECT z.*, NOT EXISTS (SELECT 1 FROM z q WHERE q.split = 'train' AND q.brand_id = z.brand_id) AS is_new FROM z) GROUP BY 1, 2""")
def time_split(spark, sf_dir):
    """The last year for test, the one before for validation, the rest for training; brands that training lacks are new."""
    z = split(labelled(spark, sf_dir).where("label is not null and healthy_at_t"))
    known = z.where("split = 'train'").select("brand_id").distinct().withColumn("known", F.lit(True))
    x = z.join(known, "brand_id", "left").withColumn("is_new", F.col("known").isNull())
    return x.groupBy("split", "is_new").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("k"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def split(x):
    """``x`` with ``split``; fewer than three years have no such split."""
    years = sorted(r.year for r in x.select("year").distinct().collect())  # a handful
    if len(years) < 3:
        raise ValueError("a time split needs three years")
    return x.withColumn("split", F.when(F.col("year") == years[-1], "test").when(F.col("year") == years[-2], "valid").otherwise("train"))


@query(f"""WITH {LABELLED}, h AS (SELECT * FROM x WHERE healthy_at_t AND label IS NOT NULL), k AS (SELECT *, {", ".join(f"CASE WHEN {c} IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY year ORDER BY {c} {o} NULLS LAST) + (count(*) OVER (PARTITION BY year, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY year) END AS r_{n}" for c, o, n in (("growth", "DESC", "store"), ("sales_growth", "DESC", "sales"), ("end_rate", "", "end")))} FROM h)
 SELECT brand_id, year, round(0.5 * n_events / 3 + 0.5 * (r_store + r_sales + r_end) / 3, 6) AS score FROM k""")
def persistence_score(spark, sf_dir):
    """Half the share of events that fired, half the mean severity of the three, each a rank within the year; an unknown severity counts one half."""
    x = labelled(spark, sf_dir).where("healthy_at_t and label is not null")
    x = x.withColumns({"d_store": -F.col("growth"), "d_sales": -F.col("sales_growth")})
    severity = sum((F.coalesce(W.average_rank_share(c, "year"), F.lit(0.5)) for c in ("d_store", "d_sales", "end_rate")), F.lit(0.0)) / 3
    return x.withColumn("severity", severity).select("brand_id", "year", r6(0.5 * F.col("n_events") / 3 + 0.5 * F.col("severity"), "score"))


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rk, count(*) OVER () AS n FROM s) SELECT id, round(p + rk * 1.0 / n * 1e-5, 8) AS p FROM r""")
def tie_broken(spark, sf_dir):
    """Scores with an offset of at most 1e-5 by rank, so that no two are equal."""
    x = ranked(scored(spark, sf_dir), [F.asc("p"), F.asc("id")])
    return x.crossJoin(F.broadcast(x.agg(F.count("*").alias("n")))).select("id", F.round(F.col("p") + F.col("rank") / F.col("n") * 1e-5, 8).alias("p"))


ALPHAS = [0.0, 5.0, 10.0, 20.0, 40.0, 80.0, 160.0]


@query(f"""WITH {SCORED}, f AS (SELECT CAST(floor(p * 20) AS INT) AS level, id % 5 AS fold, y FROM s), c AS (SELECT level, fold, count(*) AS n, sum(y) AS k FROM f GROUP BY 1, 2), a AS (SELECT unnest({ALPHAS}) AS alpha), b AS (SELECT fold, (SELECT sum(k) FROM c) - sum(k) AS k, (SELECT sum(n) FROM c) - sum(n) AS n FROM c GROUP BY 1),
 o AS (SELECT alpha, c.fold, c.level, c.n, c.k, coalesce(sum(d.k), 0) AS tk, coalesce(sum(d.n), 0) AS tn, max(b.k / b.n) AS base FROM a, c LEFT JOIN c d ON d.level = c.level AND d.fold <> c.fold JOIN b ON b.fold = c.fold GROUP BY 1, 2, 3, 4, 5),
 q AS (SELECT *, least(greatest(coalesce((tk + alpha * base) / nullif(tn + alpha, 0), base), 1e-3), 1 - 1e-3) AS r FROM o), l AS (SELECT alpha, -sum(k * ln(r) + (n - k) * ln(1 - r)) / sum(n) AS loss FROM q GROUP BY 1) SELECT alpha::DOUBLE AS alpha, round(loss, 6) AS loss FROM l""")
def shrinkage_choice(spark, sf_dir):
    """Log loss of each strength of shrinkage by five folds: counts of level and fold alone decide, a handful of rows."""
    c = scored(spark, sf_dir).groupBy(F.floor(F.col("p") * 20).cast("int").alias("level"), (F.col("id") % 5).alias("fold")).agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    levels, all_ = c.groupBy("level").agg(F.sum("n").alias("ln"), F.sum("k").alias("lk")), c.agg(F.sum("n").alias("an"), F.sum("k").alias("ak"))
    folds = c.groupBy("fold").agg(F.sum("n").alias("fn"), F.sum("k").alias("fk")).crossJoin(all_).select("fold", ((F.col("ak") - F.col("fk")) / (F.col("an") - F.col("fn"))).alias("base"))
    x = c.join(levels, "level").join(folds, "fold").withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS])))
    tn, tk = F.col("ln") - F.col("n"), F.col("lk") - F.col("k")
    r = F.least(F.greatest(F.coalesce(F.try_divide(tk + F.col("alpha") * F.col("base"), tn + F.col("alpha")), F.col("base")), F.lit(1e-3)), F.lit(1 - 1e-3))
    x = x.withColumn("r", r)
    return x.groupBy("alpha").agg(r6(-F.sum(F.col("k") * F.log("r") + (F.col("n") - F.col("k")) * F.log(1 - F.col("r"))) / F.sum("n"), "loss"))


@query(f"""WITH {BASELINES}, lv AS (SELECT year, CAST(floor(persistence * 10) AS INT) AS level, count(*) AS n, sum(label) AS k FROM s GROUP BY 1, 2), cv AS (SELECT a.year, a.level, a.n, a.k, coalesce(sum(b.n), 0) AS pn, coalesce(sum(b.k), 0) AS pk FROM lv a LEFT JOIN lv b ON b.level = a.level AND b.year < a.year GROUP BY 1, 2, 3, 4), tv AS (SELECT a.year, sum(b.k) * 1.0 / sum(b.n) AS base FROM (SELECT DISTINCT year FROM lv) a JOIN lv b ON b.year < a.year GROUP BY 1),
 pv AS (SELECT cv.*, (pk + 20 * base) / (pn + 20) AS p FROM cv JOIN tv USING (year)) SELECT year, CAST(sum(n) AS BIGINT) AS n, round(sum(k * (1 - p) * (1 - p) + (n - k) * p * p) / sum(n), 6) AS brier, round(sum(n * p) / sum(n), 6) AS predicted, round(sum(k) * 1.0 / sum(n), 6) AS observed FROM pv GROUP BY 1""")
def prior_year_calibration(spark, sf_dir):
    """Each year judged by rates of earlier years only: shrunk rates of ten levels, running over the years."""
    level = F.least(F.floor(F.col("persistence") * 10), F.lit(99)).cast("int")
    l_ = baselines(spark, sf_dir).groupBy("year", level.alias("level")).agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    years = F.broadcast(l_.select("year").distinct())
    prior = l_.withColumnRenamed("year", "before").crossJoin(years).where("before < year")  # a few years by a few levels
    own = prior.groupBy("year", "level").agg(F.sum("n").alias("pn"), F.sum("k").alias("pk"))
    base = prior.groupBy("year").agg((F.sum("k") / F.sum("n")).alias("base"))
    p = l_.join(base, "year").join(own, ["year", "level"], "left").fillna(0, ["pn", "pk"]).withColumn("p", (F.col("pk") + 20 * F.col("base")) / (F.col("pn") + 20))
    loss = F.col("k") * (1 - F.col("p")) * (1 - F.col("p")) + (F.col("n") - F.col("k")) * F.col("p") * F.col("p")
    return p.groupBy("year").agg(F.sum("n").alias("n"), r6(F.sum(loss) / F.sum("n"), "brier"), r6(F.sum(F.col("n") * F.col("p")) / F.sum("n"), "predicted"), r6(F.sum("k") / F.sum("n"), "observed"))


@query(f"""WITH {FULL}, s AS (SELECT brand_id, year, round(1 / (1 + exp(-(n_end * 1.0 / n_stores * 3 - 2))), 6) AS raw FROM f WHERE year >= 2000), g AS (SELECT *, CASE WHEN round(raw * 20) / 20 < 0.2 THEN 'FS1' WHEN round(raw * 20) / 20 < 0.4 THEN 'FS2' ELSE 'FS3' END AS grade FROM s)
 SELECT brand_id, year, grade, round(CASE grade WHEN 'FS1' THEN least(raw, 0.199999) WHEN 'FS2' THEN least(greatest(raw, 0.2), 0.399999) ELSE greatest(raw, 0.4) END, 6) AS shown FROM g""")
def cohort_grades(spark, sf_dir):
    """Scores of two cohorts: the grade from the step, the shown value clipped into its grade's band; the query fails where a feature is missing, others are dropped."""
    wanted, f = ["n_end", "n_stores"], full_panel(spark, sf_dir).where("year >= 2000")
    missing = set(wanted) - set(f.columns)
    if missing:
        raise ValueError(f"the cohort lacks {sorted(missing)}")
    raw = F.round(1 / (1 + F.exp(-(F.col("n_end") / F.col("n_stores") * 3 - 2))), 6)
    g = f.select("brand_id", "year", *wanted).withColumn("raw", raw).withColumn("grade", graded(F.round(F.col("raw") * 20) / 20, [0.2, 0.4], ["FS1", "FS2", "FS3"]))
    shown = F.when(F.col("grade") == "FS1", F.least("raw", F.lit(0.199999))).when(F.col("grade") == "FS2", F.least(F.greatest("raw", F.lit(0.2)), F.lit(0.399999))).otherwise(F.greatest("raw", F.lit(0.4)))
    return g.select("brand_id", "year", "grade", r6(shown, "shown"))


GATES = (1, 2, 3)


def _gated_sql(gate: int) -> str:
    """Labels made anew for a gate, and each year's lift of the rate of contract ends."""
    return f"""SELECT {gate} AS gate, year, n, k, rate, top / nullif(rate, 0) AS lift FROM (WITH {LABELLED.replace("/*gate*/", f"WHERE n_stores >= {gate}")}, o AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY end_rate DESC NULLS LAST, brand_id) AS rk, greatest(1, floor(count(*) OVER (PARTITION BY year) * 0.1)) AS top FROM x WHERE label IS NOT NULL AND healthy_at_t)
 SELECT year, count(*) AS n, sum(label) AS k, avg(label) AS rate, avg(label) FILTER (rk <= top) AS top FROM o GROUP BY 1)"""


@query(f"""WITH f AS ({" UNION ALL ".join(map(_gated_sql, GATES))}), c AS (SELECT year FROM f WHERE lift IS NOT NULL GROUP BY 1 HAVING count(*) = {len(GATES)})
 SELECT CAST(gate AS INTEGER) AS gate, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, round(sum(k) / sum(n), 6) AS rate, count(*) AS folds, count(c.year) AS common_folds, round(avg(lift) FILTER (c.year IS NOT NULL), 6) AS common_lift FROM f LEFT JOIN c USING (year) GROUP BY 1""")
def gate_sensitivity(spark, sf_dir):
    """The whole procedure under three settings of the size gate: events, labels and folds made anew, lifts compared on the years that all three can score."""
    out = None
    for gate in GATES:
        x = labelled(spark, sf_dir, gate).where("label is not null and healthy_at_t")
        n = F.count("*").over(Window.partitionBy("year"))
        first = F.row_number().over(Window.partitionBy("year").orderBy(F.desc_nulls_last("end_rate"), "brand_id")) <= F.greatest(F.lit(1), F.floor(n * 0.1))
        y = x.withColumn("first", first).groupBy("year").agg(F.count("*").alias("n"), F.sum("label").alias("k"), F.avg("label").alias("rate"), F.avg(F.when(F.col("first"), F.col("label"))).alias("top"))
        y = y.select(F.lit(gate).alias("gate"), "year", "n", "k", F.try_divide("top", "rate").alias("lift"))
        out = y if out is None else out.union(y)
    common = out.where("lift is not null").groupBy("year").agg(F.count("*").alias("c")).where(F.col("c") == len(GATES)).select("year", F.lit(True).alias("common"))
    f = out.join(common, "year", "left")
    own = F.col("common").isNotNull()
    return f.groupBy("gate").agg(F.sum("n").alias("n"), F.sum("k").cast("long").alias("k"), r6(F.sum("k") / F.sum("n"), "rate"), F.count("*").alias("folds"), F.count_if(own).alias("common_folds"), r6(F.avg(F.when(own, F.col("lift"))), "common_lift"))


DRAWS = 400
#: How a Poisson(1) weight comes from sixteen bits of a hash, and what the intervals say.
_WEIGHT = "CASE WHEN u >= 65296 THEN 5 WHEN u >= 64292 THEN 4 WHEN u >= 60273 THEN 3 WHEN u >= 48218 THEN 2 WHEN u >= 24109 THEN 1 ELSE 0 END"
_VERDICT = "CASE WHEN gap_low > 0 AND auc_low > 0.5 THEN 'separates' WHEN gap_high < 0 THEN 'reversed' WHEN gap_mean > 0 AND auc_mean > 0.5 THEN 'leans' ELSE 'open' END"


@query(f"""WITH {LABELLED}, b AS (SELECT brand_id, n_events AS g, sum(label) AS k, count(*) - sum(label) AS h FROM x WHERE label IS NOT NULL GROUP BY 1, 2),
 w AS (SELECT d, b.*, ('0x' || left(md5(concat(CAST(d AS VARCHAR), ':', CAST(brand_id AS VARCHAR))), 4))::INT AS u FROM b, range({DRAWS}) t(d)), c AS (SELECT d, g, CAST(sum({_WEIGHT} * k) AS DOUBLE) AS k, CAST(sum({_WEIGHT} * h) AS DOUBLE) AS h FROM w GROUP BY 1, 2),
 a AS (SELECT *, coalesce(sum(h) OVER (PARTITION BY d ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
 s AS (SELECT d, sum(k) FILTER (g >= 1) / nullif(sum(k + h) FILTER (g >= 1), 0) - sum(k) FILTER (g = 0) / nullif(sum(k + h) FILTER (g = 0), 0) AS gap, sum(k * (below + h / 2)) / nullif(sum(k) * sum(h), 0) AS auc FROM a GROUP BY 1),
 r AS (SELECT {", ".join(f"round(quantile_cont({m}, 0.025), 6) AS {m}_low, round(avg({m}), 6) AS {m}_mean, round(quantile_cont({m}, 0.975), 6) AS {m}_high" for m in ("gap", "auc"))}, count(gap) AS draws FROM s) SELECT *, {_VERDICT} AS verdict FROM r""")
def cluster_bootstrap(spark, sf_dir):
    """The gap of rates with and without events and the events' AUC, by resampling whole brands: a brand's counts by number of events once, a Poisson weight a draw."""
    x = labelled(spark, sf_dir).where("label is not null")
    b = x.groupBy("brand_id", F.col("n_events").alias("g")).agg(F.sum("label").alias("k"), (F.count("*") - F.sum("label")).alias("h"))
    w = b.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    w = w.withColumn("u", F.conv(F.substring(F.md5(F.concat(F.col("d").cast("string"), F.lit(":"), F.col("brand_id").cast("string"))), 1, 4), 16, 10).cast("int"))
    c = w.groupBy("d", "g").agg(*[F.sum(F.expr(f"({_WEIGHT}) * {v}")).cast("double").alias(v) for v in ("k", "h")])
    # a draw has a row for each number of events, four at most
    below = F.coalesce(F.sum("h").over(Window.partitionBy("d").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    a = c.withColumn("below", below)
    rate = lambda on: F.try_divide(F.sum(F.when(on, F.col("k"))), F.sum(F.when(on, F.col("k") + F.col("h"))))
    auc = F.try_divide(F.sum(F.col("k") * (F.col("below") + F.col("h") / 2)), F.sum("k") * F.sum("h"))
    s = a.groupBy("d").agg((rate(F.col("g") >= 1) - rate(F.col("g") == 0)).alias("gap"), auc.alias("auc"))
    ends = [r6(f, f"{m}_{n}") for m in ("gap", "auc") for n, f in (("low", F.percentile(m, 0.025)), ("mean", F.avg(m)), ("high", F.percentile(m, 0.975)))]
    return s.agg(*ends, F.count("gap").alias("draws")).withColumn("verdict", F.expr(_VERDICT))


FEATURES = ["growth", "sales_growth", "end_rate", "n_stores", "prev_stores", "n_events"]


def prepared(spark, sf_dir):
    """The labelled sample with its time split, imputed by training medians and standardised; weights balance the classes."""
    x = labelled(spark, sf_dir).where("healthy_at_t and label is not null").select("brand_id", "year", F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in FEATURES])
    x = cut(split(cut(x)))  # every pass of the fits reads these rows, not the tables
    train = x.where("split = 'train'")
    imputed = Imputer(strategy="median", inputCols=FEATURES, outputCols=[f"i_{c}" for c in FEATURES]).fit(train)
    vector = VectorAssembler(inputCols=[f"i_{c}" for c in FEATURES], outputCol="raw")
    scaler = StandardScaler(withMean=True, inputCol="raw", outputCol="features").fit(vector.transform(imputed.transform(train)))
    n, k = train.agg(F.count("*"), F.sum("label")).first()
    weight = F.when(F.col("label") == 1, n / (2 * max(1.0, k))).otherwise(n / (2 * max(1.0, n - k)))
    return scaler.transform(vector.transform(imputed.transform(x))).withColumn("weight", weight).select("brand_id", "year", "label", "split", "features", "weight"), n


@query()
def balanced_logistic(spark, sf_dir):
    """(brand_id, year, label, p) of the test year by a logistic model of balanced classes, its penalty 1 / n."""
    x, n = prepared(spark, sf_dir)
    model = LogisticRegression(weightCol="weight", regParam=1.0 / n, standardization=False).fit(x.where("split = 'train'"))
    return model.transform(x.where("split = 'test'")).select("brand_id", "year", "label", vector_to_array("probability")[1].alias("p"))


@query()
def boosted_candidates(spark, sf_dir):
    """(brand_id, year, label, depth, p) of the test year by the boosted trees, of three declared depths with early stopping, that discriminate best on the validation year."""
    x, _ = prepared(spark, sf_dir)
    seen = x.where("split <> 'test'").withColumn("aside", F.col("split") == "valid")
    best = None
    for depth in (2, 3, 4):
        model = GBTClassifier(maxDepth=depth, maxIter=15, stepSize=0.2, minInstancesPerNode=10, seed=7, validationIndicatorCol="aside").fit(seen)
        scored_ = lambda d, model=model: model.transform(d).select("brand_id", "year", "label", vector_to_array("probability")[1].alias("p"))
        auc = M.auc_ks(scored_(x.where("split = 'valid'")), "p", "label").first().auc or 0.0
        if best is None or auc > best[0]:
            best = (auc, depth, scored_)
    return best[2](x.where("split = 'test'")).withColumn("depth", F.lit(best[1]))


_LOW, _HIGH = (f"(k * 1.0 / n + 1.9207294103470573 / n {s} 1.959963984540054 * sqrt((k * 1.0 / n) * (1 - k * 1.0 / n) / n + 3.8414588206941146 / (4.0 * n * n))) / (1 + 3.8414588206941146 / n)" for s in "-+")


@query(f"""WITH {LABELLED}, c AS (SELECT year, least(n_events, 2) AS grade, count(*) AS n, CAST(sum(label) AS BIGINT) AS k FROM x WHERE label IS NOT NULL AND prev_stores IS NOT NULL GROUP BY 1, 2), v AS (SELECT *, k * 1.0 / n AS rate, {_LOW} AS low, {_HIGH} AS high FROM c)
 SELECT year, CAST(grade AS INTEGER) AS grade, n, k, round(rate, 6) AS rate, rate < lead(rate) OVER w AS rises, high < lead(low) OVER w AS apart FROM v WINDOW w AS (PARTITION BY year ORDER BY grade)""")
def realised_by_year(spark, sf_dir):
    """Rates by year and grade, whether the next grade's is higher, and whether the two Wilson intervals part."""
    from tidemark.functions.expr import wilson

    x = labelled(spark, sf_dir).where("label is not null and prev_stores is not null")
    c = x.groupBy("year", F.least("n_events", F.lit(2)).alias("grade")).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    w = Window.partitionBy("year").orderBy("grade")  # a handful of grades
    v = c.withColumns({"r": F.col("k") / F.col("n"), "low": low, "high": high})
    return v.select("year", "grade", "n", "k", r6("r", "rate"), (F.col("r") < F.lead("r").over(w)).alias("rises"), (F.col("high") < F.lead("low").over(w)).alias("apart"))


@query(f"""WITH {LABELLED}, b AS (SELECT year, grp, count(*) FILTER (prev_stores >= 2) AS pool, quantile_cont(growth, 0.2) FILTER (prev_stores >= 2) AS low FROM g GROUP BY 1, 2) SELECT g.brand_id, g.year, pool, coalesce(growth < low, false) AS fired FROM g JOIN b USING (year, grp)""")
def pool_masked_flags(spark, sf_dir):
    """Flags against a group quantile that only the pool's rows make, laid on all rows of the group."""
    pool = F.col("prev_stores") >= 2
    x = labelled(spark, sf_dir).select("brand_id", "year", "grp", "growth", "prev_stores")
    sizes = x.groupBy("year", "grp").agg(F.count_if(pool).alias("pool"))
    q = W.group_quantiles(x, ["year", "grp"], {"low": ("growth", 0.2)}, pool)
    return q.join(sizes, ["year", "grp"]).select("brand_id", "year", "pool", F.coalesce(F.col("growth") < F.col("low"), F.lit(False)).alias("fired"))
