"""Statistics of scores against outcomes: the labels table is the outcome, a document statistic the score."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators.ordered import ranked
from tidemark.plans.base import FULL, full_panel, panel, PANEL, query, r6, table


def scored(spark, sf_dir):
    """(id, p, y): a probability-like score from a document's length and its quality label."""
    d, y = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    return d.join(y, "doc_id").select(F.col("doc_id").alias("id"), F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 3).alias("p"), F.col("quality").alias("y"))


SCORED = "s AS (SELECT doc_id AS id, round(n_chars / (n_chars + 1500.0::DOUBLE), 3) AS p, quality AS y FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM s) SELECT round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r""")
def auc_mann_whitney(spark, sf_dir):
    return M.auc_ks(scored(spark, sf_dir), "p", "y").select(r6("auc", "auc"))


@query(f"""WITH {SCORED}, t AS (SELECT p, sum(y) AS a, count(*) - sum(y) AS b FROM s GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY p) / (SELECT sum(a) FROM t) AS fa, sum(b) OVER (ORDER BY p) / (SELECT sum(b) FROM t) AS fb FROM t) SELECT round(max(abs(fa - fb)), 6) AS ks FROM c""")
def ks_stat(spark, sf_dir):
    return M.auc_ks(scored(spark, sf_dir), "p", "y").select(r6("ks", "ks"))


LIFT = f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS rk, greatest(1, floor(count(*) OVER () * 0.1)) AS k FROM s)"


@query(f"""{LIFT} SELECT CAST(max(k) AS BIGINT) AS k, round(avg(y) FILTER (rk <= k), 6) AS precision_at_k, round(avg(y), 6) AS base_rate, round(avg(y) FILTER (rk <= k) / avg(y), 6) AS lift FROM r""")
def lift_top_k(spark, sf_dir):
    t = M.lift(scored(spark, sf_dir), "p", "y", "id")
    return t.select(F.col("k").cast("long").alias("k"), r6("precision_at_k", "precision_at_k"), r6("base_rate", "base_rate"), r6("lift", "lift"))


@query(f"WITH {SCORED} SELECT count(*) AS n, round(avg(y), 6) AS base_rate, round(avg((p - y) * (p - y)), 6) AS brier, round(-avg(CASE WHEN y = 1 THEN ln(greatest(p, 1e-6)) ELSE ln(greatest(1 - p, 1e-6)) END), 6) AS log_loss FROM s")
def metric_row(spark, sf_dir):
    p, y = F.col("p"), F.col("y")
    loss = -F.avg(F.when(y == 1, F.log(F.greatest(p, F.lit(1e-6)))).otherwise(F.log(F.greatest(1 - p, F.lit(1e-6)))))
    return scored(spark, sf_dir).agg(F.count("*").alias("n"), r6(F.avg(y), "base_rate"), r6(F.avg((p - y) * (p - y)), "brier"), r6(loss, "log_loss"))


@query(f"WITH {SCORED}, t AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS m, avg(y) AS r FROM s GROUP BY 1) SELECT round(sum(n * abs(r - m)) / sum(n), 6) AS ece FROM t")
def ece(spark, sf_dir):
    return M.expected_calibration_error(M.calibration_table(scored(spark, sf_dir), "p", "y")).select(r6("ece", "ece"))


@query(f"WITH {SCORED} SELECT round(sum((y - p) * (1 - 2 * p)) / sqrt(sum((1 - 2 * p) * (1 - 2 * p) * p * (1 - p))), 6) AS z FROM s")
def spiegelhalter(spark, sf_dir):
    p, y = F.col("p"), F.col("y")
    return scored(spark, sf_dir).agg(r6(F.sum((y - p) * (1 - 2 * p)) / F.sqrt(F.sum((1 - 2 * p) * (1 - 2 * p) * p * (1 - p))), "z"))


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS rk, count(*) OVER () AS n FROM s) SELECT CAST(greatest(ceil((rk - 1) * 10.0 / (n - 1)), 1) - 1 AS INTEGER) AS bin, count(*) AS size, CAST(sum(y) AS BIGINT) AS observed, round(sum(p), 6) AS expected FROM r GROUP BY 1""")
def hosmer_lemeshow_bins(spark, sf_dir):
    x = ranked(scored(spark, sf_dir), [F.asc("p"), F.asc("id")])
    n = x.agg(F.count("*").alias("n"))
    at = (F.greatest(F.ceil((F.col("rank") - 1) * 10.0 / (F.col("n") - 1)), F.lit(1)) - 1).cast("int")
    return x.crossJoin(F.broadcast(n)).groupBy(at.alias("bin")).agg(F.count("*").alias("size"), F.sum(F.col("y").cast("long")).alias("observed"), r6(F.sum("p"), "expected"))


@query("""WITH r AS (SELECT n_chars AS v FROM documents WHERE doc_id % 2 = 0), a AS (SELECT n_chars AS v FROM documents WHERE doc_id % 2 = 1),
 g AS (SELECT DISTINCT x FROM (SELECT unnest(quantile_cont(CAST(v AS DOUBLE), [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS x FROM r)),
 b AS (SELECT unnest(generate_series(0, (SELECT count(*) FROM g))) AS bin), rb AS (SELECT (SELECT count(*) FROM g WHERE x <= v) AS bin, count(*) AS n FROM r GROUP BY 1), ab AS (SELECT (SELECT count(*) FROM g WHERE x <= v) AS bin, count(*) AS n FROM a GROUP BY 1),
 t AS (SELECT CAST(b.bin AS INTEGER) AS bin, coalesce(rb.n, 0) AS n_ref, coalesce(ab.n, 0) AS n_act FROM b LEFT JOIN rb USING (bin) LEFT JOIN ab USING (bin)),
 s AS (SELECT *, greatest(n_ref * 1.0 / sum(n_ref) OVER (), 1e-6) AS e, greatest(n_act * 1.0 / sum(n_act) OVER (), 1e-6) AS a FROM t) SELECT bin, n_ref, n_act, CASE WHEN (SELECT sum(n_ref) FROM t) >= 20 AND (SELECT sum(n_act) FROM t) >= 10 THEN round((a - e) * ln(a / e), 6) END AS part FROM s""")
def psi(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    t = M.stability_index(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "n_chars")
    return t.select("bin", "n_ref", "n_act", r6("part", "part"))


@query(f"""WITH {FULL}, h AS (SELECT brand_id, year, CASE WHEN n_stores < 2 THEN 'low' WHEN n_stores < 4 THEN 'mid' ELSE 'high' END AS grade FROM f), m AS (SELECT a.grade AS from_grade, coalesce(b.grade, 'exit') AS to_grade, count(*) AS n
 FROM h a LEFT JOIN h b ON b.brand_id = a.brand_id AND b.year = a.year + 1 WHERE a.year < (SELECT max(year) FROM h) GROUP BY 1, 2) SELECT from_grade, to_grade, n, round(n * 1.0 / sum(n) OVER (PARTITION BY from_grade), 6) AS share FROM m""")
def transition_matrix(spark, sf_dir):
    h = full_panel(spark, sf_dir).select("brand_id", "year", F.when(F.col("n_stores") < 2, "low").when(F.col("n_stores") < 4, "mid").otherwise("high").alias("grade"))
    return M.transition_matrix(h, "brand_id", "year", "grade").select("from_grade", "to_grade", "n", r6("share", "share"))


@query("""WITH x AS (SELECT quality AS gold, CAST(n_chars > 800 AS INT) AS pred FROM documents JOIN labels USING (doc_id)), c AS (SELECT gold AS class, count(*) FILTER (gold = pred) AS tp, count(*) AS support FROM x GROUP BY 1), p AS (SELECT pred AS class, count(*) AS predicted FROM x GROUP BY 1)
 SELECT class, support, round(tp * 1.0 / predicted, 6) AS precision, round(tp * 1.0 / support, 6) AS recall, round(2.0 * tp / (predicted + support), 6) AS f1 FROM c LEFT JOIN p USING (class)""")
def classification_f1(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    cells = d.groupBy(F.col("quality").alias("gold"), (F.col("n_chars") > 800).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    gold = cells.groupBy(F.col("gold").alias("class")).agg(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("support"))
    pred = cells.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    return gold.join(pred, "class", "left").select("class", "support", r6(F.col("tp") / F.col("predicted"), "precision"), r6(F.col("tp") / F.col("support"), "recall"), r6(2 * F.col("tp") / (F.col("predicted") + F.col("support")), "f1"))


@query(f"""WITH {SCORED}, b AS (SELECT CAST(floor(p * 60) AS INT) AS b, count(*) AS n, sum(y) AS k FROM s GROUP BY 1), g AS (SELECT unnest(generate_series(1, 59)) AS c) , a AS (SELECT c1.c AS c1, c2.c AS c2 FROM g c1 JOIN g c2 ON c1.c < c2.c),
 t AS (SELECT c1, c2, sum(n) FILTER (b < c1) AS n1, sum(k) FILTER (b < c1) AS k1, sum(n) FILTER (b >= c1 AND b < c2) AS n2, sum(k) FILTER (b >= c1 AND b < c2) AS k2, sum(n) FILTER (b >= c2) AS n3, sum(k) FILTER (b >= c2) AS k3 FROM a, b GROUP BY 1, 2)
 SELECT CAST(c1 AS INTEGER) AS c1, CAST(c2 AS INTEGER) AS c2, round(least(k2 / n2 - k1 / n1, k3 / n3 - k2 / n2), 6) AS gap FROM t WHERE n1 >= 30 AND n2 >= 30 AND n3 >= 30 AND k1 / n1 < k2 / n2 AND k2 / n2 < k3 / n3""")
def grid_cut_search(spark, sf_dir):
    """Pairs of cuts on a grid of 60, with their least gap of rates: prefix counts of 60 buckets, then 59 x 58 / 2 pairs."""
    s = scored(spark, sf_dir)
    grid = spark.range(1, 60).select(F.col("id").cast("int").alias("c"))
    buckets = s.groupBy(F.floor(F.col("p") * 60).cast("int").alias("b")).agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    below = grid.crossJoin(F.broadcast(buckets)).groupBy("c").agg(*[F.sum(F.when(F.col("b") < F.col("c"), F.col(v)).otherwise(0)).alias(v) for v in ("n", "k")])
    total = buckets.agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    one, two = below.select(*[F.col(c).alias(f"{c}1") for c in ("c", "n", "k")]), below.select(F.col("c").alias("c2"), F.col("n").alias("nb"), F.col("k").alias("kb"))
    t = one.join(two, F.col("c1") < F.col("c2")).crossJoin(F.broadcast(total))
    n2, n3 = F.col("nb") - F.col("n1"), F.col("tn") - F.col("nb")
    ok = t.where((F.col("n1") >= 30) & (n2 >= 30) & (n3 >= 30))
    r1, r2, r3 = F.col("k1") / F.col("n1"), (F.col("kb") - F.col("k1")) / n2, (F.col("tk") - F.col("kb")) / n3
    return ok.where((r1 < r2) & (r2 < r3)).select("c1", "c2", r6(F.least(r2 - r1, r3 - r2), "gap"))


@query(f"""WITH {FULL}, s AS (SELECT c_nationkey AS region, year, f.brand_id, n_stores, n_end, mid FROM f JOIN customer ON c_custkey = f.brand_id), b AS (SELECT mid, year, region, count(*) AS r, count(*) FILTER (n_end * 2 > n_stores) AS k FROM s GROUP BY 1, 2, 3)
 SELECT mid, CAST(sum(r) AS BIGINT) AS n, round(sum(k) * 1.0 / sum(r), 6) AS p, round(sum(k * (k - 1) / 2.0) / sum(r * (r - 1) / 2.0), 6) AS p11,
 round((sum(k * (k - 1) / 2.0) / sum(r * (r - 1) / 2.0) - (sum(k) * 1.0 / sum(r)) * (sum(k) * 1.0 / sum(r))) / ((sum(k) * 1.0 / sum(r)) * (1 - sum(k) * 1.0 / sum(r))), 6) AS event_correlation FROM b WHERE r >= 2 GROUP BY 1""")
def pair_event_correlation(spark, sf_dir):
    """Correlation of events inside a block from counts alone: pairs are never listed."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("brand_id"), F.col("c_nationkey").alias("region"))
    x = full_panel(spark, sf_dir).join(c, "brand_id")
    b = x.groupBy("mid", "year", "region").agg(F.count("*").alias("r"), F.count_if(F.col("n_end") * 2 > F.col("n_stores")).alias("k")).where("r >= 2")
    r, k = F.col("r"), F.col("k")
    t = b.groupBy("mid").agg(F.sum("r").alias("n"), (F.sum("k") / F.sum("r")).alias("p"), (F.sum(k * (k - 1) / 2) / F.sum(r * (r - 1) / 2)).alias("p11"))
    p = F.col("p")
    return t.select("mid", "n", r6("p", "p"), r6("p11", "p11"), r6((F.col("p11") - p * p) / (p * (1 - p)), "event_correlation"))


@query(f"""WITH {PANEL}, y AS (SELECT year, count(*) AS n, avg(CAST(n_end * 2 > n_stores AS INT)) AS r FROM p GROUP BY 1 HAVING count(*) >= 20) SELECT round(greatest(var_samp(r) - avg(r * (1 - r) / n), 0), 6) AS between_var, round(var_samp(r), 6) AS total_var, count(*) AS years FROM y""")
def variance_decomposition(spark, sf_dir):
    y = panel(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"), F.avg((F.col("n_end") * 2 > F.col("n_stores")).cast("int")).alias("r")).where("n >= 20")
    r = F.col("r")
    return y.agg(r6(F.greatest(F.var_samp("r") - F.avg(r * (1 - r) / F.col("n")), F.lit(0.0)), "between_var"), r6(F.var_samp("r"), "total_var"), F.count("*").alias("years"))
