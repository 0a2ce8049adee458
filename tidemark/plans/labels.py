"""Panel windows, labels and features.  A row of year t looks at years up to t only."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.expr import ratio
from tidemark.operators import windows as W
from tidemark.plans.base import FULL, LAGGED, PANEL, full_panel, panel, query, r6

#: Rows that a fine industry needs in a year to stand for itself.
FINE_ROWS = 30


def lagged(spark, sf_dir):
    p = full_panel(spark, sf_dir)
    return p.withColumns({"prev_stores": W.guarded_lag("n_stores", "brand_id", "year"), "prev_sales": W.guarded_lag("avg_sales", "brand_id", "year")})


def labelled(spark, sf_dir, gate: int = 0):
    """Events of deterioration by group quantiles, the healthy gate and the label of the following year; of brand years of ``gate`` stores or more."""
    x = lagged(spark, sf_dir)
    x = x.where(F.col("n_stores") >= gate) if gate else x
    x = x.withColumns({
        "growth": F.round(ratio(F.col("n_stores"), F.col("prev_stores")) - 1, 6),
        "sales_growth": F.round(ratio(F.col("avg_sales"), F.col("prev_sales")) - 1, 6),
        "end_rate": F.round(ratio(F.col("n_end"), F.col("prev_stores")), 6),
        "grp": W.group_key("mid", "major", "year", FINE_ROWS),
    })
    x = W.group_quantiles(x, ["year", "grp"], {"q_store": ("growth", 0.2), "q_sales": ("sales_growth", 0.2), "q_end": ("end_rate", 0.8)})
    false = F.lit(False)
    x = x.withColumns({
        "ev_store": F.coalesce(F.col("growth") < F.col("q_store"), false),
        "ev_sales": F.coalesce(F.col("sales_growth") < F.col("q_sales"), false),
        "ev_contract": F.coalesce(F.col("end_rate") > F.col("q_end"), false),
    })
    x = x.withColumn("n_events", sum(F.col(c).cast("int") for c in ("ev_store", "ev_sales", "ev_contract")))
    x = x.withColumn("healthy_at_t", F.col("prev_stores").isNotNull() & (F.col("n_events") <= 1))
    after = x.select("brand_id", (F.col("year") - 1).alias("year"), F.col("n_events").alias("next_events"))
    return x.join(after, ["brand_id", "year"], "left").withColumn("label", F.when(F.col("next_events").isNotNull(), (F.col("next_events") >= 2).cast("int")))


LABELLED = f"""{FULL}, {LAGGED}, g AS (SELECT *, round(CAST(n_stores AS DOUBLE) / prev_stores - 1, 6) AS growth, round(avg_sales / prev_sales - 1, 6) AS sales_growth, round(CAST(n_end AS DOUBLE) / prev_stores, 6) AS end_rate,
 CASE WHEN count(*) OVER (PARTITION BY year, mid) >= {FINE_ROWS} THEN mid ELSE major END AS grp FROM l /*gate*/),
 q AS (SELECT year, grp, quantile_cont(growth, 0.2) AS q_store, quantile_cont(sales_growth, 0.2) AS q_sales, quantile_cont(end_rate, 0.8) AS q_end FROM g GROUP BY 1, 2),
 e AS (SELECT g.*, coalesce(growth < q_store, false) AS ev_store, coalesce(sales_growth < q_sales, false) AS ev_sales, coalesce(end_rate > q_end, false) AS ev_contract FROM g JOIN q USING (year, grp)),
 n AS (SELECT *, CAST(ev_store AS INT) + CAST(ev_sales AS INT) + CAST(ev_contract AS INT) AS n_events FROM e),
 x AS (SELECT n.*, n.prev_stores IS NOT NULL AND n.n_events <= 1 AS healthy_at_t, m.n_events AS next_events, CASE WHEN m.n_events IS NOT NULL THEN CAST(m.n_events >= 2 AS INT) END AS label
 FROM n LEFT JOIN n m ON m.brand_id = n.brand_id AND m.year = n.year + 1)"""


@query(f"WITH {LABELLED} SELECT year, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate FROM x WHERE healthy_at_t AND label IS NOT NULL GROUP BY 1")
def label_rate_by_year(spark, sf_dir):
    x = labelled(spark, sf_dir).where("healthy_at_t and label is not null")
    return x.groupBy("year").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), r6(F.avg("label"), "rate"))


@query(f"WITH {LABELLED} SELECT brand_id, year, label, healthy_at_t, ev_store, ev_sales, ev_contract, n_events FROM x WHERE healthy_at_t AND label IS NOT NULL")
def label_build(spark, sf_dir):
    return labelled(spark, sf_dir).where("healthy_at_t and label is not null").select("brand_id", "year", "label", "healthy_at_t", "ev_store", "ev_sales", "ev_contract", "n_events")


@query(f"WITH {LABELLED} SELECT CASE WHEN prev_stores IS NULL THEN 'unassessable' WHEN n_events >= 2 THEN 'watch' ELSE 'healthy' END AS state, n_events, count(*) AS n FROM x GROUP BY 1, 2")
def brand_state(spark, sf_dir):
    x = labelled(spark, sf_dir)
    state = F.when(F.col("prev_stores").isNull(), "unassessable").when(F.col("n_events") >= 2, "watch").otherwise("healthy")
    return x.groupBy(state.alias("state"), "n_events").agg(F.count("*").alias("n"))


@query(f"""WITH {LABELLED} SELECT section, name, count(*) AS n, round(avg(v), 6) AS rate FROM (SELECT 'event' AS section, 'store' AS name, CAST(ev_store AS INT) AS v FROM x UNION ALL SELECT 'event', 'sales', CAST(ev_sales AS INT) FROM x
 UNION ALL SELECT 'event', 'contract', CAST(ev_contract AS INT) FROM x UNION ALL SELECT 'label', CAST(year AS VARCHAR), label FROM x WHERE label IS NOT NULL) GROUP BY 1, 2""")
def composition_long(spark, sf_dir):
    x = labelled(spark, sf_dir)
    entry = lambda s, n, v: F.struct(F.lit(s).alias("section"), n.alias("name"), v.cast("int").alias("v"))
    items = F.array(*[entry("event", F.lit(n), F.col(f"ev_{n}")) for n in ("store", "sales", "contract")], entry("label", F.col("year").cast("string"), F.col("label")))
    long = x.select(F.explode(items).alias("e")).select("e.*").where("section = 'event' or v is not null")
    return long.groupBy("section", "name").agg(F.count("*").alias("n"), r6(F.avg("v"), "rate"))


@query(f"WITH {FULL}, {LAGGED} SELECT brand_id, year, prev_stores, round(CAST(n_stores AS DOUBLE) / prev_stores - 1, 6) AS growth, round(avg_sales / prev_sales - 1, 6) AS sales_growth FROM l")
def guarded_lag_growth(spark, sf_dir):
    return lagged(spark, sf_dir).select("brand_id", "year", "prev_stores", r6(ratio(F.col("n_stores"), F.col("prev_stores")) - 1, "growth"), r6(ratio(F.col("avg_sales"), F.col("prev_sales")) - 1, "sales_growth"))


RUNS = f"""{PANEL}, s AS (SELECT *, sum(gap) OVER (PARTITION BY brand_id ORDER BY year) AS run FROM (SELECT *, CASE WHEN year - lag(year) OVER (PARTITION BY brand_id ORDER BY year) = 1 THEN 0 ELSE 1 END AS gap FROM p))"""


@query(f"""WITH {RUNS} SELECT brand_id, year, CAST(run AS BIGINT) AS run, row_number() OVER (PARTITION BY brand_id, run ORDER BY year) AS run_length, max(n_stores) OVER (PARTITION BY brand_id ORDER BY year) AS peak,
 max(n_stores) OVER (PARTITION BY brand_id ORDER BY year) >= 3 AND row_number() OVER (PARTITION BY brand_id, run ORDER BY year) >= 2 AS eligible FROM s""")
def run_id_eligibility(spark, sf_dir):
    x = W.run_id("brand_id", "year", panel(spark, sf_dir))
    length = F.row_number().over(Window.partitionBy("brand_id", "run").orderBy("year")).cast("long")
    x = x.withColumns({"run_length": length, "peak": W.running_max("n_stores", "brand_id", "year")})
    return x.select("brand_id", "year", "run", "run_length", "peak", ((F.col("peak") >= 3) & (F.col("run_length") >= 2)).alias("eligible"))


@query(f"""WITH {RUNS} SELECT brand_id, year, CASE WHEN count(n_stores) OVER w >= 2 THEN round(avg(n_stores) OVER w, 6) END AS mean3, CASE WHEN count(n_stores) OVER w >= 2 THEN round(stddev_samp(n_stores) OVER w, 6) END AS std3,
 CASE WHEN count(n_stores) OVER w >= 2 THEN round(regr_slope(n_stores, year) OVER w, 6) END AS slope3 FROM s WINDOW w AS (PARTITION BY brand_id, run ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rolling_trend(spark, sf_dir):
    x = W.run_id("brand_id", "year", panel(spark, sf_dir))
    mean, std, slope = W.rolling("n_stores", "brand_id", "run", "year")
    return x.select("brand_id", "year", r6(mean, "mean3"), r6(std, "std3"), r6(slope, "slope3"))


@query(f"WITH {FULL} SELECT year, CASE WHEN count(*) OVER (PARTITION BY year, mid) >= 200 THEN mid ELSE major END AS grp, brand_id FROM f")
def group_key_conditional(spark, sf_dir):
    return full_panel(spark, sf_dir).select("year", W.group_key("mid", "major", "year", 200).alias("grp"), "brand_id")


@query(f"""WITH {LABELLED} SELECT year, grp, count(*) AS n, round(min(q_store), 6) AS q_store, round(min(q_sales), 6) AS q_sales, round(min(q_end), 6) AS q_end FROM (SELECT g.*, q_store, q_sales, q_end FROM g JOIN q USING (year, grp)) GROUP BY 1, 2""")
def pooled_quantile_flags(spark, sf_dir):
    x = labelled(spark, sf_dir)
    return x.groupBy("year", "grp").agg(F.count("*").alias("n"), *[r6(F.min(c), c) for c in ("q_store", "q_sales", "q_end")])


@query(f"""WITH {FULL} SELECT brand_id, year, round((rank() OVER (PARTITION BY year, mid ORDER BY n_stores) + (count(*) OVER (PARTITION BY year, mid, n_stores) - 1) / 2.0) / count(*) OVER (PARTITION BY year, mid), 6) AS share FROM f""")
def rank_pct_average(spark, sf_dir):
    return full_panel(spark, sf_dir).select("brand_id", "year", r6(W.average_rank_share("n_stores", "year", "mid"), "share"))


@query(f"""WITH {FULL} SELECT brand_id, year, round(row_number() OVER (ORDER BY avg_sales, brand_id, year) * 1.0 / count(*) OVER (), 6) AS share FROM f""")
def rank_pct_first(spark, sf_dir):
    from tidemark.operators.ordered import ranked

    x = ranked(panel(spark, sf_dir), [F.asc("avg_sales"), F.asc("brand_id"), F.asc("year")])
    return x.crossJoin(F.broadcast(x.agg(F.count("*").alias("n")))).select("brand_id", "year", r6(F.col("rank") / F.col("n"), "share"))


@query(f"""WITH {FULL} SELECT brand_id, year, CASE WHEN count(*) OVER (PARTITION BY year, mid) >= 5 THEN round((cume_dist() OVER w + (rank() OVER w - 1.0) / count(*) OVER (PARTITION BY year, mid)) / 2, 6) END AS share FROM f WINDOW w AS (PARTITION BY year, mid ORDER BY avg_sales)""")
def midrank_percentile(spark, sf_dir):
    w = Window.partitionBy("year", "mid").orderBy("avg_sales")
    n = F.count("*").over(Window.partitionBy("year", "mid"))
    return full_panel(spark, sf_dir).select("brand_id", "year", F.when(n >= 5, F.round((F.cume_dist().over(w) + (F.rank().over(w) - 1) / n) / 2, 6)).alias("share"))


@query(f"""WITH {PANEL}, b AS (SELECT year, quantile_cont(avg_sales, 0.01) AS lo, quantile_cont(avg_sales, 0.99) AS hi, quantile_cont(CAST(n_stores AS DOUBLE), 0.01) AS l2, quantile_cont(CAST(n_stores AS DOUBLE), 0.99) AS h2 FROM p GROUP BY 1)
 SELECT brand_id, year, round(least(greatest(avg_sales, lo), hi), 4) AS avg_sales, round(least(greatest(n_stores, l2), h2), 4) AS n_stores FROM p JOIN b USING (year)""")
def winsorize_by_year(spark, sf_dir):
    x = W.winsorized(panel(spark, sf_dir).withColumn("n_stores", F.col("n_stores").cast("double")), ["year"], ["avg_sales", "n_stores"])
    return x.select("brand_id", "year", F.round("avg_sales", 4).alias("avg_sales"), F.round("n_stores", 4).alias("n_stores"))


@query(f"""WITH {PANEL}, k AS (SELECT *, CASE WHEN year % 5 <> 0 THEN n_end > n_stores / 2.0 END AS loss FROM p), b AS (SELECT *, sum(CASE WHEN coalesce(loss, false) THEN 0 ELSE 1 END) OVER (PARTITION BY brand_id ORDER BY year) AS blk FROM k)
 SELECT brand_id, year, CASE WHEN loss IS NOT NULL THEN CAST(sum(CASE WHEN loss THEN 1 ELSE 0 END) OVER (PARTITION BY brand_id, blk ORDER BY year) AS BIGINT) END AS streak FROM b""")
def loss_streak(spark, sf_dir):
    loss = F.when(F.col("year") % 5 != 0, F.col("n_end") > F.col("n_stores") / 2)
    return W.streak(panel(spark, sf_dir), loss, "brand_id", "year", "streak").select("brand_id", "year", "streak")


@query(f"""WITH {FULL} SELECT year, mid, count(*) AS n, round(quantile_cont(avg_sales, 0.5), 6) AS median_sales, round(quantile_cont(CAST(n_stores AS DOUBLE), 0.5), 6) AS median_stores, round(quantile_cont(CAST(n_end AS DOUBLE) / n_stores, 0.5), 6) AS median_end FROM f GROUP BY 1, 2""")
def benchmarks_by_group(spark, sf_dir):
    x = full_panel(spark, sf_dir)
    return x.groupBy("year", "mid").agg(F.count("*").alias("n"), r6(F.percentile("avg_sales", 0.5), "median_sales"), r6(F.percentile("n_stores", 0.5), "median_stores"), r6(F.percentile(F.col("n_end") / F.col("n_stores"), 0.5), "median_end"))


@query(f"""WITH {PANEL}, a AS (SELECT p.year, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM p q WHERE q.brand_id = p.brand_id AND q.year = p.year + 1)) AS absent,
 count(*) FILTER (NOT EXISTS (SELECT 1 FROM p q WHERE q.brand_id = p.brand_id AND q.year > p.year)) AS gone FROM p GROUP BY 1)
 SELECT year, n, absent, gone, year = (SELECT max(year) FROM p) AS censored, round(gone * 1.0 / n, 6) AS rate FROM a""")
def attrition_table(spark, sf_dir):
    p = panel(spark, sf_dir).select("brand_id", "year")
    w = Window.partitionBy("brand_id").orderBy("year")
    x = p.withColumn("next", F.lead("year").over(w))
    t = x.groupBy("year").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("next") == F.col("year") + 1, F.lit(False))).alias("absent"), F.count_if(F.col("next").isNull()).alias("gone"))
    return t.crossJoin(F.broadcast(p.agg(F.max("year").alias("last")))).select("year", "n", "absent", "gone", (F.col("year") == F.col("last")).alias("censored"), r6(F.col("gone") / F.col("n"), "rate"))


@query(f"""WITH {LABELLED}, t AS (SELECT n_events, count(*) AS n, CAST(sum(label) AS BIGINT) AS k FROM x WHERE label IS NOT NULL AND prev_stores IS NOT NULL GROUP BY 1)
 SELECT n_events, n, k, round(((k * 1.0 / n) + 1.9207294103470573 / n - 1.959963984540054 * sqrt((k * 1.0 / n) * (1 - k * 1.0 / n) / n + 3.8414588206941146 / (4.0 * n * n))) / (1 + 3.8414588206941146 / n), 6) AS low,
 round(((k * 1.0 / n) + 1.9207294103470573 / n + 1.959963984540054 * sqrt((k * 1.0 / n) * (1 - k * 1.0 / n) / n + 3.8414588206941146 / (4.0 * n * n))) / (1 + 3.8414588206941146 / n), 6) AS high FROM t""")
def base_rates_wilson(spark, sf_dir):
    from tidemark.functions.expr import wilson

    x = labelled(spark, sf_dir).where("label is not null and prev_stores is not null")
    t = x.groupBy("n_events").agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return t.select("n_events", "n", "k", r6(low, "low"), r6(high, "high"))
