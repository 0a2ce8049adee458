"""Entity resolution, enrichment joins, as-of joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import joins
from tidemark.plans.base import PANEL, panel, query, r6, table


@query("""WITH k AS (SELECT l_partkey AS brand, l_suppkey AS corp, min(l_orderkey) AS mnno, count(DISTINCT l_orderkey) AS n_ids FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2),
 b AS (SELECT brand, CASE WHEN count(*) = 1 THEN min(mnno) END AS loose FROM k GROUP BY 1)
 SELECT CASE WHEN k.mnno IS NOT NULL THEN 'exact' WHEN b.loose IS NOT NULL THEN 'loose' WHEN b.brand IS NOT NULL THEN 'ambiguous' ELSE 'none' END AS source, count(*) AS n,
 count(coalesce(k.mnno, b.loose)) AS resolved FROM lineitem x LEFT JOIN k ON k.brand = x.l_partkey AND k.corp = x.l_suppkey LEFT JOIN b ON b.brand = x.l_partkey GROUP BY 1""")
def crosswalk_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("brand"), F.col("l_suppkey").alias("corp"), "l_orderkey", "l_linenumber")
    cross = li.where("l_linenumber = 1").groupBy("brand", "corp").agg(F.min("l_orderkey").alias("mnno"))
    loose = cross.groupBy("brand").agg(F.when(F.count("*") == 1, F.min("mnno")).alias("loose"), F.lit(True).alias("named"))
    out = li.join(cross, ["brand", "corp"], "left").join(loose, "brand", "left")
    source = F.when(F.col("mnno").isNotNull(), "exact").when(F.col("loose").isNotNull(), "loose").when(F.col("named"), "ambiguous").otherwise("none")
    return out.groupBy(source.alias("source")).agg(F.count("*").alias("n"), F.count(F.coalesce("mnno", "loose")).alias("resolved"))


@query("""WITH r AS (SELECT l_partkey AS brand, l_suppkey AS corp, CAST(year(l_shipdate) AS INTEGER) AS year, l_tax AS fee FROM lineitem WHERE l_orderkey % 3 = 0),
 e AS (SELECT brand, corp, year, max(fee) AS fee FROM r GROUP BY 1, 2, 3), o AS (SELECT brand, year, max(fee) AS fee, count(DISTINCT corp) AS c FROM r GROUP BY 1, 2 HAVING count(DISTINCT corp) = 1)
 SELECT CASE WHEN e.fee IS NOT NULL THEN 'exact' WHEN o.fee IS NOT NULL THEN 'loose' ELSE 'none' END AS matched_by, count(*) AS n, round(sum(coalesce(e.fee, o.fee)), 6) AS fees
 FROM (SELECT l_partkey AS brand, l_suppkey AS corp, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem) x LEFT JOIN e USING (brand, corp, year) LEFT JOIN o USING (brand, year) GROUP BY 1""")
def guarded_fallback_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("brand"), F.col("l_suppkey").alias("corp"), F.year("l_shipdate").alias("year"), F.col("l_tax").alias("fee"), "l_orderkey")
    out = joins.guarded_left_join(li.select("brand", "corp", "year"), li.where("l_orderkey % 3 = 0"), ["brand", "corp", "year"], ["brand", "year"], ["fee"], "corp")
    return out.groupBy("matched_by").agg(F.count("*").alias("n"), r6(F.sum("fee"), "fees"))


@query(f"""WITH {PANEL}, h AS (SELECT brand_id, year AS fiscal_year, n_stores AS revenue FROM p WHERE (brand_id + year) % 3 <> 0),
 a AS (SELECT p.brand_id, p.year, h.fiscal_year, h.revenue FROM p ASOF LEFT JOIN h ON p.brand_id = h.brand_id AND p.year - 1 >= h.fiscal_year)
 SELECT brand_id, year, CASE WHEN year - 1 - fiscal_year <= 3 THEN revenue END AS revenue, CASE WHEN year - 1 - fiscal_year <= 3 THEN fiscal_year END AS matched_fiscal_year FROM a""")
def asof_join(spark, sf_dir):
    p = panel(spark, sf_dir)
    h = p.where((F.col("brand_id") + F.col("year")) % 3 != 0).select("brand_id", F.col("year").alias("fiscal_year"), F.col("n_stores").alias("revenue"))
    left = p.select("brand_id", "year", (F.col("year") - 1).alias("cut"))
    return joins.asof_join(left, h, "brand_id", "cut", "fiscal_year", ["revenue"], 3).drop("cut")


@query("""WITH v AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2),
 b AS (SELECT event_id AS id, user_id, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type = 'purchase')
 SELECT id, CASE WHEN b.t - v.t <= 43200 THEN v.event_id END AS view_id, CASE WHEN b.t - v.t <= 43200 THEN v.t END AS matched_seen FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.t >= v.t""")
def asof_join_tolerance(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    views = e.where("event_type = 'view'").groupBy("user_id", F.col("t").alias("seen")).agg(F.max("event_id").alias("view_id"))
    buys = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", "t")
    return joins.asof_join(buys, views, "user_id", "t", "seen", ["view_id"], 12 * 3600).select("id", "view_id", "matched_seen")


@query(f"""WITH {PANEL} SELECT a.year, count(*) AS n, round(avg(CAST(b.n_stores AS DOUBLE) / a.n_stores - 1), 6) AS mean_growth FROM p a JOIN p b ON a.brand_id = b.brand_id AND b.year = a.year + 1 GROUP BY 1""")
def next_period_self_join(spark, sf_dir):
    p = panel(spark, sf_dir).select("brand_id", "year", "n_stores")
    both = joins.next_period(p, p.withColumnRenamed("n_stores", "next_stores"), "brand_id", "year")
    return both.groupBy("year").agg(F.count("*").alias("n"), r6(F.avg(F.col("next_stores") / F.col("n_stores") - 1), "mean_growth"))


@query(f"""WITH {PANEL} SELECT year, count(*) AS disappeared FROM p WHERE year < (SELECT max(year) FROM p) AND NOT EXISTS (SELECT 1 FROM p q WHERE q.brand_id = p.brand_id AND q.year = p.year + 1) GROUP BY 1""")
def anti_disappeared(spark, sf_dir):
    p = panel(spark, sf_dir).select("brand_id", "year")
    last = p.agg(F.max("year").alias("last"))
    gone = p.join(p.withColumn("year", F.col("year") - 1), ["brand_id", "year"], "left_anti")
    return gone.crossJoin(F.broadcast(last)).where("year < last").groupBy("year").agg(F.count("*").alias("disappeared"))


@query(f"""WITH {PANEL} SELECT year, count(*) AS gaps, count(*) FILTER (EXISTS (SELECT 1 FROM p q WHERE q.brand_id = g.brand_id AND q.year > g.year + 1)) AS returned
 FROM (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.brand_id = p.brand_id AND q.year = p.year + 1)) g GROUP BY 1""")
def gap_return_semi(spark, sf_dir):
    p = panel(spark, sf_dir).select("brand_id", "year")
    gone = p.join(p.withColumn("year", F.col("year") - 1), ["brand_id", "year"], "left_anti")
    last = p.groupBy("brand_id").agg(F.max("year").alias("last"))
    return gone.join(last, "brand_id").groupBy("year").agg(F.count("*").alias("gaps"), F.count_if(F.col("last") > F.col("year") + 1).alias("returned"))


@query(f"""WITH {PANEL}, a AS (SELECT brand_id, year, n_stores, 'audited' AS source FROM p WHERE brand_id % 2 = 0), m AS (SELECT brand_id, year, n_stores * 2 AS n_stores, 'manual' AS source FROM p WHERE year % 2 = 0)
 SELECT source, count(*) AS n, CAST(sum(n_stores) AS BIGINT) AS stores FROM (SELECT * FROM a UNION ALL SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.brand_id = m.brand_id AND a.year = m.year)) GROUP BY 1""")
def union_prefer_source(spark, sf_dir):
    p = panel(spark, sf_dir).select("brand_id", "year", "n_stores")
    audited = p.where("brand_id % 2 = 0").withColumn("source", F.lit("audited"))
    manual = p.where("year % 2 = 0").withColumn("n_stores", F.col("n_stores") * 2).withColumn("source", F.lit("manual"))
    return joins.prefer(audited, manual, ["brand_id", "year"]).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_stores").alias("stores"))


@query("""SELECT count(*) FILTER (o_orderkey % 10 = 0) AS deleted, count(*) FILTER (o_orderkey % 10 = 1) AS added, count(*) FILTER (o_orderkey % 10 = 2) AS modified, count(*) FILTER (o_orderkey % 10 > 2) AS same FROM (SELECT DISTINCT o_orderkey FROM orders)""")
def drift_compare(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.max("o_orderstatus").alias("status"))
    old = o.where("o_orderkey % 10 <> 1")
    new = o.where("o_orderkey % 10 <> 0").withColumn("status", F.when(F.col("o_orderkey") % 10 == 2, F.lit("changed")).otherwise(F.col("status")))
    return joins.drift(old, new, ["o_orderkey"])


@query(f"""WITH {PANEL} SELECT c_custkey AS brand_id, coalesce(e.n_stores, l.n_stores) AS n_stores, CASE WHEN e.n_stores IS NOT NULL THEN 'exact' WHEN l.n_stores IS NOT NULL THEN 'latest' ELSE 'none' END AS basis
 FROM customer LEFT JOIN (SELECT * FROM p WHERE year = 2000) e ON e.brand_id = c_custkey LEFT JOIN (SELECT brand_id, arg_max(n_stores, year) AS n_stores FROM p GROUP BY 1) l ON l.brand_id = c_custkey""")
def exact_else_latest(spark, sf_dir):
    p = panel(spark, sf_dir)
    at = p.groupBy("brand_id").agg(F.max(F.when(F.col("year") == 2000, F.col("n_stores"))).alias("exact"), F.max_by("n_stores", "year").alias("latest"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("brand_id")).join(at, "brand_id", "left")
    return c.select("brand_id", F.coalesce("exact", "latest").alias("n_stores"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("latest").isNotNull(), "latest").otherwise("none").alias("basis"))


@query("""WITH x AS (SELECT l_suppkey AS supplier, c_nationkey AS nation, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
 SELECT supplier, count(*) AS n_regions, round(sum(CAST(n AS DOUBLE) * n) / (sum(n) * sum(n)), 6) AS hhi, round(max(n) * 1.0 / sum(n), 6) AS top_share, max(n) AS top FROM x GROUP BY 1""")
def hhi_by_entity(spark, sf_dir):
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    flows = li.select("l_suppkey", "l_orderkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    n = flows.groupBy(F.col("l_suppkey").alias("supplier"), F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    d = F.col("n").cast("double")
    return n.groupBy("supplier").agg(F.count("*").alias("n_regions"), r6(F.sum(d * d) / (F.sum(d) * F.sum(d)), "hhi"), r6(F.max(d) / F.sum(d), "top_share"), F.max("n").alias("top"))


@query("""WITH x AS (SELECT s_suppkey AS id, s_nationkey AS hq, round(s_acctbal, 2) AS bal FROM supplier) SELECT id, CAST(count(*) OVER w - 1 AS BIGINT) AS siblings, round(sum(bal) OVER w - bal, 4) AS sibling_sum,
 round((sum(bal) OVER w - bal) / nullif(count(*) OVER w - 1, 0), 4) AS sibling_mean FROM x WINDOW w AS (PARTITION BY hq)""")
def sibling_leave_one_out(spark, sf_dir):
    x = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("hq"), F.round("s_acctbal", 2).alias("bal"))
    totals = x.groupBy("hq").agg(F.count("*").alias("n"), F.sum("bal").alias("total"))
    rest = F.col("total") - F.col("bal")
    return x.join(totals, "hq").select("id", (F.col("n") - 1).alias("siblings"), F.round(rest, 4).alias("sibling_sum"), F.round(rest / F.nullif(F.col("n") - 1, F.lit(0)), 4).alias("sibling_mean"))


@query("""SELECT 'P' || lpad(CAST(row_number() OVER (ORDER BY sha1('salt:' || CAST(s_suppkey AS VARCHAR))) AS VARCHAR), 5, '0') AS pseudonym, s_suppkey AS id FROM supplier""")
def pseudonym_mask(spark, sf_dir):
    from tidemark.operators.ordered import ranked

    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.sha1(F.concat(F.lit("salt:"), F.col("s_suppkey").cast("string"))).alias("h"))
    return ranked(s, [F.asc("h")]).select(F.concat(F.lit("P"), F.lpad(F.col("rank").cast("string"), 5, "0")).alias("pseudonym"), "id")


@query()
def greedy_transfer_pairs(spark, sf_dir):
    """Closings and openings of one user within -30..90 days, one to one, smallest gap first."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.to_date("ts").alias("day"))
    side = lambda kind: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), "day")
    return joins.greedy_pairs(side("error"), side("signup"), ["user_id"], -30, 90)


@query(f"""WITH {PANEL} SELECT brand_id, max(year) AS year, arg_max(n_stores, year) AS n_stores FROM p GROUP BY 1""")
def latest_per_key(spark, sf_dir):
    return joins.best_row(panel(spark, sf_dir), ["brand_id"], [F.desc("year")]).select("brand_id", "year", "n_stores")


@query("""SELECT owner, domain FROM (SELECT c_custkey AS owner, c_custkey % 700 AS domain, count(*) OVER (PARTITION BY c_custkey % 700) AS owners FROM customer) WHERE owners = 1""")
def shared_asset_pruning(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), (F.col("c_custkey") % 700).alias("domain"))
    return a.withColumn("owners", F.count("*").over(Window.partitionBy("domain"))).where("owners = 1").drop("owners")
