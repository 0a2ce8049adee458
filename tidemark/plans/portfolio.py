"""Exposure, concentration, expected loss, rules, queues and grades."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import simulate
from tidemark.operators.ordered import ranked
from tidemark.plans.base import FULL, LAGGED, query, r6, table
from tidemark.plans.labels import lagged


def exposures(spark, sf_dir):
    """(id, nation, exposure, p): a supplier's sales are an exposure, its return rate a probability of default."""
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    x = li.groupBy(F.col("l_suppkey").alias("id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("exposure"), F.round(F.avg((F.col("l_returnflag") == "R").cast("int")), 6).alias("p"))
    return x.join(s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")), "id")


EXPOSURES = """x AS (SELECT l_suppkey AS id, s_nationkey AS nation, round(sum(l_extendedprice), 2) AS exposure, round(avg(CAST(l_returnflag = 'R' AS INT)), 6) AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""


@query(f"""WITH {EXPOSURES}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS rk, count(*) OVER () AS n FROM x), g AS (SELECT unnest([0.1, 0.45, 0.65]::DOUBLE[]) AS lgd)
 SELECT lgd, round(sum(exposure * p * lgd), 2) AS el, round(sum(exposure * least(CASE WHEN rk <= ceil(n * 0.1) THEN p * 2 ELSE p END, 1) * lgd), 2) AS stressed FROM r, g GROUP BY 1""")
def portfolio_el_stress(spark, sf_dir):
    r = ranked(exposures(spark, sf_dir), [F.desc("p"), F.asc("id")])
    r = r.crossJoin(F.broadcast(r.agg(F.count("*").alias("n"))))
    shocked = F.least(F.when(F.col("rank") <= F.ceil(F.col("n") * 0.1), F.col("p") * 2).otherwise(F.col("p")), F.lit(1.0))
    sums = r.agg(F.sum(F.col("exposure") * F.col("p")).alias("el"), F.sum(F.col("exposure") * shocked).alias("st"))
    return sums.select(F.explode(F.array(*[F.lit(v) for v in (0.1, 0.45, 0.65)])).alias("lgd"), "el", "st").select("lgd", F.round(F.col("el") * F.col("lgd"), 2).alias("el"), F.round(F.col("st") * F.col("lgd"), 2).alias("stressed"))


@query(f"""WITH {EXPOSURES}, s AS (SELECT *, exposure / sum(exposure) OVER () AS share, row_number() OVER (ORDER BY exposure DESC, id) AS rk FROM x) SELECT round(sum(share * share), 6) AS hhi, round(sum(share) FILTER (rk <= 10), 6) AS top10, round(max(share), 6) AS top1 FROM s""")
def concentration(spark, sf_dir):
    r = ranked(exposures(spark, sf_dir), [F.desc("exposure"), F.asc("id")])
    total = r.agg(F.sum("exposure").alias("t"))
    share = F.col("exposure") / F.col("t")
    return r.crossJoin(F.broadcast(total)).agg(r6(F.sum(share * share), "hhi"), r6(F.sum(F.when(F.col("rank") <= 10, share)), "top10"), r6(F.max(share), "top1"))


@query(f"""WITH {EXPOSURES}, t AS (SELECT sum(exposure) AS t FROM x) SELECT 'name' AS kind, id AS key, round(exposure / t, 6) AS share FROM x, t WHERE exposure / t > 0.0105 UNION ALL
 SELECT 'nation', nation, round(sum(exposure) / max(t), 6) FROM x, t GROUP BY nation HAVING sum(exposure) / max(t) > 0.05""")
def limit_breaches(spark, sf_dir):
    x = exposures(spark, sf_dir)
    total = F.broadcast(x.agg(F.sum("exposure").alias("t")))
    names = x.crossJoin(total).select(F.lit("name").alias("kind"), F.col("id").cast("long").alias("key"), (F.col("exposure") / F.col("t")).alias("share")).where("share > 0.0105")
    nations = x.groupBy("nation").agg(F.sum("exposure").alias("e")).crossJoin(total).select(F.lit("nation").alias("kind"), F.col("nation").cast("long").alias("key"), (F.col("e") / F.col("t")).alias("share")).where("share > 0.05")
    return names.union(nations).select("kind", "key", r6("share", "share"))


@query("""WITH x AS (SELECT l_suppkey AS id, l_extendedprice AS e, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE (l_linenumber % 5) / 10.0::DOUBLE END AS lgd, CASE WHEN l_quantity > 40 THEN 'fuzzy' WHEN l_quantity > 20 THEN 'alias' ELSE 'exact' END AS status FROM lineitem)
 SELECT id, count(*) AS rows, round(sum(e), 2) AS exposure, round(sum(e * coalesce(lgd, 0.45)) / sum(e), 6) AS lgd, max(CASE status WHEN 'exact' THEN 0 WHEN 'alias' THEN 1 ELSE 2 END) AS worst, count(lgd) AS known FROM x GROUP BY 1""")
def weighted_rollup_lgd(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x = li.select(F.col("l_suppkey").alias("id"), F.col("l_extendedprice").alias("e"), F.when(F.col("l_orderkey") % 4 != 0, (F.col("l_linenumber") % 5) / 10.0).alias("lgd"), F.when(F.col("l_quantity") > 40, 2).when(F.col("l_quantity") > 20, 1).otherwise(0).alias("status"))
    return x.groupBy("id").agg(F.count("*").alias("rows"), F.round(F.sum("e"), 2).alias("exposure"), r6(F.sum(F.col("e") * F.coalesce("lgd", F.lit(0.45))) / F.sum("e"), "lgd"), F.max("status").alias("worst"), F.count("lgd").alias("known"))


#: Weights of findings by severity, for risks and for mitigants (fixed values).
RISK, MITIGANT = {"High": 12.0, "Medium": 6.0, "Low": 2.0}, {"High": -8.0, "Medium": -4.0, "Low": -1.5}


def findings(spark, sf_dir):
    """(brand_id, year, code, category, severity, weight): one row a finding, from an array of optional structs."""
    x = lagged(spark, sf_dir).where("prev_stores is not null")
    x = x.withColumns({"growth": F.round(F.col("n_stores") / F.col("prev_stores") - 1, 6), "sales": F.round(F.col("avg_sales") / F.col("prev_sales") - 1, 6), "ends": F.round(F.col("n_end") / F.col("prev_stores"), 6)})

    level = lambda value, high, medium: F.when(value <= high, "High").when(value <= medium, "Medium").otherwise("Low")
    entry = lambda when, code, category, severity, sign: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), severity.alias("severity"), F.lit(sign).alias("sign")))
    rules = F.array_compact(F.array(
        entry(F.col("growth") < -0.02, "STORE_DECLINE", "store", level(F.col("growth"), -0.15, -0.07), "risk"),
        entry(F.col("growth") >= 0.1, "STORE_GROWTH", "store", F.lit("Medium"), "mitigant"),
        entry(F.col("sales") < -0.03, "SALES_DECLINE", "sales", level(F.col("sales"), -0.2, -0.1), "risk"),
        entry(F.col("sales") >= 0.08, "SALES_GROWTH", "sales", F.lit("Low"), "mitigant"),
        entry(F.col("ends") >= 0.12, "CONTRACT_END_HIGH", "contract", F.when(F.col("ends") >= 0.25, "High").otherwise("Medium"), "risk"),
        entry(F.col("n_stores") < 3, "SMALL_SCALE", "structure", F.lit("Low"), "risk"),
    ))
    # a strong decline speaks for smallness already
    seen = F.filter(rules, lambda r: ~((r["code"] == "SMALL_SCALE") & F.exists(rules, lambda q: (q["code"] == "STORE_DECLINE") & (q["severity"] == "High"))))
    long = x.select("brand_id", "year", F.explode(seen).alias("f")).select("brand_id", "year", "f.*")
    weights = F.create_map(*[F.lit(v) for k, t in (("risk", RISK), ("mitigant", MITIGANT)) for s, w in t.items() for v in (k + s, w)])
    return long.withColumn("weight", F.element_at(weights, F.concat("sign", "severity")))


FINDINGS = f"""{FULL}, {LAGGED}, c AS (SELECT *, round(CAST(n_stores AS DOUBLE) / prev_stores - 1, 6) AS growth, round(avg_sales / prev_sales - 1, 6) AS sales, round(CAST(n_end AS DOUBLE) / prev_stores, 6) AS ends FROM l WHERE prev_stores IS NOT NULL),
 d AS (SELECT brand_id, year, 'STORE_DECLINE' AS code, 'store' AS category, CASE WHEN growth <= -0.15 THEN 'High' WHEN growth <= -0.07 THEN 'Medium' ELSE 'Low' END AS severity, 'risk' AS sign FROM c WHERE growth < -0.02
 UNION ALL SELECT brand_id, year, 'STORE_GROWTH', 'store', 'Medium', 'mitigant' FROM c WHERE growth >= 0.1
 UNION ALL SELECT brand_id, year, 'SALES_DECLINE', 'sales', CASE WHEN sales <= -0.2 THEN 'High' WHEN sales <= -0.1 THEN 'Medium' ELSE 'Low' END, 'risk' FROM c WHERE sales < -0.03
 UNION ALL SELECT brand_id, year, 'SALES_GROWTH', 'sales', 'Low', 'mitigant' FROM c WHERE sales >= 0.08
 UNION ALL SELECT brand_id, year, 'CONTRACT_END_HIGH', 'contract', CASE WHEN ends >= 0.25 THEN 'High' ELSE 'Medium' END, 'risk' FROM c WHERE ends >= 0.12
 UNION ALL SELECT brand_id, year, 'SMALL_SCALE', 'structure', 'Low', 'risk' FROM c WHERE n_stores < 3 AND NOT (growth <= -0.15)),
 w AS (SELECT *, CASE WHEN sign = 'risk' THEN CASE severity WHEN 'High' THEN 12.0 WHEN 'Medium' THEN 6.0 ELSE 2.0 END ELSE CASE severity WHEN 'High' THEN -8.0 WHEN 'Medium' THEN -4.0 ELSE -1.5 END END::DOUBLE AS weight FROM d)"""


@query(f"WITH {FINDINGS} SELECT brand_id, year, code, category, severity, sign, weight FROM w")
def rules_findings(spark, sf_dir):
    return findings(spark, sf_dir).select("brand_id", "year", "code", "category", "severity", "sign", "weight")


@query(f"""WITH {FINDINGS}, k AS (SELECT brand_id, year, category, sign, CASE WHEN sign = 'risk' THEN max(weight) + 0.35 * (sum(weight) - max(weight)) ELSE min(weight) + 0.35 * (sum(weight) - min(weight)) END AS part FROM w GROUP BY 1, 2, 3, 4)
 SELECT brand_id, year, round(30 * tanh(sum(part) / 30), 6) AS component FROM k GROUP BY 1, 2""")
def rule_component_score(spark, sf_dir):
    k = findings(spark, sf_dir).groupBy("brand_id", "year", "category", "sign").agg(F.sum("weight").alias("s"), F.max("weight").alias("hi"), F.min("weight").alias("lo"))
    peak = F.when(F.col("sign") == "risk", F.col("hi")).otherwise(F.col("lo"))
    k = k.withColumn("part", peak + 0.35 * (F.col("s") - peak))
    return k.groupBy("brand_id", "year").agg(r6(30 * F.tanh(F.sum("part") / 30), "component"))


@query(f"""WITH {FINDINGS} SELECT brand_id, year, count(*) FILTER (sign = 'risk') AS risks, count(*) FILTER (sign = 'mitigant') AS mitigants, (min(struct_pack(a := -weight, b := code)) FILTER (sign = 'risk')).b AS headline FROM w GROUP BY 1, 2""")
def findings_summary(spark, sf_dir):
    f = findings(spark, sf_dir)
    return f.groupBy("brand_id", "year").agg(F.count_if(F.col("sign") == "risk").alias("risks"), F.count_if(F.col("sign") == "mitigant").alias("mitigants"), F.min(F.when(F.col("sign") == "risk", F.struct((-F.col("weight")).alias("a"), F.col("code").alias("b"))))["b"].alias("headline"))


@query(f"""WITH {EXPOSURES}, g AS (SELECT *, CASE WHEN p >= 0.35 THEN 0 WHEN p >= 0.32 THEN 1 ELSE 2 END AS grade FROM x) SELECT id, grade, row_number() OVER (ORDER BY grade, p * exposure DESC, id) AS place FROM g WHERE grade < 2""")
def priority_queue(spark, sf_dir):
    g = exposures(spark, sf_dir).withColumn("grade", F.when(F.col("p") >= 0.35, 0).when(F.col("p") >= 0.32, 1).otherwise(2)).where("grade < 2")
    return ranked(g, [F.asc("grade"), F.desc(F.col("p") * F.col("exposure")), F.asc("id")], "place").select("id", "grade", "place")


@query(f"""WITH {EXPOSURES}, q AS (SELECT *, p >= 0.34 AS queued, exposure > 25000000 OR id % 7 = 0 AS event FROM x) SELECT round(avg(CAST(queued AS INT)), 6) AS share, round(sum(CAST(queued AND event AS INT)) * 1.0 / sum(CAST(event AS INT)), 6) AS capture, round(sum(CAST(queued AND event AS INT)) * 1.0 / nullif(sum(CAST(queued AS INT)), 0), 6) AS precision FROM q""")
def queue_capture(spark, sf_dir):
    q = exposures(spark, sf_dir).select((F.col("p") >= 0.34).cast("int").alias("q"), ((F.col("exposure") > 25000000) | (F.col("id") % 7 == 0)).cast("int").alias("e"))
    both = F.sum(F.col("q") * F.col("e"))
    return q.agg(r6(F.avg("q"), "share"), r6(both / F.sum("e"), "capture"), r6(both / F.nullif(F.sum("q"), F.lit(0)), "precision"))


@query(f"""WITH {EXPOSURES}, o AS (SELECT p, id, row_number() OVER (ORDER BY p, id) AS rk, lag(p) OVER (ORDER BY p, id) AS before FROM x), s AS (SELECT *, sum(CASE WHEN before IS NULL OR p - before > 0.002 THEN 1 ELSE 0 END) OVER (ORDER BY rk) AS step FROM o),
 l AS (SELECT step, avg(p) AS level, count(*) AS n FROM s GROUP BY 1), b AS (SELECT *, lag(level) OVER (ORDER BY step) AS lo, lead(level) OVER (ORDER BY step) AS hi FROM l)
 SELECT id, round(level + (CASE WHEN n > 1 THEN 2.0 * (row_number() OVER (PARTITION BY step ORDER BY p, id) - 1) / (n - 1) - 1 ELSE 0 END) * 0.5 * least(coalesce(level - lo, level), coalesce(hi - level, 1 - level)), 6) AS smooth FROM s JOIN b USING (step)""")
def plateau_smooth(spark, sf_dir):
    """Rows of near-equal scores spread inside half the gap to the neighbouring levels; each level's mean stays."""
    from tidemark.operators.ordered import running

    x = ranked(exposures(spark, sf_dir).select("id", "p"), [F.asc("p"), F.asc("id")])
    before = x.select((F.col("rank") + 1).alias("rank"), F.col("p").alias("before"))
    x = x.join(before, "rank", "left").withColumn("new", F.when(F.col("before").isNull() | (F.col("p") - F.col("before") > 0.002), 1).otherwise(0))
    x = running(x, [F.asc("rank")], {"step": F.col("new")})
    levels = x.groupBy("step").agg(F.avg("p").alias("level"), F.count("*").alias("n"))
    near = lambda shift, name: levels.select((F.col("step") + shift).alias("step"), F.col("level").alias(name))
    levels = levels.join(near(1, "lo"), "step", "left").join(near(-1, "hi"), "step", "left")
    place = F.row_number().over(Window.partitionBy("step").orderBy("p", "id")) - 1
    spread = F.when(F.col("n") > 1, 2.0 * place / (F.col("n") - 1) - 1).otherwise(0.0)
    half = 0.5 * F.least(F.coalesce(F.col("level") - F.col("lo"), F.col("level")), F.coalesce(F.col("hi") - F.col("level"), 1 - F.col("level")))
    return x.join(levels, "step").select("id", r6(F.col("level") + spread * half, "smooth"))


def _names(spark, sf_dir):
    """All exposures, as the portfolio that is simulated."""
    return exposures(spark, sf_dir).withColumns({"lgd": F.lit(0.45), "borrowers": F.lit(50)})


@query()
def nested_mc_tail(spark, sf_dir):
    return simulate.tail(_names(spark, sf_dir), 0.05, 0.4, 20_000)


@query()
def euler_contrib(spark, sf_dir):
    return simulate.contributions(_names(spark, sf_dir), 0.05, 0.4, 20_000)
