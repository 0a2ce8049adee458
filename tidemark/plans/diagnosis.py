"""The rules engine: one finding for each rule that holds for an entity and year.

A supplier stands for a brand, its line items of a year for its stores, its nation for the headquarters whose yearly accounts are looked up
as of the year before.  A rule is a row of ``RULES``: trigger and severity are SQL expressions over the brand's year.  All rules become one array of optional
structs in one projection; suppressed codes are filtered inside the array, then the array is exploded.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.operators.joins import asof_join
from tidemark.plans.base import query, r6, table

#: Rate rules need so many stores the year before, percentiles so many peers; accounts older than so many years weigh one level less.
RATE_BASE, PEERS, STALE_YEARS = 10, 10, 3
#: Weights of findings (fixed values).
WEIGHTS = {"risk": {"High": 12.0, "Medium": 6.0, "Low": 2.0}, "mitigant": {"High": -8.0, "Medium": -4.0, "Low": -1.5}, "info": {"High": 0.0, "Medium": 0.0, "Low": 0.0}}
#: Code, category, direction, severity, trigger (fixed values of the rule book).
RULES = [
    ("STORE_DECLINE", "growth", "risk", "CASE WHEN store_growth <= -0.15 THEN 'High' WHEN store_growth <= -0.07 THEN 'Medium' ELSE 'Low' END", "store_growth < -0.02"),
    ("STORE_DECLINE_STREAK", "growth", "risk", "CASE WHEN store_streak >= 3 THEN 'High' ELSE 'Medium' END", "store_streak >= 2"),
    ("STORE_GROWTH", "growth", "mitigant", "'Medium'", "store_growth >= 0.10"),
    ("NEW_OPEN_STALL", "growth", "risk", "'Medium'", "prev_new >= 5 AND n_new / prev_stores < 0.05 AND n_new / prev_new - 1 <= -0.5"),
    ("CONTRACT_END_HIGH", "contract", "risk", "CASE WHEN coalesce(end_pct, 0) >= 0.92 OR end_rate >= 0.25 THEN 'High' ELSE 'Medium' END", f"prev_stores >= {RATE_BASE} AND n_contract_end > 0 AND (coalesce(end_pct, 0) >= 0.75 OR end_rate >= 0.12)"),
    ("CANCEL_HIGH", "contract", "risk", "CASE WHEN n_contract_cancel / prev_stores >= 0.12 THEN 'High' ELSE 'Medium' END", f"prev_stores >= {RATE_BASE} AND n_contract_cancel / prev_stores >= 0.05"),
    ("CHURN_EXCEEDS_OPEN", "contract", "risk", "'Medium'", "n_contract_end + n_contract_cancel - n_new >= 3"),
    ("NAME_CHANGE_HIGH", "contract", "risk", "'Low'", f"prev_stores >= {RATE_BASE} AND n_name_change / prev_stores >= 0.08"),
    ("SALES_DECLINE", "sales", "risk", "CASE WHEN sales_growth <= -0.20 THEN 'High' WHEN sales_growth <= -0.10 THEN 'Medium' ELSE 'Low' END", "sales_growth < -0.03"),
    ("SALES_DECLINE_STREAK", "sales", "risk", "'High'", "sales_streak >= 2"),
    ("SALES_LOW_RANK", "sales", "risk", "'Medium'", "sales_pct <= 0.20"),
    ("SALES_PER_AREA_DECLINE", "sales", "risk", "'Low'", "area_growth < -0.08 AND coalesce(sales_growth, 0) <= 0 AND NOT (area_growth <= -0.60 AND coalesce(sales_growth, 0) > -0.30)"),
    ("SALES_GROWTH", "sales", "mitigant", "'Medium'", "sales_growth >= 0.08"),
    ("REGION_CONCENTRATION", "structure", "risk", "'Medium'", "n_stores >= 30 AND top_region_share >= 0.55 AND n_regions <= 6"),
    ("REGION_SHRINK", "structure", "risk", "'Medium'", "prev_regions - n_regions >= 2"),
    ("DIRECT_RATIO_DROP", "structure", "risk", "'Low'", "prev_direct >= 3 AND prev_direct / prev_stores - n_direct / n_stores >= 0.05"),
    ("SMALL_SCALE", "structure", "risk", "'Low'", "n_stores < 50"),
    ("YOUNG_BRAND", "structure", "risk", "'Low'", "year - biz_start_year <= 4"),
    ("STARTUP_COST_HIGH", "structure", "risk", "'Low'", "startup_pct >= 0.85"),
    ("REGISTRATION_CANCELLED", "structure", "risk", "'High'", "cancel_flag"),
    ("HQ_EQUITY_NEGATIVE", "accounts", "risk", "'High'", "equity <= 0"),
    ("HQ_CAPITAL_IMPAIRED", "accounts", "risk", "'High'", "capital_stock > 0 AND equity > 0 AND equity < capital_stock"),
    ("HQ_OPERATING_LOSS", "accounts", "risk", "CASE WHEN loss_years >= 2 THEN 'High' ELSE 'Medium' END", "operating_income < 0"),
    ("HQ_HIGH_LEVERAGE", "accounts", "risk", "CASE WHEN liabilities / equity >= 8 THEN 'High' ELSE 'Medium' END", "equity > 0 AND liabilities >= 4 * equity"),
    ("HQ_GOING_CONCERN", "accounts", "risk", "'High'", "going_concern"),
    ("HQ_AUDIT_OPINION", "accounts", "info", "'Medium'", "audit_opinion <> '적정'"),
    ("HQ_REVENUE_DECLINE", "accounts", "risk", "CASE WHEN revenue / prev_revenue - 1 <= -0.25 THEN 'High' ELSE 'Medium' END", "prev_revenue > 0 AND revenue / prev_revenue - 1 < -0.10"),
    ("HQ_SOLID", "accounts", "mitigant", "'Medium'", "equity > 0 AND operating_income > 0 AND NOT (coalesce(capital_stock, 0) > 0 AND equity < capital_stock) AND coalesce(net_income, 0) >= 0"),
    ("HQ_NO_DATA", "accounts", "info", "'Low'", "fiscal_year IS NULL"),
    ("DEMAND_DECLINE", "demand", "risk", "CASE WHEN brand_yoy <= -0.40 THEN 'High' ELSE 'Medium' END", "brand_yoy < -0.15"),
    ("DEMAND_UNDERPERFORM", "demand", "risk", "'Medium'", "brand_yoy - category_yoy < -0.15"),
    ("CATEGORY_DECLINE", "demand", "risk", "'Low'", "category_yoy < -0.15"),
    ("DEMAND_GROWTH", "demand", "mitigant", "'Medium'", "brand_yoy >= 0.20"),
    ("NEWS_본부분쟁", "reputation", "risk", "'High'", "news_dispute > 0"),
    ("NEWS_재무이슈", "reputation", "risk", "'High'", "news_finance > 0"),
    ("NEWS_집단폐점", "reputation", "risk", "'High'", "news_closures > 0"),
    ("NEWS_기타", "reputation", "risk", "'Low'", "news_other > 0"),
]
#: Codes that speak for others already (fixed values).
SUPPRESSES = {
    "HQ_EQUITY_NEGATIVE": ["HQ_CAPITAL_IMPAIRED", "HQ_HIGH_LEVERAGE", "HQ_SOLID"],
    "HQ_CAPITAL_IMPAIRED": ["HQ_SOLID"],
    "HQ_GOING_CONCERN": ["HQ_SOLID"],
    "HQ_AUDIT_OPINION": ["HQ_SOLID"],
    "HQ_OPERATING_LOSS": ["HQ_SOLID"],
    "HQ_HIGH_LEVERAGE": ["HQ_SOLID"],
    "HQ_REVENUE_DECLINE": ["HQ_SOLID"],
    "SALES_DECLINE_STREAK": ["SALES_DECLINE"],
    "DEMAND_UNDERPERFORM": ["CATEGORY_DECLINE"],
}
#: Findings that put a brand at the head of the queue.
CRITICAL = ["HQ_EQUITY_NEGATIVE", "HQ_GOING_CONCERN", "REGISTRATION_CANCELLED"]


def brands(spark, sf_dir):
    """(brand_id, year, ...): the dense panel of suppliers' line items."""
    li = table(spark, sf_dir, "lineitem")
    region = F.when(F.col("l_suppkey") % 5 == 0, F.least("l_linenumber", F.lit(2))).when((F.col("l_suppkey") % 5 == 1) & (F.year("l_shipdate") % 3 == 0), F.least("l_linenumber", F.lit(4))).otherwise(F.col("l_linenumber"))
    x = li.select(F.col("l_suppkey").alias("brand_id"), F.year("l_shipdate").alias("year"), region.alias("region"), "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    tax, kind = F.col("l_tax"), F.col("l_linenumber")
    news = lambda k: F.count_if((F.col("l_quantity") == 50) & (kind == k))
    # regions first, so that their dispersion needs no second pass over the rows
    parts = x.groupBy("brand_id", "year", "region").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") < 0.015).alias("n_new"), F.count_if((F.col("l_returnflag") == "R") & (tax > 0.04)).alias("n_contract_end"),
        F.count_if((F.col("l_returnflag") == "A") & (tax > 0.06)).alias("n_contract_cancel"), F.count_if(tax < 0.01).alias("n_name_change"), F.count_if(kind == 7).alias("n_direct"),
        F.sum("l_extendedprice").alias("sales"), F.sum(F.col("l_extendedprice") / F.col("l_quantity")).alias("area"), F.sum(tax * F.col("l_extendedprice")).alias("startup"),
        F.sum(F.when(kind <= 3, F.col("l_quantity"))).alias("demand"), *[news(k).alias(f"news_{n}") for k, n in enumerate(("dispute", "finance", "closures", "other"), 1)],
    )
    counts = ["n_new", "n_contract_end", "n_contract_cancel", "n_name_change", "n_direct", "news_dispute", "news_finance", "news_closures", "news_other"]
    t = parts.groupBy("brand_id", "year").agg(
        F.sum("n").alias("n_stores"), *[F.sum(c).alias(c) for c in counts], F.round(F.sum("sales") / F.sum("n"), 2).alias("avg_sales"), F.round(F.sum("area") / F.sum("n"), 2).alias("avg_sales_per_area"),
        F.count("*").alias("n_regions"), (F.max("n") / F.sum("n")).alias("top_region_share"), F.round(F.sum("demand"), 2).alias("demand"), F.round(F.sum("startup") / F.sum("n"), 2).alias("startup"),
    )
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    named = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables of 25 and 5 rows
    return t.join(named.select(F.col("s_suppkey").alias("brand_id"), F.col("s_nationkey").alias("nation"), F.col("r_name").alias("grp")), "brand_id").withColumns({
        "startup": F.when(F.col("year") % 2 == 1, F.col("startup")), "biz_start_year": 1991 + F.col("brand_id") % 10, "cancel_flag": (F.col("brand_id") % 37 == 5) & (F.col("year") >= 1999),
    })


def accounts(spark, sf_dir):
    """(nation, fiscal_year, ...): yearly accounts of headquarters, with gaps; some headquarters have none."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    price = F.col("o_totalprice")
    h = o.join(c, "o_custkey").groupBy("nation", F.year("o_orderdate").alias("fiscal_year")).agg(
        F.round(F.sum(price), 2).alias("revenue"), F.round(F.sum(price * F.when(F.col("o_orderstatus") == "F", -1.1).when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.1)), 2).alias("operating_income"),
        F.round(F.sum(price * F.when(F.col("o_orderkey") % 5 == 0, -3.8).otherwise(1.0)), 2).alias("equity"),
    )
    h = h.where("nation % 6 <> 0 and (nation * 3 + fiscal_year) % 4 <> 0 and not (nation % 6 = 1 and fiscal_year > 1997)")
    h = h.withColumns({
        "liabilities": F.round(F.col("revenue") * (F.col("nation") % 4), 2), "capital_stock": F.round(F.col("revenue") * 0.05, 2), "net_income": F.round(F.col("operating_income") * 0.8, 2),
        "audit_opinion": F.when((F.col("nation") + F.col("fiscal_year")) % 11 == 0, "한정").otherwise("적정"), "going_concern": (F.col("nation") + F.col("fiscal_year")) % 13 == 0,
        "prev_revenue": F.lag("revenue").over(W.by("nation", "fiscal_year")),
    })
    return W.streak(h, F.col("operating_income") < 0, "nation", "fiscal_year", "loss_years")


def brand_years(spark, sf_dir):
    """A brand's year with the year before, its streaks, its places among peers and its headquarters' last accounts."""
    p = brands(spark, sf_dir)
    lag = lambda c: W.guarded_lag(c, "brand_id", "year")
    p = p.withColumns({f"prev_{n}": lag(c) for n, c in (("stores", "n_stores"), ("new", "n_new"), ("sales", "avg_sales"), ("area", "avg_sales_per_area"), ("regions", "n_regions"), ("direct", "n_direct"), ("demand", "demand"))})
    growth = lambda now, before: F.round(F.col(now) / F.col(before) - 1, 6)
    p = p.withColumns({
        "store_growth": growth("n_stores", "prev_stores"), "sales_growth": growth("avg_sales", "prev_sales"), "area_growth": growth("avg_sales_per_area", "prev_area"), "brand_yoy": growth("demand", "prev_demand"),
        "end_rate": F.round(F.col("n_contract_end") / F.col("prev_stores"), 6),
        # the latest cost that was disclosed, with its year
        "known": F.last(F.when(F.col("startup") > 0, F.struct(F.col("year").alias("y"), F.col("startup").alias("v"))), ignorenulls=True).over(W.by("brand_id", "year").rowsBetween(Window.unboundedPreceding, 0)),
    })
    for flag, name in (("n_stores", "store_streak"), ("avg_sales", "sales_streak")):
        p = W.streak(p, F.col(flag) < F.lag(flag).over(W.by("brand_id", "year")), "brand_id", "year", name)

    def share(c: str):
        """The share of peers of the year at or below a value, where enough are known."""
        w = Window.partitionBy("grp", "year", F.col(c).isNotNull())
        return F.when(F.col(c).isNotNull() & (F.count("*").over(w) >= PEERS), F.round(F.cume_dist().over(w.orderBy(c)), 6))

    p = p.withColumns({"end_pct": share("end_rate"), "sales_pct": share("avg_sales"), "own_startup_pct": share("startup")})
    costs = p.select("brand_id", F.col("year").alias("known_year"), F.col("own_startup_pct").alias("startup_pct"))
    p = p.withColumn("known_year", F.col("known.y")).join(costs, ["brand_id", "known_year"], "left")
    category = p.where("prev_demand is not null").groupBy("grp", "year").agg(F.round(F.sum("demand") / F.sum("prev_demand") - 1, 6).alias("category_yoy"))
    p = p.join(category, ["grp", "year"], "left").withColumn("asof", F.col("year") - 1)
    return asof_join(p.drop("known"), accounts(spark, sf_dir), "nation", "asof", "fiscal_year", ["revenue", "prev_revenue", "operating_income", "net_income", "equity", "liabilities", "capital_stock", "audit_opinion", "going_concern", "loss_years"]).withColumnRenamed("matched_fiscal_year", "fiscal_year")


def found(spark, sf_dir):
    """(brand_id, year, n_stores, code, category, direction, severity, weight): all findings that no other suppresses."""
    b = brand_years(spark, sf_dir)
    stale = (F.col("year") - F.col("fiscal_year")) > STALE_YEARS

    def entry(place: int, rule: tuple):
        code, category, direction, severity, trigger = rule
        level = F.expr(severity)
        if code.startswith("HQ_") and direction != "info":
            level = F.when(stale, F.when(level == "High", "Medium").otherwise("Low")).otherwise(level)
        weight = F.coalesce(*[F.when(level == s, F.lit(w)) for s, w in WEIGHTS[direction].items()])
        return F.when(F.expr(trigger), F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), F.lit(direction).alias("direction"), level.alias("severity"), weight.alias("weight"), F.lit(place).alias("place")))

    fired = b.withColumn("f", F.array_compact(F.array(*[entry(k, r) for k, r in enumerate(RULES)])))
    gone = F.flatten(F.transform("f", lambda x: F.coalesce(*[F.when(x["code"] == k, F.array(*map(F.lit, v))) for k, v in SUPPRESSES.items()], F.array().cast("array<string>"))))
    kept = F.filter("f", lambda x: ~F.array_contains(F.col("gone"), x["code"]))
    return fired.withColumn("gone", gone).select("brand_id", "year", "n_stores", "grp", F.explode(kept).alias("x")).select("brand_id", "year", "n_stores", "grp", "x.*")


_LAGS = ", ".join(f"CASE WHEN lag(year) OVER w = year - 1 THEN lag({c}) OVER w END AS prev_{n}" for n, c in (("stores", "n_stores"), ("new", "n_new"), ("sales", "avg_sales"), ("area", "avg_sales_per_area"), ("regions", "n_regions"), ("direct", "n_direct"), ("demand", "demand")))
_PCT = lambda c, name: f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER (PARTITION BY grp, year) >= {PEERS} THEN round(cume_dist() OVER (PARTITION BY grp, year, {c} IS NOT NULL ORDER BY {c}), 6) END AS {name}"
_LEVEL = lambda code, d, s: f"CASE WHEN year - fiscal_year > {STALE_YEARS} THEN CASE WHEN {s} = 'High' THEN 'Medium' ELSE 'Low' END ELSE {s} END" if code.startswith("HQ_") and d != "info" else s
FOUND = f"""li AS (SELECT l_suppkey AS brand_id, CAST(year(l_shipdate) AS INTEGER) AS year, CASE WHEN l_suppkey % 5 = 0 THEN least(l_linenumber, 2) WHEN l_suppkey % 5 = 1 AND year(l_shipdate) % 3 = 0 THEN least(l_linenumber, 4) ELSE l_linenumber END AS region, * FROM lineitem),
 top AS (SELECT brand_id, year, max(n) AS top, count(*) AS n_regions FROM (SELECT brand_id, year, region, count(*) AS n FROM li GROUP BY 1, 2, 3) GROUP BY 1, 2),
 p0 AS (SELECT brand_id, year, CAST(count(*) AS DOUBLE) AS n_stores, count(*) FILTER (l_discount < 0.015) AS n_new, count(*) FILTER (l_returnflag = 'R' AND l_tax > 0.04) AS n_contract_end, count(*) FILTER (l_returnflag = 'A' AND l_tax > 0.06) AS n_contract_cancel,
 count(*) FILTER (l_tax < 0.01) AS n_name_change, CAST(count(*) FILTER (l_linenumber = 7) AS DOUBLE) AS n_direct, round(avg(l_extendedprice), 2) AS avg_sales, round(avg(l_extendedprice / l_quantity), 2) AS avg_sales_per_area, round(sum(l_quantity) FILTER (l_linenumber <= 3), 2) AS demand,
 CASE WHEN year % 2 = 1 THEN round(avg(l_tax * l_extendedprice), 2) END AS startup, {", ".join(f"count(*) FILTER (l_quantity = 50 AND l_linenumber = {k}) AS news_{n}" for k, n in enumerate(("dispute", "finance", "closures", "other"), 1))},
 1991 + brand_id % 10 AS biz_start_year, brand_id % 37 = 5 AND year >= 1999 AS cancel_flag FROM li GROUP BY 1, 2),
 p1 AS (SELECT p0.*, top.n_regions, top.top / p0.n_stores AS top_region_share, s_nationkey AS nation, r_name AS grp FROM p0 JOIN top USING (brand_id, year) JOIN supplier ON s_suppkey = brand_id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
 p2 AS (SELECT *, {_LAGS}, CASE WHEN n_stores < lag(n_stores) OVER w THEN 0 ELSE 1 END AS s0, CASE WHEN avg_sales < lag(avg_sales) OVER w THEN 0 ELSE 1 END AS s1 FROM p1 WINDOW w AS (PARTITION BY brand_id ORDER BY year)),
 p3 AS (SELECT *, round(n_stores / prev_stores - 1, 6) AS store_growth, round(avg_sales / prev_sales - 1, 6) AS sales_growth, round(avg_sales_per_area / prev_area - 1, 6) AS area_growth, round(demand / prev_demand - 1, 6) AS brand_yoy, round(n_contract_end / prev_stores, 6) AS end_rate,
 sum(s0) OVER (PARTITION BY brand_id ORDER BY year) AS b0, sum(s1) OVER (PARTITION BY brand_id ORDER BY year) AS b1, max(CASE WHEN startup > 0 THEN year END) OVER (PARTITION BY brand_id ORDER BY year) AS known_year FROM p2),
 p4 AS (SELECT *, sum(1 - s0) OVER (PARTITION BY brand_id, b0 ORDER BY year) AS store_streak, sum(1 - s1) OVER (PARTITION BY brand_id, b1 ORDER BY year) AS sales_streak, {_PCT("end_rate", "end_pct")}, {_PCT("avg_sales", "sales_pct")}, {_PCT("startup", "own_startup_pct")} FROM p3),
 cat AS (SELECT grp, year, round(sum(demand) / sum(prev_demand) - 1, 6) AS category_yoy FROM p4 WHERE prev_demand IS NOT NULL GROUP BY 1, 2),
 h0 AS (SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, round(sum(o_totalprice), 2) AS revenue, round(sum(o_totalprice * CASE o_orderstatus WHEN 'F' THEN -1.1 WHEN 'O' THEN 1.0 ELSE 0.1 END::DOUBLE), 2) AS operating_income,
 round(sum(o_totalprice * CASE WHEN o_orderkey % 5 = 0 THEN -3.8 ELSE 1.0 END::DOUBLE), 2) AS equity FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
 h1 AS (SELECT *, round(revenue * (nation % 4), 2) AS liabilities, round(revenue * 0.05::DOUBLE, 2) AS capital_stock, round(operating_income * 0.8::DOUBLE, 2) AS net_income, CASE WHEN (nation + fiscal_year) % 11 = 0 THEN '한정' ELSE '적정' END AS audit_opinion, (nation + fiscal_year) % 13 = 0 AS going_concern,
 lag(revenue) OVER w AS prev_revenue, sum(CASE WHEN operating_income < 0 THEN 0 ELSE 1 END) OVER w AS hb FROM h0 WHERE nation % 6 <> 0 AND (nation * 3 + fiscal_year) % 4 <> 0 AND NOT (nation % 6 = 1 AND fiscal_year > 1997) WINDOW w AS (PARTITION BY nation ORDER BY fiscal_year)),
 h2 AS (SELECT *, sum(CASE WHEN operating_income < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY nation, hb ORDER BY fiscal_year) AS loss_years FROM h1),
 b AS (SELECT p4.*, k.own_startup_pct AS startup_pct, category_yoy, h2.* EXCLUDE (nation) FROM p4 LEFT JOIN p4 k ON k.brand_id = p4.brand_id AND k.year = p4.known_year LEFT JOIN cat ON cat.grp = p4.grp AND cat.year = p4.year ASOF LEFT JOIN h2 ON h2.nation = p4.nation AND p4.year - 1 >= h2.fiscal_year),
 fired AS (SELECT brand_id, year, n_stores, grp, r.code AS code, r.category AS category, r.direction AS direction, r.severity AS severity, r.place AS place FROM (SELECT brand_id, year, n_stores, grp, unnest(list_filter([
 {", ".join(f"CASE WHEN {t} THEN struct_pack(code := '{c}', category := '{g}', direction := '{d}', severity := {_LEVEL(c, d, s)}, place := {k}) END" for k, (c, g, d, s, t) in enumerate(RULES))}], lambda q: q IS NOT NULL)) AS r FROM b)),
 sup(by_code, gone) AS (VALUES {", ".join(f"('{k}', '{x}')" for k, v in SUPPRESSES.items() for x in v)}),
 gone AS (SELECT DISTINCT brand_id, year, sup.gone AS code FROM fired JOIN sup ON sup.by_code = fired.code),
 x AS (SELECT f.*, CAST(CASE {" ".join(f"WHEN direction = '{d}' AND severity = '{s}' THEN {w}" for d, t in WEIGHTS.items() for s, w in t.items())} END AS DOUBLE) AS weight FROM fired f ANTI JOIN gone USING (brand_id, year, code))"""


@query(f"WITH {FOUND} SELECT brand_id, year, code, category, direction, severity, weight FROM x")
def diagnosis_findings(spark, sf_dir):
    return found(spark, sf_dir).select("brand_id", "year", "code", "category", "direction", "severity", "weight")


@query(f"""WITH {FOUND} SELECT code, direction, severity, count(*) AS n, count(DISTINCT brand_id) AS brands FROM x GROUP BY 1, 2, 3""")
def findings_by_rule(spark, sf_dir):
    return found(spark, sf_dir).groupBy("code", "direction", "severity").agg(F.count("*").alias("n"), F.count_distinct("brand_id").alias("brands"))


@query(f"""WITH {FOUND} SELECT brand_id, year, count(*) FILTER (direction = 'risk') AS n_risk, count(*) FILTER (direction = 'mitigant') AS n_mitigant, count(*) FILTER (direction = 'risk' AND severity = 'High') AS n_high,
 (SELECT string_agg(c, ', ' ORDER BY c) FROM (SELECT DISTINCT y.category AS c FROM x y WHERE y.direction = 'risk' AND y.brand_id = x.brand_id AND y.year = x.year)) AS categories,
 (min(struct_pack(s := CASE severity WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, c := code)) FILTER (direction = 'risk')).c AS headline FROM x GROUP BY 1, 2""")
def brand_summary(spark, sf_dir):
    """Counts, categories of risk joined in order, and the first risk by severity and code."""
    x = found(spark, sf_dir)
    risk = F.col("direction") == "risk"
    level = F.when(F.col("severity") == "High", 0).when(F.col("severity") == "Medium", 1).otherwise(2)
    return x.groupBy("brand_id", "year").agg(
        F.count_if(risk).alias("n_risk"), F.count_if(F.col("direction") == "mitigant").alias("n_mitigant"), F.count_if(risk & (F.col("severity") == "High")).alias("n_high"),
        F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(risk, F.col("category")))), ", "), F.lit("")).alias("categories"), F.min(F.when(risk, F.struct(level.alias("s"), F.col("code").alias("c"))))["c"].alias("headline"),
    )


@query(f"""WITH {FOUND} SELECT brand_id, year, string_agg(code, ',' ORDER BY place) AS critical FROM x WHERE code IN ({", ".join(f"'{c}'" for c in CRITICAL)}) AND severity = 'High' GROUP BY 1, 2""")
def critical_map(spark, sf_dir):
    """A brand's critical findings in the order of the rule book."""
    x = found(spark, sf_dir).where(F.col("code").isin(CRITICAL) & (F.col("severity") == "High"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "code")))
    return x.groupBy("brand_id", "year").agg(F.array_join(F.transform(ordered, lambda s: s["code"]), ",").alias("critical"))


#: What to ask for at a finding: rules of one kind share a question (fixed values).
CHECKS = [("STORE", "store list of three years"), ("SALES", "sales by store"), ("HQ", "accounts of three years"), ("DEMAND", "search volume"), ("NEWS", "the articles themselves"), ("REGION", "store list of three years")]


@query(f"""WITH {FOUND}, c AS (SELECT *, CASE {" ".join(f"WHEN code LIKE '{p}%' THEN '{t}'" for p, t in CHECKS)} END AS item FROM x WHERE direction <> 'mitigant')
 SELECT brand_id, year, item, CAST(min(place) AS INTEGER) AS place, string_agg(code, ',' ORDER BY place) AS codes FROM c WHERE item IS NOT NULL GROUP BY 1, 2, 3""")
def checklist(spark, sf_dir):
    """One line for each question, at the place of the first finding that asks it, with the codes of all that do."""
    item = F.coalesce(*[F.when(F.col("code").startswith(p), F.lit(t)) for p, t in CHECKS])
    x = found(spark, sf_dir).where("direction <> 'mitigant'").withColumn("item", item).where("item is not null")
    ordered = F.array_sort(F.collect_list(F.struct("place", "code")))
    return x.groupBy("brand_id", "year", "item").agg(F.min("place").alias("place"), F.array_join(F.transform(ordered, lambda s: s["code"]), ",").alias("codes"))


@query(f"""WITH {FOUND}, k AS (SELECT brand_id, year, category, direction, CASE WHEN direction = 'risk' THEN max(weight) + 0.35 * (sum(weight) - max(weight)) ELSE min(weight) + 0.35 * (sum(weight) - min(weight)) END AS part FROM x WHERE weight <> 0 GROUP BY 1, 2, 3, 4),
 c AS (SELECT brand_id, year, 30 * tanh(sum(part) / 30) AS component FROM k GROUP BY 1, 2), q AS (SELECT c.*, n_stores, EXISTS (SELECT 1 FROM x WHERE x.brand_id = c.brand_id AND x.year = c.year AND severity = 'High' AND code IN ({", ".join(f"'{c}'" for c in CRITICAL)})) AS critical FROM c JOIN p0 USING (brand_id, year) WHERE year = 2001)
 SELECT brand_id, critical, round(component, 6) AS component, row_number() OVER (ORDER BY critical DESC, round(component, 6) * n_stores DESC, brand_id) AS place FROM q WHERE critical OR component >= 8""")
def work_queue(spark, sf_dir):
    """The last year's brands with a critical finding or a high rule component: critical ones first, then by component times stores."""
    from tidemark.operators.ordered import ranked

    x = found(spark, sf_dir).where("year = 2001")
    k = x.where("weight <> 0").groupBy("brand_id", "category", "direction").agg(F.sum("weight").alias("s"), F.max("weight").alias("hi"), F.min("weight").alias("lo"))
    peak = F.when(F.col("direction") == "risk", F.col("hi")).otherwise(F.col("lo"))
    c = k.groupBy("brand_id").agg(F.round(30 * F.tanh(F.sum(peak + 0.35 * (F.col("s") - peak)) / 30), 6).alias("component"))
    flags = x.groupBy("brand_id").agg(F.max("n_stores").alias("n_stores"), F.bool_or(F.col("code").isin(CRITICAL) & (F.col("severity") == "High")).alias("critical"))
    q = c.join(flags, "brand_id").where("critical or component >= 8").withColumn("weighed", F.col("component") * F.col("n_stores"))
    return ranked(q, [F.desc("critical"), F.desc("weighed"), F.asc("brand_id")], "place").select("brand_id", "critical", "component", "place")
