"""Scans, casts and scalar cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.operators.joins import best_row
from tidemark.plans.base import query, r6, table


@query("""SELECT CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS INTEGER) AS k_mod, event_type, count(*) AS n,
 round(sum(value), 6) AS total FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2""")
def scan_flatten_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("item", F.from_json("props", "k int"))
    return e.where("item.k is not null").groupBy((F.col("item.k") % 10).alias("k_mod"), "event_type").agg(F.count("*").alias("n"), r6(F.sum("value"), "total"))


@query("""SELECT o_orderpriority AS priority, count(*) AS n, count(*) FILTER (TRY_CAST(replace(v, ',', '') AS DOUBLE) IS NULL) AS unknown,
 round(sum(CASE WHEN TRY_CAST(replace(v, ',', '') AS DOUBLE) > 0 THEN TRY_CAST(replace(v, ',', '') AS DOUBLE) END), 4) AS total
 FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN '-5' ELSE concat(CAST(o_orderkey AS VARCHAR), ',', '000') END AS v FROM orders) GROUP BY 1""")
def cast_clean(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 11 == 0, "-5").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(",000")))
    return o.withColumn("x", expr.number(v)).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("unknown"), F.round(F.sum(expr.positive(F.col("x"))), 4).alias("total"))


@query("""SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS rn FROM lineitem) WHERE rn = 1 GROUP BY 1""")
def dedupe_keep_best(spark, sf_dir):
    best = best_row(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_quantity"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice"), F.asc("l_returnflag")])
    return best.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""WITH b AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 + 1000000000 AS VARCHAR), 10, '0') AS bno FROM customer),
 d AS (SELECT *, CAST(bno[1] AS INT)*1 + CAST(bno[2] AS INT)*3 + CAST(bno[3] AS INT)*7 + CAST(bno[4] AS INT)*1 + CAST(bno[5] AS INT)*3 + CAST(bno[6] AS INT)*7
 + CAST(bno[7] AS INT)*1 + CAST(bno[8] AS INT)*3 + CAST(bno[9] AS INT)*5 + CAST(bno[9] AS INT)*5 // 10 AS t FROM b)
 SELECT c_custkey AS brand_id, bno, concat(substr(bno, 1, 3), '-**-***', substr(bno, 9, 2)) AS masked, (10 - t % 10) % 10 = CAST(bno[10] AS INT) AS valid FROM d""")
def bno_checksum(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    b = c.withColumn("bno", expr.business_number(F.col("c_custkey") * 7919 + 1000000000))
    return b.select(F.col("c_custkey").alias("brand_id"), "bno", expr.masked_number(F.col("bno")).alias("masked"), expr.check_digit_ok(F.col("bno")).alias("valid"))


#: Headers and the millions that their unit is.
HEADERS = [("금액(억원)", 100.0), ("금액(백만원)", 1.0), ("금액(천원)", 0.001), ("금액(원)", 0.000001), ("여신잔액(만원)", 0.01), ("Balance (MKRW)", 1.0), ("amount, million won", 1.0), ("exposure KRW", 0.000001), ("천안 지점", None), ("잔액 원", 0.000001)]


@query(f"""SELECT s_suppkey AS id, round(CASE s_suppkey % {len(HEADERS)} {" ".join(f"WHEN {i} THEN {'NULL' if f is None else f'{f}::DOUBLE'}" for i, (_, f) in enumerate(HEADERS))} END * round(s_acctbal, 2), 6) AS mkrw FROM supplier""")
def unit_parse(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    header = F.element_at(F.array(*[F.lit(h) for h, _ in HEADERS]), (F.col("s_suppkey") % len(HEADERS) + 1).cast("int"))
    shown = F.when(F.col("s_acctbal") < 0, F.concat(F.lit("("), F.format_number(-F.col("s_acctbal"), 2), F.lit(")"))).otherwise(F.format_number("s_acctbal", 2))
    return s.select(F.col("s_suppkey").alias("id"), r6(expr.unit_factor(header) * expr.money(shown), "mkrw"))


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 4 GROUP BY 1
 UNION ALL SELECT NULL, count(*) FROM orders WHERE o_orderkey % 5 = 4""")
def origination_years(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate").cast("date")
    shown = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyyMMdd")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).when(k == 3, F.date_diff(d, F.to_date(F.lit("1899-12-30"))).cast("string")).otherwise("abc")
    return o.groupBy(expr.origination_year(shown, 1990).alias("year")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN k IN (0, 6) THEN 1 WHEN k IN (1, 7) THEN 0 WHEN k = 2 THEN NULL WHEN q >= 30 THEN 1 ELSE 0 END AS outcome, count(*) AS n
 FROM (SELECT l_orderkey % 8 AS k, l_quantity AS q FROM lineitem) GROUP BY 1""")
def outcome_parse(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") % 8
    shown = F.when(k == 0, "Y").when(k == 6, "예").when(k == 1, "No").when(k == 7, "아니오").when(k == 2, "").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".0")))
    # days of one, as a number, are a flag word's spelling: keep them apart by the decimal
    return li.groupBy(expr.outcome(shown, 30).alias("outcome")).agg(F.count("*").alias("n"))


#: Phrases of loan books (fixed values of the test).
PHRASES = ["보증서", "신용보증재단 보증서", "보증서담보대출", "임차보증금", "전세 보증금", "부동산 담보", "근저당", "예적금 담보", "신용", "순수 신용", "무담보", "무보증", "Unsecured", "secured loan", "mortgage", "guarantee", "", "-", "기계", "credit line"]
_PHRASE = f"[{', '.join(repr(p) for p in PHRASES)}][CAST(p_partkey % {len(PHRASES)} + 1 AS INTEGER)]"


@query(f"""WITH t AS (SELECT regexp_replace(lower({_PHRASE}), '\\s+', '', 'g') AS t, p_retailprice FROM part)
 SELECT CASE WHEN t IN ('', 'nan', 'none', '-') THEN '미기재' WHEN t LIKE '%무담보%' OR t LIKE '%무보증%' OR t LIKE '%순수신용%' OR t LIKE '%unsecured%' THEN '신용' WHEN t LIKE '%보증금%' OR t LIKE '%전세%' THEN '담보'
 WHEN regexp_matches(t, '보증|신보|기보|guarantee') THEN '보증서' WHEN regexp_matches(t, '부동산|저당|질권|예적금|담보|secured|mortgage|collateral') THEN '담보' WHEN regexp_matches(t, '신용|credit') THEN '신용' ELSE '기타' END AS collateral,
 count(*) AS n, round(avg(p_retailprice), 6) AS price FROM t GROUP BY 1""")
def collateral_classify(spark, sf_dir):
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("p_partkey") % len(PHRASES) + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy(expr.collateral(phrase).alias("collateral")).agg(F.count("*").alias("n"), r6(F.avg("p_retailprice"), "price"))


@query("""SELECT nullif(regexp_replace(lower(trim(p_name)), '[^a-z0-9가-힣]', '', 'g'), '') AS norm, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1""")
def name_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(expr.normal_name(F.col("p_name")).alias("norm")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id"))


@query("""SELECT s_suppkey AS id, CASE WHEN p < 0.05 AND round(p * 100, 1) >= 5 THEN floor(p * 1000) / 10 WHEN p < 0.12 AND round(p * 100, 1) >= 12 THEN floor(p * 1000) / 10
 ELSE round(p * 100, 1) END AS shown, CASE WHEN p < 0.05 THEN 'FS1' WHEN p < 0.12 THEN 'FS2' ELSE 'FS3' END AS grade FROM (SELECT s_suppkey, (s_suppkey * 37 % 2000) / 10000.0::DOUBLE + 0.00003::DOUBLE AS p FROM supplier)""")
def step_grade(spark, sf_dir):
    p = (F.col("s_suppkey") * 37 % 2000) / 10000.0 + 0.00003
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), p.alias("p"))
    return s.select("id", expr.shown_percent(F.col("p"), [0.05, 0.12]).cast("double").alias("shown"), expr.graded(F.col("p"), [0.05, 0.12], ["FS1", "FS2", "FS3"]).alias("grade"))


@query("""SELECT brand AS name, n, rate_known, CAST(y0 AS INTEGER) AS first_year FROM (SELECT 'orders' AS brand, count(*) AS n, round(count(o_totalprice) * 1.0 / count(*), 6) AS rate_known, min(year(o_orderdate)) AS y0 FROM orders
 UNION ALL SELECT 'filled', count(*), round(count(o_totalprice) * 1.0 / count(*), 6), min(year(o_orderdate)) FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT 'large', count(*), round(count(o_totalprice) * 1.0 / count(*), 6), min(year(o_orderdate)) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)""")
def funnel_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    steps = {"orders": F.lit(True), "filled": F.col("o_orderstatus") == "F", "large": (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)}
    # one scan: a row counts for each step that it reaches
    at = o.select("o_totalprice", "o_orderdate", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in steps.items()]))).alias("name"))
    return at.groupBy("name").agg(F.count("*").alias("n"), r6(F.count("o_totalprice") / F.count("*"), "rate_known"), F.min(F.year("o_orderdate")).alias("first_year"))


@query("""SELECT name, count(*) AS n, count(*) FILTER (v IS NULL) AS missing, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS low, round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS high
 FROM (SELECT 'quantity' AS name, CAST(l_quantity AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'discount', nullif(l_discount, 0) FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) GROUP BY 1""")
def profile_columns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.col("l_tax").alias("tax"))
    long = li.unpivot([], ["quantity", "discount", "tax"], "name", "v")
    return long.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), r6(F.avg("v"), "mean"), r6(F.stddev_samp("v"), "std"), r6(F.min("v"), "low"), r6(F.percentile("v", 0.5), "median"), r6(F.max("v"), "high"))
