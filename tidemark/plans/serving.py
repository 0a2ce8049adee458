"""What lists, reports and work queues read: grades, ranks, trends, comparisons, coverage and masked views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import ranked, running
from tidemark.plans.base import FULL, LAGGED, PANEL, full_panel, panel, query, r6, table
from tidemark.plans.labels import LABELLED, labelled, lagged
from tidemark.plans.portfolio import EXPOSURES, FINDINGS, exposures, findings

GRADES = ["FS1", "FS2", "FS3"]


def graded(spark, sf_dir):
    x = labelled(spark, sf_dir)
    return x.withColumn("grade", F.when(F.col("n_events") == 0, "FS1").when(F.col("n_events") == 1, "FS2").otherwise("FS3"))


GRADED = f"{LABELLED}, gr AS (SELECT *, CASE n_events WHEN 0 THEN 'FS1' WHEN 1 THEN 'FS2' ELSE 'FS3' END AS grade FROM x)"


@query(f"WITH {GRADED} SELECT mid, count(*) AS n, {', '.join(f'''count(*) FILTER (grade = '{g}') AS {g.lower()}''' for g in GRADES)}, round(count(*) FILTER (grade = 'FS3') * 1.0 / count(*), 6) AS worst_share FROM gr GROUP BY 1 HAVING count(*) >= 20")
def grade_composition(spark, sf_dir):
    """Grades of each industry side by side; industries of few rows are left out."""
    t = graded(spark, sf_dir).groupBy("mid").agg(F.count("*").alias("n"), *[F.count_if(F.col("grade") == g).alias(g.lower()) for g in GRADES]).where("n >= 20")
    return t.withColumn("worst_share", F.round(F.col("fs3") / F.col("n"), 6))


@query(f"WITH {GRADED} SELECT year, {', '.join(f'''round(count(*) FILTER (grade = '{g}') * 1.0 / count(*), 6) AS {g.lower()}''' for g in GRADES)} FROM gr GROUP BY 1")
def grade_distribution(spark, sf_dir):
    p = graded(spark, sf_dir).groupBy("year").pivot("grade", GRADES).count().fillna(0, GRADES)
    total = sum((F.col(g) for g in GRADES), F.lit(0))
    return p.select("year", *[r6(F.col(g) / total, g.lower()) for g in GRADES])


@query(f"WITH {GRADED}, r AS (SELECT grade, count(*) AS n, avg(label) AS rate FROM gr WHERE label IS NOT NULL GROUP BY 1) SELECT grade, n, round(rate, 6) AS rate, coalesce(rate > lag(rate) OVER (ORDER BY grade), true) AS rises FROM r")
def realised_rates(spark, sf_dir):
    """The rate of each grade, and whether it is above that of the grade before."""
    r = graded(spark, sf_dir).where("label is not null").groupBy("grade").agg(F.count("*").alias("n"), F.avg("label").alias("rate"))
    before = r.select(F.element_at(F.create_map(*[F.lit(x) for pair in zip(GRADES, GRADES[1:]) for x in pair]), F.col("grade")).alias("grade"), F.col("rate").alias("below"))
    return r.join(F.broadcast(before), "grade", "left").select("grade", "n", r6("rate", "rate"), F.coalesce(F.col("rate") > F.col("below"), F.lit(True)).alias("rises"))  # a row a grade


@query(f"WITH {FULL} SELECT major, mid, count(*) AS n, CAST(sum(n_stores) AS BIGINT) AS stores, CAST(grouping(major) * 2 + grouping(mid) AS BIGINT) AS level FROM f GROUP BY CUBE (major, mid)")
def industry_cube(spark, sf_dir):
    return full_panel(spark, sf_dir).cube("major", "mid").agg(F.count("*").alias("n"), F.sum("n_stores").alias("stores"), F.grouping_id().alias("level"))


@query(f"""WITH {EXPOSURES}, r AS (SELECT *, row_number() OVER (ORDER BY exposure DESC, id) AS rk FROM x) SELECT id, rk AS place, round(sum(exposure) OVER (ORDER BY rk) / sum(exposure) OVER (), 6) AS coverage FROM r""")
def cumulative_coverage(spark, sf_dir):
    x = ranked(exposures(spark, sf_dir), [F.desc("exposure"), F.asc("id")], "place")
    x = running(x, [F.asc("place")], {"so_far": F.col("exposure")})
    return x.crossJoin(F.broadcast(x.agg(F.sum("exposure").alias("total")))).select("id", "place", r6(F.col("so_far") / F.col("total"), "coverage"))


@query(f"""WITH {FULL}, l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY brand_id ORDER BY year DESC) = 1) SELECT brand_id, rank() OVER (ORDER BY n_stores DESC) AS overall, CASE WHEN count(*) OVER (PARTITION BY mid) >= 5 THEN rank() OVER (PARTITION BY mid ORDER BY n_stores DESC) END AS in_industry FROM l""")
def competition_rank(spark, sf_dir):
    """One more than the number of greater values, overall and in the industry, of each brand's latest row; from counts at each value."""
    x = full_panel(spark, sf_dir).groupBy("brand_id").agg(F.max_by(F.struct("n_stores", "mid"), "year").alias("l")).select("brand_id", "l.n_stores", "l.mid")
    at = x.groupBy("mid", "n_stores").agg(F.count("*").alias("n"))
    after = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("n_stores")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    overall = running(at.groupBy("n_stores").agg(F.sum("n").alias("n")), [F.desc("n_stores")], {"upto": F.col("n")}).select("n_stores", (F.col("upto") - F.col("n") + 1).alias("overall"))
    inside = at.withColumns({"in_industry": after("mid"), "peers": F.sum("n").over(Window.partitionBy("mid"))}).select("mid", "n_stores", F.when(F.col("peers") >= 5, F.col("in_industry")).alias("in_industry"))
    return x.join(overall, "n_stores").join(inside, ["mid", "n_stores"]).select("brand_id", "overall", "in_industry")


@query(f"""WITH {FULL}, {LAGGED}, t AS (SELECT *, row_number() OVER (PARTITION BY brand_id ORDER BY year DESC) AS rn FROM l) SELECT brand_id, year, n_stores, CASE WHEN prev_stores >= 2 THEN round(CAST(n_stores AS DOUBLE) / prev_stores - 1, 6) END AS growth FROM t WHERE rn <= 3""")
def trend_rows(spark, sf_dir):
    """The last three years of each brand; a rate only where its base is large enough."""
    t = lagged(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("brand_id").orderBy(F.desc("year")))).where("rn <= 3")
    return t.select("brand_id", "year", "n_stores", F.when(F.col("prev_stores") >= 2, F.round(F.col("n_stores") / F.col("prev_stores") - 1, 6)).alias("growth"))


@query(f"""WITH {PANEL}, r AS (SELECT *, lag(n_stores) OVER (PARTITION BY brand_id ORDER BY year) AS before, row_number() OVER (PARTITION BY brand_id ORDER BY year DESC) AS rn FROM p) SELECT brand_id, coalesce(min(rn) FILTER (NOT coalesce(n_stores < before, false)), count(*) + 1) - 1 AS streak FROM r GROUP BY 1""")
def decline_streak(spark, sf_dir):
    """How many rows in succession fall, counted back from the last."""
    w = Window.partitionBy("brand_id")
    r = panel(spark, sf_dir).withColumns({"before": F.lag("n_stores").over(w.orderBy("year")), "rn": F.row_number().over(w.orderBy(F.desc("year")))})
    holds = F.coalesce(F.col("n_stores") < F.col("before"), F.lit(False))
    return r.groupBy("brand_id").agg((F.coalesce(F.min(F.when(~holds, F.col("rn"))), F.count("*") + 1) - 1).alias("streak"))


@query(f"""WITH {PANEL} SELECT brand_id, year, CASE WHEN z = 0 AND lag(z) OVER w >= 3 THEN NULL ELSE z END AS n_end FROM (SELECT brand_id, year, n_end AS z FROM p) WINDOW w AS (PARTITION BY brand_id ORDER BY year)""")
def ghost_zero_repair(spark, sf_dir):
    """A zero right after a row of some size is a gap in the record, not a value."""
    z, before = F.col("n_end"), F.lag("n_end").over(Window.partitionBy("brand_id").orderBy("year"))
    return panel(spark, sf_dir).select("brand_id", "year", F.when(~F.coalesce((z == 0) & (before >= 3), F.lit(False)), z).alias("n_end"))


@query(f"""WITH {GRADED}, m AS (SELECT brand_id, year, unnest([{{'name': 'growth', 'v': growth}}, {{'name': 'sales', 'v': sales_growth}}, {{'name': 'ends', 'v': end_rate}}]) AS m FROM gr WHERE prev_stores IS NOT NULL),
 k AS (SELECT brand_id, year, m.name AS name, m.v AS v, row_number() OVER (PARTITION BY brand_id, year ORDER BY abs(m.v) DESC, m.name) AS place FROM m WHERE m.v IS NOT NULL) SELECT brand_id, year, place, name, round(v, 6) AS v FROM k WHERE place <= 2""")
def top_drivers(spark, sf_dir):
    """The two largest values, by size, of each row: sorted inside the row, without a shuffle."""
    x = labelled(spark, sf_dir).where("prev_stores is not null")
    items = F.array(*[F.struct((-F.abs(c)).alias("k"), F.lit(n).alias("name"), F.col(c).alias("v")) for n, c in (("growth", "growth"), ("sales", "sales_growth"), ("ends", "end_rate"))])
    best = F.slice(F.array_sort(F.filter(items, lambda i: i["v"].isNotNull())), 1, 2)
    return x.select("brand_id", "year", F.posexplode(best).alias("p", "i")).select("brand_id", "year", (F.col("p") + 1).cast("long").alias("place"), "i.name", r6("i.v", "v"))


@query(f"""WITH {FINDINGS}, b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY brand_id, year, category ORDER BY abs(weight) DESC, code) = 1), t AS (SELECT *, row_number() OVER (PARTITION BY brand_id, year ORDER BY abs(weight) DESC, code) AS place FROM b) SELECT brand_id, year, place, code FROM t WHERE place <= 4""")
def head_by_category(spark, sf_dir):
    """The strongest finding of each category, and of these the first four."""
    order = [F.desc(F.abs("weight")), F.asc("code")]
    first = lambda df, *keys: df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    best = first(findings(spark, sf_dir), "brand_id", "year", "category").where("place = 1")
    return first(best, "brand_id", "year").where("place <= 4").select("brand_id", "year", F.col("place").cast("long").alias("place"), "code")


@query("""WITH o AS (SELECT o_custkey AS id, count(*) AS stores, round(sum(o_totalprice), 2) AS actual FROM orders GROUP BY 1),
 x AS (SELECT c_custkey AS id, c_mktsegment AS mid, coalesce(stores, 0) AS stores, CASE WHEN c_custkey % 3 = 0 THEN actual END AS actual, CASE WHEN c_acctbal > 0 AND c_custkey % 5 <> 0 THEN c_acctbal END AS cost FROM customer LEFT JOIN o ON id = c_custkey),
 m AS (SELECT *, median(cost) OVER (PARTITION BY mid) AS mid_cost, (SELECT median(cost) FROM x) AS all_cost FROM x)
 SELECT id, round(coalesce(actual, stores * coalesce(cost, mid_cost, all_cost) * 0.6 * 0.15), 6) AS exposure, CASE WHEN actual IS NOT NULL THEN 'actual' WHEN cost IS NOT NULL THEN 'cost' WHEN mid_cost IS NOT NULL THEN 'industry' ELSE 'all' END AS basis FROM m""")
def exposure_waterfall(spark, sf_dir):
    """An exposure from the book, else from size and cost, the cost imputed by the industry's and then the overall median."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("stores"), F.round(F.sum("o_totalprice"), 2).alias("actual"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("mid"), F.when((F.col("c_acctbal") > 0) & (F.col("c_custkey") % 5 != 0), F.col("c_acctbal")).alias("cost"))
    x = c.join(o, "id", "left").withColumns({"stores": F.coalesce("stores", F.lit(0)), "actual": F.when(F.col("id") % 3 == 0, F.col("actual"))})
    mids = F.broadcast(c.groupBy("mid").agg(F.median("cost").alias("mid_cost")))  # a row an industry
    x = x.join(mids, "mid").crossJoin(F.broadcast(c.agg(F.median("cost").alias("all_cost"))))
    basis = F.when(F.col("actual").isNotNull(), "actual").when(F.col("cost").isNotNull(), "cost").when(F.col("mid_cost").isNotNull(), "industry").otherwise("all")
    return x.select("id", F.round(F.coalesce("actual", F.col("stores") * F.coalesce("cost", "mid_cost", "all_cost") * 0.6 * 0.15), 6).alias("exposure"), basis.alias("basis"))


@query(f"""WITH {PANEL}, e AS (SELECT max(year) AS last FROM p), b AS (SELECT brand_id, max(year) AS latest, count(*) AS n, arg_max(n_stores, year) AS size, max(year) FILTER (year < (SELECT last FROM e)) AS before FROM p GROUP BY 1)
 SELECT brand_id, CASE WHEN latest < last - 1 THEN 'gone' WHEN n < 3 THEN 'short history' WHEN size < 2 THEN 'small' WHEN latest = last - 1 THEN 'previous year' WHEN before = last - 1 THEN 'regular' ELSE 'bridged' END AS basis FROM b, e""")
def coverage_reasons(spark, sf_dir):
    """Why a brand is scored as usual, over a gap, or not at all: the first reason that holds."""
    p = panel(spark, sf_dir)
    last = F.broadcast(p.agg(F.max("year").alias("last")))
    b = p.crossJoin(last).groupBy("brand_id", "last").agg(F.max("year").alias("latest"), F.count("*").alias("n"), F.max_by("n_stores", "year").alias("size"), F.max(F.when(F.col("year") < F.col("last"), F.col("year"))).alias("before"))
    reason = F.when(F.col("latest") < F.col("last") - 1, "gone").when(F.col("n") < 3, "short history").when(F.col("size") < 2, "small").when(F.col("latest") == F.col("last") - 1, "previous year").when(F.col("before") == F.col("last") - 1, "regular").otherwise("bridged")
    return b.select("brand_id", reason.alias("basis"))


@query("""SELECT s_suppkey AS id FROM supplier ORDER BY md5('11:' || CAST(s_suppkey AS VARCHAR)), id LIMIT 25""")
def seeded_sample(spark, sf_dir):
    """Twenty-five rows without replacement, the same for one seed in any partitioning: a sampling operator."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return s.orderBy(F.md5(F.concat(F.lit("11:"), F.col("id").cast("string"))), "id").limit(25)


@query("""WITH c AS (SELECT l_suppkey AS brand, l_partkey % 97 AS name_key, l_orderkey % 1009 AS a, l_orderkey % 2003 AS b FROM lineitem), r AS (SELECT s_suppkey AS corp, s_suppkey % 97 AS name_key, s_suppkey % 1009 AS a, s_suppkey * 13 % 2003 AS b FROM supplier),
 k AS (SELECT DISTINCT brand, corp FROM c JOIN r USING (name_key) WHERE c.a = r.a OR c.b = r.b) SELECT brand, min(corp) AS corp FROM k GROUP BY 1 HAVING count(*) = 1""")
def registry_confirm(spark, sf_dir):
    """Candidates by name that either number confirms; a brand with several confirmed owners has none."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("brand"), (F.col("l_partkey") % 97).alias("name_key"), (F.col("l_orderkey") % 1009).alias("a"), (F.col("l_orderkey") % 2003).alias("b")).distinct()
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("corp"), (F.col("s_suppkey") % 97).alias("name_key"), (F.col("s_suppkey") % 1009).alias("a"), (F.col("s_suppkey") * 13 % 2003).alias("b"))
    # each number is a key of its own: two equi-joins instead of one with an OR
    by = lambda n: c.join(r, ["name_key", n]).select("brand", "corp")
    return by("a").union(by("b")).distinct().groupBy("brand").agg(F.count("*").alias("n"), F.min("corp").alias("corp")).where("n = 1").drop("n")


@query(r"""WITH n AS (SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS brand FROM part), l AS (SELECT p_partkey AS id, regexp_replace(lower(p_name || p_brand), '[^a-z0-9]', '', 'g') AS name FROM part)
 SELECT id, max(length(brand)) AS matched, arg_max(brand, length(brand)) AS brand FROM l JOIN n ON starts_with(name, brand) WHERE length(brand) >= 4 GROUP BY 1""")
def longest_prefix_match(spark, sf_dir):
    """The longest brand name that a licence's name begins with: prefixes are exploded and equi-joined."""
    p = table(spark, sf_dir, "part")
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    brands = p.select(plain(F.col("p_name")).alias("brand")).distinct().where(F.length("brand") >= 4)
    names = p.select(F.col("p_partkey").alias("id"), plain(F.concat("p_name", "p_brand")).alias("name")).where(F.length("name") >= 4)
    prefixes = names.select("id", F.explode(F.transform(F.sequence(F.lit(4), F.length("name")), lambda k: F.substr("name", F.lit(1), k))).alias("brand"))
    return prefixes.join(brands, "brand").groupBy("id").agg(F.max(F.length("brand")).cast("long").alias("matched"), F.max_by("brand", F.length("brand")).alias("brand"))


@query(f"""WITH {PANEL} SELECT brand_id, year, 'Brand ' || CAST(brand_id AS VARCHAR) || ' had ' || CAST(n_stores AS VARCHAR) || ' stores in ' || CAST(year AS VARCHAR) || CASE WHEN n_end > 0 THEN ', ' || CAST(n_end AS VARCHAR) || ' ended' ELSE '' END || '.' AS sentence FROM p""")
def row_sentences(spark, sf_dir):
    """Rows as sentences, for retrieval."""
    ended = F.when(F.col("n_end") > 0, F.concat(F.lit(", "), F.col("n_end").cast("string"), F.lit(" ended"))).otherwise("")
    return panel(spark, sf_dir).select("brand_id", "year", F.concat(F.lit("Brand "), F.col("brand_id").cast("string"), F.lit(" had "), F.col("n_stores").cast("string"), F.lit(" stores in "), F.col("year").cast("string"), ended, F.lit(".")).alias("sentence"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.]+', '<mail>', 'g'), '\+?[0-9][0-9 -]{6,}[0-9]', '<number>', 'g') AS text FROM conversations""")
def masked_texts(spark, sf_dir):
    """Texts with mail addresses and long numbers taken out."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.regexp_replace(F.regexp_replace("text", r"[\w.+-]+@[\w-]+\.[\w.]+", "<mail>"), r"\+?[0-9][0-9 -]{6,}[0-9]", "<number>").alias("text"))


@query(f"""WITH {EXPOSURES}, q AS (SELECT quantile_cont(p, 0.5) AS a, quantile_cont(p, 0.9) AS b FROM x) SELECT id, CASE WHEN p < a THEN 'FS1' WHEN p < b THEN 'FS2' ELSE 'FS3' END AS grade, round(a, 4) AS low_cut, round(b, 4) AS high_cut FROM x, q""")
def grade_bounds(spark, sf_dir):
    """Grades by quantile cuts, for scores that have no published ones."""
    x = exposures(spark, sf_dir)
    q = F.broadcast(x.agg(F.percentile("p", 0.5).alias("a"), F.percentile("p", 0.9).alias("b")))
    return x.crossJoin(q).select("id", F.when(F.col("p") < F.col("a"), "FS1").when(F.col("p") < F.col("b"), "FS2").otherwise("FS3").alias("grade"), F.round("a", 4).alias("low_cut"), F.round("b", 4).alias("high_cut"))


@query(f"""WITH {PANEL}, t AS (SELECT year, count(*) AS brands, CAST(sum(n_stores) AS BIGINT) AS stores, CAST(sum(n_end) AS BIGINT) AS ends FROM p GROUP BY 1) SELECT measure, year, value FROM t UNPIVOT (value FOR measure IN (brands, stores, ends))""")
def side_by_side(spark, sf_dir):
    """Measures as rows."""
    t = panel(spark, sf_dir).groupBy("year").agg(F.count("*").alias("brands"), F.sum("n_stores").alias("stores"), F.sum("n_end").alias("ends"))
    return t.unpivot("year", ["brands", "stores", "ends"], "measure", "value").select("measure", "year", "value")


@query("""WITH d AS (SELECT o_custkey AS id, min(o_orderdate) FILTER (o_orderstatus = 'F') AS first FROM orders GROUP BY 1) SELECT id, CAST(CAST(first AS DATE) AS VARCHAR) AS first_end FROM d WHERE first IS NOT NULL""")
def earliest_event(spark, sf_dir):
    d = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("first"))
    return d.select("id", F.to_date("first").cast("string").alias("first_end"))
