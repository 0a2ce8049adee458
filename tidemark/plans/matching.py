"""Texts of tables read by the rules for names, amounts and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.operators import scan
from tidemark.plans.base import query, table

_NORMAL = "regexp_replace(lower({}), '[^a-z0-9가-힣]', '', 'g')"


@query(f"""WITH n AS (SELECT DISTINCT name FROM (SELECT {_NORMAL.format("unnest(list_concat([p_name], string_split(p_name, ' ')))")} AS name FROM part) WHERE name <> ''), t AS (SELECT page_id, {_NORMAL.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title FROM pages),
 m AS (SELECT title, count(*) AS n_names, min(name) AS first_name FROM (SELECT DISTINCT title FROM t WHERE title <> '') JOIN n ON contains(title, name) OR (length(name) >= 4 AND contains(title, left(name, 2)) AND contains(title, right(name, 2))) GROUP BY 1)
 SELECT page_id, coalesce(n_names, 0) AS n_names, first_name FROM t LEFT JOIN m USING (title)""")
def pages_of_names(spark, sf_dir):
    """For every page, of how many part names and words of them its title speaks, and the least of these."""
    names = table(spark, sf_dir, "part").select(F.explode(F.array_union(F.array("p_name"), F.split("p_name", " "))).alias("name")).select(expr.normal_name(F.col("name")).alias("name"))
    pages = table(spark, sf_dir, "pages").select("page_id", expr.normal_name(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    return pages.join(scan.titles_naming(names, pages), "title", "left").select("page_id", F.coalesce("n_names", F.lit(0)).cast("long").alias("n_names"), "first_name")


#: How reports print an amount, {0} with and {1} without commas, and its sign there; the last is no amount.
FORMS = [("{0}", 1), ("({0})", -1), ("△{0}", -1), ("▲ {0}", -1), ("−{1}", -1), ("₩ {0}", 1), ("${1}", 1), (" {0}원 ", 1), ("{1}KRW", 1), ("{1} %", 1), ("{0}층-2", 0)]
_FORM = f"CAST((l_orderkey + l_linenumber) % {len(FORMS)} AS INTEGER)"
_SQL_FORMS = ", ".join(f"'{f}'" for f, _ in FORMS)


@query(f"""WITH p AS (SELECT {_FORM} AS form, l_returnflag, [{", ".join(str(s) for _, s in FORMS)}][{_FORM} + 1] * l_extendedprice AS meant, format('{{:,.2f}}', l_extendedprice) AS shown FROM lineitem), t AS (SELECT *, replace(replace([{_SQL_FORMS}][form + 1], '{{0}}', shown), '{{1}}', replace(shown, ',', '')) AS raw FROM p),
 s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(raw), '^\\((.*)\\)$', '-\\1'), '^[△▲−]', '-'), '[,\\s₩$]', '', 'g'), '(원|krw|KRW|%)$', '') AS v FROM t), a AS (SELECT *, TRY_CAST(v AS DOUBLE) AS amount FROM s)
 SELECT form, l_returnflag, count(*) AS n, count(amount) AS known, count(*) FILTER (abs(amount - meant) < 0.005) AS same, CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS BIGINT) AS cents FROM a GROUP BY 1, 2""")
def amounts_read_back(spark, sf_dir):
    """Every price of lineitem printed in one of the forms that reports use, and read back by the rule for amounts."""
    form = ((F.col("l_orderkey") + F.col("l_linenumber")) % len(FORMS)).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("form") + 1)
    p = table(spark, sf_dir, "lineitem").select(form.alias("form"), "l_returnflag", "l_extendedprice", F.format_number("l_extendedprice", 2).alias("shown"))
    raw = F.replace(F.replace(pick([f for f, _ in FORMS]), F.lit("{0}"), F.col("shown")), F.lit("{1}"), F.replace("shown", F.lit(","), F.lit("")))
    a = p.select("form", "l_returnflag", (pick([s for _, s in FORMS]) * F.col("l_extendedprice")).alias("meant"), expr.money(raw).alias("amount"))
    same = F.count_if(F.coalesce(F.abs(F.col("amount") - F.col("meant")) < 0.005, F.lit(False)))
    return a.groupBy("form", "l_returnflag").agg(F.count("*").alias("n"), F.count("amount").alias("known"), same.alias("same"), F.sum(F.round(F.col("amount") * 100).cast("long")).alias("cents"))


@query(f"""WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name || '(' || p_brand || ')' WHEN 1 THEN p_brand || ' （' || p_type || '） ' || p_name WHEN 2 THEN '(A)' || p_name || '점포(' || p_brand || ')(' || p_type || ')' ELSE p_name END AS raw FROM part),
 a AS (SELECT id, raw, unnest(list_distinct(list_filter(list_transform(list_concat([raw, regexp_replace(raw, '[(（][^)）]*[)）]', ' ', 'g')], regexp_extract_all(raw, '[(（]([^)）]*)[)）]', 1)), lambda x: {_NORMAL.format("x")}), lambda x: length(x) >= 2))) AS alias FROM r)
 SELECT alias, count(*) AS owners, CASE WHEN count(*) = 1 THEN min(id) END AS owner, max(regexp_replace(raw, '[^가-힣]', '', 'g')) AS hangul FROM a GROUP BY 1""")
def alias_owners(spark, sf_dir):
    """Normal names by which parts are known: the whole, what is outside parentheses and each part inside; an alias of several owners names nobody."""
    k, joined = F.col("p_partkey") % 4, lambda *parts: F.concat(*[F.col(p) if p.startswith("p_") else F.lit(p) for p in parts])
    raw = F.when(k == 0, joined("p_name", "(", "p_brand", ")")).when(k == 1, joined("p_brand", " （", "p_type", "） ", "p_name")).when(k == 2, joined("(A)", "p_name", "점포(", "p_brand", ")(", "p_type", ")")).otherwise(F.col("p_name"))
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw")).select("id", expr.hangul_only(F.col("raw")).alias("hangul"), F.explode(expr.aliases(F.col("raw"))).alias("alias"))
    return a.groupBy("alias").agg(F.count("*").alias("owners"), F.when(F.count("*") == 1, F.min("id")).alias("owner"), F.max("hangul").alias("hangul"))


#: Words of goods that name a category.
GOODS = {"ring": "jewellery", "bolt": "fasteners", "gear": "drives", "rod": "drives", "x": "unknown"}


@query(f"""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS brand, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN lower(p_type) || ' bolted goods' WHEN 2 THEN NULL WHEN 3 THEN ' ' || lower(p_type) || ' ' ELSE lower(p_type) || ' and other goods' END AS mid, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS major FROM part)
 SELECT coalesce({", ".join([f"CASE WHEN contains(brand, '{k}') THEN '{v}' END" for k, v in GOODS.items() if len(k) > 1] + [f"CASE WHEN contains(mid, '{k}') THEN '{v}' END" for k, v in GOODS.items()])}, CASE WHEN length(trim(mid)) BETWEEN 1 AND 10 THEN trim(mid) END, trim(coalesce(nullif(major, ''), '외식'))) AS term, count(*) AS n, min(id) AS first_id, count(*) FILTER (brand IS NULL) AS unnamed FROM t GROUP BY 1""")
def categories_of_goods(spark, sf_dir):
    """The category that a part is compared with, by its name, then its kind, then its sector."""
    k, kind = F.col("p_partkey"), F.lower("p_type")
    mid = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.concat(kind, F.lit(" bolted goods"))).when(k % 5 == 3, F.concat(F.lit(" "), kind, F.lit(" "))).when(k % 5 == 4, F.concat(kind, F.lit(" and other goods")))
    t = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 > 0, F.col("p_name")).alias("brand"), mid.alias("mid"), F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("major"))
    term = expr.category_term(F.col("brand"), F.col("mid"), F.col("major"), GOODS)
    return t.groupBy(term.alias("term")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.count_if(F.col("brand").isNull()).alias("unnamed"))
