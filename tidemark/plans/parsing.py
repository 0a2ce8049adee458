"""Reading raw texts: amounts, names, units, statements, tables and envelopes, from texts made of the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.operators.joins import best_row
from tidemark.plans.base import query, r6, table
from tidemark.sources import books, disclosures, licences

_K = lambda c, n: (F.col(c) % n).cast("int")


def _pick(col: str, values: list[str]):
    """One of a few texts by a key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), _K(col, len(values)) + 1)


def _sql_pick(col: str, values: list[str]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][CAST({col} % {len(values)} + 1 AS INTEGER)]"


AMOUNTS = ["1,234", "(500)", "△30", "▲1,000.5", "−7", "₩ 9,000", "$12", "80%", "3 000원", "A동 102호", "3층-2", "", "-", "12KRW"]


@query(f"""WITH t AS (SELECT p_partkey AS id, {_sql_pick("p_partkey", AMOUNTS)} AS raw FROM part), s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(raw), '^\\((.*)\\)$', '-\\1'), '^[△▲−]', '-'), '[,\\s₩$]', '', 'g'), '(원|krw|KRW|%)$', '') AS v FROM t)
 SELECT raw, count(*) AS n, max(TRY_CAST(nullif(nullif(v, ''), '-') AS DOUBLE)) AS amount FROM s GROUP BY 1""")
def money_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(_pick("p_partkey", AMOUNTS).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"), F.max(expr.money(F.col("raw"))).alias("amount"))


CORPS = ["(주){}", "주식회사 {}", "{} 유한회사", "㈜{}-F&B", "{}", "{} (유)"]


@query(f"""WITH t AS (SELECT p_partkey, lower(replace({_sql_pick("p_partkey", CORPS)}, '{{}}', p_name)) AS raw FROM part),
 n AS (SELECT p_partkey, replace(replace(replace(replace(replace(raw, '주식회사', ''), '㈜', ''), '(주)', ''), '유한회사', ''), '(유)', '') AS v FROM t) SELECT translate(v, ' ()[]-_&,./', '') AS corp, count(*) AS n, min(p_partkey) AS first_id FROM n GROUP BY 1""")
def corporate_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.replace(_pick("p_partkey", CORPS), F.lit("{}"), F.col("p_name"))
    return p.groupBy(expr.corporate_name(expr.nfkc(raw)).alias("corp")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id"))


NAMES = ["피자나라 치킨공주(피나치공)", "BBQ 비비큐", "60계 치킨", "Cafe(커피)집", "(A)", "메가MGC커피"]


@query(f"""WITH t AS (SELECT c_custkey AS id, {_sql_pick("c_custkey", NAMES)} AS raw FROM customer) SELECT raw, count(*) AS n, max(regexp_replace(raw, '[^가-힣]', '', 'g')) AS hangul,
 max(array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat([raw, regexp_replace(raw, '\\([^)]*\\)', ' ', 'g')], regexp_extract_all(raw, '\\(([^)]*)\\)', 1)), lambda x: regexp_replace(lower(trim(x)), '[^a-z0-9가-힣]', '', 'g')), lambda x: length(x) >= 2))), '|')) AS aliases FROM t GROUP BY 1""")
def name_aliases(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(_pick("c_custkey", NAMES).alias("raw"))
    return c.groupBy("raw").agg(F.count("*").alias("n"), F.max(expr.hangul_only(F.col("raw"))).alias("hangul"), F.max(F.array_join(expr.aliases(F.col("raw")), "|")).alias("aliases"))


@query("""WITH r AS (SELECT l_suppkey % 20 AS book, l_orderkey % CASE WHEN l_suppkey % 3 = 0 THEN 50 ELSE 1000000 END AS brand, CASE l_suppkey % 4 WHEN 0 THEN round(l_extendedprice * 1000) WHEN 1 THEN l_extendedprice WHEN 2 THEN round(l_extendedprice / 1000, 1) ELSE round(l_extendedprice / 100) END AS v,
 CASE WHEN l_suppkey % 20 IN (2, 6) THEN l_quantity * 2 END AS b FROM lineitem),
 m AS (SELECT book, median(v) FILTER (v > 0) AS med, median(v / b) FILTER (b > 0 AND v > 0) AS each, avg(CAST(abs(v - round(v)) > 1e-9 AS INT)) FILTER (v > 0) AS dec FROM r GROUP BY 1), d AS (SELECT book, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS rep FROM (SELECT book, brand, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1)
 SELECT book, round(med, 4) AS median_amount, round(rep, 6) AS repeated, CAST(CASE WHEN med >= 1e6 THEN 1e-6 WHEN each BETWEEN 3 AND 3000 AND NOT each * 100 BETWEEN 3 AND 3000 THEN 1 WHEN each * 100 BETWEEN 3 AND 3000 AND NOT each BETWEEN 3 AND 3000 THEN 100
 WHEN med >= 1000 THEN 1 WHEN rep >= 0.3 THEN 1 WHEN dec >= 0.2 THEN 100 WHEN med < 100 THEN 100 ELSE 1 END AS DOUBLE) AS factor FROM m JOIN d USING (book)""")
def book_units(spark, sf_dir):
    li, k = table(spark, sf_dir, "lineitem"), _K("l_suppkey", 4)
    v = F.when(k == 0, F.round(F.col("l_extendedprice") * 1000)).when(k == 1, F.col("l_extendedprice")).when(k == 2, F.round(F.col("l_extendedprice") / 1000, 1)).otherwise(F.round(F.col("l_extendedprice") / 100))
    book = F.col("l_suppkey") % 20
    rows = li.select(book.alias("book"), (F.col("l_orderkey") % F.when(F.col("l_suppkey") % 3 == 0, 50).otherwise(1000000)).alias("brand"), v.alias("v"), F.when(book.isin(2, 6), F.col("l_quantity") * 2).alias("b"))
    s = books.amount_statistics(rows, ["book"], "brand", "v", "b")
    return s.select("book", F.round("median_amount", 4).alias("median_amount"), r6("repeated", "repeated"), books.unit_of(*[F.col(c) for c in ("median_amount", "median_each", "repeated", "decimals")]).alias("factor"))


@query("""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, l_suppkey % 2 = 0 AS recovery, CASE l_linenumber % 4 WHEN 0 THEN l_discount WHEN 1 THEN l_discount * 1000 WHEN 2 THEN NULL ELSE l_quantity * 5 END AS v FROM lineitem), s AS (SELECT *, CASE WHEN v > 1 THEN v / 100 ELSE v END AS x FROM r)
 SELECT recovery, line, count(*) AS n, count(l) AS known, round(avg(l), 6) AS lgd FROM (SELECT *, CASE WHEN (CASE WHEN recovery THEN 1 - x ELSE x END) BETWEEN 0 AND 1 THEN round(CASE WHEN recovery THEN 1 - x ELSE x END, 6) END AS l FROM s) GROUP BY 1, 2""")
def loss_rates(spark, sf_dir):
    k = _K("l_linenumber", 4)
    v = F.when(k == 0, F.col("l_discount")).when(k == 1, F.col("l_discount") * 1000).when(k == 3, F.col("l_quantity") * 5)
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 2 == 0).alias("recovery"), F.col("l_linenumber").alias("line"), v.alias("v"))
    rate = F.when(F.col("recovery"), books.loss_rate(F.col("v"), True)).otherwise(books.loss_rate(F.col("v"), False))
    return li.withColumn("l", rate).groupBy("recovery", "line").agg(F.count("*").alias("n"), F.count("l").alias("known"), r6(F.avg("l"), "lgd"))


#: Words of dishes that name a category, first in a brand's name and then in its industry (fixed values of the test).
CATEGORIES = {"냉면": "냉면", "치킨": "치킨", "커피": "커피", "피자": "피자"}
BRANDS, MIDS = ["인생냉면", "착한치킨", "집밥", "메가커피", "도시락", "냉면치킨"], ["한식", "치킨", "커피", "기타 외국식 음식점업종류", ""]


@query(f"""WITH t AS (SELECT {_sql_pick("c_custkey", BRANDS)} AS brand, {_sql_pick("c_nationkey", MIDS)} AS mid FROM customer) SELECT brand, mid, count(*) AS n, max(CASE WHEN brand LIKE '%냉면%' THEN '냉면' WHEN brand LIKE '%치킨%' THEN '치킨' WHEN brand LIKE '%커피%' THEN '커피' WHEN brand LIKE '%피자%' THEN '피자'
 WHEN mid LIKE '%냉면%' THEN '냉면' WHEN mid LIKE '%치킨%' THEN '치킨' WHEN mid LIKE '%커피%' THEN '커피' WHEN mid LIKE '%피자%' THEN '피자' WHEN mid <> '' AND length(mid) <= 10 THEN mid ELSE '외식' END) AS term FROM t GROUP BY 1, 2""")
def category_terms(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(_pick("c_custkey", BRANDS).alias("brand"), _pick("c_nationkey", MIDS).alias("mid"))
    named = [F.when(F.col(c).contains(k), F.lit(v)) for c in ("brand", "mid") for k, v in CATEGORIES.items()]
    term = F.coalesce(*named, F.when((F.col("mid") != "") & (F.length("mid") <= 10), F.col("mid")), F.lit("외식"))
    return t.groupBy("brand", "mid").agg(F.count("*").alias("n"), F.max(term).alias("term"))


@query("""SELECT CAST(CAST(t AS DATE) AS VARCHAR) AS day, count(*) AS n, max(date_diff('day', CAST(t AS DATE), DATE '2001-12-31')) AS age, count(*) FILTER (date_diff('day', CAST(t AS DATE), DATE '2001-12-31') <= 730) AS recent
 FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 32 HOUR ELSE o_orderdate + INTERVAL 8 HOUR END AS t FROM orders) GROUP BY 1""")
def mail_dates(spark, sf_dir):
    """Days of mail stamps as they are read at +09:00: a stamp of 23:00 +0000 is of the next day.  Recent ones are of two years."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "dd MMM yyyy")
    stamp = F.when(F.col("o_orderkey") % 9 == 0, "yesterday").when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Mon, "), day, F.lit(" 23:00:00 +0000"))).otherwise(F.concat(F.lit("Tue, "), day, F.lit(" 08:00:00 +0900")))
    d = o.select(expr.mail_date(stamp).alias("d")).withColumn("age", F.date_diff(F.to_date(F.lit("2001-12-31")), "d"))
    return d.groupBy(F.col("d").cast("string").alias("day")).agg(F.count("*").alias("n"), F.max("age").cast("long").alias("age"), F.count_if(F.col("age") <= 730).alias("recent"))


TITLES = ["메가MGC커피 점주 모임", "오늘의 날씨", "bhc치킨 매출", "커피메가", "small ring news", "red bolt and widget"]


@query(f"""WITH t AS (SELECT DISTINCT p_name AS brand FROM part UNION SELECT '메가커피' UNION SELECT 'bhc'), x AS (SELECT brand, unnest([{", ".join("'" + t + "'" for t in TITLES)}]) AS title FROM t)
 SELECT brand, title FROM x WHERE contains(title, brand) OR (length(brand) >= 4 AND contains(title, left(brand, 2)) AND contains(title, right(brand, 2)))""")
def titles_of_brands(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("brand")).union(spark.createDataFrame([("메가커피",), ("bhc",)], "brand string")).distinct()
    return names.select("brand", F.explode(F.array(*map(F.lit, TITLES))).alias("title")).where(expr.title_names(F.col("brand"), F.col("title")))


@query("""WITH a AS (SELECT o_orderkey AS id, o_totalprice AS assets, round(o_totalprice * 0.6::DOUBLE, 2) AS liabilities, round(o_totalprice * CASE WHEN o_orderkey % 5 = 0 THEN 0.3 ELSE 0.4 END::DOUBLE, 2) AS equity, CASE WHEN o_orderkey % 7 = 0 THEN -1.0 ELSE o_totalprice END AS revenue, o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 1.2 ELSE 0.1 END::DOUBLE AS oi,
 o_totalprice * 0.02::DOUBLE AS join_fee, o_totalprice * 0.03::DOUBLE AS edu, o_totalprice * CASE WHEN o_orderkey % 4 = 0 THEN 0.06 ELSE 0.05 END::DOUBLE AS total FROM orders)
 SELECT id % 10 AS kind, count(*) AS n, count(*) FILTER (abs(assets - (liabilities + equity)) <= 0.01 * greatest(abs(assets), 1)) AS balanced, count(*) FILTER (NOT (oi > revenue * 1.01 OR revenue < 0)) AS sound, count(*) FILTER (abs(join_fee + edu - total) <= 0.01 * greatest(abs(total), 1)) AS fees FROM a GROUP BY 1""")
def account_gates(spark, sf_dir):
    """Balance identity, results that a revenue can give, and fees that add up to their total: what fails is unknown."""
    t, k = F.col("o_totalprice"), F.col("o_orderkey")
    a = table(spark, sf_dir, "orders").select(
        k.alias("id"), t.alias("assets"), F.round(t * 0.6, 2).alias("liabilities"), F.round(t * F.when(k % 5 == 0, 0.3).otherwise(0.4), 2).alias("equity"), F.when(k % 7 == 0, -1.0).otherwise(t).alias("revenue"), (t * F.when(k % 3 == 0, 1.2).otherwise(0.1)).alias("operating_income"),
        t.alias("net_income"), (t * 0.02).alias("fee_join"), (t * 0.03).alias("fee_edu"), (t * F.when(k % 4 == 0, 0.06).otherwise(0.05)).alias("fee_total"),
    )
    g = disclosures.fee_gate(disclosures.balance_gate(a), ["fee_join", "fee_edu"], "fee_total")
    return g.groupBy((F.col("id") % 10).alias("kind")).agg(F.count("*").alias("n"), F.count("assets").alias("balanced"), F.count("operating_income").alias("sound"), F.count("fee_total").alias("fees"))


_TITLE, _TO = "독립된 감사인의 감사보고서", " 주주 및 이사회 귀중 "
_FAIR = "우리의 의견으로는 재무제표는 2023. 12. 31 현재의 재무상태를 {}공정하게 표시하고 있{}. "
_LATER = "기타사항 전기 재무제표에 대한 감사보고서에는 한정의견이 표명되었습니다. 감사보고서일 현재로 유효 주석 관계기업의 감사인은 의견거절 우리는 표명하였습니다. "
#: Audit reports around a supplier's name: text, opinion, where it comes from, doubt about going concern.
REPORTS = [
    (f"목차 {_TITLE} 1 {_TITLE}{_TO}감 사 의 견 우리는 {{}}의 재무제표를 감사하였습니다. {_FAIR.format('', '습니다')}감사의견근거 우리는 독립적입니다. {_LATER}", "unqualified", "heading", 0),
    (f"{_TITLE}{_TO}의견 거절 우리는 {{}}의 재무제표에 대하여 의견을 표명하지 않습니다. 의견거절근거 계속기업으로서의 존속능력에 유의적 의문이 있습니다. {_LATER}", "disclaimer", "heading", 1),
    (f"{_TITLE}{_TO}감사의견 우리는 {{}}를 감사하였습니다. {_FAIR.format('한정 사항의 영향을 제외하고 ', '습니다')}", "qualified", "heading", 0),
    (f"{_TITLE}{_TO}본 감사인은 {{}}를 감사하였습니다. {_FAIR.format('', '지 않습니다')}{_LATER}", "adverse", "sentence", 0),
    (f"{_TITLE}{_TO}{{}} 감사인의 책임 계속기업 관련 불확실성이 있는지 결론을 내립니다. {_FAIR.format('', '습니다')}재무상태표 (단위: 원) 의견거절 우리는", "unqualified", "sentence", 0),
    (f"{_TITLE}{_TO}{{}} 재무상태표 (단위: 원) 자산 한정의견 우리는 그렇게 봅니다.", "qualified", "text", 0),
    ("{} 회사는 의견거절을 받은 적이 없습니다. 계속기업 관련 중요한 불확실성", None, None, 1),
    (f"{{}} 부 적 정 의 견: 우리는 감사하였습니다. 강조사항 불확실성이 계속기업 가정에 있습니다. 기타정보 없음.", "adverse", "heading", 1),
]


@query(f"""SELECT s_suppkey AS id, {" ".join(f"CASE s_suppkey % {len(REPORTS)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if r[k] is None else repr(r[k])) for i, r in enumerate(REPORTS)) + f" END AS {n}," for k, n in ((1, "opinion"), (2, "source"), (3, "doubt")))[:-1]} FROM supplier""")
def audit_reports(spark, sf_dir):
    """Opinion, where it was read, and doubt about going concern, from reports with contents, earlier years' opinions and notes around them."""
    s = table(spark, sf_dir, "supplier")
    text = F.replace(_pick("s_suppkey", [r[0] for r in REPORTS]), F.lit("{}"), F.col("s_name"))
    x = s.select(F.col("s_suppkey").alias("id"), disclosures.audit_reading(text).alias("r"), disclosures.going_concern_reading(text).cast("int").alias("doubt"))
    return x.select("id", "r.opinion", "r.source", "doubt")


#: A statement's text by kind around an amount, and what the amount is worth there; the last year's stands first.
STATEMENTS = [
    ("매출액 2018년 {}", 1), ("목차 손익계산서 10 매출액 9,999 백만원 주석 포괄 손 익 계 산 서 (단 위: 원) 매 출 액 (주14,17) {} 8,000", 1), ("영업수익 ({})", -1), ("매출액 - {}", 0), ("매출액 2,018 {}", None),
    ("Ⅰ. 매 출 액 ( {} ) 7,000", -1), ("영업손실 {}", None), ("영 업 수 익 △{}", -1), ("매출액(주석 3) 12 {} 매출액 5,555", 1),
]
LOSSES = [("영업손실 {}", -1), ("영업손실 ({})", -1), ("영업이익 {}", 1), ("영 업 이 익 △{}", -1), ("영업손실 2017", None), ("영업이익 0", 0)]


def _worth(key: str, kinds: list, other: str) -> str:
    return f"CASE {key} % {len(kinds)} " + " ".join(f"WHEN {i} THEN {other if w is None else f'{w} * v'}" for i, (_, w) in enumerate(kinds)) + " END"


@query(f"""WITH s AS (SELECT s_suppkey AS id, CAST(10000 + round(abs(s_acctbal) * 100) AS DOUBLE) AS v FROM supplier)
 SELECT id, CASE WHEN id % {len(STATEMENTS)} = 4 THEN 2018 ELSE {_worth("id", STATEMENTS, "NULL")} END::DOUBLE AS revenue, CAST({_worth("id", LOSSES, "NULL")} AS DOUBLE) AS income FROM s""")
def statement_amounts(spark, sf_dir):
    """Revenue and operating income of statements whose labels and amounts are written in nine and six ways around a supplier's figure."""
    v = F.format_number(10000 + F.round(F.abs("s_acctbal") * 100), 0)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), *[F.replace(_pick("s_suppkey", [t for t, _ in kinds]), F.lit("{}"), v).alias(n) for n, kinds in (("a", STATEMENTS), ("b", LOSSES))])
    revenue = disclosures.statement_amount(F.col("a"), ["매출액", "영업수익"], results=True)
    income = disclosures.statement_amount(F.col("b"), [("영업이익", 1), ("영업손실", -1)])
    return s.select("id", revenue.alias("revenue"), income.alias("income"))


@query("""WITH r AS (SELECT s_suppkey AS book, unnest(generate_series(1, 50)) AS line FROM supplier), c AS (SELECT *, CASE WHEN line <= 3 THEN 0 ELSE 1 + book % 3 END AS real, CASE WHEN line % 2 = 0 THEN 1 ELSE 0 END AS noise FROM r WHERE line <= 40)
 SELECT book, [',', chr(9), ';', '|'][CAST(book % 4 + 1 AS INTEGER)] AS delimiter, 4 AS header FROM c GROUP BY 1""")
def book_layouts(spark, sf_dir):
    """Delimiter and header row of delimited texts: three lines of a title, then a header and rows, with commas inside some fields."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("book"))
    d = _pick("book", [",", "\t", ";", "|"])
    n = F.explode(F.sequence(F.lit(1), F.lit(50))).alias("no")
    cells = lambda *c: F.concat_ws("\u0001", *[F.lit(x) if isinstance(x, str) else x for x in c])
    row = F.when(F.col("no") <= 3, F.lit("여신 현황")).when(F.col("no") == 4, cells("브랜드명", "여신잔액(억원)", "담보")).otherwise(cells("가", F.col("no").cast("string"), F.when(F.col("no") % 2 == 0, "a|b").otherwise("c")))
    text = s.select("book", n).select("book", "no", F.replace(row, F.lit("\u0001"), d).alias("line"))
    return books.layouts(text, "book", "no", "line")


PAGE = "<h2>other</h2><table><tr><td>x</td></tr></table><h2>재무</h2><table><tr><th>연도</th><th>매출</th><th>이익</th></tr><tr><td>2000</td><td>{a}</td><td>({b})</td></tr><tr><td>1999</td><td>-</td><td>0</td></tr></table>"


@query("SELECT s_suppkey AS id, '2000' AS year, round(abs(s_acctbal), 2) * 1000 AS revenue, -CAST(s_nationkey + 1 AS DOUBLE) * 1000 AS income FROM supplier")
def html_tables(spark, sf_dir):
    """The first table after a heading as records by header name; rows of dashes and noughts are left out; amounts in thousands."""
    s = table(spark, sf_dir, "supplier")
    page = F.replace(F.replace(F.lit(PAGE), F.lit("{a}"), F.format_number(F.abs("s_acctbal"), 2)), F.lit("{b}"), (F.col("s_nationkey") + 1).cast("string"))
    rec = s.select(F.col("s_suppkey").alias("id"), F.explode(disclosures.records(disclosures.table_after(page, "재무"))).alias("r"))
    value = lambda k: F.round(expr.money(F.col("r")[k]) * 1000, 2)
    return rec.select("id", F.col("r")["연도"].alias("year"), value("매출").alias("revenue"), value("이익").alias("income"))


@query("""SELECT r_name AS service, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def envelope_items(spark, sf_dir):
    """Items of JSON snapshots in three envelopes: a flat list, response.body.items.item as a list, and as a single object."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    item = F.struct(F.col("n_nationkey").alias("key"))
    flat = n.groupBy("n_regionkey").agg(F.collect_list(item).alias("i"))  # a fixed table of 25 rows
    whole = flat.where("n_regionkey % 2 = 0").select("n_regionkey", F.to_json(F.struct(F.col("i").alias("items"))).alias("raw"))
    nested = F.struct(F.struct(F.struct(F.struct(F.col("i").alias("item")).alias("items")).alias("body")).alias("response"))
    deep = flat.where("n_regionkey % 2 = 1 and n_regionkey <> 3").select("n_regionkey", F.to_json(nested.getField("response").alias("x")).alias("raw"))
    deep = deep.select("n_regionkey", F.concat(F.lit('{"response":'), "raw", F.lit("}")).alias("raw"))
    single = n.where("n_regionkey = 3").select("n_regionkey", F.format_string('{"response":{"body":{"items":{"item":{"key":%d}}}}}', "n_nationkey").alias("raw"))
    docs = whole.unionByName(deep).unionByName(single)
    lists = F.coalesce(
        F.from_json("raw", "items array<struct<key:int>>")["items"],
        F.from_json(F.get_json_object("raw", "$.response.body.items.item"), "array<struct<key:int>>"),
    )  # a single object is read as a list of one
    return docs.select("n_regionkey", F.explode(lists).alias("i")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("service")).agg(F.count("*").alias("n"), F.sum(F.col("i.key").cast("long")).alias("keys"))


@query("""WITH r AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'restaurant' ELSE 'bakery' END AS service, l_suppkey AS org, CASE WHEN l_orderkey % 10 <> 0 THEN l_orderkey END AS mng, CASE WHEN l_linenumber > 1 THEN CAST(l_shipdate AS DATE) END AS upd, l_quantity AS q, l_partkey, l_extendedprice FROM lineitem),
 k AS (SELECT *, row_number() OVER (PARTITION BY service, org, mng ORDER BY upd DESC NULLS LAST, l_partkey, l_extendedprice, q) AS rn FROM r WHERE mng IS NOT NULL) SELECT service, count(*) AS n, CAST(sum(q) AS DOUBLE) AS q, count(mng) AS keyed FROM (SELECT service, mng, q FROM k WHERE rn = 1 UNION ALL SELECT service, mng, q FROM r WHERE mng IS NULL) GROUP BY 1""")
def licence_newest(spark, sf_dir):
    """The newest record of each key, the service told by the file's name; records without a key all stay."""
    li = table(spark, sf_dir, "lineitem")
    file = F.when(F.col("l_suppkey") % 2 == 0, "general_restaurant_01.csv").otherwise("bakery_01.csv")
    r = li.select(licences.service_of(file, {"restaurant": "restaurant", "bakery": "bakery"}).alias("service"), F.col("l_suppkey").alias("org"), F.when(F.col("l_orderkey") % 10 != 0, F.col("l_orderkey")).alias("mng"), F.when(F.col("l_linenumber") > 1, F.to_date("l_shipdate")).alias("upd"), F.col("l_quantity").alias("q"), "l_partkey", "l_extendedprice")
    best = best_row(r.where("mng is not null"), ["service", "org", "mng"], [F.desc_nulls_last("upd"), F.asc("l_partkey"), F.asc("l_extendedprice"), F.asc("q")])
    return best.unionByName(r.where("mng is null")).groupBy("service").agg(F.count("*").alias("n"), F.sum("q").alias("q"), F.count("mng").alias("keyed"))


@query("""SELECT s_suppkey AS id, CAST(1999 + y AS INTEGER) AS year, CASE WHEN (s_suppkey + y) % 3 = 0 THEN NULL ELSE CAST((s_nationkey + 1) * 1000 * y AS DOUBLE) END AS amount, CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 3 = 1 THEN 1 END AS risk FROM supplier, (SELECT unnest([1, 2]) AS y)""")
def document_sections(spark, sf_dir):
    """Sections of a document, of a repeated code the first: year rows of one in thousands, a flag of three states from the other."""
    s = table(spark, sf_dir, "supplier")
    line = lambda y: F.concat(F.lit(f"{1999 + y} "), F.when((F.col("s_suppkey") + y) % 3 == 0, "-").otherwise(F.format_number((F.col("s_nationkey") + 1) * y, 0)))
    risk = F.when(F.col("s_suppkey") % 3 == 0, "해당 사항 없음").when(F.col("s_suppkey") % 3 == 1, F.repeat(F.lit("소송 "), 200)).otherwise("소송")
    text = F.concat_ws("\n", F.lit("앞글"), F.lit("I. 재무"), line(1), line(2), F.lit("II. 위반"), risk, F.lit("I. 재무"), F.lit("1990 5"))
    parts = disclosures.sections(s.select(F.col("s_suppkey").alias("id"), text.alias("text")), "id", "text")
    years = parts.where("code = 'I'").select("id", F.explode(disclosures.year_rows(F.col("body"), ["amount"], 1000)).alias("y")).select("id", "y.year", "y.amount")
    return years.join(parts.where("code = 'II'").select("id", disclosures.risk_flag(F.col("body")).alias("risk")), "id")


OPINIONS = ["감사의견: 우리의 의견으로는 적정의견 입니다", "의견거절", "한정의견", "부적정의견", "an unqualified opinion", "계속기업으로서의 존속능력에 의문", "의견 없음"]


@query(f"""SELECT count(DISTINCT t) >= 2 AS alive, count(*) AS probes, count(*) FILTER (t LIKE '%의견거절%') AS disclaimer, count(*) FILTER (t LIKE '부적정%') AS adverse, count(*) FILTER (t LIKE '한정%') AS qualified,
 count(*) FILTER (t LIKE '감사의견%' OR t LIKE '%unqualified%') AS clean, count(*) FILTER (t LIKE '계속기업%') AS doubt FROM (SELECT {_sql_pick("s_suppkey", OPINIONS)} AS t FROM supplier)""")
def audit_opinions(spark, sf_dir):
    """Opinions and going-concern doubts of documents, and whether the source gives different documents at all."""
    s = table(spark, sf_dir, "supplier").select(_pick("s_suppkey", OPINIONS).alias("t"))
    o = disclosures.audit_opinion(F.col("t"))
    return s.withColumn("o", o).agg((F.count_distinct(F.sha2("t", 256)) >= 2).alias("alive"), F.count("*").alias("probes"), *[F.count_if(F.col("o") == k).alias(n) for k, n in (("disclaimer", "disclaimer"), ("adverse", "adverse"), ("qualified", "qualified"), ("unqualified", "clean"))], F.count_if(disclosures.going_concern(F.col("t")) == 1).alias("doubt"))


@query("""SELECT s_suppkey AS id, CAST(2000 AS INTEGER) AS year, CAST(s_nationkey + 1 AS DOUBLE) * 1000 + 234 AS a, CAST(s_suppkey % 900 + 100 AS DOUBLE) AS b, CAST(12345678 AS DOUBLE) AS c FROM supplier""")
def glued_tables(spark, sf_dir):
    """Year rows of text whose amounts stand without blanks, parted by their groups of three digits."""
    s = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("매출 자산 부채\n2000"), (F.col("s_nationkey") + 1).cast("string"), F.lit(",234"), (F.col("s_suppkey") % 900 + 100).cast("string"), F.lit(" 12,345,678\n끝"))
    return s.select(F.col("s_suppkey").alias("id"), F.explode(disclosures.glued_rows(text, 3)).alias("r")).select("id", F.col("r.year").alias("year"), *[F.col("r.values")[i].alias(c) for i, c in enumerate("abc")])


@query("""SELECT s_suppkey AS id, concat(s_name, '는') AS topic, concat(CASE WHEN s_suppkey % 2 = 0 THEN '본점' ELSE '가게' END, CASE WHEN s_suppkey % 2 = 0 THEN '은' ELSE '는' END) AS place,
 CASE WHEN abs(s_acctbal) >= 100 THEN concat(format('{:,.1f}', s_acctbal / 100), '억원') ELSE concat(format('{:,.0f}', s_acctbal), '백만원') END AS amount, concat(CASE WHEN s_acctbal > 0 THEN '+' ELSE '' END, format('{:.1f}', s_acctbal), '%') AS change FROM supplier""")
def amount_texts(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    place = F.when(F.col("s_suppkey") % 2 == 0, "본점").otherwise("가게")
    change = F.concat(F.when(F.col("s_acctbal") > 0, "+").otherwise(""), F.replace(F.format_number("s_acctbal", 1), F.lit(","), F.lit("")), F.lit("%"))
    return s.select(F.col("s_suppkey").alias("id"), expr.particle(F.col("s_name"), "은", "는").alias("topic"), expr.particle(place, "은", "는").alias("place"), expr.amount_text(F.col("s_acctbal")).alias("amount"), change.alias("change"))


@query(r"""WITH h AS (SELECT doc_id, left(coalesce(text, ''), length(coalesce(text, '')) // 2) AS a, substr(coalesce(text, ''), length(coalesce(text, '')) // 2 + 1) AS b FROM documents),
 v AS (SELECT doc_id, list_transform(list_filter(list_transform(regexp_extract_all(b, '[0-9][0-9,]*[.]?[0-9]*'), lambda t: rtrim(replace(t, ',', ''), '.')), lambda t: length(t) < 12), lambda t: CAST(t AS DOUBLE)) AS x, list_transform(list_filter(list_transform(regexp_extract_all(a, '[0-9][0-9,]*[.]?[0-9]*'), lambda t: rtrim(replace(t, ',', ''), '.')), lambda t: length(t) < 12), lambda t: CAST(t AS DOUBLE)) AS c FROM h)
 SELECT doc_id, len(x) AS n, len(list_filter(x, lambda n: len(list_filter(c, lambda m: abs(n - m) <= 0.001 * m OR abs(n - m * 100) <= 0.1 * m OR abs(n * 100 - m) <= 0.001 * m)) > 0)) AS supported FROM v WHERE len(x) > 0""")
def supported_numbers(spark, sf_dir):
    """Of the numbers in the second half of a text those that one in its first half supports: within a thousandth, as it is or as a percentage either way."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")

    def numbers(part):
        plain = F.transform(F.regexp_extract_all(part, F.lit("[0-9][0-9,]*[.]?[0-9]*"), F.lit(0)), lambda t: F.rtrim(F.replace(t, F.lit(","), F.lit("")), F.lit(".")))
        return F.transform(F.filter(plain, lambda t: F.length(t) < 12), lambda t: t.cast("double"))

    d = table(spark, sf_dir, "documents").select("doc_id", numbers(F.substring(text, F.lit(1), half)).alias("c"), numbers(F.substring(text, half + 1, F.length(text))).alias("x")).where("size(x) > 0")
    near = lambda n, m: (F.abs(n - m) <= 0.001 * m) | (F.abs(n - m * 100) <= 0.1 * m) | (F.abs(n * 100 - m) <= 0.001 * m)
    held = F.filter("x", lambda n: F.exists("c", lambda m: near(n, m)))
    return d.select("doc_id", F.size("x").cast("long").alias("n"), F.size(held).cast("long").alias("supported"))


@query("""SELECT o_orderkey AS id, CAST(greatest(0.001, least(0.999, least(greatest(coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 400000 END, o_totalprice / 500000), 0), 1))) AS DOUBLE) AS p, round(ln(1 + greatest(o_totalprice - 50000, 0)), 6) AS log_price FROM orders""")
def model_columns(spark, sf_dir):
    """The calibrated probability or else the raw one, clipped and floored; a logarithm of what is above zero."""
    o, t = table(spark, sf_dir, "orders"), F.col("o_totalprice")
    p = expr.clipped(F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, t / 400000), t / 500000), 0.0, 1.0)
    return o.select(F.col("o_orderkey").alias("id"), expr.clipped(p, 0.001, 0.999).alias("p"), r6(F.log1p(F.greatest(t - 50000, F.lit(0.0))), "log_price"))


@query("""SELECT 'l_linenumber' AS name, false AS two FROM lineitem HAVING count(*) > 0 UNION ALL SELECT 'flag', bool_and(CAST(l_returnflag = 'R' AS INT) IN (0, 1)) FROM lineitem UNION ALL SELECT 'discount', bool_and(l_discount IN (0, 1)) FROM lineitem""")
def binary_columns(spark, sf_dir):
    """Which columns hold noughts and ones only, in one pass; those are not winsorized."""
    li = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("flag"), F.col("l_discount").alias("discount"))
    found = li.agg(*[F.bool_and(F.col(c).isin(0, 1)).alias(c) for c in li.columns])
    return found.unpivot([], li.columns, "name", "two")


@query("""SELECT s_suppkey AS id, trim(left(trim(regexp_replace(regexp_replace(concat(s_name, ' (본점) [', s_nationkey, ']'), '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '[^a-zA-Z0-9가-힣]+', ' ', 'g')), 40)) AS term, replace(concat('with ', s_name, ' and ', s_name, '0'), s_name, concat('P', s_suppkey)) AS masked FROM supplier""")
def search_terms(spark, sf_dir):
    """Search terms without parentheses and signs; names of a text replaced by others in one pass, the longest first."""
    s = table(spark, sf_dir, "supplier")
    term = expr.search_term(F.concat(F.col("s_name"), F.lit(" (본점) ["), F.col("s_nationkey").cast("string"), F.lit("]")))
    text = F.concat(F.lit("with "), "s_name", F.lit(" and "), "s_name", F.lit("0"))
    return s.select(F.col("s_suppkey").alias("id"), term.alias("term"), F.replace(text, F.col("s_name"), F.concat(F.lit("P"), F.col("s_suppkey").cast("string"))).alias("masked"))


@query("""SELECT service, count(*) AS n, count(DISTINCT name) AS names FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS service, n_name AS name FROM nation) GROUP BY 1""")
def personal_fields_dropped(spark, sf_dir):
    """A snapshot without the columns of persons; the query fails if one is left."""
    from tidemark.sources import snapshots

    n = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "a").otherwise("b").alias("service"), F.col("n_name").alias("name"), F.lit("010-0000").alias(sorted(snapshots.PERSONAL)[0]))
    kept = snapshots.without_persons(snapshots.cleaned(n))
    if snapshots.PERSONAL & set(kept.columns):
        raise ValueError("a personal column is left")
    return kept.groupBy("service").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


#: How many rows a stream of newest records keeps of each key is its feature; this one counts the duplicate share of loan rows.
@query("""SELECT l_suppkey AS book, round(avg(CAST(n > 1 AS INT)), 6) AS repeated FROM (SELECT l_suppkey, count(*) OVER (PARTITION BY l_suppkey, l_partkey) AS n FROM lineitem) GROUP BY 1""")
def duplicate_share(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.count("*").over(Window.partitionBy("l_suppkey", "l_partkey")).alias("n"))
    return li.groupBy(F.col("l_suppkey").alias("book")).agg(r6(F.avg((F.col("n") > 1).cast("int")), "repeated"))
