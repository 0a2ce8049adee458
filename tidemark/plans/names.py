"""Names in texts, licences to brands by tiers, and which brands a year covers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.plans.base import PANEL, panel, query, table

#: Names that a report of a text shows.
SHOWN = 3


def title_names(spark, sf_dir):
    """The names: the first two words of each document, as its title, and the names of customers and parts."""
    d = table(spark, sf_dir, "documents").select(scan.words(F.col("text")).alias("w")).where("size(w) > 1").select(F.array_join(F.slice("w", 1, 2), " ").alias("name"))
    p, c = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")), table(spark, sf_dir, "customer").select(F.lower("c_name").alias("name"))
    return d.union(p).union(c).distinct()


@query(r"""WITH n0 AS (SELECT array_to_string(list_slice(w, 1, 2), ' ') AS name FROM (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents) WHERE len(w) > 1 UNION SELECT array_to_string(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), ' ') FROM part UNION SELECT lower(c_name) FROM customer),
 n AS (SELECT DISTINCT name FROM n0 WHERE name NOT LIKE 'customer#%'), t AS (SELECT conv_id, turn, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), ' ') || ' ' AS s FROM conversations),
 h AS (SELECT conv_id, turn, name FROM t JOIN n ON contains(s, ' ' || name || ' ')), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(name) DESC, name) AS k, count(*) OVER (PARTITION BY conv_id, turn) AS c FROM h)
 SELECT conv_id, turn, string_agg(name, '|' ORDER BY k) AS found, max(c) AS n FROM r WHERE k <= 3 GROUP BY 1, 2""")
def names_in_texts(spark, sf_dir):
    """The names that each turn of a conversation holds as whole words, the three longest first, and how many there are."""
    t = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    found = scan.hits(t, "id", "text", title_names(spark, sf_dir), "name")
    names = F.array_sort(F.transform(F.array_distinct(F.transform("hits", lambda h: h["name"])), lambda n: F.struct((-F.length(n)).alias("l"), n.alias("name"))))
    shown = found.select("id", F.array_join(F.transform(F.slice(names, 1, SHOWN), lambda n: n["name"]), "|").alias("found"), F.size(names).cast("long").alias("n"))
    return t.select("id", "conv_id", "turn").join(shown, "id").select("conv_id", "turn", "found", "n")


@query()
def names_replaced(spark, sf_dir):
    """(doc_id, n, text): documents with each title of another place and each part's or customer's name given way to a mark; the title of the text itself as well."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan.hits(d, "doc_id", "text", title_names(spark, sf_dir), "name").select(F.col("id").alias("doc_id"), scan.leftmost_longest(F.col("hits")).alias("chosen"))
    out = d.join(found, "doc_id")
    return out.select("doc_id", F.size("chosen").alias("n"), scan.replaced(F.col("text"), F.col("chosen"), lambda name: F.concat(F.lit("<"), F.substring(F.md5(name), 1, 6), F.lit(">"))).alias("text"))


#: Words that end a branch's name, and those that do not though they look so; goods that a rest may not name (fixed values of this query).
BRANCH, SHOP, GOODS = ("branch", "store"), ("bookstore", "drugstore"), ("widget", "gizmo")
#: Letters of a key from which on it counts as strong, and at least.
STRONG, LEAST, MOST = 7, 4, 16

_LICENCES = ["{b}", "{b} {n} branch", "{s} {n} store", "{n}{b} branch", "{s}{n}", "{n} {s} branch", "{s} widget branch", "{n}branch{b}", "{n}{s} drugstore", "{s}y {n} branch"]


def brand_keys(spark, sf_dir):
    """(key, brand, strong): names of parts and, as brands of a short name, their last words; a key of several brands goes to none but the one of that name."""
    p = table(spark, sf_dir, "part").select(F.lower("p_name").alias("brand")).where("brand is not null").distinct()
    short = p.select(F.substring_index("brand", " ", -1).alias("brand"))
    return p.union(short).distinct().select(F.regexp_replace("brand", r"[^\p{L}\p{N}]", "").alias("key"), "brand").where(F.length("key").between(LEAST, MOST)).groupBy("key").agg(F.min("brand").alias("brand")).withColumn("strong", F.length("key") >= STRONG)


def licences(spark, sf_dir):
    """(id, raw, place): a licence a line, its name in ten forms of a part's name and a nation, its address the nation."""
    li, p, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    x = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # twenty-five nations
    name, place = F.lower("p_name"), F.lower(F.regexp_replace("n_name", r"[^\p{L}\p{N}]", ""))
    form = F.element_at(F.array(*[F.lit(f) for f in _LICENCES]), ((F.col("l_partkey") + F.col("l_suppkey")) % len(_LICENCES) + 1).cast("int"))
    raw = F.replace(F.replace(F.replace(form, F.lit("{b}"), name), F.lit("{s}"), F.substring_index(name, " ", -1)), F.lit("{n}"), place)
    return x.select(raw.alias("raw"), place.alias("place")).groupBy("raw", "place").agg(F.count("*").alias("n"))


def is_branch(word):
    """Whether a word ends like a branch's name and not like a shop's."""
    ends, shops = [word.endswith(w) for w in BRANCH], [word.endswith(w) for w in SHOP]
    return (ends[0] | ends[1]) & ~(shops[0] | shops[1])


def rest_ok(rest):
    """Whether what follows a brand is nothing or names a branch, and no goods of another trade."""
    goods = [rest.contains(g) for g in GOODS]
    return (rest == "") | (is_branch(rest) & ~(goods[0] | goods[1]))


_BR = "(({0} LIKE '%branch' OR {0} LIKE '%store') AND NOT ({0} LIKE '%bookstore' OR {0} LIKE '%drugstore'))"
_OK = f"({{0}} = '' OR ({_BR} AND NOT ({{0}} LIKE '%widget%' OR {{0}} LIKE '%gizmo%')))"
_FORM = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_LICENCES))


@query(f"""WITH l AS (SELECT replace(replace(replace(f, '{{b}}', b), '{{s}}', split_part(b, ' ', -1)), '{{n}}', place) AS raw, place, count(*) AS n FROM (SELECT lower(p_name) AS b, lower(regexp_replace(n_name, '[^A-Za-z0-9]', '', 'g')) AS place,
 CASE (l_partkey + l_suppkey) % {len(_LICENCES)} {_FORM} END AS f FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) GROUP BY 1, 2),
 kb AS (SELECT DISTINCT lower(p_name) AS brand FROM part WHERE p_name IS NOT NULL UNION SELECT split_part(lower(p_name), ' ', -1) FROM part), k AS (SELECT regexp_replace(brand, '[^a-z0-9]', '', 'g') AS key, min(brand) AS brand FROM kb GROUP BY 1 HAVING length(key) BETWEEN {LEAST} AND {MOST}),
 w AS (SELECT raw, place, n, string_split(raw, ' ') AS t FROM l), s AS (SELECT *, array_to_string(list_filter(t, lambda x: NOT {_BR.format("x")}), '') AS bare, unnest(generate_series(1, len(t))) AS i FROM w),
 x AS (SELECT *, t[i] AS own, array_to_string(list_slice(t, i, len(t)), '') AS tail, CASE WHEN i > 1 THEN t[i - 1] ELSE '' END AS prev FROM s),
 c AS (SELECT raw, place, n, 0 AS tier, 0 AS i, 0 AS o, key, brand FROM s JOIN k ON key = bare
 UNION ALL SELECT raw, place, n, CASE WHEN length(key) >= {STRONG} THEN 1 ELSE 2 END, i, 0, key, brand FROM x JOIN k ON starts_with(tail, key) WHERE length(key) >= {STRONG} OR ((i = 1 OR prev = place OR {_BR.format("prev")}) AND {_OK.format("substr(tail, length(key) + 1)")})
 UNION ALL SELECT raw, place, n, 3, i, o, key, brand FROM (SELECT *, unnest(generate_series(2, length(own))) AS o FROM x) JOIN k ON starts_with(substr(tail, o), key) WHERE (substr(own, 1, o - 1) = place OR {_BR.format("substr(own, 1, o - 1)")}) AND (length(key) >= {STRONG} OR ({_BR.format("substr(own, 1, o - 1)")} AND {_OK.format("substr(tail, o + length(key))")}))),
 b AS (SELECT *, row_number() OVER (PARTITION BY raw, place ORDER BY CASE WHEN tier = 0 THEN 0 WHEN tier = 3 THEN 2 ELSE 1 END, i, o, length(key) DESC, key) AS rk FROM c)
 SELECT l.raw, l.place, l.n, CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' WHEN 2 THEN 'prefix_weak' WHEN 3 THEN 'glued' ELSE 'none' END AS rule, b.brand FROM l LEFT JOIN b ON b.raw = l.raw AND b.place = l.place AND b.rk = 1""")
def licence_brands(spark, sf_dir):
    """Licences to brands: the whole name without branches, a strong key at any word's start, a weak one with a rest that names a branch, or a key glued to a place.

    Beginnings of each word's tail are equi-joined to the keys; the earliest tier, then word, then longest key stands.
    """
    keys = brand_keys(spark, sf_dir)
    named = licences(spark, sf_dir).withColumn("t", F.split("raw", " "))
    bare = F.array_join(F.filter("t", lambda w: ~is_branch(w)), "")
    exact = named.select("raw", "place", bare.alias("key")).join(keys, "key").select("raw", "place", F.lit(0).alias("tier"), F.lit(0).alias("i"), F.lit(0).alias("o"), "key", "brand")
    tails = named.select("raw", "place", "t", F.posexplode("t").alias("i", "own")).withColumns({"tail": F.array_join(F.slice("t", F.col("i") + 1, F.size("t")), ""), "prev": F.when(F.col("i") > 0, F.get("t", F.col("i") - 1)).otherwise("")})

    def joined(d, text):
        found = d.withColumn("p", F.explode(scan.prefixes(text, LEAST, MOST))).withColumn("key", F.col("p.text")).join(keys, "key")
        return found.withColumn("rest", F.substring(text, F.length("key") + 1, F.length(text)))

    at_word = joined(tails, F.col("tail"))
    anchored = (F.col("i") == 0) | (F.col("prev") == F.col("place")) | is_branch(F.col("prev"))
    at_word = at_word.where(F.col("strong") | (anchored & rest_ok(F.col("rest")))).select("raw", "place", F.when(F.col("strong"), 1).otherwise(2).alias("tier"), (F.col("i") + 1).alias("i"), F.lit(0).alias("o"), "key", "brand")
    inside = tails.where(F.length("own") > 1).withColumn("o", F.explode(F.sequence(F.lit(2), F.length("own"))))
    inside = inside.withColumns({"head": F.substring(F.col("own"), F.lit(1), F.col("o") - 1), "cut": F.substring(F.col("tail"), F.col("o"), F.length("tail"))})
    glued = joined(inside.where((F.col("head") == F.col("place")) | is_branch(F.col("head"))), F.col("cut"))
    glued = glued.where(F.col("strong") | (is_branch(F.col("head")) & rest_ok(F.col("rest")))).select("raw", "place", F.lit(3).alias("tier"), (F.col("i") + 1).alias("i"), "o", "key", "brand")
    order = [F.when(F.col("tier") == 0, 0).when(F.col("tier") == 3, 2).otherwise(1), F.asc("i"), F.asc("o"), F.desc(F.length("key")), F.asc("key")]
    best = scan.first_by(exact.union(at_word).union(glued), ["raw", "place"], order)
    rule = F.when(F.col("tier") == 0, "exact").when(F.col("tier") == 1, "prefix").when(F.col("tier") == 2, "prefix_weak").when(F.col("tier") == 3, "glued").otherwise("none")
    return named.join(best, ["raw", "place"], "left").select("raw", "place", "n", rule.alias("rule"), "brand")


#: Stores that a brand must have had, years in a row that it must show.
STORES, YEARS = 2, 3
_COVER = f"""{PANEL}, e AS (SELECT max(year) AS last FROM p), b AS (SELECT c_custkey AS brand_id, c_custkey // 3 AS number, c_custkey // 8 AS corp, c_mktsegment AS alias FROM customer), q AS (SELECT p.*, number, corp, alias FROM p JOIN b USING (brand_id)),
 cur AS (SELECT q.*, max(n_stores) OVER (PARTITION BY brand_id ORDER BY year) AS most FROM q), now AS (SELECT cur.* FROM cur, e WHERE year = last),
 ev AS (SELECT DISTINCT brand_id // 3 AS number, year, 'region' AS kind FROM p WHERE n_end > 0 UNION SELECT DISTINCT c_custkey // 3, 1990 + c_nationkey % 12 + unnest(generate_series(0, 3)), 'registry' FROM customer),
 need AS (SELECT brand_id, number, corp, alias, unnest(generate_series(last - {YEARS - 1}, last)) AS y FROM now, e),
 l AS (SELECT DISTINCT n.brand_id, o.brand_id AS other FROM now n JOIN b o ON o.number = n.number AND o.brand_id <> n.brand_id UNION SELECT DISTINCT n.brand_id, o.brand_id FROM now n JOIN b o ON o.corp = n.corp AND o.alias = n.alias AND o.brand_id <> n.brand_id),
 ly AS (SELECT DISTINCT l.brand_id, p.year FROM l JOIN p ON p.brand_id = l.other JOIN e ON p.year < last), ln AS (SELECT DISTINCT brand_id, number FROM need UNION SELECT l.brand_id, b.number FROM l JOIN b ON b.brand_id = l.other),
 g AS (SELECT need.brand_id, y, CASE WHEN p.year IS NOT NULL THEN 'own' WHEN ly.year IS NOT NULL THEN 'linked' WHEN EXISTS (SELECT 1 FROM ln JOIN ev USING (number) WHERE ln.brand_id = need.brand_id AND ev.year = y AND kind = 'region') THEN 'region' WHEN EXISTS (SELECT 1 FROM ln JOIN ev USING (number) WHERE ln.brand_id = need.brand_id AND ev.year = y AND kind = 'registry') THEN 'registry' ELSE 'none' END AS why
 FROM need LEFT JOIN p ON p.brand_id = need.brand_id AND p.year = y LEFT JOIN ly ON ly.brand_id = need.brand_id AND ly.year = y),
 s AS (SELECT brand_id, string_agg(y || ':' || why, ',' ORDER BY y) FILTER (why NOT IN ('own', 'none')) AS basis, min(y) FILTER (why = 'none') AS broken, bool_or(why = 'own' AND y = last - 1) AS before FROM g, e GROUP BY 1),
 early AS (SELECT s.brand_id, min(yy.year) AS first FROM s JOIN (SELECT brand_id, year FROM p UNION SELECT brand_id, year FROM ly) yy USING (brand_id) GROUP BY 1)"""


@query(f"""WITH {_COVER} SELECT now.brand_id, now.n_stores, CASE WHEN broken IS NULL AND basis IS NULL AND most >= {STORES} THEN 'scored' WHEN most < {STORES} THEN 'too few stores' WHEN broken IS NULL AND before THEN 'bridged' WHEN broken IS NULL THEN 'year before missing' WHEN first < broken THEN 'gap unconfirmed' ELSE 'short history' END AS status,
 CASE WHEN most >= {STORES} THEN basis END AS basis, CAST(CASE WHEN most >= {STORES} THEN broken END AS INTEGER) AS broken FROM now JOIN s USING (brand_id) JOIN early USING (brand_id)""")
def coverage_bridging(spark, sf_dir):
    """Which brands of the last year are scored as usual, bridged over missing years by other records, or not scored, by the first reason that holds.

    Records of a missing year are tried in turn: the brand's other ids (same number, or same corporation and alias), regional
    statistics of any of their numbers, the register.  The first year that none confirms breaks the row.
    """
    p = panel(spark, sf_dir).select("brand_id", "year", "n_stores", "n_end")
    c = table(spark, sf_dir, "customer")
    b = c.select(F.col("c_custkey").alias("brand_id"), F.floor(F.col("c_custkey") / 3).alias("number"), F.floor(F.col("c_custkey") / 8).alias("corp"), F.col("c_mktsegment").alias("alias"))
    last = p.agg(F.max("year")).first()[0]
    if last is None:
        return spark.createDataFrame([], "brand_id long, n_stores long, status string, basis string, broken int")
    most = p.groupBy("brand_id").agg(F.max("n_stores").alias("most"), F.max_by("n_stores", "year").alias("n_stores"), F.max("year").alias("latest"), F.min("year").alias("first_own")).where(F.col("latest") == last)
    now = most.join(b, "brand_id")
    other = b.select(F.col("brand_id").alias("other"), *[F.col(k).alias(f"o_{k}") for k in ("number", "corp", "alias")])
    same = lambda on: now.join(other, on).where("other <> brand_id").select("brand_id", "other", "o_number")
    links = same(F.col("number") == F.col("o_number")).union(same((F.col("corp") == F.col("o_corp")) & (F.col("alias") == F.col("o_alias")))).distinct()
    linked = links.join(p.select(F.col("brand_id").alias("other"), "year"), "other").where(F.col("year") < last).select("brand_id", "year").distinct()
    numbers = now.select("brand_id", "number").union(links.select("brand_id", F.col("o_number").alias("number"))).distinct()
    region = p.where("n_end > 0").select(F.floor(F.col("brand_id") / 3).alias("number"), "year", F.lit(2).alias("rank"))
    since = 1990 + F.col("c_nationkey") % 12
    registry = c.select(F.floor(F.col("c_custkey") / 3).alias("number"), F.explode(F.sequence(since, since + 3)).alias("year"), F.lit(3).alias("rank"))
    records = numbers.join(region.union(registry), "number").select("brand_id", "year", "rank")
    records = records.union(p.select("brand_id", "year", F.lit(0))).union(linked.select("brand_id", "year", F.lit(1)))
    best = records.where(F.col("year") > last - YEARS).groupBy("brand_id", "year").agg(F.min("rank").alias("rank"))
    need = now.select("brand_id", F.explode(F.sequence(F.lit(last - YEARS + 1), F.lit(last))).alias("year")).join(best, ["brand_id", "year"], "left")
    words = F.element_at(F.array(*map(F.lit, ("own", "linked", "region", "registry"))), F.col("rank") + 1)
    basis = F.array_sort(F.collect_list(F.when(F.col("rank") > 0, F.struct("year", words.alias("why")))))
    s = need.groupBy("brand_id").agg(F.nullif(F.array_join(F.transform(basis, lambda x: F.concat(x["year"].cast("string"), F.lit(":"), x["why"])), ","), F.lit("")).alias("basis"), F.min(F.when(F.col("rank").isNull(), F.col("year"))).alias("broken"), F.bool_or((F.col("year") == last - 1) & (F.coalesce("rank", F.lit(9)) == 0)).alias("before"))
    s = now.join(s, "brand_id").join(linked.groupBy("brand_id").agg(F.min("year").alias("first_linked")), "brand_id", "left").withColumn("first", F.least("first_own", "first_linked"))
    enough = F.col("most") >= STORES
    status = (
        F.when(~enough, "too few stores").when(F.col("broken").isNull() & F.col("basis").isNull(), "scored").when(F.col("broken").isNull() & F.col("before"), "bridged")
        .when(F.col("broken").isNull(), "year before missing").when(F.col("first") < F.col("broken"), "gap unconfirmed").otherwise("short history")
    )
    return s.select("brand_id", "n_stores", status.alias("status"), F.when(enough, F.col("basis")).alias("basis"), F.when(enough, F.col("broken")).cast("int").alias("broken"))
