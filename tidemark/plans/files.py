"""Delimited files of the shared folder, as banks and registries send them, read by their rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import shared_folder
from tidemark.plans.base import query, r6, table
from tidemark.sources import books, licences


def sent(df: DataFrame, name: str, separator: str) -> str:
    """Write delimited files with a header each, and give their folder, whose name holds ``name``."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("header", True).option("sep", separator).csv(path)
    return path


#: Collateral as a book writes it, and the kind that is read from it (fixed values of the test).
PLEDGES = [("무담보", "신용"), ("신용보증기금 보증서", "보증서"), ("부동산담보", "담보"), ("", "미기재"), ("어음", "기타")]


@query(f"""WITH b AS (SELECT o_orderkey AS k, 'Brand ' || o_custkey AS brand, round(o_totalprice, 1) AS v, [{", ".join(f"'{x}'" for _, x in PLEDGES)}][CAST(o_orderkey % {len(PLEDGES)} + 1 AS INTEGER)] AS collateral FROM orders),
 r AS (SELECT brand, collateral, round(v * 0.01::DOUBLE, 6) AS e, CASE k % 3 WHEN 1 THEN 0.4 WHEN 2 THEN 0.75 ELSE CASE collateral {" ".join(f"WHEN '{k}' THEN {v}" for k, v in books.LGD.items())} END END::DOUBLE AS l, (k % 7)::DOUBLE AS borrowers FROM b WHERE k % 11 > 0 AND k % 13 > 0 AND k % 17 > 0 AND k % 19 > 0 AND v > 0)
 SELECT brand AS brand_input, collateral, count(*) AS n, round(sum(e), 4) AS exposure_mkrw, round(avg(l), 6) AS lgd, sum(borrowers) AS n_borrowers FROM r GROUP BY 1, 2""")
def book_of_files(spark, sf_dir):
    """A loan book of all orders: bar-separated files, amounts with commas in 만원, recoveries as shares or percentages; nameless, total, amountless and negative rows among them."""
    k, amount = F.col("o_orderkey"), F.format_number(F.round("o_totalprice", 1), 1)
    book = table(spark, sf_dir, "orders").select(
        F.when(k % 11 == 0, " ").when(k % 13 == 0, F.concat(F.lit("소계 "), "o_custkey")).otherwise(F.concat(F.lit("Brand "), "o_custkey")).alias("브랜드명"),
        F.when(k % 17 == 0, "-").when(k % 19 == 0, F.concat(F.lit("△"), amount)).otherwise(amount).alias("여신잔액(만원)"),
        F.element_at(F.array(*[F.lit(x) for x, _ in PLEDGES]), (k % len(PLEDGES) + 1).cast("int")).alias("담보 구분"),
        F.when(k % 3 == 1, "60%").when(k % 3 == 2, "0.25").alias("회수율"),
        (k % 7).cast("string").alias("건수"),
    )
    read = books.read_book(spark, sent(book, "book", "|"))
    return read.groupBy("brand_input", "collateral").agg(F.count("*").alias("n"), F.round(F.sum("exposure_mkrw"), 4).alias("exposure_mkrw"), r6(F.avg("lgd"), "lgd"), F.sum("n_borrowers").alias("n_borrowers"))


@query("""WITH l AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'restaurant' ELSE 'cafe' END AS service, CAST(o_custkey % 10 AS VARCHAR) AS org_code, CASE WHEN o_custkey % 50 > 0 THEN 'M' || o_custkey END AS mng_no, CASE WHEN o_orderstatus = 'F' THEN '03' ELSE '01' END AS status_code,
 CAST(o_orderdate AS DATE) AS day, o_orderdate + to_seconds(o_orderkey % 86400) AS updated FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY service, org_code, mng_no ORDER BY updated DESC) AS r FROM l)
 SELECT service, org_code, mng_no, status_code, CASE WHEN k % 7 > 0 THEN day END AS opened_on, CASE WHEN status_code = '03' THEN day + 30 END AS closed_on, strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated FROM n WHERE r = 1 OR mng_no IS NULL""")
def licences_of_files(spark, sf_dir):
    """Licence records of all orders in files of two services, with dates in three writings and some that are none: the newest row of each number, all rows without one."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    closed = F.date_add(day.cast("date"), 30)
    o = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 10).cast("string").alias("개방자치단체코드"),
        F.when(F.col("o_custkey") % 50 > 0, F.concat(F.lit("M"), "o_custkey")).alias("관리번호"),
        F.concat(F.lit("Place, "), k).alias("사업장명"),
        F.when(F.col("o_orderstatus") == "F", "03").otherwise("01").alias("영업상태코드"),
        F.when(k % 7 == 0, "미상").when(k % 3 == 0, F.date_format(day, "yyyyMMdd")).when(k % 3 == 1, F.date_format(day, "yyyy.MM.dd")).otherwise(F.date_format(day, "yyyy-MM-dd 00:00:00")).alias("인허가일자"),
        F.date_format(closed, "yyyy-MM-dd").alias("폐업일자"),
        F.date_format(F.timestamp_add("SECOND", (k % 86400).cast("int"), day), "yyyy-MM-dd HH:mm:ss").alias("데이터갱신일자"),
        (F.col("o_custkey") % 2).alias("side"),
    )
    paths = [sent(o.where(F.col("side") == side).drop("side"), name, ",") for side, name in ((0, "general"), (1, "coffee"))]
    read = licences.licences(spark, paths, {"general-": "restaurant", "coffee-": "cafe"})
    return read.select("service", "org_code", "mng_no", "status_code", "opened_on", "closed_on", F.date_format("data_updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))
