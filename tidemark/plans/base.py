"""Registration of queries, and the frames and SQL that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col, name: str):
    """A double of six decimals, as results are compared."""
    return F.round(col.cast("double") if not isinstance(col, str) else F.col(col).cast("double"), 6).alias(name)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity by year: a customer's orders stand for a brand's stores."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("brand_id"), F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("n_stores"), F.count_if(F.col("o_orderstatus") == "F").alias("n_end"), F.round(F.avg("o_totalprice"), 4).alias("avg_sales")
    )


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(brand_id, mid, major): the market segment and the region of a customer."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    named = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables of 25 and 5 rows
    return named.select(F.col("c_custkey").alias("brand_id"), F.col("c_mktsegment").alias("mid"), F.col("r_name").alias("major"))


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).join(industries(spark, sf_dir), "brand_id")


PANEL = """p AS (SELECT o_custkey AS brand_id, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_stores,
 count(*) FILTER (o_orderstatus = 'F') AS n_end, round(avg(o_totalprice), 4) AS avg_sales FROM orders GROUP BY 1, 2)"""
INDUSTRIES = """i AS (SELECT c_custkey AS brand_id, c_mktsegment AS mid, r_name AS major FROM customer
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FULL = f"{PANEL}, {INDUSTRIES}, f AS (SELECT * FROM p JOIN i USING (brand_id))"
#: Guarded lags of the panel.
LAGGED = """l AS (SELECT *, CASE WHEN lag(year) OVER w = year - 1 THEN lag(n_stores) OVER w END AS prev_stores,
 CASE WHEN lag(year) OVER w = year - 1 THEN lag(avg_sales) OVER w END AS prev_sales FROM f WINDOW w AS (PARTITION BY brand_id ORDER BY year))"""
