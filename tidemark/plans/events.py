"""Event tables: dense flows, balances, year-on-year signals and their stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import ranked, running
from tidemark.plans.base import query, r6, table
from tidemark.streaming import licences


def flows(spark, sf_dir):
    """(user_id, day, n_open, n_close) on the dense grid of users and days."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    daily = e.groupBy("user_id", "day").agg(F.count_if(F.col("event_type") == "signup").alias("n_open"), F.count_if(F.col("event_type") == "error").alias("n_close"))
    span = e.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    # a user's days are made beside the user: no join of users with days
    grid = e.select("user_id").distinct().crossJoin(F.broadcast(span)).select("user_id", F.explode(F.sequence("a", "b")).alias("day"))
    return grid.join(daily, ["user_id", "day"], "left").fillna(0, ["n_open", "n_close"])


FLOWS = """d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'signup') AS n_open, count(*) FILTER (event_type = 'error') AS n_close FROM events GROUP BY 1, 2),
 g AS (SELECT user_id, CAST(unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), (SELECT max(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT user_id FROM events)),
 f AS (SELECT user_id, day, coalesce(n_open, 0) AS n_open, coalesce(n_close, 0) AS n_close FROM g LEFT JOIN d USING (user_id, day))"""


@query(f"WITH {FLOWS} SELECT user_id, CAST(day AS VARCHAR) AS day, n_open, n_close FROM f")
def dense_flows(spark, sf_dir):
    return flows(spark, sf_dir).select("user_id", F.col("day").cast("string").alias("day"), "n_open", "n_close")


@query(f"""WITH {FLOWS} SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(100 + sum(n_open - n_close) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS active FROM f""")
def active_balance(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("day")
    return flows(spark, sf_dir).select("user_id", F.col("day").cast("string").alias("day"), (100 + F.sum(F.col("n_open") - F.col("n_close")).over(w)).alias("active"))


@query(f"""WITH {FLOWS}, w AS (SELECT *, sum(n_close) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3 FROM f), y AS (SELECT *, lag(s3, 7) OVER (PARTITION BY user_id ORDER BY day) AS before FROM w)
 SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(s3 AS BIGINT) AS closes, CAST(before AS BIGINT) AS before, CASE WHEN before IS NULL OR s3 + before < 3 THEN 'hold' WHEN s3 > before THEN 'worse' WHEN s3 < before THEN 'better' ELSE 'same' END AS signal FROM y""")
def yoy_signal(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("day")
    x = flows(spark, sf_dir).withColumn("closes", F.sum("n_close").over(w.rowsBetween(-2, 0))).withColumn("before", F.lag("closes", 7).over(w))
    signal = F.when(F.col("before").isNull() | (F.col("closes") + F.col("before") < 3), "hold").when(F.col("closes") > F.col("before"), "worse").when(F.col("closes") < F.col("before"), "better").otherwise("same")
    return x.select("user_id", F.col("day").cast("string").alias("day"), "closes", "before", signal.alias("signal"))


@query("""WITH a AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS closes, count(*) FILTER (event_type = 'signup') AS opens FROM events GROUP BY 1), b AS (SELECT *, CAST(100 + sum(opens - closes) OVER (ORDER BY day) AS BIGINT) AS active FROM a)
 SELECT CAST(day AS VARCHAR) AS day, closes, opens, active, coalesce(closes >= 20 AND closes >= 0.3 * lag(active) OVER (ORDER BY day), false) AS bulk FROM b""")
def bulk_flag(spark, sf_dir):
    """Days on which twenty or more close, thirty percent or more of those active the day before; events are counted directly, no grid is made."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("closes"), F.count_if(F.col("event_type") == "signup").alias("opens"))
    x = running(e, [F.asc("day")], {"net": F.col("opens") - F.col("closes")}).withColumn("active", 100 + F.col("net"))
    last = ranked(x, [F.asc("day")], "place")
    before = last.select((F.col("place") + 1).alias("place"), F.col("active").alias("before"))
    bulk = F.coalesce((F.col("closes") >= 20) & (F.col("closes") >= 0.3 * F.col("before")), F.lit(False))
    return last.join(before, "place", "left").select(F.col("day").cast("string").alias("day"), "closes", "opens", "active", bulk.alias("bulk"))


@query(f"""WITH {FLOWS}, t AS (SELECT user_id, sum(n_open) AS o, sum(n_close) AS c, regr_slope(n_close, epoch(day) / 86400) AS slope FROM f GROUP BY 1) SELECT user_id, CAST(o AS BIGINT) AS opens, CAST(c AS BIGINT) AS closes, round(slope, 6) AS slope FROM t""")
def close_trend(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.groupBy("user_id").agg(F.sum("n_open").alias("opens"), F.sum("n_close").alias("closes"), r6(F.regr_slope(F.col("n_close").cast("double"), F.unix_date("day").cast("double")), "slope"))


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def stream_daily_counts(spark, sf_dir):
    """The same counts as a batch would give, from a stream that reads the files once and then ends."""
    return licences.daily_counts(spark, f"{sf_dir}/events.parquet").select(F.col("day").cast("string").alias("day"), "event_type", "n", r6("total", "total"))
