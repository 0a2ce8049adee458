"""Daily counts of an event stream with a watermark, and an upsert of the newest record."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, lateness: str = "60 days") -> DataFrame:
    """(day, event_type, n, total) of a stream of events with event_id, ts, event_type, value; repeats within the lateness count once."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """The result of ``windowed`` over all files that are there, kept in memory by a query that ends when they are read.

    The result is a row a day and type, which bounds the memory table.
    """
    schema = spark.read.parquet(path).schema
    name = f"daily_{uuid.uuid4().hex}"
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    # a stream reads a folder: a single file is named by its folder and a filter on the name
    parent, _, leaf = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", leaf).parquet(parent) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    query = windowed(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
