"""Global order without a global task: ranks and running totals over range partitions."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, as the session's checkpoint folder.  Only a local session may go without: it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def running(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """``df`` with running totals in the given total order, rows of ``order`` being distinct.

    Rows are range-partitioned; each partition's sums, a row a partition, become the offsets of the next ones.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.withColumns({f"__{k}": v for k, v in totals.items()}).repartitionByRange(width, *order).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy("__part").agg(*[F.sum(f"__{k}").alias(f"__{k}_sum") for k in totals])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sums.select("__part", *[F.coalesce(F.sum(f"__{k}_sum").over(before), F.lit(0)).alias(f"__{k}_off") for k in totals])
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "__part")
    out = out.withColumns({k: F.sum(f"__{k}").over(own) + F.col(f"__{k}_off") for k in totals})
    return out.drop("__part", *[f"__{k}" for k in totals], *[f"__{k}_off" for k in totals])


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its place, from 1, in a total order."""
    return running(df, order, {name: F.lit(1).cast("long")})


def value_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg, cum_pos, cum_neg): counts at each distinct score and up to it, ascending."""
    at = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    return running(at, [F.asc(score)], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")})
