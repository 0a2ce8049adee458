"""JSON snapshots with envelopes of several shapes, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def items_of(body: Column, item_type: str) -> Column:
    """The array of items in a JSON envelope: flat ``items``, or a response with a body; items listed, wrapped as ``item`` or single.

    ``item_type`` is the DDL of one item's struct.  What fits no shape is an empty array.
    """
    parsed = lambda shape: F.from_json(body, shape)
    many, one = f"array<struct<{item_type}>>", f"struct<{item_type}>"
    flat, wrapped, alone = (parsed(f"items {t}")["items"] for t in (many, f"struct<item {many}>", f"struct<item {one}>"))
    in_body, in_item, in_one = (parsed(f"response struct<body struct<items {t}>>")["response"]["body"]["items"] for t in (many, f"struct<item {many}>", f"struct<item {one}>"))
    # a list read as a single struct, or the other way round, gives structs of nulls: these are dropped
    filled = lambda a: F.filter(a, lambda x: F.size(F.map_values(F.map_filter(F.from_json(F.to_json(x), "map<string,string>"), lambda k, v: v.isNotNull()))) > 0)
    shapes = [flat, wrapped["item"], F.when(alone["item"].isNotNull(), F.array(alone["item"])), in_body, in_item["item"], F.when(in_one["item"].isNotNull(), F.array(in_one["item"]))]
    out = F.array().cast(many)
    for shape in reversed(shapes):
        kept = filled(shape)
        out = F.when(F.size(kept) > 0, kept).otherwise(out)
    return out


def snapshots(spark: SparkSession, paths: str | list[str], item_type: str, keep: Column | None = None, personal: tuple[str, ...] = ()) -> DataFrame:
    """Items of all snapshot files (plain or gzip) with ``_yr``, the four digits before the file's extension, and without personal columns.

    Files are read as whole texts, one row a file; ``keep`` is a condition on an item's columns.
    """
    files = spark.read.text(paths, wholetext=True).select("value", F.try_element_at(F.split(F.regexp_extract(F.input_file_name(), r"_(\d{4})\.json(?:\.gz)?$", 1), ","), F.lit(1)).try_cast("int").alias("_yr"))
    rows = files.select("_yr", F.explode(items_of(F.col("value"), item_type)).alias("i")).select("i.*", "_yr")
    rows = rows if keep is None else rows.where(keep)
    return rows.drop(*personal)


def cleaned(df: DataFrame) -> DataFrame:
    """Blank strings as NULL and NaN as NULL, at ingest."""
    out = {}
    for f in df.schema:
        if f.dataType.typeName() == "string":
            out[f.name] = F.nullif(F.trim(f.name), F.lit(""))
        elif f.dataType.typeName() in ("double", "float"):
            out[f.name] = F.when(~F.isnan(f.name), F.col(f.name))
    return df.withColumns(out) if out else df


def distinct_contents(files: DataFrame, column: str = "value", least: int = 2) -> DataFrame:
    """(n, distinct, ok): whether several probes gave several contents; too few probes are not ok."""
    return files.agg(F.count("*").alias("n"), F.count_distinct(F.sha2(column, 256)).alias("distinct")).withColumn("ok", (F.col("n") >= least) & (F.col("distinct") >= 2))


def to_spreadsheet_csv(df: DataFrame, path: str) -> None:
    """CSV files with header; each begins with the byte order mark that spreadsheets look for."""
    first = df.columns[0]
    renamed = df.withColumnRenamed(first, "﻿" + first)
    renamed.write.mode("overwrite").option("header", True).csv(path)


def schema_of(item_type: str) -> StructType:
    return StructType.fromDDL(item_type)


#: Columns of persons, dropped at ingest (fixed values).
PERSONAL = frozenset({"rprsvNm", "telno", "mbtlnum", "email", "lctnAddr"})


def without_persons(df: DataFrame) -> DataFrame:
    return df.drop(*PERSONAL)
