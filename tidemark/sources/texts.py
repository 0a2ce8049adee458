"""Text files in encodings that Spark's own readers don't take, and delimited lines as columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """(file, line) of text files.  Files are split at line feeds by Spark, and decoded in tasks unless they are UTF-8.

    Encodings in which a line feed's byte stands for nothing else will do, such as CP949.  Bytes that cannot be decoded become a replacement sign;
    a byte order mark is taken off.
    """
    raw = spark.read.text(paths).select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = [b.decode(encoding, "replace").lstrip("﻿").rstrip("\r") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.string())], names=["file", "line"])

    return raw.mapInArrow(run, "file string, line string")


def fields(line: Column, names: list[str], separator: str) -> Column:
    """A struct of a delimited line's fields, quotes taken off; missing ones are NULL."""
    return F.from_csv(line, ", ".join(f"`{n}` string" for n in names), {"sep": separator, "mode": "PERMISSIVE"})
