"""Helpers that every operator here shares: input columns, cut lineage, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bit map: 16 MB whatever the input.
MAP_BITS = 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that no other column of the input can clash; a null text is empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir`` of the session.  Only a local session may go without: it gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder, for results too large for a checkpoint's plain rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a table of ``written`` that nothing reads any more."""
    context, files = table.sparkSession.sparkContext, table.inputFiles()
    if not files:
        return
    folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if folder.getName().startswith("table-"):
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


class Bitmap:
    """A set of bigints as bits of a map of fixed size, which every task gets: what it holds may be in the set, what it does not is not."""

    def __init__(self, shared: Broadcast):
        self.shared = shared

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = mixed(keys.view(np.uint64)) & np.uint64((1 << MAP_BITS) - 1)
        return ((self.shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def bitmap_of(rows: DataFrame, key: str) -> Bitmap:
    """The bit map of a column of bigints; it is aggregated by words of 64 bits, so at most 2^21 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(mixed(batch.column(0).to_numpy().view(np.uint64)) & np.uint64((1 << MAP_BITS) - 1))
            word = (at >> np.uint64(6)).astype(np.int32)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.empty(0, np.int64)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(word) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = rows.select(F.col(key).cast("long").alias("key")).where("key is not null").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Bitmap(rows.sparkSession.sparkContext.broadcast(bitmap))


def sampled(rows: DataFrame, id_col: str, most: int, n: int, salt: int) -> DataFrame:
    """Of ``n`` rows about ``most``, by a hash of their id over 63 bits, so that the share can be as small as it must."""
    return rows if n <= most else rows.where(F.xxhash64(F.col(id_col), F.lit(salt)).bitwiseAND(2**63 - 1) < share_limit(most, n))


def share_limit(most: int, n: int) -> int:
    """The bound below which about ``most`` of ``n`` values of 63 bits lie."""
    return 2**63 - 1 if n <= most else max(1, (most << 63) // n)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo a number; null ids count as the text ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def mixed(keys: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift); one-to-one, so that distinct keys stay distinct."""
    x = keys.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def whole_groups(batches, columns: int):
    """Arrays of ``columns`` columns in which every key of the first, sorted column is complete.

    What is held between two batches is the rows of one key, as packed values.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        last = np.searchsorted(held[0], held[0][-1])
        if last:
            yield [x[:last] for x in held]
            held = [x[last:] for x in held]
    if held is not None:
        yield held


def spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal values."""
    edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], edge)), np.concatenate((edge, [len(keys)]))
