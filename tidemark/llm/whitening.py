"""Embedding whitening: principal components of all rows by a randomised range finder and Rayleigh-Ritz.

A random block of directions, a few more than the components asked for, is multiplied by the covariance in passes over all
centred rows.  Every pass gives the Rayleigh-Ritz values of its block and their residuals at once; where these are not
small enough after a few passes the block is doubled, in the end to the full dimension, which is exact.  Only sums of one
value a cell of the block reach the driver: at most the square of the dimension, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components kept, further directions of the first block, passes before a block is doubled.
COMPONENTS, OVERSAMPLING, PASSES = 8, 8, 3
#: Greatest residual of a component, as a share of the greatest eigenvalue.
TOLERANCE = 1e-14
#: An entry c counts as floor(SCALE * c) + OFFSET, cut at LARGEST either way.
SCALE, OFFSET, LARGEST = 1024, 100_000, 2**52
SEED = 13

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Model:
    """Rows, sums by dimension, span of the entries, unit components by falling eigenvalue, eigenvalues, trace of the covariance, width of the last block and passes taken."""

    n: int
    sums: list[int]
    span: int
    components: np.ndarray
    values: np.ndarray
    trace: float
    width: int
    passes: int


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows whose vector is there, not empty and has finite entries only."""
    vector = rows[vector_col].cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(rows[id_col].cast("long").alias("vec_id"), vector.alias("vector")).where(vector.isNotNull() & (F.size(vector) > 0) & ~bad)


def entries(vectors: pa.ListArray, dimension: int) -> np.ndarray:
    """The whole-number entries of a batch, one row a vector."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    return np.floor(np.clip(c * SCALE, -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Entries less their means, from whole numbers, so that each is rounded once."""
    if sums.dtype == object:
        return ((x.astype(object) * n - sums) / n).astype(np.float64)
    return (x * n - sums) / n


def exact_sums(model_sums: list[int], n: int, span: int) -> np.ndarray:
    """The sums as bigints where n * x - S cannot leave their range, else as Python's numbers."""
    small = n * max(span, 1) < 2**62 and n * (max(map(abs, model_sums)) // n + span + 1) < 2**62
    return np.array(model_sums, np.int64 if small else object)


def orthonormal(block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block)[0]


def ritz(block: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values by falling size, vectors and residuals of a symmetric operator on an orthonormal block, given the block's image."""
    inner = block.T @ image
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = block @ turn
    return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)


def range_finder(product, dimension: int, components: int, oversampling: int = OVERSAMPLING, passes: int = PASSES, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(values, vectors, width, passes) of the operator ``product``, which takes an orthonormal block and gives its image."""
    rng = np.random.default_rng(SEED)
    width, taken = min(dimension, components + oversampling), 0
    block = np.eye(dimension) if width == dimension else orthonormal(rng.standard_normal((dimension, width)))
    while True:
        for _ in range(passes):
            image = product(block)
            taken += 1
            values, vectors, residuals = ritz(block, image)
            if width == dimension or residuals[:components].max() <= tolerance * max(values[0], 0.0):
                return values, vectors, width, taken
            block = orthonormal(image)
        width = min(dimension, 2 * width)
        more = rng.standard_normal((dimension, width - block.shape[1]))
        block = np.eye(dimension) if width == dimension else orthonormal(np.hstack((block, more)))


def fit(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> Model | None:
    """The model of all usable rows; None if there are none.

    Vectors of another length than the commonest (of equally common ones the longest) are left out.  Repeated rows count each
    time.  Directions without variance are no components, so that a table of equal vectors has none.
    """
    good = usable(rows, id_col, vector_col)
    most = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return None
    d, n = most["d"], most["count"]
    vectors = good.where(F.size("vector") == d).select("vector")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = np.zeros(d, object), np.full(d, 2**60), np.full(d, -(2**60))
        for batch in batches:
            x = entries(batch.column(0), d)
            if len(x):
                # halves, so that a batch's sum stays within a bigint
                total += (x >> 32).sum(axis=0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if low[0] <= high[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([str(s) for s in total]), pa.array(low), pa.array(high)], names=["at", "total", "low", "high"])

    parts = vectors.mapInArrow(add_up, "at int, total string, low long, high long")
    found = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()  # one row a dimension
    sums, span = [int(r["total"]) for r in found], max(r["high"] - r["low"] for r in found)
    s = exact_sums(sums, n, span)
    trace = 0.0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal trace

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            image = np.zeros((d, block.shape[1]))
            squares = 0.0
            for batch in batches:
                c = centred(entries(batch.column(0), d), n, s)
                image += c.T @ (c @ block)
                squares += float(np.einsum("ij,ij", c, c))
            values = np.append(image.ravel(), squares)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["cell", "value"])

        cells = vectors.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()  # one row a cell of the block
        values = np.zeros(d * block.shape[1] + 1)
        values[cells["cell"].to_numpy()] = cells["value"].to_numpy()
        trace = values[-1] / n
        return values[:-1].reshape(d, -1) / n

    values, vectors_found, width, taken = range_finder(product, d, min(components, d), **options)
    kept = int(np.sum(values[:components] > d * np.finfo(float).eps * max(values[0], 0.0)))
    return Model(n, sums, span, vectors_found[:, :kept], values[:kept], trace, width, taken)


def identity_error(rows: DataFrame, model: Model, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The largest entry, by size, of the covariance of all whitened rows less the identity."""
    d, r, whiten = len(model.sums), model.components.shape[1], whitener(model)
    vectors = usable(rows, id_col, vector_col).where(F.size("vector") == d).select("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((r + 1, r))
        for batch in batches:
            y = whiten(entries(batch.column(0), d))
            total[:r] += y.T @ y
            total[r] += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"])

    cells = vectors.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((r + 1) * r)
    total[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    moments = total.reshape(r + 1, r) / model.n
    return float(np.abs(moments[:r] - np.outer(moments[r], moments[r]) - np.eye(r)).max())


def whitener(model: Model):
    """A function from entries to whitened coordinates."""
    s, directions = exact_sums(model.sums, model.n, model.span), model.components / np.sqrt(model.values)
    return lambda x: centred(x, model.n, s) @ directions


def deviations(x: np.ndarray, n: int, sums: list[int], span: int) -> list[int | None]:
    """The sums over dimensions of (n * x - S) ** 2, exact; None beyond the range of a bigint."""
    s = exact_sums(sums, n, span)
    if s.dtype != object and len(sums) * (n * max(span, 1)) ** 2 < 2**63:
        c = x * n - s
        return np.einsum("ij,ij->i", c, c).tolist()
    c = x.astype(object) * n - np.array(sums, object)
    return [v if v < 2**63 else None for v in (c * c).sum(axis=1)]


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each usable row and component.

    A vector that is null or empty or has null or non-finite entries is left out, one of another length than the commonest as
    well.  Null ids and repeated rows keep their rows.  ``deviation`` is null beyond the range of a bigint.  Components without
    variance are left out, so that a table of fewer than two different vectors gives no row; nor does an empty one.
    """
    spark = rows.sparkSession
    model = fit(rows, components, id_col, vector_col, **options)
    if model is None or not len(model.values):
        return spark.createDataFrame([], RESULT)
    error, d, r, project = identity_error(rows, model, id_col, vector_col), len(model.sums), len(model.values), whitener(model)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = entries(batch.column(1), d)
            m = len(x)
            repeated = np.repeat(np.arange(m), r)
            dev = pa.array(deviations(x, model.n, model.sums, model.span), pa.int64())
            columns = [batch.column(0).take(pa.array(repeated)), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), m)), pa.array(np.full(m * r, model.n, np.int64)), dev.take(pa.array(repeated))]
            columns += [pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * r, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable(rows, id_col, vector_col).where(F.size("vector") == d).mapInArrow(run, RESULT)
