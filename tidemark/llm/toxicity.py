"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over word presence is trained with numpy from confirmed toxic texts (P) and texts of
unknown kind (U).  With class prior p and logistic loss l the risk is
p * E_P[l(f)] + max(0, E_U[l(-f)] - p * E_P[l(-f)]); where the bracket falls below zero, its gradient is
walked back instead, so that the negative part of the risk can't be fitted below nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, id_remainder, sampled, texts

#: Bounds, in expectation, of the labelled rows and unlabelled rows that a model is fitted on.
POSITIVE_ROWS, UNLABELLED_ROWS = 4_000, 12_000
#: How far apart, in standard errors, the document frequencies of a word of the model must be; the bounded rows bound the words.
APART = 4.0
#: Full-batch Adam steps, their rate, and the weight of the L1 penalty.
STEPS, RATE, SPARSE = 400, 0.1, 1e-4

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Model:
    weights: dict[str, float]
    bias: float


def score(weights: dict[str, float], bias: float, text: str) -> float:
    z = bias + sum(weights[w] for w in sorted(words(text) & weights.keys()))
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train(rows: list[np.ndarray], positive: np.ndarray, width: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias for rows of word numbers; ``positive`` tells P from U."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    index = np.concatenate(rows) if rows else np.empty(0, np.int64)
    w, grad2, grad1 = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    share = np.where(positive, 1 / max(1, positive.sum()), 1 / max(1, (~positive).sum()))
    for step in range(1, STEPS + 1):
        f = np.bincount(owner, w[index], len(rows)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(f, -60, 60)))
        minus = np.logaddexp(0, f)  # the loss of calling a row negative
        rest = (share * minus)[~positive].sum() - prior * (share * minus)[positive].sum()
        d_pos = np.where(positive, prior * share * (s - 1), 0)
        d_rest = np.where(positive, -prior * share * s, share * s)
        d = d_pos + d_rest if rest >= 0 else -d_rest
        g = np.append(np.bincount(index, d[owner], width), d.sum()) + SPARSE * np.append(np.sign(w[:-1]), 0)
        grad1, grad2 = 0.9 * grad1 + 0.1 * g, 0.99 * grad2 + 0.01 * g * g
        w -= RATE * (grad1 / (1 - 0.9**step)) / (np.sqrt(grad2 / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Model:
    """A model from the rows of ``docs`` whose ids ``learn`` admits (a condition on doc_id; default: all).

    P are the rows that ``labels`` calls toxic, U all others.  The prior is the share of toxic rows among the
    labelled ones.  Both sets are hash samples of ids with the given expected bounds.  A label that is null counts as
    none, an id labelled twice as toxic if any label says so.  Without any toxic row the model scores all texts 0.
    """
    spark = docs.sparkSession
    rows = texts(docs).where("doc_id is not null").where(F.lit(True) if learn is None else learn)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marks = marks.where(F.lit(True) if learn is None else learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_marked, n_toxic = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return Model({}, -500.0)
    prior = min(0.99, n_toxic / n_marked)

    toxic = marks.where("toxic = 1").select("doc_id")
    p = rows.join(F.broadcast(sampled(toxic, "doc_id", positive_rows, n_toxic, 1)), "doc_id").select("doc_id", "text", F.lit(True).alias("positive"))
    u = sampled(rows, "doc_id", unlabelled_rows, rows.count(), 2).join(toxic, "doc_id", "left_anti").select("doc_id", "text", F.lit(False).alias("positive"))
    sample = cut(p.union(u))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, positive in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = sorted(words(t))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([positive] * len(found), pa.bool_())], names=["word", "positive"])

    n_p, n_u = (sample.where(c).count() for c in ("positive", "not positive"))
    df = sample.mapInArrow(tokens, "word string, positive boolean").groupBy("word").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    both, pooled = F.lit(1.0 / max(1, n_p) + 1.0 / max(1, n_u)), (F.col("p") + F.col("u")) / F.lit(n_p + n_u)
    z = F.abs(F.col("p") / max(1, n_p) - F.col("u") / max(1, n_u)) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * both)
    chosen = df.where("p + u >= 3").withColumn("z", z).where(F.col("z") >= APART).orderBy("word")
    vocabulary = {r.word: i for i, r in enumerate(chosen.select("word").collect())}

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(vocabulary[w] for w in words(t) & vocabulary.keys()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "positive", "found"])

    # sorted, so that the sums and with them the model don't hang on the order of arrival
    table = sample.mapInArrow(encoded, "doc_id long, positive boolean, found array<int>").orderBy("doc_id", "positive").toArrow()
    found = [np.array(x, np.int64) for x in table["found"].to_pylist()]
    weights, bias = train(found, np.array(table["positive"].to_pylist(), bool), len(vocabulary), prior)
    return Model(dict(zip(vocabulary, weights.tolist())), bias)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row; null and empty texts get the score of a text without words.

    Null ids keep their rows, repeated rows repeat; an empty table gives none.
    """
    weights, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([score(weights.value, bias, t) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under one half."""
    weights, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([score(weights.value, bias, t or "") < 0.5 for t in column.to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label may not be learned from."""
    return id_remainder(F.col(id_col), 5) == 0
