"""Quality scores from random-indexing word vectors and a two-layer network.

Every token has a sparse ternary index vector, drawn from the hash of the token; nothing is listed and no token is left out.  Its word
vector is the sum of the index vectors around it (itself included) over the whole corpus.  Tokens whose hashes share a slot share
both vectors: this bounds the table at every size of corpus.  A document is the mean of its tokens' vectors; a network with
one hidden layer, trained with numpy, and a temperature fitted on rows kept aside give the probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, id_remainder, mixed, sampled, shuffle_width, texts

#: Bound, in expectation, of the labelled rows that the network is fitted on.
LABELLED_ROWS = 12_000
#: Slots of the hash, dimensions, non-zeros of an index vector, neighbours on either side, hidden units.
SLOTS, DIMENSIONS, NONZEROS, WINDOW, HIDDEN = 1 << 16, 64, 4, 2, 32
EPOCHS, RATE, DECAY, SEED = 400, 0.01, 1e-4, 20
#: From which score a text counts as good.
GOOD = 0.3
#: Tokens whose neighbours are added up at once, and slots that go into one row.
BLOCK, ROW = 1_000_000, 256

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")


class Slots(dict):
    """token -> slot, remembering some."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[token] = slot = xxhash.xxh64_intdigest(token, SEED) & (SLOTS - 1)
        return slot

    def of(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, _TOKEN.findall(text)), np.int32)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(dimension, sign) of the non-zeros of each slot's vector, from the hash of the slot: a start and an odd step, so that the dimensions differ, and as many plus as minus."""
    h = mixed(np.arange(SLOTS, dtype=np.uint64) + np.uint64(SEED << 32))
    start, step = (h & np.uint64(0xFFFF)).astype(np.int64), ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64) | 1
    places = (start[:, None] + step[:, None] * np.arange(NONZEROS)) % DIMENSIONS
    turn = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)[:, None]
    return places.astype(np.int32), np.where((np.arange(NONZEROS) + turn) % 2 == 0, 1, -1).astype(np.int64)


def context_sums(ids: np.ndarray, ends: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """For each slot the sum of the index vectors of its tokens and their neighbours; no neighbour is beyond the end of a text.

    Pairs of slots are counted first, so that a pair that comes often is added once.
    """
    pairs, n = [ids.astype(np.int64) * SLOTS + ids], len(ids)
    text = np.searchsorted(ends, np.arange(n), side="right")
    for step in range(1, WINDOW + 1):
        inside = text[:-step] == text[step:]
        left, right = ids[:-step][inside].astype(np.int64), ids[step:][inside].astype(np.int64)
        pairs += [left * SLOTS + right, right * SLOTS + left]
    pair, times = np.unique(np.concatenate(pairs), return_counts=True)
    token, around = pair // SLOTS, pair % SLOTS
    sums = np.zeros(SLOTS * DIMENSIONS)
    for k in range(NONZEROS):
        sums += np.bincount(token * DIMENSIONS + places[around, k], times * signs[around, k], SLOTS * DIMENSIONS)
    return sums.astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The context sums of every slot over all rows of (doc_id, text), centred and of length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, (places, signs) = Slots(), index_vectors()
        sums = np.zeros(SLOTS * DIMENSIONS, np.int64)
        held, size = [], 0

        def add() -> None:
            np.add(sums, context_sums(np.concatenate(held), np.cumsum([len(x) for x in held]), places, signs), out=sums)

        def packed() -> pa.RecordBatch:
            # rows of ROW slots, only those with a slot that came
            parts = sums.reshape(-1, ROW * DIMENSIONS)
            some = np.flatnonzero(parts.any(axis=1))
            rows = pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(parts[some].astype(np.int32)), pa.list_(pa.int32()))], names=["part", "sums"])
            sums[:] = 0
            return rows

        for batch in batches:
            for t in batch.column(1).to_pylist():
                own = slots.of(t)
                for begin in range(0, len(own), BLOCK):  # a text of over BLOCK tokens is parted there
                    held.append(own[begin : begin + BLOCK])
                    size += len(held[-1])
                    if size >= BLOCK:
                        add()
                        held, size = [], 0
                        if np.abs(sums).max() >= 2**30:  # before they pass 32 bits
                            yield packed()
        if size:
            add()
        yield packed()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a part's rows, one from each task, are added as they come
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = own.values.to_numpy().astype(np.int64)
                found[part] = found[part] + x if part in found else x
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["part", "sums"])

    parts = docs.mapInArrow(run, "part int, sums array<int>").repartition(shuffle_width(docs.sparkSession), "part").mapInArrow(total, "part int, sums array<long>")
    vectors = np.zeros((SLOTS // ROW, ROW * DIMENSIONS))
    found = parts.toArrow()  # a table of fixed size
    for part, own in zip(found["part"].to_pylist(), found["sums"]):
        vectors[part] = own.values.to_numpy()
    vectors = vectors.reshape(SLOTS, DIMENSIONS)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.maximum(length, 1e-12)
    seen = length[:, 0] > 0
    if seen.any():
        vectors[seen] -= vectors[seen].mean(axis=0)
    return vectors.astype(np.float32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of a text's tokens, with the share of distinct tokens; zeros for none."""
    if not len(ids):
        return np.zeros(vectors.shape[1] + 1)
    some, count = np.unique(ids, return_counts=True)
    return np.append(count @ vectors[some] / len(ids), len(some) / np.sqrt(len(ids)))


def train(x: np.ndarray, y: np.ndarray) -> dict:
    """A two-layer network by Adam with the epoch of least loss on rows aside, and a temperature fitted there."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(SEED)
    aside = np.zeros(len(y), bool)
    aside[rng.permutation(len(y))[: len(y) // 6]] = True
    if len(set(y[aside])) < 2:
        aside[:] = False
    xt, yt = x[~aside], y[~aside]
    xv, yv = (x[aside], y[aside]) if aside.any() else (xt, yt)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    best = (np.inf, p)
    for step in range(1, EPOCHS + 1):
        h = np.tanh(xt @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - yt) / len(yt)
        dh = np.outer(d, p[2]) * (1 - h * h)
        grads = [xt.T @ dh + DECAY * p[0], dh.sum(axis=0), h.T @ d + DECAY * p[2], d.sum(keepdims=True)]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
        p = [a - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) for k, a in enumerate(p)]
        if step % 5 == 0:
            loss = log_loss(np.tanh(xv @ p[0] + p[1]) @ p[2] + p[3], yv)
            best = min(best, (loss, p), key=lambda b: b[0])
    p = best[1]
    z = np.tanh(xv @ p[0] + p[1]) @ p[2] + p[3]
    temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: log_loss(z / t, yv))
    return {"mean": mean, "scale": scale, "layers": p, "temperature": float(temperature)}


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -z, z))))


def probabilities(net: dict, x: np.ndarray) -> np.ndarray:
    x = np.clip((x - net["mean"]) / net["scale"], -8, 8)
    a, b, c, d = net["layers"]
    return 1 / (1 + np.exp(-np.clip((np.tanh(x @ a + b) @ c + d) / net["temperature"], -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, labelled_rows: int = LABELLED_ROWS) -> dict:
    """A model: the network from a hash sample of labelled rows that ``learn`` admits, word vectors from all rows.

    A null label counts as none, an id labelled twice as good if any label says so.  Without both classes the score is the
    share of good rows, or one half without labels.
    """
    rows = texts(docs)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    marks = marks.where(F.lit(True) if learn is None else learn).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = marks.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if good in (0, n):
        return {"constant": 0.5 if not n else float(good / n)}
    sample = cut(rows.join(F.broadcast(sampled(marks, "doc_id", labelled_rows, n, 3)), "doc_id"))
    vectors = word_vectors(rows)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            x = [pooled(slots.of(t), shared.value).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    table = sample.mapInArrow(pool, "doc_id long, quality int, x array<double>").orderBy("doc_id", "x").toArrow()
    net = train(np.array(table["x"].to_pylist()), np.array(table["quality"].to_pylist()))
    return {"vectors": vectors, "net": net}


def scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row; a null or empty text is scored as one without tokens.

    Null ids and repeated rows keep their rows; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        slots = Slots()
        for batch in batches:
            if "net" not in m or not batch.num_rows:
                s = np.full(batch.num_rows, m.get("constant", 0.5))
            else:
                s = probabilities(m["net"], np.stack([pooled(slots.of(t), m["vectors"]) for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= GOOD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label may not be learned from."""
    return id_remainder(F.col(id_col), 5) == 0
