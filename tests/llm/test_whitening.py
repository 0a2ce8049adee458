"""Whitening against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest

from tidemark.llm import whitening
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, vector string, cell int, n long"


def by_numpy(vectors, components=8):
    x = np.floor(np.asarray(vectors, np.float32).astype(np.float64) * 1024).astype(int) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, turned = np.linalg.eigh(c.T @ c / n)
    values, turned = values[::-1][:components], turned[:, ::-1][:, :components]
    return [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s))) for r in x], c @ turned / np.sqrt(values), values / np.trace(c.T @ c / n)


def compare(found, ids, vectors, components=8):
    deviation, white, explained = by_numpy(vectors, components)
    table = {(r.vec_id, r.component): r for r in found}
    assert len(table) == len(ids) * components == len(found)
    got = np.array([[table[i, k].whitened for k in range(1, components + 1)] for i in ids])
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got - white * signs).max() < 1e-8
    for i, dev in zip(ids, deviation):
        for k in range(1, components + 1):
            r = table[i, k]
            assert (r.n, r.deviation) == (len(ids), dev)
            assert r.explained == pytest.approx(explained[k - 1], rel=1e-9) and r.identity_error < 1e-9


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    found = QUERIES["op13_whitening"](spark, SF)
    assert found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(found.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_range_finder_stops_early_or_expands():
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    steep, flat = (basis * 0.1 ** np.arange(64.0)) @ basis.T, (basis * np.linspace(2, 1, 64)) @ basis.T
    for v, widest in ((steep, 16), (flat, 64)):
        values, vectors, width, passes = whitening.range_finder(lambda q, v=v: v @ q, 64, 8)
        want = np.sort(np.linalg.eigvalsh(v))[::-1][:8]
        assert width == widest and passes <= 7
        assert np.allclose(values[:8], want, rtol=1e-9, atol=1e-14) and np.abs(v @ vectors[:, :8] - vectors[:, :8] * values[:8]).max() < 1e-13
    assert whitening.range_finder(lambda q: np.diag([3.0, 2.0]) @ q, 2, 2)[2] == 2


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = (rng.standard_normal((60, 12)) * np.linspace(3, 0.2, 12)).astype(np.float32)
    rows = [(i, v.tolist(), 1, "v", 1, 1) for i, v in enumerate(good)]
    bad = [None, [], [None] * 12, [1.0] * 11 + [None], [1.0] * 11 + [float("nan")], [float("inf")] + [0.0] * 11, [1.0, 2.0, 3.0]]
    rows += [(1000 + i, v, None, None, None, None) for i, v in enumerate(bad)]
    compare(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect(), list(range(60)), good)
    # repeated rows and null ids count each time
    twice = rows[:60] + [(None, *rows[0][1:])] + [rows[1]]
    found = whitening.whiten(spark.createDataFrame(twice, SCHEMA)).collect()
    assert len(found) == 62 * 8 and {r.n for r in found} == {62} and sum(r.vec_id is None for r in found) == 8
    # one vector, equal vectors, none
    for few in (rows[:1], rows[:1] * 5, rows[60:66], []):
        assert whitening.whiten(spark.createDataFrame(few, SCHEMA)).count() == 0
    # two different vectors have one component
    assert {r.component for r in whitening.whiten(spark.createDataFrame(rows[:2], SCHEMA)).collect()} == {1}


def test_large_values_stay_exact(spark):
    # next to such entries the second dimension's variance is no component
    vectors = [[1e30, 0.0], [-1e30, 1.0], [3.0, 2.0]]
    found = whitening.whiten(spark.createDataFrame([(i, v, 0, "", 0, 0) for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert len(found) == 3 and all(r.deviation is None for r in found if r.vec_id < 2)
    x = [int(c) for c in (2**52 + 100_000, -(2**52) + 100_000, 3 * 1024 + 100_000)], [100_000, 101_024, 102_048]
    want = sum((3 * col[2] - sum(col)) ** 2 for col in x)
    assert {r.deviation for r in found if r.vec_id == 2} == {want if want < 2**63 else None}
