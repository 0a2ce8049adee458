"""Exact Shapley values of boosted trees, by paths.

A tree's expectation given a set of known features is a sum over its leaves: the product over the features of the leaf's path of
either whether the row keeps to the path (known) or the share of training rows that did (unknown).  So each leaf is a game of its
own whose players are the features of its path, at most the depth, and its Shapley values come from the coefficients of a product of
linear polynomials, weighted by the size of the set.  Leaves are looped over, rows are worked on as arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Leaf:
    """Value (with its tree's weight), features of the path in the order of their first split, bounds that a row must keep (low < x <= high) and share of training rows that did, by feature."""

    value: float
    features: tuple[int, ...]
    lows: tuple[float, ...]
    highs: tuple[float, ...]
    shares: tuple[float, ...]


def leaves_of(root, weight: float = 1.0) -> list[Leaf]:
    """The leaves of a tree of nodes with numFeature splits on thresholds, as the library's trees hold them in the JVM."""
    out: list[Leaf] = []

    def walk(node, path: dict[int, tuple[float, float, float]]) -> None:
        if node.subtreeDepth() == 0:
            f = tuple(path)
            out.append(Leaf(weight * node.prediction(), f, *(tuple(path[i][k] for i in f) for k in range(3))))
            return
        split, count = node.split(), node.impurityStats().count()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("only splits of numbers have attributions")
        i, threshold = split.featureIndex(), split.threshold()
        low, high, share = path.get(i, (-math.inf, math.inf, 1.0))
        left, right = node.leftChild(), node.rightChild()
        walk(left, path | {i: (low, min(high, threshold), share * left.impurityStats().count() / count)})
        walk(right, path | {i: (max(low, threshold), high, share * right.impurityStats().count() / count)})

    walk(root, {})
    return out


def leaves(model) -> list[Leaf]:
    """The leaves of all trees of a fitted gradient-boosted model; a few thousand numbers."""
    return [leaf for tree, weight in zip(model.trees, model.treeWeights) for leaf in leaves_of(tree._call_java("rootNode"), weight)]


def base_value(found: list[Leaf]) -> float:
    """The expectation with no feature known."""
    return math.fsum(leaf.value * math.prod(leaf.shares) for leaf in found)


def shapley(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """A row of values for each row of ``x``; with ``base_value`` they add up to the margin."""
    out = np.zeros(x.shape)
    for leaf in found:
        d = len(leaf.features)
        kept = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high in zip(leaf.features, leaf.lows, leaf.highs)]
        weights = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
        for own in range(d):
            # coefficient k: the sum over the sets of k other features of what the leaf is worth to them
            worth = np.zeros((d, len(x)))
            worth[0] = leaf.value
            for size, other in enumerate(j for j in range(d) if j != own):
                for k in range(size + 1, 0, -1):
                    worth[k] = worth[k] * leaf.shares[other] + worth[k - 1] * kept[other]
                worth[0] *= leaf.shares[other]
            out[:, leaf.features[own]] += (kept[own] - leaf.shares[own]) * np.tensordot(weights, worth, 1)
    return out


def attributed(rows: DataFrame, found: list[Leaf], keys: list[str], features: list[str], most: int = 10) -> DataFrame:
    """(keys, feature, shap_value, feature_value): the ``most`` features of greatest effect of each row, ties by the order of ``features``.

    Every row gives min(most, features) rows; a null feature counts as NaN, which keeps to no side and so to no path.
    """
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", feature string, shap_value double, feature_value double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, k = np.array(features, object), min(most, len(features))
        for batch in batches:
            x = batch[features].to_numpy(float)
            values = shapley(found, x)
            order = np.argsort(-np.abs(values), axis=1, kind="stable")[:, :k]
            out = {key: batch[key].repeat(k).to_numpy() for key in keys}
            out |= {"feature": names[order].ravel(), "shap_value": np.take_along_axis(values, order, 1).ravel(), "feature_value": np.take_along_axis(x, order, 1).ravel()}
            yield pd.DataFrame(out)

    return rows.select(*keys, *features).mapInPandas(run, schema)
