"""Logistic regression by Newton's method on sums: several models a pass, and errors robust to clusters."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Problem:
    """Features (an intercept is added), rows that count, and a penalty on all coefficients but the intercept."""

    features: list[Column]
    rows: Column = field(default_factory=lambda: F.lit(True))
    ridge: float = 0.0

    def columns(self) -> list[Column]:
        return [F.lit(1.0), *self.features]


def _chance(columns: list[Column], beta: list[Column]) -> Column:
    z = sum((b * c for b, c in zip(beta[1:], columns[1:])), beta[0])
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def _literals(beta: np.ndarray) -> list[Column]:
    return [F.lit(float(b)) for b in beta]


def _sums(problem: Problem, beta: list[Column], label: Column) -> tuple[list[Column], list[Column]]:
    """Gradient and upper triangle of the information, as aggregates."""
    x, p = problem.columns(), _chance(problem.columns(), beta)
    held = lambda c: F.coalesce(F.sum(F.when(problem.rows, c)), F.lit(0.0))
    return [held(c * (label - p)) for c in x], [held(x[i] * x[j] * p * (1 - p)) for i in range(len(x)) for j in range(i, len(x))]


def _square(values: list[float], m: int) -> np.ndarray:
    out = np.zeros((m, m))
    out[np.triu_indices(m)] = values
    return out + np.triu(out, 1).T


def newton(rows: DataFrame, problems: list[Problem], label: str, steps: int = 60, tolerance: float = 1e-9) -> list[np.ndarray]:
    """The coefficients of each problem, intercept first.  A step is one aggregate for all problems; only sums reach the driver."""
    y, spark = F.col(label).cast("double"), rows.sparkSession
    found = [np.zeros(len(p.features) + 1) for p in problems]
    # coefficients come as a row beside the data, so that a step runs the code that the first one compiled
    names = [[f"__b{i}_{j}" for j in range(len(b))] for i, b in enumerate(found)]
    wanted = [_sums(p, [F.col(n) for n in own], y) for p, own in zip(problems, names)]
    sums = [c.alias(f"s{n}") for n, c in enumerate(c for g, h in wanted for c in g + h)]
    open_ones = set(range(len(problems)))
    for _ in range(steps):
        if not open_ones:
            break
        row = spark.createDataFrame([tuple(float(v) for b in found for v in b)], ", ".join(f"{n} double" for own in names for n in own))
        values = list(rows.crossJoin(F.broadcast(row)).agg(*sums).first())  # one row
        for i, (g, h) in enumerate(wanted):
            m = len(g)
            own, values = values[: m + len(h)], values[m + len(h) :]
            if i not in open_ones:
                continue
            penalty = np.array([0.0] + [problems[i].ridge] * (m - 1))
            step = np.linalg.solve(_square(own[m:], m) + np.diag(penalty + 1e-9), np.array(own[:m], float) - penalty * found[i])
            found[i] = found[i] + step
            if np.abs(step).max() < tolerance:
                open_ones.discard(i)
    return found


def chance(problem: Problem, beta: np.ndarray) -> Column:
    """The probability that a fitted problem gives."""
    return _chance(problem.columns(), _literals(beta))


def cluster_covariance(rows: DataFrame, problem: Problem, beta: np.ndarray, label: str, cluster: str) -> tuple[np.ndarray, int]:
    """(covariance, clusters): the sandwich of the information and the outer products of the clusters' scores, times G / (G - 1)."""
    y, m = F.col(label).cast("double"), len(beta)
    gradient, information = _sums(problem, _literals(beta), y)
    scores = rows.groupBy(cluster).agg(*[c.alias(f"u{i}") for i, c in enumerate(gradient)], *[c.alias(f"h{i}") for i, c in enumerate(information)], F.count_if(problem.rows).alias("n")).where("n > 0")
    meat = [F.sum(F.col(f"u{i}") * F.col(f"u{j}")) for i in range(m) for j in range(i, m)]
    found = scores.agg(F.count("*"), *meat, *[F.sum(f"h{i}") for i in range(len(information))]).first()
    groups, k = found[0], m * (m + 1) // 2
    bread = np.linalg.inv(_square(list(found[1 + k :]), m))
    return bread @ _square(list(found[1 : 1 + k]), m) @ bread * groups / max(groups - 1, 1), groups
