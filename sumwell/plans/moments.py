"""Centred moments: what a linear model needs when its regressors don't repeat.

Products of uncentred columns lose about half of the digits of a double, so
means come first and products of deviations second: two scans, p(p+3)/2
numbers to the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwell.functions.columns import col
from sumwell.functions.solve import gram_solve


@dataclass
class Moments:
    """n, means, and sums of products of deviations from ``centre`` of the regressors x and outcomes y."""

    n: float
    x_mean: np.ndarray
    y_mean: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray

    def coefficients(self) -> np.ndarray:
        """(1 + regressors, outcomes), the intercept first."""
        slope = gram_solve(self.xx, self.xy) if len(self.x_mean) else np.zeros((0, len(self.y_mean)))
        return np.vstack([self.y_mean - self.x_mean @ slope, slope])


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _column_sums(z: Sequence[Column]) -> list[Column]:
    return [F.sum(z[i] * z[j]).alias(f"m{k}") for k, (i, j) in enumerate(_pairs(len(z)))]


def _square(row, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for m, (i, j) in enumerate(_pairs(k)):
        out[i, j] = out[j, i] = row[f"m{m}"] or 0.0
    return out


def means(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    row = df.agg(F.count("*").alias("n"), *[F.avg(col(c)).alias(f"a{k}") for k, c in enumerate(columns)]).first()
    return row["n"], np.array([row[f"a{k}"] if row["n"] else np.nan for k in range(len(columns))], dtype=float)


def centred_moments(df: DataFrame, x: Sequence[str], y: Sequence[str]) -> Moments:
    n, centre = means(df, [*x, *y])
    z = [col(c) - F.lit(float(m)) for c, m in zip([*x, *y], centre, strict=True)]
    m = _square(df.agg(*_column_sums(z)).first(), len(z))
    p = len(x)
    return Moments(n, centre[:p], centre[p:], m[:p, :p], m[:p, p:], m[p:, p:])


def score_products(df: DataFrame, x: Sequence[str], y: str, beta: np.ndarray) -> np.ndarray:
    """Sum of e^2 z z' for z = (1, x) and residuals e at ``beta``: the middle of a robust variance."""
    z = [F.lit(1.0), *[col(c) for c in x]]
    e = col(y) - sum((c * F.lit(float(b)) for c, b in zip(z, beta, strict=True)), F.lit(0.0))
    rows = df.select(e.alias("_e"), *[c.alias(f"_z{k}") for k, c in enumerate(z)])
    return _square(rows.agg(*_column_sums([F.col("_e") * F.col(f"_z{k}") for k in range(len(z))])).first(), len(z))


class ClusterMoments:
    """Moments of z = (1, x - mean, y - mean) per cluster, one row each; a draw of clusters is a weighted sum of rows.

    A first aggregation runs per cluster with partial sums before the
    shuffle.  Up to ``limit`` clusters come to the driver, where draws have
    multinomial weights.  With more, draws are Poisson(1) weights hashed from
    the cluster's key and are summed where the rows are.
    """

    def __init__(self, df: DataFrame, x: Sequence[str], y: Sequence[str], cluster: str, limit: int, weight_seed: int = 0):
        self.x, self.y, self.seed = list(x), list(y), weight_seed
        self.n, self.centre = means(df, [*x, *y])
        z = [F.lit(1.0), *[col(c) - F.lit(float(m)) for c, m in zip([*x, *y], self.centre, strict=True)]]
        self.k = len(z)
        self.rows = df.groupBy(col(cluster).alias("cluster")).agg(*_column_sums(z)).persist()
        self.clusters = self.rows.count()
        self.local = self.clusters <= limit
        if self.local:
            got = self.rows.toPandas().sort_values("cluster", key=lambda s: s.astype(str), kind="stable")
            self.values = got[[f"m{k}" for k in range(len(_pairs(self.k)))]].to_numpy(dtype=float)
            self.rows.unpersist()

    def square(self, v: np.ndarray) -> np.ndarray:
        return _square({f"m{k}": x for k, x in enumerate(v)}, self.k)

    def coefficients(self, m: np.ndarray) -> np.ndarray:
        p = 1 + len(self.x)
        b = gram_solve(m[:p, :p], m[:p, p:])
        b[0] += self.centre[len(self.x) :] - self.centre[: len(self.x)] @ b[1:]
        return b

    def draws(self, count: int, rng: np.random.Generator) -> np.ndarray:
        """Coefficients (draws, 1 + regressors, outcomes)."""
        if self.local:
            out = []
            for _ in range(count):
                w = np.bincount(rng.integers(0, self.clusters, self.clusters), minlength=self.clusters)
                out.append(self.coefficients(self.square(w @ self.values)))
            return np.array(out)
        u = (F.xxhash64("cluster", "draw", F.lit(self.seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")
        rows = self.rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(count)))).withColumn("w", poisson_weight(u))
        sums = rows.groupBy("draw").agg(*[F.sum(F.col(f"m{k}") * F.col("w")).alias(f"m{k}") for k in range(len(_pairs(self.k)))])
        return np.array([self.coefficients(_square(r, self.k)) for r in sums.orderBy("draw").toPandas().to_dict("records")])

    def scores(self, outcome: int, beta: np.ndarray) -> np.ndarray:
        """Sum over clusters of u u', for u = sum of (1, x) e in the cluster at ``beta``."""
        p, k = 1 + len(self.x), 1 + len(self.x) + outcome
        centre = self.centre[: len(self.x)]
        b = beta.copy()
        b[0] += centre @ beta[1:] - self.centre[len(self.x) + outcome]
        shift = np.eye(p)
        shift[1:, 0] = centre  # back from deviations to the columns themselves
        values = self.values if self.local else None
        if values is not None:
            total = np.zeros((p, p))
            for v in values:
                m = self.square(v)
                u = shift @ (m[:p, k] - m[:p, :p] @ b)
                total += np.outer(u, u)
            return total
        pair = {ij: n for n, ij in enumerate(_pairs(self.k))}
        at = lambda i, j: F.col(f"m{pair[(min(i, j), max(i, j))]}")
        raw = [at(i, k) - sum((at(i, j) * F.lit(float(b[j])) for j in range(p)), F.lit(0.0)) for i in range(p)]
        u = [sum((r * F.lit(float(shift[i, j])) for j, r in enumerate(raw)), F.lit(0.0)) for i in range(p)]
        named = self.rows.select(*[c.alias(f"u{i}") for i, c in enumerate(u)])
        return _square(named.agg(*_column_sums([F.col(f"u{i}") for i in range(p)])).first(), p)


def poisson_weight(u: Column, most: int = 12) -> Column:
    """Poisson(1) by inversion of a uniform number."""
    total, term, out = 0.0, np.exp(-1.0), F.lit(most)
    steps = []
    for k in range(most):
        total += term
        steps.append((k, total))
        term /= k + 1
    for k, t in reversed(steps):
        out = F.when(u < t, k).otherwise(out)
    return out.cast("double")


def weighted_draws(rows: DataFrame, keys: Sequence[str], count: int, seed: int, first: int = 0) -> DataFrame:
    """The rows once per draw from ``first`` on, with the number of the draw as _draw and a Poisson(1) weight hashed from keys and draw as _w."""
    drawn = rows.withColumn("_draw", F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))))
    u = (F.xxhash64(*[col(k) for k in keys], "_draw", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")
    return drawn.withColumn("_w", poisson_weight(u))


def tidy(terms: Sequence[str], estimate: np.ndarray, se: np.ndarray | None) -> pd.DataFrame:
    return pd.DataFrame({"term": list(terms), "estimate": np.ravel(estimate), "se": np.full(len(terms), np.nan) if se is None else np.ravel(se)})
