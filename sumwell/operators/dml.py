"""Partialling-out with leave-one-out stratum means, for double machine learning with discrete confounders."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwell.functions.columns import col, free, usable
from sumwell.operators.base import Estimator, covariance, sandwich
from sumwell.plans.moments import weighted_draws
from sumwell.sources.tables import TooManyRows, fetch


class PartialOut(Estimator):
    """Residuals of outcome and treatments on the mean of all other rows of the stratum, regressed on each other.

    Strata are the combinations of ``discrete_covars``; singletons drop out.
    With n rows and centred sums of squares S in a stratum, leave-one-out
    residuals have the products (n / (n-1))^2 S, so that one row per stratum
    holds all that is needed, and k(k+3)/2 numbers come to the driver.
    The estimate is NaN if nothing is left or the treatments are collinear.
    """

    def __init__(self, source, outcome_var: str, treatment_var: str | Sequence[str], discrete_covars: Sequence[str], n_bootstraps: int = 200, **options):
        super().__init__(source, n_bootstraps=n_bootstraps, **options)
        self.y, self.x, self.by = outcome_var, [treatment_var] if isinstance(treatment_var, str) else list(treatment_var), list(discrete_covars)

    def prepare_data(self) -> None:
        self.design = usable(self.data, [self.y, *self.x], self.by, self.nulls)

    def _names(self) -> list[tuple[int, int, str]]:
        k = len(self.x)
        return [(i, j, free(f"c{i}_{j}", self.by)) for i in range(k + 1) for j in range(i, k + 1)]

    @property
    def count(self) -> str:
        return free("count", self.by)

    def compress_data(self) -> None:
        v = [*self.x, self.y]
        n = F.count("*")
        products = [(F.covar_pop(col(v[i]), col(v[j])) * n).alias(name) for i, j, name in self._names()]
        self.compressed = self.design.groupBy(*[col(c) for c in self.by]).agg(n.alias(self.count), *[F.sum(col(c)).alias(free(f"s{k}", self.by)) for k, c in enumerate(v)], *products).where(col(self.count) > 1).persist()

    def _factor(self) -> Column:
        return F.pow(col(self.count) / (col(self.count) - 1), 2)

    def _sums(self, weights: Column | None = None) -> np.ndarray:
        """Sum over strata of factor * weight * S."""
        w = self._factor() if weights is None else self._factor() * weights
        row = self.compressed.agg(F.sum(col(self.count)).alias("n"), *[F.sum(w * F.col(name)).alias(name) for _, _, name in self._names()]).first()
        self.n = int(row["n"] or 0)
        return self._square(row)

    def _square(self, row) -> np.ndarray:
        out = np.zeros((len(self.x) + 1,) * 2)
        for i, j, name in self._names():
            out[i, j] = out[j, i] = np.nan if row[name] is None else row[name]
        return out

    def _solve(self, m: np.ndarray) -> np.ndarray:
        k = len(self.x)
        a, b = m[:k, :k], m[:k, k]
        if not np.isfinite(m).all() or np.linalg.matrix_rank(a, hermitian=True) < k:
            return np.full(k, np.nan)
        return np.linalg.solve(a, b)

    def estimate(self) -> np.ndarray:
        self.total = self._sums()
        return self._solve(self.total)

    def fit_vcov(self) -> np.ndarray:
        """Analytic variance with equal error variance within a stratum and the factor N / (N - k)."""
        k, beta = len(self.x), self.point_estimate
        bread = np.linalg.pinv(self.total[:k, :k], hermitian=True)
        f = self._factor()
        name = {(i, j): c for i, j, c in self._names()}
        rss = F.col(name[k, k])
        for i in range(k):
            rss = rss - F.lit(2 * float(beta[i])) * F.col(name[i, k])
            for j in range(k):
                rss = rss + F.lit(float(beta[i] * beta[j])) * F.col(name[min(i, j), max(i, j)])
        m = self._sums(f * rss / col(self.count))[:k, :k]
        self.vcov = sandwich(bread, m) * self.n / (self.n - k)
        return self.vcov

    def bootstrap(self) -> np.ndarray:
        """Strata drawn with replacement; more than ``max_rows`` get Poisson(1) weights hashed from their keys, where they are."""
        try:
            g = fetch(self.compressed, self.max_rows).sort_values(self.by, kind="stable")
        except TooManyRows:
            w = self._factor() * F.col("_w")
            drawn = weighted_draws(self.compressed, self.by, self.n_bootstraps, self.seed or 0)
            sums = drawn.groupBy("_draw").agg(*[F.sum(w * F.col(name)).alias(name) for _, _, name in self._names()])
            self.draws = np.array([self._solve(self._square(r)) for r in sums.orderBy("_draw").collect()])  # a row per draw
            return covariance(self.draws[np.isfinite(self.draws).all(axis=1)])
        f = (g[self.count] / (g[self.count] - 1)).to_numpy() ** 2
        rows = g[[name for _, _, name in self._names()]].to_numpy() * f[:, None]
        out = []
        for _ in range(self.n_bootstraps):
            w = np.bincount(self.rng.integers(0, len(rows), len(rows)), minlength=len(rows))
            out.append(self._solve(self._square(dict(zip((name for _, _, name in self._names()), w @ rows, strict=True)))))
        self.draws = np.array(out)
        return covariance(self.draws[np.isfinite(self.draws).all(axis=1)])

    def terms(self) -> list[str]:
        return list(self.x)


def leave_one_out_residuals(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Each column less the mean of the other rows of its stratum, as loo_{column}; singletons drop out."""
    groups = df.groupBy(*[col(c) for c in by]).agg(F.count("*").alias("_n"), *[F.avg(col(c)).alias(f"_a{k}") for k, c in enumerate(columns)]).where(F.col("_n") > 1)
    out = df.join(groups, list(by))
    return out.select(*[col(c) for c in df.columns], *[((col(c) - F.col(f"_a{k}")) * F.col("_n") / (F.col("_n") - 1)).alias(f"loo_{c}") for k, c in enumerate(columns)])
