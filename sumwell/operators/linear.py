"""Least squares from compressed data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwell.functions.columns import col, free, usable
from sumwell.functions.formula import parse
from sumwell.functions.solve import gram_solve, wls
from sumwell.operators.base import Estimator, covariance, sandwich
from sumwell.plans.compress import stat_names, strata
from sumwell.plans.moments import ClusterMoments, Moments, centred_moments, poisson_weight, score_products
from sumwell.sources.tables import TooManyRows, fetch


class LeastSquares(Estimator):
    """Regression of one or more outcomes on an intercept and numeric columns of ``self.design``.

    Rows that share their regressors are compressed and solved together.  If
    there are more than ``max_rows`` of such groups, as with continuous
    regressors, centred moments take their place: p(p+3)/2 numbers.
    """

    x: list[str]
    y: list[str]
    design: DataFrame
    cluster: str | None = None
    row_key: str | None = None
    compressible = True

    def compress_data(self) -> None:
        self.compressed, self.stats = strata(self.design, self.x, self.y), stat_names(list(dict.fromkeys(self.x)), self.y)
        self.groups = self.moments = None
        if self.compressible:
            try:
                g = fetch(self.compressed, self.max_rows)
                self.groups = g.sort_values(self.x, kind="stable", ignore_index=True) if self.x else g
                self.n = int(g[self.stats[0]].sum())
            except TooManyRows:
                pass
        if self.groups is None:
            self.moments: Moments = centred_moments(self.design, self.x, self.y)
            self.n = self.moments.n

    def matrix(self) -> np.ndarray:
        return np.column_stack([np.ones(len(self.groups)), *[self.groups[c].to_numpy(dtype=float) for c in self.x]])

    def counts(self) -> np.ndarray:
        return self.groups[self.stats[0]].to_numpy(dtype=float)

    def sums(self, square: bool = False) -> np.ndarray:
        return np.column_stack([self.groups[c].to_numpy(dtype=float) for c in self.stats[2 if square else 1]])

    def mean_frame(self):
        """The compressed table with the mean of each outcome."""
        return self.groups.assign(**{free(f"mean_{y}", self.groups.columns): self.groups[s] / self.groups[self.stats[0]] for y, s in zip(self.y, self.stats[1], strict=True)})

    def coefficients(self) -> np.ndarray:
        """(1 + regressors, outcomes)."""
        if self.n == 0:
            return np.full((1 + len(self.x), len(self.y)), np.nan)
        if self.moments is not None:
            return self.moments.coefficients()
        n = self.counts()
        return wls(self.matrix(), self.sums() / n[:, None], n)

    def estimate(self) -> np.ndarray:
        """Coefficients; of several outcomes, all of the first term before all of the second."""
        return self.coefficients().ravel()

    def terms(self) -> list[str]:
        names = ["Intercept", *self.x]
        return names if len(self.y) == 1 else [f"{t}_{y}" for t in names for y in self.y]

    def bread(self) -> np.ndarray:
        if self.moments is None:
            x = self.matrix()
            return np.linalg.pinv((x * self.counts()[:, None]).T @ x, hermitian=True)
        inner, a = np.linalg.pinv(self.moments.xx, hermitian=True), self.moments.x_mean
        corner = 1 / self.n + a @ inner @ a
        return np.block([[np.array([[corner]]), -(a @ inner)[None, :]], [-(inner @ a)[:, None], inner]])

    def fit_vcov(self, kind: str = "HC1") -> np.ndarray:
        """Variance of all outcomes' coefficients, block by outcome in the order of :meth:`terms`: iid, HC0, HC1 or CR1."""
        if self.point_estimate is None:
            raise RuntimeError("fit() first")
        p, m = 1 + len(self.x), len(self.y)
        if self.n == 0:
            self.vcov = np.full((p * m, p * m), np.nan)
            return self.vcov
        beta, bread = self.point_estimate.reshape(p, m), self.bread()
        out = np.zeros((p * m, p * m))
        clusters = self.cluster_moments() if kind == "CR1" else None
        for j in range(m):
            b = beta[:, j]
            if kind in ("HC0", "HC1"):
                if self.moments is None:
                    x, n, s, q = self.matrix(), self.counts(), self.sums()[:, j], self.sums(True)[:, j]
                    fitted = x @ b
                    rss = n * fitted**2 - 2 * fitted * s + q
                    meat = (x * rss[:, None]).T @ x
                else:
                    meat = score_products(self.design, self.x, self.y[j], b)
                v = sandwich(bread, meat) * (self.n / (self.n - p) if kind == "HC1" else 1.0)
            elif kind == "iid":
                v = bread * self.residual_sum(j, b) / (self.n - p)
            elif kind == "CR1":
                g = clusters.clusters
                v = sandwich(bread, clusters.scores(j, b)) * g / (g - 1) * (self.n - 1) / (self.n - p)
            else:
                raise ValueError("the variance is iid, HC0, HC1 or CR1")
            out[j::m, j::m] = v
        self.vcov = out
        return out

    def residual_sum(self, j: int, b: np.ndarray) -> float:
        if self.moments is None:
            x, n, s, q = self.matrix(), self.counts(), self.sums()[:, j], self.sums(True)[:, j]
            f = x @ b
            return float((n * f * f - 2 * f * s + q).sum())
        m = self.moments
        return float(m.yy[j, j] - 2 * b[1:] @ m.xy[:, j] + b[1:] @ m.xx @ b[1:])

    def cluster_moments(self) -> ClusterMoments:
        if self.cluster is None:
            raise ValueError("no cluster column was given")
        return ClusterMoments(self.design, self.x, self.y, self.cluster, self.max_rows, self.seed or 0)

    def bootstrap(self) -> np.ndarray:
        """Clusters drawn with replacement; without a cluster column, rows with Poisson(1) weights."""
        if self.cluster is not None:
            self.draws = self.cluster_moments().draws(self.n_bootstraps, self.rng)
        else:
            self.draws = self.row_draws()
        return covariance(self.draws)

    def row_draws(self, block: int = 25) -> np.ndarray:
        """Each row gets a weight hashed from its key and the draw; draws are summed in blocks, one scan per block."""
        key = [col(self.row_key)] if self.row_key else [col(c) for c in self.design.columns]
        out, p = [], 1 + len(self.x)
        centre = self.moments or centred_moments(self.design, self.x, self.y)
        z = [F.lit(1.0), *[col(c) - F.lit(float(m)) for c, m in zip([*self.x, *self.y], [*centre.x_mean, *centre.y_mean], strict=True)]]
        for lo in range(0, self.n_bootstraps, block):
            draw = F.explode(F.sequence(F.lit(lo), F.lit(min(lo + block, self.n_bootstraps) - 1)))
            rows = self.design.select(*[c.alias(f"z{k}") for k, c in enumerate(z)], F.xxhash64(*key).alias("key"), draw.alias("draw"))
            u = (F.xxhash64("key", "draw", F.lit(self.seed or 0)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")
            w = rows.withColumn("w", poisson_weight(u))
            pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
            sums = w.groupBy("draw").agg(*[F.sum(F.col("w") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"m{k}") for k, (i, j) in enumerate(pairs)])
            for r in sums.orderBy("draw").collect():  # a row per draw
                m = np.zeros((len(z), len(z)))
                for k, (i, j) in enumerate(pairs):
                    m[i, j] = m[j, i] = r[f"m{k}"]
                b = gram_solve(m[:p, :p], m[:p, p:])
                b[0] += centre.y_mean - centre.x_mean @ b[1:]
                out.append(b)
        return np.array(out)

    def strata_bootstrap(self, draws: int) -> np.ndarray:
        """Variance over resampled compressed rows instead of observations."""
        if self.groups is None:
            raise TooManyRows("the compressed table isn't on the driver")
        x, n, s = self.matrix(), self.counts(), self.sums()
        out = []
        for _ in range(draws):
            k = self.rng.integers(0, len(n), len(n))
            out.append(wls(x[k], s[k] / n[k][:, None], n[k]))
        self.draws = np.array(out)
        return covariance(self.draws)


class LinearRegression(LeastSquares):
    """``y1 + y2 ~ a + b`` by least squares, exactly as on the uncompressed rows.

    ``row_key`` names a unique column: it makes the row bootstrap independent
    of what other rows look like.  ``vcov`` HC1, CR1, HC0 or iid is computed
    by ``fit`` when given, and no bootstrap then runs.
    """

    def __init__(self, source, formula: str, *, cluster: str | None = None, row_key: str | None = None, n_bootstraps: int = 100, vcov: str | None = None, **options):
        super().__init__(source, n_bootstraps=0 if vcov else n_bootstraps, **options)
        self.formula, self.cluster, self.row_key, self.kind = parse(formula), cluster, row_key, vcov
        self.x, self.y = list(self.formula.covariates), list(self.formula.outcomes)

    def prepare_data(self) -> None:
        self.design = usable(self.data, [*self.x, *self.y], [c for c in (self.cluster, self.row_key) if c], self.nulls)

    def fit(self):
        super().fit()
        if self.kind:
            self.fit_vcov(self.kind)
        return self
