"""Logistic, Poisson and multinomial models from compressed data."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sumwell.functions.columns import col, free, hash_fraction, usable
from sumwell.functions.formula import parse
from sumwell.functions.solve import LOG_RATE_BOUND, PROBABILITY_MARGIN, iterate, logistic_newton, logistic_parts, multinomial_newton, multinomial_parts, newton_step, poisson_newton, poisson_parts, sigmoid
from sumwell.operators.base import Estimator, sandwich
from sumwell.plans.compress import class_counts, class_names, label_names, label_sums, stat_names, strata
from sumwell.sources.tables import TooManyRows, fetch

#: Smallest pilot of the one-step estimator.
MIN_PILOT = 200


class CanonicalGLM(Estimator):
    """One outcome with the canonical link.

    ``irls`` iterates Newton steps on the compressed table.  ``one_step``
    fits a pilot of about N^(5/9) rows and takes a single step from there on
    all data; the pilot is the rows whose hash of ``row_key`` (of all used
    columns if none is given) is below a threshold, so it repeats.  More than
    ``max_rows`` covariate patterns stay where they are, and each step is one
    aggregation over them.
    """

    newton = parts = None

    def __init__(self, source, formula: str, *, method: str = "one_step", subsample_exponent: float = 5 / 9, max_iter: int = 100, tol: float = 1e-10, row_key: str | None = None, **options):
        super().__init__(source, **options)
        if method not in ("irls", "one_step"):
            raise ValueError("the method is irls or one_step")
        if self.n_bootstraps:
            raise NotImplementedError("generalised models have no bootstrap")
        f = parse(formula, many_outcomes=False)
        self.x, self.y, self.row_key = list(f.covariates), f.outcomes[0], row_key
        self.method, self.exponent, self.max_iter, self.tol = method, subsample_exponent, max_iter, tol

    def prepare_data(self) -> None:
        self.design = usable(self.data, [*self.x, self.y], [self.row_key] if self.row_key else [], self.nulls)

    def compress_data(self) -> None:
        self.compressed = strata(self.design, self.x, [self.y])
        count, (total,), (square,) = self.stats = stat_names(list(dict.fromkeys(self.x)), [self.y])
        try:
            g = fetch(self.compressed, self.max_rows)
        except TooManyRows:  # patterns stay where they are; each Newton step sums over them
            self.groups, self.compressed = None, self.compressed.persist()
            facts = self.compressed.agg(F.sum(col(count)).alias("n"), F.sum(col(total)).alias("s")).first()
            self.n, self.s = np.array([float(facts["n"])]), np.array([float(facts["s"])])
            return
        self.groups = g.sort_values(self.x, kind="stable", ignore_index=True) if self.x else g
        self.design_matrix, self.n, self.s = self._arrays(self.groups)

    def _arrays(self, g: pd.DataFrame):
        x = np.column_stack([np.ones(len(g)), *[g[c].to_numpy(dtype=float) for c in self.x]])
        return x, g[self.stats[0]].to_numpy(dtype=float), g[self.stats[1][0]].to_numpy(dtype=float)

    def pilot(self):
        total = int(self.n.sum())
        size = min(max(int(np.ceil(total**self.exponent)), MIN_PILOT), total, self.max_rows)
        keys = [self.row_key] if self.row_key else self.design.columns
        rows = self.design if size == total else self.design.where(hash_fraction(keys, self.seed or 0) < size / total)
        return self._arrays(fetch(strata(rows, self.x, [self.y]), self.max_rows))

    def estimate(self) -> np.ndarray:
        newton, parts = type(self).newton, type(self).parts
        if self.groups is None:
            if self.method == "irls":
                return iterate(self.start(), self.far_parts, self.max_iter, self.tol)
            beta = newton(*self.pilot(), self.max_iter, self.tol)
            g, h = self.far_parts(beta)
            return beta + newton_step(h, g)
        if not len(self.n):
            return np.full(1 + len(self.x), np.nan)
        if self.method == "irls":
            return newton(self.design_matrix, self.n, self.s, self.max_iter, self.tol)
        beta = newton(*self.pilot(), self.max_iter, self.tol)
        g, h = parts(self.design_matrix, self.n, self.s, beta)
        return beta + newton_step(h, g)

    def _far(self, beta: np.ndarray):
        """Columns of the design, count, sum, sum of squares, and the mean at beta, of a pattern."""
        z = [F.lit(1.0), *[col(c) for c in self.x]]
        eta = sum((c * F.lit(float(b)) for c, b in zip(z, beta, strict=True)), F.lit(0.0))
        return z, col(self.stats[0]), col(self.stats[1][0]), col(self.stats[2][0]), self.mean_column(eta)

    def far_parts(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and information, summed over the patterns where they are: p(p+3)/2 numbers."""
        z, n, s, _, mean = self._far(beta)
        k = len(z)
        rows = self.compressed.select((s - n * mean).alias("_u"), (n * self.weight_column(mean)).alias("_w"), *[c.alias(f"_z{i}") for i, c in enumerate(z)])
        at = lambda i: F.col(f"_z{i}")
        row = rows.agg(*[F.sum(F.col("_u") * at(i)).alias(f"g{i}") for i in range(k)], *[F.sum(F.col("_w") * at(i) * at(j)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        return np.array([row[f"g{i}"] for i in range(k)]), np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])

    def far_scores(self, beta: np.ndarray, by_stratum: bool) -> np.ndarray:
        """Sum of u u' by pattern, or by observation."""
        z, n, s, q, mean = self._far(beta)
        square = F.pow(s - n * mean, 2) if by_stratum else q - 2 * mean * s + n * mean * mean
        rows, k = self.compressed.select(square.alias("_q"), *[c.alias(f"_z{i}") for i, c in enumerate(z)]), len(z)
        row = rows.agg(*[F.sum(F.col("_q") * F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        return np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])

    def start(self) -> np.ndarray:
        return np.zeros(1 + len(self.x))

    def terms(self) -> list[str]:
        return ["Intercept", *self.x]

    def fit_vcov(self, kind: str = "iid") -> np.ndarray:
        """``iid``: inverse information.  ``stratum``: scores summed per covariate pattern.  ``hc0``: scores per observation."""
        if self.groups is None:
            bread = np.linalg.pinv(self.far_parts(self.point_estimate)[1], hermitian=True)
            if kind not in ("iid", "stratum", "hc0"):
                raise ValueError("the variance is iid, stratum or hc0")
            self.vcov = bread if kind == "iid" else sandwich(bread, self.far_scores(self.point_estimate, kind == "stratum"))
            return self.vcov
        _, h = type(self).parts(self.design_matrix, self.n, self.s, self.point_estimate)
        bread = np.linalg.pinv(h, hermitian=True)
        mean = self.mean(self.design_matrix @ self.point_estimate)
        if kind == "iid":
            self.vcov = bread
        elif kind == "stratum":
            u = self.design_matrix * (self.s - self.n * mean)[:, None]
            self.vcov = sandwich(bread, u.T @ u)
        elif kind == "hc0":
            q = self.groups[self.stats[2][0]].to_numpy(dtype=float)
            square = q - 2 * mean * self.s + self.n * mean**2
            self.vcov = sandwich(bread, (self.design_matrix * square[:, None]).T @ self.design_matrix)
        else:
            raise ValueError("the variance is iid, stratum or hc0")
        return self.vcov


class LogisticRegression(CanonicalGLM):
    """Binary outcome (0/1)."""

    newton, parts, mean = staticmethod(logistic_newton), staticmethod(logistic_parts), staticmethod(sigmoid)

    @staticmethod
    def mean_column(eta: Column) -> Column:
        return F.least(F.greatest(1 / (1 + F.exp(-eta)), F.lit(PROBABILITY_MARGIN)), F.lit(1 - PROBABILITY_MARGIN))

    @staticmethod
    def weight_column(mean: Column) -> Column:
        return mean * (1 - mean)


class PoissonRegression(CanonicalGLM):
    """Counts, log link."""

    newton, parts, mean = staticmethod(poisson_newton), staticmethod(poisson_parts), staticmethod(lambda eta: np.exp(np.clip(eta, -30, 30)))

    @staticmethod
    def mean_column(eta: Column) -> Column:
        return F.exp(F.least(F.greatest(eta, F.lit(-LOG_RATE_BOUND)), F.lit(LOG_RATE_BOUND)))

    @staticmethod
    def weight_column(mean: Column) -> Column:
        return mean

    def start(self) -> np.ndarray:
        beta = super().start()
        beta[0] = np.log(max(self.s.sum() / max(self.n.sum(), 1e-300), 1e-8))
        return beta


class MultinomialLogit(Estimator):
    """``label ~ a + b``: log-odds of each label against a baseline, the last label in order unless given."""

    def __init__(self, source, formula: str, *, labels: Sequence | None = None, baseline=None, max_iter: int = 100, tol: float = 1e-10, **options):
        super().__init__(source, **options)
        if self.n_bootstraps:
            raise NotImplementedError("generalised models have no bootstrap")
        f = parse(formula, many_outcomes=False)
        self.x, self.y, self.given, self.baseline, self.max_iter, self.tol = list(f.covariates), f.outcomes[0], labels, baseline, max_iter, tol

    def prepare_data(self) -> None:
        self.design = usable(self.data, self.x, [self.y], self.nulls)
        labels = list(self.given) if self.given is not None else sorted(r[0] for r in self.design.select(col(self.y)).distinct().limit(10_001).collect())
        if len(labels) > 10_000:
            raise TooManyRows("more than 10,000 labels")
        if self.baseline is None:
            self.baseline = labels[-1]
        if self.baseline not in labels or len(labels) < 2:
            raise ValueError("there must be two labels at least, the baseline among them")
        self.labels = [v for v in labels if v != self.baseline]

    def compress_data(self) -> None:
        self.compressed = class_counts(self.design, self.x, self.y, [*self.labels, self.baseline])
        g = fetch(self.compressed, self.max_rows)
        self.groups = g.sort_values(self.x, kind="stable", ignore_index=True) if self.x else g
        self.design_matrix = np.column_stack([np.ones(len(g)), *[self.groups[c].to_numpy(dtype=float) for c in self.x]])
        self.counts = self.groups[class_names(self.x, len(self.labels) + 1)].to_numpy(dtype=float)

    def estimate(self) -> np.ndarray:
        return multinomial_newton(self.design_matrix, self.counts, self.max_iter, self.tol)

    def fit_vcov(self) -> np.ndarray:
        """Inverse information, stacked by label."""
        self.vcov = np.linalg.pinv(multinomial_parts(self.design_matrix, self.counts, self.point_estimate.ravel())[1], hermitian=True)
        return self.vcov

    def standard_error(self):
        return None if self.vcov is None else super().standard_error().reshape(self.point_estimate.shape)

    def terms(self) -> list[str]:
        return [f"{v}:{t}" for v in self.labels for t in ["Intercept", *self.x]]

    def summary(self) -> dict:
        return {"labels": self.labels, "baseline": self.baseline, **super().summary()}


class LabelPoisson(Estimator):
    """An independent Poisson regression of ``count_col`` for each label; many labels are fitted where their groups are."""

    def __init__(self, source, count_col: str, label_col: str, covars: Sequence[str], labels: Sequence | None = None, *, max_iter: int = 100, tol: float = 1e-10, **options):
        super().__init__(source, **options)
        if self.n_bootstraps:
            raise NotImplementedError("generalised models have no bootstrap")
        self.y, self.label, self.x, self.labels, self.max_iter, self.tol = count_col, label_col, list(covars), labels, max_iter, tol

    def prepare_data(self) -> None:
        self.design = usable(self.data, [*self.x, self.y], [self.label], self.nulls)
        if self.labels is not None:
            self.design = self.design.where(col(self.label).isin(list(self.labels)))

    def compress_data(self) -> None:
        self.compressed = label_sums(self.design, self.label, self.x, self.y)

    def estimate(self) -> pd.DataFrame:
        x, tol, most, label = self.x, self.tol, self.max_iter, self.label
        rows, y = label_names(label, x)
        terms = ["Intercept", *x]

        def fit(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(x, kind="stable") if x else g
            design = np.column_stack([np.ones(len(g)), *[g[c].to_numpy(dtype=float) for c in x]])
            beta = poisson_newton(design, g[rows].to_numpy(dtype=float), g[y].to_numpy(dtype=float), most, tol)
            return pd.DataFrame({label: [g[label].iloc[0]], **{free(f"b{k}", [label]): [b] for k, b in enumerate(beta)}})

        kind = self.design.schema[label].dataType.simpleString()
        schema = ", ".join([f"`{label}` {kind}", *[f"{free(f'b{k}', [label])} double" for k in range(len(terms))]])
        out = fetch(self.compressed.groupBy(col(label)).applyInPandas(fit, schema), self.max_rows)
        out = out.set_index(label).sort_index()
        out.columns = terms
        return out if self.labels is None else out.reindex(list(self.labels))

    def terms(self) -> list[str]:
        return [f"{v}:{t}" for v in self.point_estimate.index for t in self.point_estimate.columns]

    def tidy(self) -> pd.DataFrame:
        return pd.DataFrame({"term": self.terms(), "estimate": self.point_estimate.to_numpy().ravel(), "se": np.nan})

    def summary(self) -> pd.DataFrame:
        return self.point_estimate
