"""Ridge regression from compressed data, with a penalty path and cross-validation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwell.functions.columns import col, ordered_index, usable
from sumwell.functions.formula import parse
from sumwell.functions.solve import ridge_closed_form, ridge_closed_form_batch
from sumwell.operators.base import Estimator
from sumwell.plans.compress import stat_names, strata
from sumwell.sources.tables import TooManyRows, fetch


def fold_column(df: DataFrame, key: str, k: int, how: str = "hash", seed: int = 42) -> DataFrame:
    """Adds fold_id in 0..k-1: hashed from a unique key, or dealt in the order of the key, starting with 1."""
    if how == "hash":
        return df.withColumn("fold_id", F.pmod(F.xxhash64(col(key), F.lit(seed)), F.lit(k)).cast("int"))
    if how == "ordered":
        return ordered_index(df, [key], "_at").withColumn("fold_id", ((F.col("_at") + 1) % k).cast("int")).drop("_at")
    raise ValueError("folds are hash or ordered")


class Ridge(Estimator):
    """Minimises the weighted squares plus lambda times the squared coefficients, the intercept's among them unless told otherwise.

    ``fit`` selects the penalty: by cross-validation with more than one fold
    (``selection="cv"``), as the middle of the grid (``"path"``), or the first.
    Cross-validation compares means of compressed rows; within-group variance
    is missing from the scores and is the same for all penalties.  More than
    ``max_rows`` compressed rows are summed to products by fold where they are.
    """

    def __init__(self, source, formula: str, lambda_grid: Sequence[float] | None = None, cv_folds: int = 5, *, selection: str = "cv", penalize_intercept: bool = True, fold_key: str | None = None, folds: str = "hash", **options):
        super().__init__(source, **options)
        if self.n_bootstraps:
            raise NotImplementedError("ridge has no bootstrap")
        f = parse(formula, many_outcomes=False)
        self.x, self.y = list(f.covariates), f.outcomes[0]
        self.lambda_grid = np.logspace(-4, 2, 50) if lambda_grid is None else np.asarray(lambda_grid, dtype=float)
        self.cv_folds, self.selection, self.fold_key, self.folds = cv_folds, selection, fold_key, folds
        self.penalize = np.array([1.0 if penalize_intercept else 0.0, *np.ones(len(self.x))])
        self.best_lambda = self.cv_scores = self.lambda_path_coefs = None

    def _use_cv(self) -> bool:
        return self.selection == "cv" and self.cv_folds > 1

    def prepare_data(self) -> None:
        rows = usable(self.data, [self.y, *self.x], [self.fold_key] if self.fold_key and self.fold_key not in self.x else [], self.nulls)
        if self._use_cv():
            if not self.fold_key:
                raise ValueError("cross-validation needs a fold_key, a column that tells rows apart")
            rows = fold_column(rows, self.fold_key, self.cv_folds, self.folds, self.seed or 0)
        self.design = rows

    def compress_data(self) -> None:
        self.compressed = strata(self.design, self.x, [self.y], ["fold_id"] if self._use_cv() else [])
        self.stats = stat_names(list(dict.fromkeys([*self.x, *(["fold_id"] if self._use_cv() else [])])), [self.y])
        try:
            g = fetch(self.compressed, self.max_rows)
        except TooManyRows:
            self.groups = None
            self.products = self._products()
            return
        self.groups = g.sort_values([*self.x, *(["fold_id"] if self._use_cv() else [])], kind="stable", ignore_index=True) if len(g.columns) > 3 else g

    def _arrays(self, g: pd.DataFrame):
        x = np.column_stack([np.ones(len(g)), *[g[c].to_numpy(dtype=float) for c in self.x]])
        n = g[self.stats[0]].to_numpy(dtype=float)
        return x, g[self.stats[1][0]].to_numpy(dtype=float) / n, n

    def _products(self) -> dict[int, tuple[np.ndarray, np.ndarray, float, float]]:
        """By fold: X'NX, X's, the sum of s^2 / n, and n, summed where the compressed rows are."""
        z, n, s = [F.lit(1.0), *[col(c) for c in self.x]], col(self.stats[0]), col(self.stats[1][0])
        k = len(z)
        fold = F.col("fold_id") if self._use_cv() else F.lit(0)
        rows = self.compressed.select(fold.alias("_f"), n.cast("double").alias("_n"), s.alias("_s"), *[c.alias(f"_z{i}") for i, c in enumerate(z)])
        at = lambda i: F.col(f"_z{i}")
        sums = [F.sum(F.col("_n") * at(i) * at(j)).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col("_s") * at(i)).alias(f"b{i}") for i in range(k)]
        out = {}
        for r in rows.groupBy("_f").agg(*sums, F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("q"), F.sum("_n").alias("n")).collect():  # a row per fold
            out[r["_f"]] = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]), np.array([r[f"b{i}"] for i in range(k)]), r["q"], r["n"]
        return out

    def _far_path(self, folds) -> np.ndarray:
        a, b = (sum((self.products[f][k] for f in folds), 0.0) for k in (0, 1))
        return np.array([np.linalg.lstsq(a + lam * np.diag(self.penalize), b, rcond=None)[0] for lam in self.lambda_grid])

    def _far_cv(self) -> np.ndarray:
        total = np.zeros(len(self.lambda_grid))
        for f, (a, b, q, n) in self.products.items():
            rest = [g for g in self.products if g != f]
            if rest:
                path = self._far_path(rest)
                total += (q - 2 * path @ b + np.einsum("li,ij,lj->l", path, a, path)) / n
        return total / self.cv_folds

    def fit_lambda_path(self) -> np.ndarray:
        if self.groups is None:
            self.lambda_path_coefs = self._far_path(self.products)
            return self.lambda_path_coefs
        self.lambda_path_coefs = ridge_closed_form_batch(*self._arrays(self.groups), self.lambda_grid, self.penalize)
        return self.lambda_path_coefs

    def cross_validate(self) -> np.ndarray:
        """Mean over folds of the weighted squared error of held-out means, per penalty; an empty fold adds 0."""
        if self.groups is None:
            self.cv_scores = self._far_cv()
            return self.cv_scores
        total = np.zeros(len(self.lambda_grid))
        for k in range(self.cv_folds):
            held = self.groups["fold_id"] == k
            if not held.any() or held.all():
                continue
            path = ridge_closed_form_batch(*self._arrays(self.groups[~held]), self.lambda_grid, self.penalize)
            x, y, n = self._arrays(self.groups[held])
            total += (n[:, None] * (y[:, None] - x @ path.T) ** 2).sum(axis=0) / n.sum()
        self.cv_scores = total / self.cv_folds
        return self.cv_scores

    def estimate(self) -> np.ndarray:
        self.fit_lambda_path()
        if self._use_cv():
            self.best_lambda = float(self.lambda_grid[int(np.argmin(self.cross_validate()))])
        else:
            self.best_lambda = float(self.lambda_grid[len(self.lambda_grid) // 2 if self.selection == "path" else 0])
        if self.groups is None:
            return self.lambda_path_coefs[int(np.flatnonzero(self.lambda_grid == self.best_lambda)[0])]
        return ridge_closed_form(*self._arrays(self.groups), self.best_lambda, self.penalize)

    def terms(self) -> list[str]:
        return ["Intercept", *self.x]

    def summary(self) -> dict:
        more = {"best_lambda": self.best_lambda, "cv_scores": self.cv_scores, "lambda_grid": self.lambda_grid, "lambda_path_coefs": self.lambda_path_coefs}
        return super().summary() | {k: v for k, v in more.items() if v is not None}

    def cv_curve(self) -> pd.DataFrame:
        """lambda and score, ready to plot."""
        return pd.DataFrame({"lambda": self.lambda_grid, "score": self.cv_scores})

    def coefficient_path(self) -> pd.DataFrame:
        """lambda and the coefficients, ready to plot."""
        return pd.DataFrame(self.lambda_path_coefs, columns=self.terms()).assign(**{"lambda": self.lambda_grid})
