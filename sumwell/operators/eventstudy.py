"""Event studies with cohort-by-time effects, from the table of cells."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwell.functions.columns import col, usable
from sumwell.functions.solve import wls
from sumwell.operators.base import Estimator, covariance
from sumwell.plans.moments import weighted_draws
from sumwell.sources.tables import TooManyRows, fetch


def with_cohort(df: DataFrame, unit: str, time: str, treatment: str) -> DataFrame:
    """Adds cohort, the first time at which the unit's treatment is 1; null if there is none.

    Units are joined, not windowed: a unit may have any number of rows.
    """
    first = df.where(col(treatment) == 1).groupBy(col(unit)).agg(F.min(col(time)).alias("cohort"))
    return df.join(first, unit, "left")


def design(cells: pd.DataFrame, cohorts: Sequence[int], last: int, pre_treat: bool) -> tuple[np.ndarray, list[str]]:
    """0/1 columns of cells (cohort, time, w): intercept, cohorts, all times, and cohort by time but for the period before."""
    c, t, w = cells["cohort"].to_numpy(dtype=float), cells["time"].to_numpy(dtype=int), cells["w"].to_numpy(dtype=float)
    columns, names = [np.ones(len(cells))], ["intercept"]
    for g in cohorts:
        columns.append(c == g)
        names.append(f"cohort_{g}")
    for i in range(last + 1):
        columns.append(t == i)
        names.append(f"time_{i}")
    for g in cohorts:
        for i in range(last + 1):
            if i != g - 1:
                columns.append((c == g) & (t == i) & (pre_treat | (w == 1)))
                names.append(f"treatment_time_{g}_{i}")
    return np.column_stack(columns).astype(float), names


def effects(beta: np.ndarray, names: Sequence[str], cohorts: Sequence[int], last: int) -> dict[str, pd.Series]:
    """Effects by cohort and time; zero in the reference period."""
    at = dict(zip(names, beta, strict=True))
    return {str(g): pd.Series([at.get(f"treatment_time_{g}_{i}", 0.0) for i in range(last + 1)], index=pd.RangeIndex(last + 1, name="time")) for g in cohorts}


class CellModel(Estimator):
    """Least squares on the cells (cohort, time, w) with counts and sums of y.  Times are whole numbers from 0.

    Solved with minimum norm, as intercept and time columns are collinear.
    Without never-treated units, and for a cohort treated from time 0, effects
    are not identified: ``identified`` tells for which they are.
    """

    pre_treat = True
    cells: pd.DataFrame

    def estimate(self) -> dict[str, pd.Series]:
        g = self.cells
        self.cohorts = sorted(int(c) for c in g["cohort"].dropna().unique())
        self.last = int(g["time"].max()) if len(g) else -1
        self.matrix, self.names = design(g, self.cohorts, self.last, self.pre_treat)
        n = g["count"].to_numpy(dtype=float)
        self.beta = wls(self.matrix, g["sum_y"].to_numpy(dtype=float) / n, n)
        u, s, vt = np.linalg.svd(self.matrix, full_matrices=False)
        self.rank = int((s > s.max(initial=0) * 1e-10).sum())
        null = np.eye(self.matrix.shape[1]) - vt[: self.rank].T @ vt[: self.rank]
        self.identified = pd.Series(np.abs(null).max(axis=1) < 1e-8, index=self.names)
        if self.cohorts and not self.identified[[k for k in self.names if k.startswith("treatment")]].all():
            warnings.warn("some cohort effects are not identified; minimum-norm values are given", stacklevel=3)
        return effects(self.beta, self.names, self.cohorts, self.last)

    def terms(self) -> list[str]:
        return [f"{g}:{i}" for g, s in self.point_estimate.items() for i in s.index]

    def flat(self, est: dict[str, pd.Series]) -> np.ndarray:
        return np.concatenate([s.to_numpy() for s in est.values()]) if est else np.empty(0)

    def tidy(self) -> pd.DataFrame:
        se = np.full(len(self.terms()), np.nan) if self.vcov is None else np.concatenate([np.sqrt(np.clip(np.diag(v), 0, None)) for v in self.vcov.values()])
        return pd.DataFrame({"term": self.terms(), "estimate": self.flat(self.point_estimate), "se": se})

    def by_cohort(self, draws: np.ndarray) -> dict[str, np.ndarray]:
        k = self.last + 1
        return {g: covariance(draws[:, m * k : (m + 1) * k]) for m, g in enumerate(self.point_estimate)}

    def summary(self) -> dict:
        if self.vcov is None:
            return {"point_estimate": {g: s.to_frame("est") for g, s in self.point_estimate.items()}}
        return {g: pd.DataFrame({"point_estimate": s, "se": np.sqrt(np.clip(np.diag(self.vcov[g]), 0, None))}) for g, s in self.point_estimate.items()}


class EventStudy(CellModel):
    """Cohorts from first treatment.  ``pre_treat_interactions=False`` pools the periods before.

    Only (C+1) T cells come to the driver; 0/1 columns are made there.
    """

    def __init__(self, source, outcome_var: str, treatment_col: str, unit_col: str, time_col: str, cluster_col: str | None = None, pre_treat_interactions: bool = True, n_bootstraps: int = 100, **options):
        super().__init__(source, n_bootstraps=n_bootstraps, **options)
        self.y, self.w, self.unit, self.time, self.cluster, self.pre_treat = outcome_var, treatment_col, unit_col, time_col, cluster_col or unit_col, pre_treat_interactions

    def prepare_data(self) -> None:
        rows = usable(self.data, [self.y], list(dict.fromkeys([self.w, self.unit, self.time, self.cluster])), self.nulls)
        rows = with_cohort(rows, self.unit, self.time, self.w)
        w = F.lit(0) if self.pre_treat else (col(self.w) == 1).cast("int")
        self.design = rows.select(F.col("cohort").cast("int").alias("cohort"), col(self.time).cast("int").alias("time"), w.alias("w"), col(self.y).alias("y"), col(self.cluster).alias("cluster"))

    def compress_data(self) -> None:
        self.compressed = self.design.groupBy("cohort", "time", "w").agg(F.count("*").alias("count"), F.sum("y").alias("sum_y"), F.sum(F.col("y") * F.col("y")).alias("sum_y_sq"))
        self.cells = fetch(self.compressed, self.max_rows).sort_values(["cohort", "time", "w"], ignore_index=True)

    def bootstrap(self) -> dict[str, np.ndarray]:
        """Clusters drawn with replacement: one aggregation by cluster and cell, draws on the driver.

        More than ``max_rows`` of these get Poisson(1) weights hashed from the
        cluster, and are summed by cell where they are.
        """
        try:
            g = fetch(self.design.groupBy("cluster", "cohort", "time", "w").agg(F.count("*").alias("n"), F.sum("y").alias("s")), self.max_rows)
        except TooManyRows:
            return self._far_bootstrap()
        key = {k: i for i, k in enumerate(zip(self.cells["cohort"].fillna(-1), self.cells["time"], self.cells["w"], strict=True))}
        cell = np.array([key[k] for k in zip(g["cohort"].fillna(-1), g["time"], g["w"], strict=True)])
        code, names = pd.factorize(g["cluster"], sort=True)
        draws = []
        for _ in range(self.n_bootstraps):
            m = np.bincount(self.rng.integers(0, len(names), len(names)), minlength=len(names))[code]
            n = np.bincount(cell, m * g["n"], minlength=len(key))
            s = np.bincount(cell, m * g["s"], minlength=len(key))
            ok = n > 0
            beta = wls(self.matrix[ok], s[ok] / n[ok], n[ok])
            draws.append(self.flat(effects(beta, self.names, self.cohorts, self.last)))
        self.draws = np.array(draws)
        return self.by_cohort(self.draws)

    def _far_bootstrap(self, block: int = 25) -> dict[str, np.ndarray]:
        by = self.design.groupBy("cluster", "cohort", "time", "w").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
        cells = self.cells.assign(cohort=self.cells["cohort"].fillna(-1))[["cohort", "time", "w"]]
        draws = []
        for lo in range(0, self.n_bootstraps, block):
            size = min(block, self.n_bootstraps - lo)
            drawn = weighted_draws(by, ["cluster"], size, self.seed or 0, lo)
            sums = drawn.groupBy("_draw", "cohort", "time", "w").agg(F.sum(F.col("n") * F.col("_w")).alias("n"), F.sum(F.col("s") * F.col("_w")).alias("s")).toPandas()  # block x cells
            sums["cohort"] = sums["cohort"].fillna(-1)
            for k in range(lo, lo + size):
                m = cells.merge(sums[sums["_draw"] == k], on=["cohort", "time", "w"], how="left").fillna(0)
                n, total = m["n"].to_numpy(dtype=float), m["s"].to_numpy(dtype=float)
                ok = n > 0
                draws.append(self.flat(effects(wls(self.matrix[ok], total[ok] / n[ok], n[ok]), self.names, self.cohorts, self.last)))
        self.draws = np.array(draws)
        return self.by_cohort(self.draws)
