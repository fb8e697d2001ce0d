"""Panel models by group means: Mundlak and double demeaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwell.functions.columns import col, usable
from sumwell.operators.linear import LeastSquares

#: Periods whose means are broadcast, at most.
MAX_BROADCAST_PERIODS = 100_000


def group_means(df: DataFrame, columns: Sequence[str], by: str, suffix: str) -> DataFrame:
    """``by`` and avg_{column}_{suffix} of each column."""
    return df.groupBy(col(by)).agg(*[F.avg(col(c)).alias(f"avg_{c}_{suffix}") for c in columns])


def with_means(df: DataFrame, columns: Sequence[str], unit: str, time: str | None) -> DataFrame:
    """Adds means by unit and by time.  Units are joined as the planner sees fit, periods are broadcast if they are few."""
    out = df.join(group_means(df, columns, unit, "unit"), unit)
    if time is not None:
        means = group_means(df, columns, time, "time")
        few = means.limit(MAX_BROADCAST_PERIODS + 1).count() <= MAX_BROADCAST_PERIODS
        out = out.join(F.broadcast(means) if few else means, time)
    return out


class Mundlak(LeastSquares):
    """Outcome on covariates and their means by unit and, with ``time_col``, by time.

    Bootstraps draw clusters (units unless ``cluster_col`` is given); means
    are those of the full data in every draw.
    """

    def __init__(self, source, outcome_var: str, covariates: str | Sequence[str], unit_col: str, time_col: str | None = None, cluster_col: str | None = None, n_bootstraps: int = 100, **options):
        super().__init__(source, n_bootstraps=n_bootstraps, **options)
        self.y, self.covariates = [outcome_var], [covariates] if isinstance(covariates, str) else list(covariates)
        self.unit, self.time, self.cluster = unit_col, time_col, cluster_col or unit_col
        self.x = [*self.covariates, *[f"avg_{c}_unit" for c in self.covariates], *([f"avg_{c}_time" for c in self.covariates] if time_col else [])]

    def prepare_data(self) -> None:
        rows = usable(self.data, [*self.y, *self.covariates], [c for c in dict.fromkeys([self.unit, self.time, self.cluster]) if c], self.nulls)
        self.design = with_means(rows, self.covariates, self.unit, self.time)

    def estimate(self):
        return self.coefficients()


class DoubleDemeaning(LeastSquares):
    """Outcome on the treatment less its unit and time means plus its overall mean.

    This equals two-way fixed effects on balanced panels only.  The demeaned
    treatment is a computed double that hardly repeats, so moments are used
    instead of groups.  Bootstraps draw clusters, units unless ``cluster_col``
    is given, with means of the full data.
    """

    compressible = False

    def __init__(self, source, outcome_var: str, treatment_var: str, unit_col: str, time_col: str, cluster_col: str | None = None, n_bootstraps: int = 100, **options):
        super().__init__(source, n_bootstraps=n_bootstraps, **options)
        self.y, self.treatment, self.unit, self.time, self.cluster = [outcome_var], treatment_var, unit_col, time_col, cluster_col or unit_col
        self.x = [f"ddot_{treatment_var}"]

    def prepare_data(self) -> None:
        t = self.treatment
        rows = usable(self.data, [*self.y, t], list(dict.fromkeys([self.unit, self.time, self.cluster])), self.nulls)
        mean = rows.agg(F.avg(col(t))).first()[0]
        ddot = col(t) - col(f"avg_{t}_unit") - col(f"avg_{t}_time") + F.lit(mean)
        self.design = with_means(rows, [t], self.unit, self.time).withColumn(self.x[0], ddot)

    def estimate(self):
        return self.coefficients()
