"""What all estimators share."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sumwell.plans.moments import tidy
from sumwell.sources.tables import table

#: Rows of a compressed table that may come to the driver.
MAX_ROWS = 1_000_000


class Estimator(ABC):
    """``fit()`` prepares, compresses, estimates, and bootstraps if asked to; ``summary()`` reports.

    The session belongs to the caller and is never stopped.  Rows in which a
    used column is null or NaN are left out (``nulls="keep"`` turns that off).
    """

    def __init__(self, source: DataFrame | str | pd.DataFrame, *, spark: SparkSession | None = None, seed: int | None = 42, n_bootstraps: int = 0, nulls: str = "drop", max_rows: int = MAX_ROWS):
        if n_bootstraps < 0 or n_bootstraps == 1:
            raise ValueError("a bootstrap needs at least two draws")
        self.data = table(source, spark)
        self.spark = self.data.sparkSession
        self.seed, self.n_bootstraps, self.nulls, self.max_rows = seed, n_bootstraps, nulls, max_rows
        self.rng = np.random.default_rng(seed)
        self.point_estimate: np.ndarray | None = None
        self.vcov: np.ndarray | None = None
        self.draws: np.ndarray | None = None

    @abstractmethod
    def prepare_data(self) -> None:
        """Derive the columns that the model needs, lazily."""

    @abstractmethod
    def compress_data(self) -> None:
        """Reduce the data to sufficient statistics."""

    @abstractmethod
    def estimate(self) -> np.ndarray:
        """Solve for the coefficients."""

    def bootstrap(self) -> np.ndarray:
        """Variance of the coefficients over resampled data."""
        raise NotImplementedError(f"{type(self).__name__} has no bootstrap")

    def fit(self):
        self.prepare_data()
        self.compress_data()
        self.point_estimate = self.estimate()
        if self.n_bootstraps:
            self.vcov = self.bootstrap()
        return self

    def standard_error(self) -> np.ndarray | None:
        return None if self.vcov is None else np.sqrt(np.clip(np.diag(self.vcov), 0, None))

    def summary(self) -> dict:
        out = {"point_estimate": self.point_estimate}
        if self.vcov is not None:
            out["standard_error"] = self.standard_error()
        return out

    def terms(self) -> list[str]:
        raise NotImplementedError

    def tidy(self) -> pd.DataFrame:
        """term, estimate, se."""
        return tidy(self.terms(), self.point_estimate, self.standard_error())

    def tidy_frame(self) -> DataFrame:
        """:meth:`tidy` as a DataFrame."""
        return self.spark.createDataFrame(self.tidy(), "term string, estimate double, se double")


def covariance(draws: np.ndarray) -> np.ndarray:
    return np.atleast_2d(np.cov(draws.reshape(len(draws), -1), rowvar=False))


def sandwich(bread: np.ndarray, meat: np.ndarray) -> np.ndarray:
    return bread @ meat @ bread
