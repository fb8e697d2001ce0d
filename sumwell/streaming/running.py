"""Regressions that follow a stream: sufficient statistics are additive."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sumwell.functions.columns import usable
from sumwell.functions.formula import parse
from sumwell.functions.solve import wls
from sumwell.plans.compress import stat_names, strata
from sumwell.sources.tables import fetch


def running_strata(stream: DataFrame, formula: str, nulls: str = "drop") -> DataFrame:
    """The compressed table of a stream.  State is one row per distinct combination of regressors."""
    f = parse(formula)
    return strata(usable(stream, [*f.covariates, *f.outcomes], nulls=nulls), f.covariates, f.outcomes)


def coefficients(groups: pd.DataFrame, formula: str) -> pd.DataFrame:
    """term and a column of estimates per outcome."""
    f = parse(formula)
    x = np.column_stack([np.ones(len(groups)), *[groups[c].to_numpy(dtype=float) for c in f.covariates]])
    count, sums, _ = stat_names(f.covariates, f.outcomes)
    n = groups[count].to_numpy(dtype=float)
    y = np.column_stack([groups[s].to_numpy(dtype=float) / n for s in sums])
    return pd.DataFrame(wls(x, y, n), columns=list(f.outcomes)).assign(term=["Intercept", *f.covariates])


def running_regression(stream: DataFrame, formula: str, update: Callable[[pd.DataFrame, int], None], checkpoint: str, max_rows: int = 1_000_000, **trigger) -> StreamingQuery:
    """Calls ``update`` with the coefficients on all rows so far, after each micro-batch."""

    def batch(df: DataFrame, epoch: int) -> None:
        groups = fetch(df, max_rows)
        if len(groups):
            update(coefficients(groups, formula), epoch)

    writer = running_strata(stream, formula).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(**trigger) if trigger else writer).start()
