"""Lossless compression: rows that share their regressors become one row of sufficient statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwell.functions.columns import col, free


def stat_names(by: Sequence[str], outcomes: Sequence[str]) -> tuple[str, list[str], list[str]]:
    """Names of count, sums and sums of squares; a name that a column of ``by`` has already gets an underscore."""
    count = free("count", by)
    sums, squares = [], []
    for y in outcomes:
        sums.append(free(f"sum_{y}", [*by, count, *sums, *squares]))
        squares.append(free(f"sum_{y}_sq", [*by, count, *sums, *squares]))
    return count, sums, squares


def strata(df: DataFrame, by: Sequence[str], outcomes: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """``by`` and ``extra`` columns, count, and sum_y and sum_y_sq of each outcome; partial sums are combined before the shuffle."""
    keys = list(dict.fromkeys([*by, *extra]))
    count, sums, squares = stat_names(keys, outcomes)
    stats = [f for y, s, q in zip(outcomes, sums, squares, strict=True) for f in (F.sum(col(y)).alias(s), F.sum(col(y) * col(y)).alias(q))]
    return df.groupBy(*[col(c) for c in keys]).agg(F.count("*").alias(count), *stats)


def class_counts(df: DataFrame, by: Sequence[str], label: str, labels: Sequence) -> DataFrame:
    """``by`` columns and the rows of each label as class_0, class_1, ..."""
    counts = [F.sum(F.when(col(label) == F.lit(v), 1).otherwise(0)).alias(name) for v, name in zip(labels, class_names(by, len(labels)), strict=True)]
    return df.groupBy(*[col(c) for c in by]).agg(*counts)


def class_names(by: Sequence[str], n: int) -> list[str]:
    return [free(f"class_{j}", by) for j in range(n)]


def label_names(label: str, by: Sequence[str]) -> tuple[str, str]:
    """Names of rows and sum_y."""
    return free("rows", [label, *by]), free("sum_y", [label, *by])


def label_sums(df: DataFrame, label: str, by: Sequence[str], count: str) -> DataFrame:
    """label, ``by`` columns, rows, sum_y."""
    rows, total = label_names(label, by)
    return df.groupBy(col(label), *[col(c) for c in by]).agg(F.count("*").alias(rows), F.sum(col(count)).alias(total))
