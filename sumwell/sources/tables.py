"""Where data come from and how small results get out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


class TooManyRows(RuntimeError):
    """A result that should be small is not."""


def table(source: DataFrame | str | pd.DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """A DataFrame, the name of a table or view, a path of parquet files, a SELECT or WITH statement, or a pandas frame."""
    if isinstance(source, DataFrame):
        return source
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise ValueError("a name needs a session")
    if not isinstance(spark, SparkSession):
        raise TypeError(f"not a SparkSession: {type(spark).__name__}")
    if isinstance(source, pd.DataFrame):
        return spark.createDataFrame(source)
    if not isinstance(source, str):
        raise TypeError(f"not a table: {type(source).__name__}")
    if is_select(source):
        return spark.sql(source)
    if "/" in source:
        return spark.read.parquet(source)
    return spark.table(source)


def is_select(text: str) -> bool:
    return text.lstrip().split(None, 1)[:1] != [] and text.lstrip().split(None, 1)[0].lower() in ("select", "with")


def fetch(df: DataFrame, limit: int | None = None) -> pd.DataFrame:
    """The rows of a small result; more than ``limit`` raise, and no more than limit + 1 travel."""
    out = (df if limit is None else df.limit(limit + 1)).toPandas()
    if limit is not None and len(out) > limit:
        raise TooManyRows(f"more than {limit} rows")
    return out


def fetch_one(df: DataFrame):
    """The first value of the first row, or None."""
    row = df.first()
    return None if row is None else row[0]


def register(spark: SparkSession, **frames: pd.DataFrame | DataFrame) -> None:
    """Make frames readable by name in SQL."""
    for name, frame in frames.items():
        (frame if isinstance(frame, DataFrame) else spark.createDataFrame(frame)).createOrReplaceTempView(name)


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of another database, with filters and columns pushed down to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
