"""Column helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def usable(df: DataFrame, numeric: Iterable[str] = (), keys: Iterable[str] = (), nulls: str = "drop") -> DataFrame:
    """Only the used columns, numeric ones as doubles, without rows that miss one of them.

    ``nulls="keep"`` leaves such rows in.  NaN counts as missing.  Dropping
    them is what keeps counts and sums about the same rows.
    """
    numeric, keys = list(dict.fromkeys(numeric)), list(dict.fromkeys(keys))
    keys = [k for k in keys if k not in numeric]
    missing = [c for c in [*numeric, *keys] if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    out = df.select(*[col(c).cast("double").alias(c) for c in numeric], *[col(k) for k in keys])
    if nulls == "drop":
        for c in numeric:
            out = out.where(col(c).isNotNull() & ~F.isnan(col(c)))
        for k in keys:
            out = out.where(col(k).isNotNull())
    elif nulls != "keep":
        raise ValueError("nulls is 'drop' or 'keep'")
    return out


def free(base: str, taken: Iterable[str]) -> str:
    """A name like ``base`` that is not among the taken ones, in any spelling."""
    lower = {c.lower() for c in taken}
    while base.lower() in lower:
        base += "_"
    return base


def ordered_index(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Adds the rank (from 0) of each row in the order of ``keys``, without a global window.

    Ranges of the keys are sorted apart; the sizes of the ranges before, one
    number per partition, are added to the rank within.  Keys should be
    unique, else the order among equals is open.
    """
    order = [col(k) for k in keys]
    part = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist()
    sizes = part.groupBy("_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return part.withColumn("_rank", rank).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")


def hash_fraction(keys: Sequence[str], seed: int) -> Column:
    """A repeatable pseudo-random number in [0, 1) per row that doesn't depend on partitions; rows with equal keys share it."""
    return (F.xxhash64(*[col(k) for k in keys], F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")
