"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task contracts by union-find; about 200 bytes of memory each.
TASK_EDGES = 500_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; where it is unset in local mode, a temporary folder becomes it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sumwell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Parquet tables that cut lineage: a lost executor costs the stage that reads, never the ones before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write and read again; the shuffle files of the write, which nothing needs any more, are deleted with its end."""
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", compression).parquet(self.path(name))
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def most_frequent(table: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of ``table`` with the highest counts, whole levels of counts, ``most`` rows at most.

    Levels (each count below 1024, above it 64 to a doubling) are counted
    first, so that neither a sort nor every task's own candidates are needed.
    """
    c = F.col(count)
    level = F.when(c < 1024, c).otherwise(1024 + F.floor(F.log2(c / 1024) * 64)).cast("long")
    left, least = most, None
    for r in sorted(table.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):  # a few thousand rows
        left -= r["n"]
        if left < 0:
            break
        least = r["level"]
    return table.where(level >= least) if least is not None else table.limit(0)


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """All rows if they are ``most`` at most, else about 97 % of so many, chosen by a hash of the key where they are."""
    n = df.count()
    return df if n <= most else df.where(F.xxhash64(key).bitwiseAND(F.lit((1 << 40) - 1)) < F.lit(int(0.97 * most / n * (1 << 40))))


def _forest(batches):
    """Edges (a, b) of one task -> an edge from every node to the smallest node that it reaches by them."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if len(b)]
    if not parts:
        return
    names, at = np.unique(np.concatenate([x for p in parts for x in p]), return_inverse=True)
    pairs = np.split(at, np.cumsum([len(x) for p in parts for x in p])[:-1])
    root = list(range(len(names)))  # names are sorted, so the smallest position is the smallest node
    for a, b in zip(pairs[0::2], pairs[1::2], strict=True):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            if x < y:
                root[y] = x
            elif y < x:
                root[x] = y
    for x in range(len(root)):
        root[x] = root[root[x]]  # parents come first
    for lo in range(0, len(names), 50_000):
        hi = lo + 50_000
        yield pa.RecordBatch.from_arrays([pa.array(names[lo:hi]), pa.array(names[np.array(root[lo:hi])])], names=["a", "b"])


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours of a node go to its smallest; small star: smaller neighbours and itself do."""
    sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
    low = sym.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    out = sym.join(low, "a")
    if large:
        return out.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node of the edges (a, b); the component is its smallest node.

    Tasks first contract their share of the edges to a forest, in memory that
    TASK_EDGES bounds.  If all edges fit one share, that is the result.  If
    not, large-star and small-star steps (Kiveris et al., 2014) alternate on
    the forests until nothing changes: each points nodes to their smallest
    neighbour, minima are combined before they are shuffled, and rounds grow
    with the logarithm of the longest path.  The edges of a hub meet its
    minimum in a join by its name, which adaptive execution splits.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    count = now.count()
    if count <= TASK_EDGES:
        out = scratch.write(now.coalesce(1).mapInArrow(_forest, "a long, b long"), name)
        return out.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    now = now.repartition(-(-count // TASK_EDGES)).mapInArrow(_forest, "a long, b long").where("a <> b")
    before, k = None, 0
    while True:
        now = scratch.write(_star(_star(now, True), False), f"{name}{k}")
        if k:
            scratch.drop(f"{name}{k - 1}")
        seen = mark(now)
        if seen == before:
            break
        before, k = seen, k + 1
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
