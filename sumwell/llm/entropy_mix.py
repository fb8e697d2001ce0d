"""Mixing sources to target weights by entropy balancing.

Rates r of documents (copies per document) stay as close as possible, in
relative entropy, to one copy each, subject to every source's token
constraint ``sum r * size = target`` and to ``r <= cap``.  The solution is an
exponential tilt, ``r = min(cap, exp(lambda * size / mean size))`` with one
multiplier per source; the multipliers solve the convex dual by safeguarded
Newton steps.  A step is one aggregation over the (source, size) counts of
all documents, in whole numbers, so that any order of addition gives the same
multipliers.

Rates are rounded to copies systematically along the sizes.  What a source
then lacks, or has too much, is spread over its documents by one copy at a
time: the cells (size, copies) take it from the largest size that still fits
to the smallest, so that what remains is less than the smallest document that
could take it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumwell.llm.exact_dedup import free_name
from sumwell.llm.scratch import Scratch

#: Rates are whole multiples of one over this.
GRID = 10**9
#: Documents of a source that are rounded along one running sum, about.
ROUND_TOGETHER = 2_000
#: Sources are held on the driver, one row each.
MAX_SOURCES = 1_000_000


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def capped_targets(sizes: list[int], weights: list[int], cap: int) -> list[float]:
    """Targets proportional to the weights that add up to all sizes, none above cap times its size."""
    targets: list[Fraction | None] = [None] * len(sizes)
    free, left = [k for k in range(len(sizes))], Fraction(sum(sizes))
    while free:
        total = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] > cap * sizes[k] * total]
        if not over:
            for k in free:
                targets[k] = left * weights[k] / total
            break
        for k in over:
            targets[k] = Fraction(cap * sizes[k])
        left -= sum(cap * sizes[k] for k in over)
        free = [k for k in free if k not in set(over)]
    return [float(t or 0) for t in targets]


@dataclass
class _Dual:
    """Bracket and current multiplier of one source."""

    source: str | None
    mean: float
    target: float
    cap: float
    lo: float = -1.0
    hi: float = 1.0
    at: float = 0.0
    done: bool = False
    has_lo: bool = False
    has_hi: bool = False

    def step(self, value: float, slope: float) -> None:
        gap = value - self.target
        if abs(gap) <= 1e-7 * max(1.0, self.target):
            self.done = True
            return
        if gap > 0:
            self.hi, self.has_hi = self.at, True
        else:
            self.lo, self.has_lo = self.at, True
        new = self.at - gap / slope if slope > 0 else math.inf
        if not self.has_hi:
            new = min(new, 2 * abs(self.at) + 1)
        if not self.has_lo:
            new = max(new, -2 * abs(self.at) - 1)
        if self.has_hi and self.has_lo and not self.lo < new < self.hi:
            new = (self.lo + self.hi) / 2
        if new == self.at or abs(new) > 1e6:
            self.done = True
        self.at = new


def _rate(size: Column, scale: Column, cap: float) -> Column:
    """Rate in units of 1/GRID; the exponent is held below the cap before it is raised."""
    return F.round(F.least(F.exp(F.least(F.lit(math.log(cap) + 1e-9), size * scale)), F.lit(float(cap))) * GRID).cast("long")


def _state(counts: DataFrame, duals: list[_Dual]) -> DataFrame:
    rows = [(d.source, d.at / d.mean, d.mean, d.target) for d in duals]
    return F.broadcast(counts.sparkSession.createDataFrame(rows, "mix_key string, scale double, mean double, target double"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, max_steps: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, copies, source.

    Sources in code-point order, null last, get the weights in turn; targets
    add up to all words but stop at ``cap`` times a source's words, the excess
    going to the others by weight.  Null and empty texts have size 0 and add
    nothing whatever their copies (0).  Repeated rows count as documents of
    their own; ties in size are broken by a hash of doc_id, and rows that share
    both are alike.  The words taken of a source differ from its target by less
    than its smallest document that could have a copy more (or less).  Texts
    count whole.  An empty table gives an empty result.  Results don't depend
    on partitioning.  Further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sizes = scratch.write(sizes, "sizes")
    counts = scratch.write(sizes.where("size > 0").groupBy("source", "size").count(), "counts")
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    targets = capped_targets([r["size"] for r in found], [weights[k % len(weights)] for k in range(len(found))], cap)
    duals = [_Dual(r["source"], max(1.0, r["size"] / r["n"]), t, float(cap), done=r["size"] == 0) for r, t in zip(found, targets, strict=True)]
    for d, r in zip(duals, found, strict=True):
        if not d.done and d.target >= cap * r["size"]:  # every rate is at the cap
            d.at, d.done = math.log(cap) * d.mean * 2, True
    by_source = {d.source: d for d in duals}
    for _ in range(max_steps):
        open_ = [d for d in duals if not d.done]
        if not open_:
            break
        s = counts.join(_state(counts, open_), F.col("source").eqNullSafe(F.col("mix_key")))
        rate = _rate(F.col("size"), F.col("scale"), cap)
        words = F.col("count").cast("decimal(20,0)") * F.col("size")
        tilt = F.round(F.col("rate") * F.col("size") / F.col("mean")).cast("decimal(18,0)")
        s = s.withColumn("rate", rate).groupBy("source").agg(
            F.sum(words.cast("decimal(19,0)") * F.col("rate").cast("decimal(11,0)")).alias("value"),
            F.sum(F.when(F.col("rate") < int(cap * GRID), words.cast("decimal(19,0)") * tilt)).alias("slope"),
        )
        for r in s.collect():
            by_source[r["source"]].step(float(r["value"]) / GRID, float(r["slope"] or 0) / GRID)

    facts = [(d.source, d.at / d.mean, r["size"], d.target, -(-r["n"] // ROUND_TOGETHER)) for d, r in zip(duals, found, strict=True)]
    facts = F.broadcast(spark.createDataFrame(facts, "mix_key string, scale double, source_size long, target double, parts long"))
    rows = sizes.join(facts, F.col("source").eqNullSafe(F.col("mix_key")))
    rows = rows.withColumn("rate", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.when(F.col("target") >= F.col("source_size") * cap, F.lit(cap * GRID)).otherwise(_rate(F.col("size"), F.col("scale"), cap))).cast("long"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    # whole rates need no rounding; the others are rounded along a running sum, ordered by size so that errors cancel
    order = Window.partitionBy("source", "part").orderBy("size", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("running", F.sum(F.col("rate") % GRID).over(order)).select("doc_id", "source", "size", "source_size", "target", "rate", "running")
    end = F.col("running") + F.lit(GRID // 2)
    copies = (F.floor(F.col("rate") / F.lit(GRID)) + F.floor(end / F.lit(GRID)) - F.floor((end - F.col("rate") % GRID) / F.lit(GRID))).cast("long")
    rows = scratch.write(rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")), "rounded")
    rows = _close_gaps(rows, cap, scratch)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def fill_cells(size: list[int], copies: list[int], n: list[int], gap: float, cap: int) -> list[int]:
    """Copies to add to (or, below 0, to take from) each cell of n documents of one size and number of copies.

    The cells take turns from the largest size to the smallest, as many copies
    as the gap and the cell hold.  Then one copy of the smallest size beyond
    what remains is tried too, with smaller ones the other way, and kept if
    that comes closer.
    """
    order = sorted((k for k in range(len(size)) if size[k] > 0), key=lambda k: (-size[k], copies[k]))
    now = [c * m for c, m in zip(copies, n, strict=True)]

    def room(k: int, at: list[int], up: bool) -> int:
        return cap * n[k] - at[k] if up else at[k]

    def fill(left: float, at: list[int], below: float) -> float:
        for k in order:
            if size[k] < below:
                took = min(room(k, at, left > 0), int(abs(left) // size[k])) * (1 if left > 0 else -1)
                at[k] += took
                left -= took * size[k]
        return left

    left = fill(gap, now, math.inf)
    for k in reversed(order):
        if size[k] > abs(left) > 0 and room(k, now, left > 0):
            other, step = now[:], 1 if left > 0 else -1
            other[k] += step
            if abs(fill(left - step * size[k], other, size[k])) < abs(left):
                now = other
            break
    return [x - c * m for x, c, m in zip(now, copies, n, strict=True)]


def _close_gaps(rows: DataFrame, cap: int, scratch: Scratch) -> DataFrame:
    """The rows with their copies changed so that each source meets its target.

    Cells are counted with partial sums and dealt by source: a task holds one
    source's distinct (size, copies), whose number grows with the longest
    text, not with the documents.  Within a cell every document takes the
    whole share; what is left over goes to the first by a hash of doc_id, found
    by counts of parts, so that no cell is ranked in one task.
    """
    cells = scratch.write(rows.where("size > 0").groupBy("source", "size", "copies", "target").agg(F.count("*").alias("n")), "cells")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        size, copies, n = (pdf[c].to_numpy().tolist() for c in ("size", "copies", "n"))
        gap = float(pdf["target"].iloc[0]) - float(sum(a * b * c for a, b, c in zip(size, copies, n, strict=True)))
        moved = fill_cells(size, copies, n, gap, cap)
        out = pdf[["source", "size", "copies"]].rename(columns={"source": "cell_source", "size": "cell_size", "copies": "cell_copies"})
        out["each"], out["more"], out["n"] = [int(m / k) for m, k in zip(moved, n, strict=True)], [m - int(m / k) * k for m, k in zip(moved, n, strict=True)], n
        return out[(out["each"] != 0) | (out["more"] != 0)]

    moves = cells.groupBy("source").applyInPandas(fill, "cell_source string, cell_size long, cell_copies long, each long, more long, n long")
    moves = scratch.write(moves, "moves")
    same = F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("size") == F.col("cell_size")) & (F.col("copies") == F.col("cell_copies"))
    # a cell is dealt into parts by the hash; parts before a document's own, and its place in it, are its place in the cell
    part = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / ROUND_TOGETHER))).cast("long")
    rows = rows.join(moves, same, "left").withColumn("part", F.when(F.col("more") != 0, part)).drop("cell_source", "cell_size", "cell_copies", "n")
    whole = rows.where("part is null").select("doc_id", "source", "size", "source_size", "target", (F.col("copies") + F.coalesce("each", F.lit(0))).alias("copies"))
    some = scratch.write(rows.where("part is not null"), "some")
    cell = ["source", "size", "copies"]
    parts = some.groupBy(*cell, "part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*cell).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*[F.col(c).alias(f"p_{c}") for c in (*cell, "part")], "before")
    here = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in (*cell, "part")]
    place = F.row_number().over(Window.partitionBy(*cell, "part").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
    some = some.withColumn("place", place).join(parts, here[0] & here[1] & here[2] & here[3])
    step = F.when(F.col("place") + F.col("before") <= F.abs("more"), F.signum("more").cast("long")).otherwise(F.lit(0))
    return whole.unionByName(some.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") + F.col("each") + step).alias("copies")))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The documents of the mixture, all columns, as many rows as a document has copies.

    Cases as in :func:`mixture`; a document without words has no copy.
    Documents that share a doc_id and a size share the copies.
    """
    copies, copy, size, key, n = (free_name(docs, f"mix_{x}") for x in ("copies", "copy", "size", "key", "n"))
    m = mixture(docs, weights, cap).where("copies > 0").select(F.col("doc_id").alias(key), F.col("source").alias(copy), F.col("size").alias(size), F.col("copies").alias(copies))
    m = m.groupBy(key, copy, size).agg(F.max(copies).alias(copies))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & docs["source"].cast("string").eqNullSafe(m[copy]) & (word_count(docs["text"]) == m[size])
    return docs.join(m, same).withColumn(n, F.explode(F.expr(f"sequence(1L, `{copies}`)"))).select(*[docs[f"`{c}`"] for c in docs.columns])
