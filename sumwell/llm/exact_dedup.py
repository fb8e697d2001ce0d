"""Exact dedup with a heavy-hitter split; DataFrame functions only.

Texts are equal when they are identical after each run of white space
(``[\\x20\\x09-\\x0D]+``) became one space.  A mergeable frequent-items sketch
(Misra-Gries counters) over the digests finds every digest that may be
frequent; an exact aggregation over just those verifies them and finds their
winners.  The winners, at most HEAVY_DIGESTS rows, are broadcast: rows of
heavy groups are decided where they are and never shuffled.  The digests that
remain have small groups and go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumwell.llm.scratch import Scratch

#: Bound of the broadcast winners.
HEAVY_DIGESTS = 1024
#: Counters of the sketch; digests above 1/COUNTERS of the rows can't be missed.
COUNTERS = 8192


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the white-space-normalised text; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base


def heavy_winners(rows: DataFrame, digest: str, doc_id: str) -> DataFrame:
    """digest, keep_id, group_size of the verified frequent digests (at most HEAVY_DIGESTS rows)."""
    sketch = rows.agg(F.expr(f"approx_top_k(`{digest}`, {HEAVY_DIGESTS}, {COUNTERS})").alias("top"))
    maybe = sketch.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("digest"))
    mine = rows.select(F.col(f"`{digest}`").alias("digest"), F.col(f"`{doc_id}`").alias("doc_id"))
    return mine.join(F.broadcast(maybe), "digest").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")


def exact_groups(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; further columns are ignored): doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty and so equal to empty ones.  The row with the
    smallest doc_id stays; of repeated rows with that doc_id just one does; a
    null doc_id is larger than any other.  An empty table gives an empty
    result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    digests = scratch.write(docs.select("doc_id", text_digest(F.col("text")).alias("digest")), "digests")
    winners = scratch.write(heavy_winners(digests, "digest", "doc_id").coalesce(1), "winners")
    marked = digests.join(F.broadcast(winners), "digest", "left")
    # heavy rows are decided here, but for rows that carry the winning doc_id: these are told apart below
    heavy = marked.where("group_size is not null and not (doc_id <=> keep_id)").withColumn("kept", F.lit(False))
    group = Window.partitionBy("digest")
    light = marked.where("group_size is null or doc_id <=> keep_id").withColumn("place", F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last())))
    light = light.select(
        "doc_id", "digest",
        F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.min("doc_id").over(group)).alias("keep_id"),
        F.coalesce("group_size", F.count("*").over(group)).alias("group_size"),
        (F.col("place") == 1).alias("kept"),
    )
    out = heavy.select("doc_id", "keep_id", "group_size", "kept", "digest").unionByName(light)
    return out.withColumnRenamed("digest", "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without further copies of a text; of copies the smallest doc_id stays.

    Handles the cases of :func:`exact_groups` alike.
    """
    digest, keep, size, place = (free_name(docs, f"exact_{x}") for x in ("digest", "keep", "size", "place"))
    rows = docs.withColumn(digest, text_digest(F.col("text")))
    winners = heavy_winners(rows, digest, "doc_id").select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.col("group_size").alias(size))
    left = rows.join(F.broadcast(winners), digest, "left").where(F.col(size).isNull() | F.col("doc_id").eqNullSafe(F.col(keep)))
    ranked = left.withColumn(place, F.row_number().over(Window.partitionBy(digest).orderBy(F.col("doc_id").asc_nulls_last())))
    return ranked.where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
