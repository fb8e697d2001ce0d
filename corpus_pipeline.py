"""Cleaning pipeline over ``documents``: each stage is one of the text operators and reads what the one before kept.

All stages read whole texts of any length and keep further columns as they
are, whatever their names.  Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sumwell.llm.cotrain import drop_low_quality
from sumwell.llm.entropy_mix import mixture
from sumwell.llm.exact_dedup import drop_exact_duplicates
from sumwell.llm.jaccard_join import drop_near_duplicates
from sumwell.llm.scratch import Scratch
from sumwell.llm.winnow import drop_contaminated


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Every row is judged by its own text, lang, source and n_chars, so repeated
    rows and rows that share a doc_id are independent; nulls and empty texts
    are features like others, and ties at the threshold stay.
    """
    return drop_low_quality(docs, _table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, that with the smallest doc_id stays.

    Null texts are empty; a null doc_id is the largest; of rows that share text
    and doc_id one stays.
    """
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at 0.8, directly or through others, one stays.

    It has the smallest doc_id, a null one last; rows that share a doc_id are
    told apart by their columns, and of rows equal in all columns one stays.
    Null, empty and wordless texts link with nothing and stay.
    """
    return drop_near_duplicates(docs, words=5, num=4, den=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 13 consecutive words of a benchmark item, or a whole item of fewer words, go, however long they are.

    Every row is judged by its own text; null and empty texts hold nothing and
    stay, repeated rows go or stay alike.
    """
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document with the copies that meet the sources' weights.

    A null source is one of its own, the last; null and empty texts have size 0
    and no copies; ties in size are broken by a hash of doc_id.
    """
    return mixture(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("mix", mix)]
#: The classifier and the mixture's iterations have no SQL; tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
