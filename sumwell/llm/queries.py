"""The ``opN_`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumwell.llm.chunk_dedup import repeated_spans
from sumwell.llm.cotrain import quality_scores
from sumwell.llm.entropy_mix import mixture
from sumwell.llm.exact_dedup import exact_groups
from sumwell.llm.html_density import extract_main_text
from sumwell.llm.jaccard_join import jaccard_components
from sumwell.llm.katz import score_texts
from sumwell.llm.toxicity import toxicity_scores
from sumwell.llm.warc import archive_round_trip
from sumwell.llm.winnow import contamination


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard index of at least 0.85."""
    return jaccard_components(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of each document, and whether it stays."""
    return exact_groups(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from labelled documents outside the held-out fifth."""
    out = toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _remainder(5) != 0)
    return out.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_passages")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of each document under a model of the documents outside the held-out seventh."""
    return score_texts(_table(spark, sf_dir, "documents"), _remainder(7) != 2)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written to archives and read back."""
    return archive_round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document by its text, its metadata and both."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("row")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of at least 25 words in whole chunks that occur in an earlier document or before in the same."""
    return repeated_spans(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies and words that a mixture with source weights 1, 2, 3 takes of each document."""
    return mixture(_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside a 13-word window of a benchmark item."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_exact_dedup, op3_toxicity, op4_lm_scoring, op5_warc, op6_quality_classifier,
        op7_substring_dedup, op8_html_extraction, op9_source_mixing, op10_benchmark_decontamination,
    )
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
              FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * o >= 85 * (na.n + nb.n - o)),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, (SELECT min(b) FROM r WHERE r.a = d.doc_id)) AS component_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
        FROM d LEFT JOIN n USING (doc_id)""",
    "op5_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, size AS payload_bytes,
               (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, 10 * q + 1, 10) AS BIGINT) >> (35 - 5 * k)) & 31) + 1 AS INTEGER), 1), '' ORDER BY q, k)
                FROM range(4) a(q), range(8) b(k)) AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, true AS verified
        FROM g""",
    "op2_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d""",
    "op10_benchmark_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        m AS (SELECT item_id, w, least(len(w), 13) AS m FROM b WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t FROM (SELECT item_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM m)),
        places AS (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM m)),
        hits AS (SELECT p.doc_id, p.i, p.m, x.item_id FROM (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t FROM places) p JOIN windows x ON p.m = x.m AND p.t = x.t),
        words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS j FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
