"""The pipeline against its stages by brute force, and the queries by name."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sumwell.llm.cotrain import quality_scores
from sumwell.llm.entropy_mix import capped_targets
from sumwell.llm.jaccard_join import drop_near_duplicates
from sumwell.llm.queries import ORACLES, QUERIES
from tests.llm.common import documents, hard_documents, words
from tests.llm.test_models import quality_corpus
from tests.llm.test_pairs import brute_contamination, brute_roots


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = quality_corpus(200)
    rows += [(1000 + r[0], *r[1:]) for r in hard_documents(11)[:-1]] + [(None, *hard_documents(11)[-1][1:]), (None, "a text of its own without an id " * 9, None, None, None)]
    text = next(t for _, t, *_ in rows if len(t.split()) > 150 and not t.isupper())
    rows += [(3000 + k, text + " more" * (k + 1), "en", "src1", 1) for k in range(4)]
    bench = [(1, " ".join(text.split()[10:40]).lower()), (2, "w1 w2")]
    where = str(tmp_path_factory.mktemp("sf"))
    documents(spark, rows).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows, labels, bench


def brute_near(rows):
    """One row of each component, that with the smallest doc_id, null last; wordless ones all."""
    out, seen = [], {}
    for k, (r, c) in enumerate(zip(rows, brute_roots(rows, 5, 4, 5), strict=True)):
        if not words(r[1]):
            out.append(r)
        elif c not in seen or (r[0] is None, r[0] or 0) < (seen[c][0] is None, seen[c][0] or 0):
            seen[c] = r
    return out + list(seen.values())


def test_near_keeps_one_row_of_each_component(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text, "en", "a", 1), (5, text + " x", "en", "a", 1), (5, text + " x", "en", "a", 1), (None, text + " y", "en", "a", 1), (None, "apart from all others, w1 w2", "en", "a", 1), (9, "apart from all others, w1 w2", None, None, None)]
    rows += [(7, "another text altogether with words", "en", "b", 1)] * 3 + [(7, "its id is shared but not its text", "en", "b", 1), (None, None, None, None, None), (None, None, None, None, None), (8, " ", None, None, None), (None, "without any id", None, None, None), (None, "without any id", None, None, None)]
    docs = documents(spark, rows, clash=True)
    got = drop_near_duplicates(docs)
    out = got.collect()
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], len(words(r["text"]))) for r in out if r["doc_id"] != 5) == Counter([(9, 6), (7, 5), (7, 8), (None, 0), (None, 0), (8, 0), (None, 3)])
    assert sum(r["doc_id"] == 5 for r in out) == 1


def test_stages_equal_brute_force(spark, folder):
    where, rows, labels, bench = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "benchmark", "mix"]
    docs = spark.read.parquet(f"{where}/documents.parquet")
    lab = spark.read.parquet(f"{where}/labels.parquet")
    kinds = docs.select("*", F.xxhash64("doc_id", "text", "lang", "source", F.col("n_chars").cast("double")).alias("row")).collect()
    scores = {r["row"]: not r["rejected"] for r in quality_scores(docs, lab).collect()}
    key = lambda r: tuple(r[:4])
    good = {key(r) for r in kinds if scores[r["row"]]}
    ids = {k[0] for k in good}
    assert {i for i, q in labels if q == 1} <= ids and not {i for i, q in labels if q == 0} & ids
    order_of = lambda r: (r[0] is None, r[0] or 0)
    left = sorted((r for r in rows if key(r) in good), key=order_of)
    seen, once = set(), []
    for r in left:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if t not in seen:
            seen.add(t)
            once.append(r)
    kept = brute_near(once)
    bad = [next(iter(brute_contamination([r], bench, 13)))[2] > 0 for r in kept]
    assert any(bad)
    kept = [r for r, b in zip(kept, bad, strict=True) if not b]
    got = corpus_pipeline.run(spark, where).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[3], len(words(r[1]))) for r in kept) and len(kept) < len(once) < len(left) < len(rows)
    size, taken = Counter(), Counter()
    for r in kept:
        size[r[3]] += len(words(r[1]))
    for g in got:
        taken[g["source"]] += g["taken"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, capped_targets([size[s] for s in order], [1 + k % 3 for k in range(len(order))], 3), strict=True):
        sums = 1  # bit k: some copies of the source's texts have k words
        for r in kept:
            if r[3] == s:
                for _ in range(3):
                    sums |= sums << len(words(r[1]))
        best = min(abs(k - t) for k in range(sums.bit_length()) if sums >> k & 1)
        assert abs(taken[s] - t) <= best + max(8, 0.005 * t)


def test_each_stage_returns_documents(spark, folder):
    where = folder[0]
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == docs.columns and out.schema == docs.schema
        assert stage(spark, docs.limit(0), where).count() == 0


def test_queries_are_named_by_number():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
