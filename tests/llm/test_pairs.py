"""Joins and dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumwell.llm import winnow
from sumwell.llm.chunk_dedup import boundaries, chunks, cut_spans, gear_hash, repeated_spans
from sumwell.llm.exact_dedup import drop_exact_duplicates, exact_groups
from sumwell.llm.jaccard_join import Rule, divide_skip, jaccard_components
from sumwell.llm.scratch import Scratch, components
from sumwell.llm.text import shingle_sets, word_slices
from sumwell.llm.winnow import contamination, drop_contaminated
from tests.llm.common import documents, hard_documents, words


def shingles(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute_roots(rows, n, num, den):
    """The component of each row."""
    return _brute(rows, n, num, den)[0]


def _brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    return [find(k) for k in range(len(rows))], links, [len(x) for x in sets]


def brute_components(rows, n, num, den):
    of, links, sizes = _brute(rows, n, num, den)
    low = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[of[k]].append(r[0])
    return sorted(((r[0], sizes[k], min(low[of[k]], default=None), links[k]) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("n,num,den,short", [(4, 85, 100, 32), (5, 4, 5, 3), (2, 1, 2, 2)])
def test_jaccard_equals_brute_force(spark, n, num, den, short):
    rows = hard_documents(n)
    got = jaccard_components(documents(spark, rows, clash=True), n, num, den, short, 8).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=str) == brute_components(rows, n, num, den)


def test_sets_that_share_a_hash_stay_apart(spark, monkeypatch):
    from sumwell.llm import jaccard_join

    rows = hard_documents(4)[:70]
    names = set()
    whole = jaccard_join._set_hash
    table, nodes, clashes = jaccard_join._nodes(documents(spark, rows).withColumn("row", F.lit(0).cast("long")).select("doc_id", "row", "text"), 4, Rule(85, 100), Scratch(spark, "t"))
    assert not clashes and nodes.count() == table.where("n > 0").select("node").distinct().count()
    for t in (r[1] for r in rows):
        s = next(iter(shingle_sets([t], 4)))
        a, b = whole(s)
        names.add(jaccard_join._node(s, frozenset([a]))[0])
        assert jaccard_join._node(s, frozenset()) == (a, b)
    assert len(names) == len({whole(next(iter(shingle_sets([r[1]], 4)))) for r in rows})


def test_jaccard_of_nothing(spark):
    assert jaccard_components(documents(spark, []), 4, 85, 100).collect() == []


def test_divide_skip_equals_counting():
    r = np.random.default_rng(0)
    base = r.choice(10**6, 300, replace=False)
    sets = [np.sort(np.unique(np.concatenate((r.choice(base, 250, replace=False), r.choice(10**6, r.integers(0, 60)))))).astype(np.uint64) for _ in range(60)]
    rule = Rule(7, 10)
    got = {(q, int(k)) for q, f in divide_skip(sets, range(60), range(60), rule) for k in f}
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 7 * len(np.union1d(sets[a], sets[b]))}
    assert got == want and 0 < len(want) < 1770


def test_components(spark, monkeypatch):
    from sumwell.llm import scratch as module

    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    want = {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}
    for limit in (500_000, 20):
        monkeypatch.setattr(module, "TASK_EDGES", limit)
        got = components(df, Scratch(spark, "t"), "c").collect()
        assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want


def test_words_and_shingles():
    texts = ["A b\tc\n\x0bd", None, "", "one", "x " * 40_000, "Ä ä"]
    sizes = [k for lo, hi, _, off in word_slices(texts) for k in np.diff(off).tolist()]
    assert sizes == [4, 0, 0, 1, 40_000, 2]
    s = list(shingle_sets(texts, 3))
    assert [len(x) for x in s] == [2, 0, 0, 1, 1, 1]
    same = list(shingle_sets(["a  B c", "A b\nc", "a b d", "ab c"], 4))
    assert np.array_equal(same[0], same[1]) and not np.array_equal(same[0], same[2]) and not np.array_equal(same[0], same[3])


def test_exact_groups(spark):
    rows = hard_documents(5) + [(1000 + k, "many copies  of\tthis", "en", "s", 1) for k in range(50)]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    got = exact_groups(documents(spark, rows, clash=True)).collect()
    key = lambda x: 1 << 62 if x is None else x
    size, low = Counter(norm), {}
    for r, t in zip(rows, norm, strict=True):
        if t not in low or key(r[0]) < key(low[t]):
            low[t] = r[0]
    want = Counter((r[0], low[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, norm, strict=True))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(size) and all(r["doc_id"] == r["keep_id"] for r in kept)
    docs = documents(spark, rows, clash=True)
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns and sorted(map(str, ((r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in left.collect()))) == sorted(map(str, ((low[t], t) for t in size)))
    assert exact_groups(documents(spark, [])).collect() == []


def brute_contamination(rows, items, span):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: cut.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        m = min(span, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(i)
    out = []
    for d, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if (x := tuple(w[k : k + m])) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[x]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_contamination(spark, monkeypatch, limit):
    monkeypatch.setattr(winnow, "MAX_BROADCAST", limit)
    rows = hard_documents(7)
    long = rows[9][1] if len(rows[9][1].split()) > 30 else next(t for _, t, *_ in rows if t and len(t.split()) > 100)
    w = long.split()
    items = [(1, " ".join(w[3:30])), (12, " ".join(w[20:33]).upper()), (3, "w1"), (4, "w0, w1"), (5, None), (6, " - "), (7, "東京"), (12, " ".join(w[20:33])), (None, " ".join(w[5:18])), (8, "the same line stands in")]
    rows = rows + [(5000, "q " * 3000 + " ".join(w[5:40]) + " z" * 10, "en", "s", 1), (5001, " ".join(w[3:16]) + " other " + " ".join(w[5:16]), "en", "s", 1)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, m string")
    got = contamination(documents(spark, rows, clash=True), bench).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in got) == brute_contamination(rows, items, 13)
    docs = documents(spark, rows, clash=True)
    clean = [r for r in rows if not next(iter(brute_contamination([r], items, 13)))[2]]
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(r[:2] for r in clean)
    assert contamination(documents(spark, []), bench).count() == 0
    none = contamination(documents(spark, rows), bench.limit(0))
    assert none.count() == len(rows) and none.where("contaminated or n_hit > 0").count() == 0


def test_a_long_text_with_a_short_passage_goes(spark):
    passage = " ".join(f"p{k}" for k in range(13))
    rows = [(1, "w " * 5000 + passage + " z" * 5000, None, None, None), (1, "another text with the same id", None, None, None), (None, passage, None, None, None), (None, "clean", None, None, None), (4, " ".join(passage.split()[:12]) + " x", None, None, None), (5, None, None, None, None)]
    bench = spark.createDataFrame([(1, "q " * 40 + passage)], "item_id long, text string")
    assert sorted(str(r["text"]) for r in drop_contaminated(documents(spark, rows), bench).collect()) == sorted(["another text with the same id", "clean", rows[4][1], "None"])


def test_winnowing_thins_and_repeats(spark):
    rows = [(1, "a " * 400, None, None, None), (2, " ".join(f"u{k}" for k in range(3000)), None, None, None)]
    kept = winnow.fingerprints(winnow._split_words(documents(spark, rows), "doc_id"), 13, [13]).where("at >= 0").groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("at").alias("d")).collect()
    n = {r["doc_id"]: (r["n"], r["d"]) for r in kept}
    assert n[2][0] == n[2][1] and 0.3 * 3000 < n[2][0] < 0.5 * 3000 and n[1][0] == n[1][1]  # 2 / (RUNS + 1) of all runs
    r = random.Random(9)
    # repetitive texts share windows in many ways
    texts = [(k, " ".join(r.choice("ab") for _ in range(r.choice([5, 30, 90]))), None, None, None) for k in range(40)]
    items = [(k, " ".join(r.choice("ab") for _ in range(r.choice([4, 14, 25])))) for k in range(8)] + [(9, texts[5][1]), (10, texts[7][1][:41])]
    got = contamination(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter(tuple(x[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for x in got) == brute_contamination(texts, items, 13)


def test_gear_chunks():
    r = np.random.default_rng(3)
    a = r.integers(97, 123, 20_000).astype(np.uint8)
    h, slow = gear_hash(a), 0
    from sumwell.llm.chunk_dedup import _GEAR

    for k, b in enumerate(a[:300].tolist()):
        slow = (2 * slow + int(_GEAR[b])) % 2**32
        assert k < 32 or slow == h[k]
    ends = boundaries(a)
    sizes = np.diff(np.concatenate(([0], ends)))
    assert ends[-1] == len(a) and sizes.max() <= 64 and (sizes[:-1] >= 12).all()
    text = bytes(a).decode()
    s1, e1, d1, _ = chunks(text)
    _, _, d2, _ = chunks(text[:7000] + "inserted" + text[7000:])
    assert len(set(d1.tolist()) - set(d2.tolist())) <= 6  # an insertion shifts nothing behind it
    assert len(chunks(None)[0]) == len(chunks("")[0]) == 0


def test_repeated_spans(spark):
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("abcdefghijklmnoprstuvé") for _ in range(r.randrange(2, 9))) for _ in range(n))
    passage, clean = text(80), {k: text(300) for k in range(20)}
    docs = [(k, t, "en", "s", 1) for k, t in clean.items()]
    docs += [(100 + k, text(120) + "\n" + passage + "\n" + text(90), "en", "s", 1) for k in range(6)]
    docs += [(200, passage + " " + text(30) + " " + passage, "en", "s", 1), (300, None, "en", "s", 0), (301, "", "en", "s", 0), (302, text(60_000), "en", "s", 0), (None, passage, None, None, None)]
    docs += [docs[0]]
    got = repeated_spans(documents(spark, docs, clash=True)).collect()
    by = defaultdict(list)
    for g in got:
        by[g["doc_id"]].append(g)
    assert set(by) == {101, 102, 103, 104, 105, 200, None} and all(g["keep_doc_id"] == 100 for g in got)
    texts = {d[0]: d[1] for d in docs}
    for d, spans in by.items():
        for g in spans:
            piece = texts[d].encode()[g["span_start"] : g["span_end"]]
            assert piece in texts[100].encode() and len(piece) > 0.5 * len(passage.encode())
    short = cut_spans(texts[101], [(g["span_start"], g["span_end"]) for g in by[101]])
    assert len(short) < len(texts[101]) - 200 and short.startswith(texts[101][:300])
    assert repeated_spans(documents(spark, [])).count() == 0
