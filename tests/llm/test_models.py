"""Language model, classifiers and mixing."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumwell.llm import cotrain, entropy_mix
from sumwell.llm.cotrain import co_train, drop_low_quality, quality_scores
from sumwell.llm.entropy_mix import capped_targets, fill_cells, mixed_documents, mixture
from sumwell.llm.katz import good_turing, score_texts
from sumwell.llm.toxicity import maximal_segments, passage_text, toxicity_scores
from tests.llm.common import documents, hard_documents, sentence, words


def held(n):
    return F.crc32(F.col("doc_id").cast("string")) % n


class BruteKatz:
    """A dictionary version of the model."""

    def __init__(self, rows):
        seqs = [[*words(t), None] for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
        self.c = Counter(x for s in seqs for x in s)
        self.pairs = Counter(p for s in seqs for p in zip([0, *s], s, strict=False))
        self.n = sum(self.c.values())
        self.own, self.unseen = self.kept(self.c)
        self.after = defaultdict(dict)
        d = self.discounts(self.pairs)
        for (u, w), k in self.pairs.items():
            self.after[u][w] = (k, d(k) * k)

    @staticmethod
    def discounts(counts):
        of = Counter(counts.values())
        d = good_turing([of.get(k, 0) for k in range(8)])
        return lambda k: d[k - 1] if k <= 5 else 1.0

    def kept(self, counts):
        d = self.discounts(counts)
        out = {w: d(k) * k / self.n for w, k in counts.items()}
        if 1 - sum(out.values()) < 1e-9:
            out = {w: x * self.n / (self.n + 1) for w, x in out.items()}
        return out, 1 - sum(out.values())

    def prob(self, u, w):
        one = self.own.get(w, self.unseen)
        if u not in self.after:
            return one
        n, kept = sum(k for k, _ in self.after[u].values()), sum(x for _, x in self.after[u].values())
        share = n / (n + 1) if kept > n * (1 - 1e-9) else 1.0
        if w in self.after[u]:
            return share * self.after[u][w][1] / n
        return (1 - share * kept / n) / (1 - sum(self.own[x] for x in self.after[u])) * one

    def score(self, text):
        s = [*words(text), None]
        return sum(math.log10(self.prob(u, w)) for u, w in zip([0, *s], s, strict=False))


@pytest.mark.parametrize("local", [1 << 18, 40])
def test_katz_is_a_distribution_and_equals_a_plain_version(spark, local):
    r = random.Random(2)
    rows = [(k, sentence(r, 120, 60) if k % 3 else sentence(r, 30, 1000)) for k in range(50)] + [(60, None), (61, ""), (62, "never seen Words here"), (None, "w1 w2 w3"), (3, "w1 w1"), (64, "w5 " * 5000)]
    df = documents(spark, [(d, t, None, None, None) for d, t in rows], clash=True)
    got = score_texts(df, held(7) != 2, local, 4 * local).collect()
    m = BruteKatz(rows)
    assert abs(sum(m.own.values()) + m.unseen - 1) < 1e-9
    base = lambda t: sum(math.log10((m.c[w] + 1) / (m.n + len(m.c) + 1)) for w in [*words(t), None])
    want = sorted((str(d), zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False, len(words(t)) + 1, sum(m.c[w] > 0 for w in [*words(t), None]), m.n, round(base(t), 6)) for d, t in rows)
    assert sorted((str(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == want
    for u in [*m.after, "unknown"]:  # exactly normalised
        assert abs(sum(m.prob(u, w) for w in m.own) + m.prob(u, "unknown") - 1) < 1e-9
    by_text = defaultdict(list)
    for x in got:
        by_text[(x["doc_id"], x["n_tokens"])].append(x["score"])
    for d, t in rows:
        want = m.score(t)
        assert any(abs(want - s) < 1e-6 * max(1, abs(want)) for s in by_text[(d, len(words(t)) + 1)])


def test_katz_where_no_count_is_discounted(spark):
    rows = [(k, "a b " * 8) for k in range(3)] + [(70, "a c")]
    got = score_texts(documents(spark, [(d, t, None, None, None) for d, t in rows]), held(7) != 2, 2, 4).collect()
    m = BruteKatz(rows)
    assert sorted(round(x["score"], 6) for x in got) == sorted(round(m.score(t), 6) for _, t in rows)


def test_katz_without_training_and_rows(spark):
    assert score_texts(documents(spark, []), F.lit(True)).count() == 0
    out = score_texts(documents(spark, [(1, "a b", None, None, None)]), F.lit(False)).first()
    assert out["train_tokens"] == 0 and out["n_known"] == 0 and out["held_out"] and out["score"] == pytest.approx(0.0)


def brute_segments(scores):
    """All maximal-scoring runs by definition: greedily the best run, then to its left and right."""
    out = []

    def go(lo, hi):
        best = None
        for a in range(lo, hi):
            t = 0.0
            for b in range(a, hi):
                t += scores[b]
                if t > 0 and (best is None or t > best[0] + 1e-12):
                    best = (t, a, b)
        if best:
            out.append(best)
            go(lo, best[1])
            go(best[2] + 1, hi)

    go(0, len(scores))
    return sorted((a, b, round(s, 6)) for s, a, b in out)


def test_maximal_segments():
    r = random.Random(1)
    for _ in range(60):
        n = r.randrange(1, 60)
        at = sorted(r.sample(range(n), r.randrange(0, n)))
        s = [round(r.uniform(0.1, 3), 3) for _ in at]
        full = [-0.7] * n
        for p, x in zip(at, s, strict=True):
            full[p] = x
        got = sorted((a, b, round(x, 6)) for x, a, b in maximal_segments(np.array(at), np.array(s), -0.7))
        assert got == brute_segments(full)


def toxic_corpus():
    r = random.Random(4)
    bad = ["vilea", "vileb", "vilec"]
    rows, labels = [], []
    for k in range(600):
        w = sentence(r, r.choice([20, 80, 300]), 300).split()
        toxic = k % 6 == 0
        if toxic:
            for _ in range(5):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    rows += [(9000, None, None, None, None), (9001, "", None, None, None), (None, "vilea vileb vilec", None, None, None), (9002, "w1 " * 20_000 + "vilea vileb vilec vilea", None, None, None), rows[0]]
    lab = spark.createDataFrame([*labels, (9001, None), (None, 1), (3, 5), (77_777, 1)], "doc_id long, toxic int").withColumn("score", F.lit("x"))
    got = toxicity_scores(documents(spark, rows, clash=True), lab, held(5) != 0).collect()
    assert len(got) == len(rows) and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.5) for g in got)
    truth = dict(labels)
    out = [g for g in got if g["doc_id"] in truth and zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0]
    assert sum(g["predicted"] == truth[g["doc_id"]] for g in out) > 0.97 * len(out)
    by = {g["doc_id"]: g for g in got}
    assert by[None]["predicted"] == 1 and by[9002]["predicted"] == 1 and by[9000]["score"] == by[9001]["score"] < 0.5
    p = by[9002]["passages"][-1]
    assert passage_text("w1 " * 20_000 + "vilea vileb vilec vilea", p["first"], p["last"]) == "vilea vileb vilec vilea"
    assert toxicity_scores(documents(spark, []), lab, held(5) != 0).count() == 0
    none = toxicity_scores(documents(spark, rows), lab.limit(0), held(5) != 0).collect()
    assert len(none) == len(rows) and all(g["predicted"] == 0 for g in none)


def quality_corpus(n=400):
    r = random.Random(6)
    rows, labels = [], []
    for k in range(n):
        good = k % 5 != 0
        t = sentence(r, r.choice([5, 60, 200]))
        t = t.replace(" ", ". ", 3) if good else "!! ".join(t.upper().split())
        rows.append((k, t, "en", f"src{r.randrange(6)}", len(t)))
        if k % 3 == 0:
            labels.append((k, int(good)))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_corpus()
    more = [(9000, None, None, None, None), (9001, "", None, None, None), (9002, "word. " * 30_000, "en", "src1", 1), rows[1], (None, rows[2][1], None, None, None)]
    lab = spark.createDataFrame([*labels, (None, 0), (1, None), (88_888, 1)], "doc_id long, quality int")
    docs = documents(spark, rows + more, clash=True)
    got = quality_scores(docs, lab).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= g["score"] <= 1 for g in got)
    assert sum((g["doc_id"] % 5 == 0) == g["rejected"] for g in got if g["doc_id"] is not None and g["doc_id"] < 400) > 0.99 * 400
    left = drop_low_quality(docs, lab)
    assert left.columns == docs.columns and left.count() == sum(not g["rejected"] for g in got)
    assert quality_scores(documents(spark, []), lab).count() == 0
    assert quality_scores(docs, lab.limit(0)).where("rejected").count() == 0
    assert quality_scores(docs.select("doc_id", "text"), lab).count() == len(got)  # without metadata


def test_views_teach_each_other():
    r = np.random.default_rng(0)
    y = (r.random(2000) < 0.7).astype(int)
    x = [np.column_stack([y[:, None] + r.normal(0, s, (2000, 1)), r.normal(size=(2000, 3))]) for s in (0.3, 0.4)]
    m = co_train([v[:30] for v in x], y[:30], [v[30:1500] for v in x])
    assert m.rounds and sum(sum(k["text"]) + sum(k["meta"]) for k in m.rounds) > 50
    z = np.column_stack([*(v.odds(f[1500:]) for v, f in zip(m.views, x, strict=True)), np.ones(500)])
    assert ((z @ m.combine > 0) == y[1500:]).mean() > 0.9


def test_all_unlabelled_documents_teach(spark):
    r = np.random.default_rng(3)
    n = 21_000
    good = r.random(n) < 0.6
    text, meta = np.zeros((n, cotrain.TEXT_FEATURES), np.float32), np.zeros((n, cotrain.META_FEATURES), np.float32)
    text[:, 0], meta[:, 5] = good + r.normal(0, 0.3, n), good + r.normal(0, 0.4, n)
    text[:, 1:4], meta[:, 6:9] = r.normal(size=(n, 3)), r.normal(size=(n, 3))
    ids = np.arange(n, dtype=object)
    ids[-5:] = None
    table = spark.createDataFrame([(k, i, t, m) for k, (i, t, m) in enumerate(zip(ids.tolist(), text.tolist(), meta.tolist(), strict=True))], "row long, doc_id long, text array<float>, meta array<float>").repartition(5)
    lab = spark.createDataFrame([(k, int(good[k])) for k in range(90)], "doc_id long, quality int")
    got = cotrain._fitted(table, lab, 20_000, cotrain.Scratch(spark, "t"))
    assert {x["pool"] for x in got.rounds} == {n - 90}
    taken = [sum(x["text"]) for x in got.rounds]
    assert taken[0] == pytest.approx(0.05 * (n - 90), rel=0.01) and len(taken) == 5
    want = cotrain.co_train([text[:90].astype(float), meta[:90].astype(float)], good[:90].astype(int), [text[90:].astype(float), meta[90:].astype(float)])
    for a, b in zip(got.views, want.views, strict=True):
        assert a.beta == pytest.approx(b.beta, abs=1e-4)
    assert ((got.scores(text, meta)[2] > 0.5) == good).mean() > 0.95


def test_pseudo_labels_meet_their_number_at_ties():
    counts = np.zeros(cotrain.BINS)
    counts[[10, 300, 500]] = 900, 80, 30
    assert cotrain._cut(counts, 50) == (300, 0.25, 50.0) and cotrain._cut(counts, 30) == (500, 1.0, 30.0)
    assert cotrain._cut(counts, 10) == (500, 10 / 30, 10.0) and cotrain._cut(counts, 2000)[2] == 110.0


def test_targets():
    assert capped_targets([100, 100, 100], [1, 2, 3], 3) == [50, 100, 150]
    assert capped_targets([10, 500, 0], [3, 1, 2], 3) == [30, 480, 0]
    assert capped_targets([], [], 3) == []


def test_one_text_larger_than_the_gap(spark):
    rows = [(k, "w " * 100, None, "a", None) for k in range(30)] + [(99, "w " * 9000, None, "a", None), (100, "w " * 6000, None, "b", None), (101, "w", None, "b", None)]
    got = mixture(documents(spark, rows), weights=(1, 1)).collect()
    taken = Counter()
    for g in got:
        taken[g["source"]] += g["taken"]
        assert 0 <= g["copies"] <= 3
    target = {g["source"]: g["target"] for g in got}
    assert all(abs(taken[s] - target[s]) <= {"a": 100, "b": 6000}[s] for s in "ab") and taken["a"] > 0.9 * target["a"]
    got = mixture(documents(spark, [*rows[:31], (200, "w " * 3000, None, "b", None)]), weights=(2, 3)).collect()
    assert sum(g["taken"] for g in got if g["source"] == "a") == pytest.approx(next(g["target"] for g in got if g["source"] == "a"), abs=100)


def test_cells_are_filled_like_by_brute_force(spark, monkeypatch):
    r = random.Random(12)
    for _ in range(300):
        k = r.randrange(1, 8)
        cells = list({(r.randrange(1, 40), r.randrange(0, 4)) for _ in range(k)})
        size, copies, n = [c[0] for c in cells], [c[1] for c in cells], [r.randrange(1, 6) for _ in cells]
        gap = r.uniform(-200, 200)
        out = fill_cells(size, copies, n, gap, 3)
        left = gap - sum(o * s for o, s in zip(out, size, strict=True))
        assert all(-m * c <= o <= m * (3 - c) for o, c, m in zip(out, copies, n, strict=True))
        plain, full = abs(gap), True  # the largest that fits, one document at a time
        for s, c, m in sorted(zip(size, copies, n, strict=True), reverse=True):
            for _ in range(m * (3 - c) if gap > 0 else m * c):
                if s <= plain:
                    plain -= s
                else:
                    full = False
        assert abs(left) <= plain + 1e-9 and (full or plain < max(size))
    monkeypatch.setattr(entropy_mix, "ROUND_TOGETHER", 7)  # many parts to a cell
    rows = [(k, "w " * 40, None, "a", None) for k in range(200)] + [(k, "w " * 50, None, "b", None) for k in range(300, 333)]
    got = mixture(documents(spark, rows), weights=(1, 3)).collect()
    for s, size_ in (("a", 40), ("b", 50)):
        assert abs(sum(g["taken"] for g in got if g["source"] == s) - next(g["target"] for g in got if g["source"] == s)) <= size_ / 2


def test_mixture(spark):
    r = random.Random(8)
    rows = [(k, sentence(r, int(math.exp(r.gauss(4, 1))) + 1), "en", ("a", "B", "c", None, "ü")[min(4, int(6 * r.random() ** 2))], 1) for k in range(800)]
    rows += [(900, None, None, "a", None), (901, "", None, "zero", None), rows[3], (902, "w " * 20_000, None, "big", 1), (None, "a b c", None, "B", 3)]
    got = mixture(documents(spark, rows, clash=True)).collect()
    again = mixture(documents(spark, rows, parts=7)).collect()
    key = lambda g: str((g["doc_id"], g["size"], g["source"]))
    assert [(key(g), g["taken"]) for g in sorted(got, key=lambda g: (key(g), g["taken"]))] == [(key(g), g["taken"]) for g in sorted(again, key=lambda g: (key(g), g["taken"]))]
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, capped_targets([size[s] for s in order], [1 + k % 3 for k in range(len(order))], 3), strict=True))
    taken = Counter()
    for g in got:
        assert g["target"] == pytest.approx(want[g["source"]]) and g["source_size"] == size[g["source"]] and g["taken"] <= 3 * g["size"]
        taken[g["source"]] += g["taken"]
    least = {s: min(len(words(t)) for _, t, _, x, _ in rows if x == s and words(t)) for s in order if size[s]}
    for s in order:  # a source of one text takes whole copies of it
        assert abs(taken[s] - want[s]) <= (least[s] if size[s] else 0)
    out = mixed_documents(documents(spark, rows[:700], clash=True))
    assert out.count() == mixture(documents(spark, rows[:700])).agg(F.sum("copies")).first()[0] and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert mixture(documents(spark, [])).count() == 0
    assert mixture(documents(spark, hard_documents(3))).count() == len(hard_documents(3))
