"""Quality classifier by co-training.

Two views describe a document: its text (composition of characters, words,
lines and their repetition) and its page metadata (language, source, length).
A logistic model of each view starts from the labelled documents.  In each
round either model labels the unlabelled documents that it is most sure of,
in the proportion of the classes, and both are fitted again on what the other
has labelled too.  At the end each view is calibrated on labelled documents
that its fit left out, the two calibrated views are combined by a third
logistic model, and every document is scored.

All unlabelled documents take part: each round scores them where they are,
histograms of log-odds give the cuts that meet the proportions, and Newton
steps are sums over them.  A document's pseudo-labels follow from the models
and cuts of the rounds so far, so that none are stored.  At most MAX_LABELLED
labelled documents are used, a pseudo-random choice by doc_id; features are
taken from all whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwell.llm.scratch import Scratch, hash_sample
from sumwell.llm.text import distinct_sorted, mix, word_hashes

MAX_LABELLED = 20_000
ROUNDS = 5
#: Share of the pool that a model labels per round.
PER_ROUND = 0.05
#: Confidence that a pseudo-label needs.
SURE = 0.9
#: Weight of a pseudo-label; a document of the bin that a cut goes through has its share of it.
WEIGHT = 0.3
#: Bins of the histograms to a unit of log-odds, and their number to either side of 0.
FINE, BINS = 64, 64 * 30 + 1
#: Partial sums that come to the driver in a pass, at most.
PARTIALS = 256
SOURCE_BUCKETS = 32
#: Languages with a feature of their own (fixed values); others share one.
LANGUAGES = ("de", "en", "es", "fr")

_KIND = np.zeros(256, dtype=np.uint8)  # 0: other ASCII punctuation
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f\r", b"\n", b".", b",", b"!?", b"|<>{}[]\\^~`", b"#$%&*+=@_/", b"'\"()-:;"), 1):
    _KIND[list(_bytes)] = _k
_KIND[128:] = 12
_KINDS = 13
TEXT_FEATURES = _KINDS + 9


def text_features(text: str | None) -> np.ndarray:
    """The text view: shares of character kinds, sizes, and how much of words and lines repeats."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(TEXT_FEATURES)
    if not data:
        out[-1] = 1
        return out
    a = np.frombuffer(data, dtype=np.uint8)
    kinds = np.bincount(_KIND[a], minlength=_KINDS)
    out[:_KINDS] = np.sqrt(kinds / len(a))
    words, _ = word_hashes(data)
    n = len(words)
    rest = out[_KINDS:]
    rest[0] = np.log1p(n) / 10
    rest[1] = np.log1p(len(a) / max(1, n)) / 3
    if n:
        rest[2] = len(distinct_sorted(words)) / n
        runs = words if n < 5 else mix(mix(mix(mix(words[:-4]) ^ words[1:-3]) ^ words[2:-2]) ^ words[3:-1]) ^ words[4:]
        rest[3] = len(distinct_sorted(runs)) / len(runs)
    lines = [x for x in data.split(b"\n") if x]
    rest[4] = len(set(lines)) / max(1, len(lines))
    rest[5] = np.log1p(len(a) / max(1, len(lines))) / 10
    letters = kinds[1] + kinds[2]
    rest[6] = kinds[2] / max(1, letters)
    rest[7] = (kinds[0] + kinds[8:11].sum()) / max(1, n)
    rest[7] = min(2.0, rest[7])
    return out


def meta_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """The metadata view: language, hashed source, length."""
    out = np.zeros(len(LANGUAGES) + 1 + SOURCE_BUCKETS + 1 + 3)
    out[LANGUAGES.index(lang) if lang in LANGUAGES else len(LANGUAGES)] = 1
    at = len(LANGUAGES) + 1
    if source is None:
        out[at + SOURCE_BUCKETS] = 1
    else:
        h, _ = word_hashes(b"s" + source.encode("utf-8", "surrogatepass").replace(b" ", b"_"))
        out[at + int(h[0] % np.uint64(SOURCE_BUCKETS)) if len(h) else at] = 1
    size = np.log1p(max(0.0, float(n_chars or 0))) / 10
    out[-3:] = size, size * size, float(not n_chars)
    return out


META_FEATURES = len(LANGUAGES) + 1 + SOURCE_BUCKETS + 1 + 3


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, row and both views of every row; metadata columns that are missing count as null."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.list_(pa.float32())), ("meta", pa.list_(pa.float32()))])
    have = {c.lower() for c in docs.columns}
    col = lambda name, kind: (F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)).alias(name)
    rows = docs.select(col("doc_id", "long"), col("text", "string"), col("lang", "string"), col("source", "string"), col("n_chars", "double"))
    # rows are told apart by their content: equal rows have equal features
    rows = rows.select(F.xxhash64("doc_id", "text", "lang", "source", "n_chars").alias("row"), "doc_id", "text", "lang", "source", F.coalesce("n_chars", F.length("text")).cast("double").alias("n_chars"))

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    def run(batches):
        for b in batches:
            _, _, text, lang, source, n = (c.to_pylist() for c in b.columns)
            t, m = np.zeros((len(text), TEXT_FEATURES), dtype=np.float32), np.zeros((len(text), META_FEATURES), dtype=np.float32)
            for k, x in enumerate(text):
                t[k], m[k] = text_features(x), meta_features(lang[k], source[k], n[k])
            if len(text):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(t), lists(m)], schema=schema)

    return rows.mapInArrow(run, "row long, doc_id long, text array<float>, meta array<float>")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        move = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * beta)
        beta += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-7:
            break
    return beta


@dataclass
class View:
    """Standardised logistic model of one view, with the slope and offset that calibrate its log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack(((x - self.mean) / self.scale, np.ones(len(x))))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * np.clip(self.design(x) @ self.beta, -30, 30) + self.offset


@dataclass
class Round:
    """The views of a round; for each, the least bin that it labels good, the share of weight in it, and the same for bad."""

    views: list[View]
    cuts: list[tuple[int, float, int, float]]


def _bins(odds: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.maximum(odds, 0) * FINE).astype(np.int64), BINS - 1)


def pseudo_labels(done: list[Round], x: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """What the rounds have taught each view on these documents (labels, weights), and which documents none has labelled."""
    n = len(x[0])
    y, w, free = [np.zeros(n), np.zeros(n)], [np.zeros(n), np.zeros(n)], np.ones(n, dtype=bool)
    for r in done:
        picked = np.zeros(n, dtype=bool)
        for k, (good, good_share, bad, bad_share) in enumerate(r.cuts):  # the labels of one view teach the other
            odds = r.views[k].odds(x[k])
            for label, least, share, b in ((1.0, good, good_share, _bins(odds)), (0.0, bad, bad_share, _bins(-odds))):
                take = free & (b >= least)
                y[1 - k][take] = label
                w[1 - k][take] = np.where(b[take] == least, share, 1.0) * WEIGHT
                picked |= take
        free &= ~picked
    return y, w, free


def pool_size(x: list[np.ndarray], state) -> np.ndarray:
    return np.array([float(len(x[0]))])


def pool_moments(x: list[np.ndarray], state) -> np.ndarray:
    """Number, sums and sums of squares of the pseudo-labelled documents, for both views."""
    w = pseudo_labels(state, x)[1]
    return np.concatenate([_moments(v[m > 0]) for v, m in zip(x, w, strict=True)])


def _moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0)))


def pool_histograms(x: list[np.ndarray], state) -> np.ndarray:
    """Of the documents without a label: counts by bin, for each view good and bad."""
    done, views = state
    free = pseudo_labels(done, x)[2]
    odds = [v.odds(f[free]) for v, f in zip(views, x, strict=True)]
    return np.concatenate([np.bincount(_bins(z), minlength=BINS).astype(float) for o in odds for z in (o, -o)])


def _newton_sums(v: View, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = v.design(x)
    p = 1 / (1 + np.exp(-np.clip(d @ v.beta, -30, 30)))
    return (d * (w * p * (1 - p))[:, None]).T @ d, d.T @ (w * (y - p))


def pool_newton(x: list[np.ndarray], state) -> np.ndarray:
    """Second and first derivatives over the pseudo-labelled documents, for both views."""
    done, views = state
    y, w, _ = pseudo_labels(done, x)
    out = []
    for k, v in enumerate(views):
        m = w[k] > 0
        h, g = _newton_sums(v, x[k][m], y[k][m], w[k][m])
        out += [h.ravel(), g]
    return np.concatenate(out)


def _fit_views(views: list[View], labelled: list[np.ndarray], y: np.ndarray, done: list[Round], pool, ridge: float = 1.0, steps: int = 30) -> list[View]:
    """Newton steps for both views at once, from where they stand, over labelled and pseudo-labelled documents."""
    sums = pool(pool_moments, done) if done else None
    at, new = 0, []
    for v, x in zip(views, labelled, strict=True):
        k = x.shape[1]
        own = _moments(x) if sums is None else _moments(x) + sums[at : at + 2 * k + 1]
        at += 2 * k + 1
        mean = own[1 : k + 1] / own[0]
        scale = np.sqrt(np.maximum(0.0, own[k + 1 :] / own[0] - mean * mean))
        scale = np.where(scale > 1e-6, scale, 1.0)
        slopes = v.beta[:-1] / v.scale
        new.append(View(mean, scale, np.append(slopes * scale, v.beta[-1] + slopes @ (mean - v.mean))))
    views = new
    for _ in range(steps):
        far = pool(pool_newton, (done, views)) if done else None
        at, most = 0, 0.0
        for v, x in zip(views, labelled, strict=True):
            h, g = _newton_sums(v, x, y, np.ones(len(y)))
            n = len(g)
            if far is not None:
                h, g = h + far[at : at + n * n].reshape(n, n), g + far[at + n * n : at + n * n + n]
            at += n * n + n
            move = np.linalg.solve(h + ridge * np.eye(n), g - ridge * v.beta)
            v.beta = v.beta + np.clip(move, -5, 5)
            most = max(most, np.abs(move).max())
        if most < 1e-5:
            break
    return views


def _cut(counts: np.ndarray, budget: int) -> tuple[int, float, float]:
    """The least bin to take, the share of weight for the documents in it, and the number taken by weight."""
    sure = -int(-np.log(SURE / (1 - SURE)) * FINE // 1)
    above = np.cumsum(counts[::-1])[::-1]  # in this bin or a higher one
    if above[sure] <= budget:
        return sure, 1.0, float(above[sure])
    k = int(np.flatnonzero(above >= budget)[-1])
    return k, float((budget - (above[k] - counts[k])) / counts[k]), float(budget)


@dataclass
class Model:
    views: list[View]
    combine: np.ndarray  # weights of the two calibrated log-odds, and an offset
    rounds: list[dict]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
        """Probability of good quality by the text, by the metadata, and by both."""
        z = [v.odds(x) for v, x in zip(self.views, (text, meta), strict=True)]
        both = self.combine[0] * z[0] + self.combine[1] * z[1] + self.combine[2]
        return [1 / (1 + np.exp(-np.clip(o, -500, 500))) for o in (*z, both)]


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool, rounds: int = ROUNDS) -> Model:
    """Fit both views and their combination.

    ``labelled`` holds the features of each view; ``pool`` does for the
    unlabelled documents, or is a function that sums a ``pool_`` function over
    them, given it and its state.
    """
    if len(np.unique(y)) < 2:  # nothing to tell apart: everybody gets the one class (or the good one)
        p = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
        views = [View(np.zeros(n), np.ones(n), np.zeros(n + 1)) for n in (TEXT_FEATURES, META_FEATURES)]
        return Model(views, np.array([0.0, 0.0, np.log(p / (1 - p))]), [])
    over = pool if callable(pool) else lambda f, state: f(pool, state)
    fold = np.arange(len(y)) % 3 == 0  # left out of the fits, for calibration
    if len(np.unique(y[~fold])) < 2 or len(np.unique(y[fold])) < 2:
        fold = np.ones(len(y), dtype=bool)
    train = ~fold if not fold.all() else fold
    mine, label = [x[train] for x in labelled], y[train].astype(float)
    size = int(over(pool_size, None)[0])
    views = [View(np.zeros(k), np.ones(k), np.zeros(k + 1)) for k in (x.shape[1] for x in labelled)]
    done, log = [], []
    share, budget = float(y.mean()), max(1, int(PER_ROUND * size))
    for _ in range(rounds if size else 0):
        views = _fit_views(views, mine, label, done, over)
        counts = over(pool_histograms, (done, views)).reshape(2, 2, BINS)
        cuts, taken = [], []
        for good, bad in counts:
            g, b = _cut(good, max(1, round(budget * share))), _cut(bad, max(1, round(budget * (1 - share))))
            cuts.append((*g[:2], *b[:2]))
            taken.append((g[2], b[2]))
        log.append({"pool": size, "text": taken[0], "meta": taken[1]})
        if not any(map(sum, taken)):
            break
        done.append(Round(views, cuts))
    views = _fit_views(views, mine, label, done, over)
    held, yh = [x[fold] for x in labelled], y[fold].astype(float)
    for v, x in zip(views, held, strict=True):
        z = v.odds(x)
        v.slope, v.offset = (float(b) for b in fit_logistic(np.column_stack((z, np.ones(len(z)))), yh, np.ones(len(z)), 0.1))
    z = np.column_stack([*(v.odds(x) for v, x in zip(views, held, strict=True)), np.ones(len(yh))])
    return Model(views, fit_logistic(z, yh, np.ones(len(z)), 0.1), log)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = MAX_LABELLED, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_score, meta_score, score, rejected (and row, a hash of the row's content).

    ``docs`` has doc_id and text, and lang, source and n_chars if known.
    ``labels`` (doc_id, quality) marks some documents; labels other than 0 and
    1 are passed over, of contradicting ones 0 counts.  With labels of one
    kind, or none, all documents get that kind's share (0.999 without).  Nulls
    are a value of their own in each feature.  Repeated rows are scored alike;
    an empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "quality")
    table = scratch.write(feature_table(docs), "features")
    model = spark.sparkContext.broadcast(_fitted(table, labels, max_labelled, scratch))
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("text_score", pa.float64()), ("meta_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        m = model.value
        for b in batches:
            x = _arrays(b.columns[2:])
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), *[pa.array(p) for p in m.scores(*x)]], schema=schema)

    out = table.select("row", "doc_id", "text", "meta").mapInArrow(run, "doc_id long, row long, text_score double, meta_score double, score double")
    return out.withColumn("rejected", F.col("score") < threshold)


_SIZES = (("text", TEXT_FEATURES), ("meta", META_FEATURES))


def _arrays(columns) -> list[np.ndarray]:
    return [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), n).astype(float) for c, (_, n) in zip(columns, _SIZES, strict=True)]


def _over(pool: DataFrame):
    """Sums of a function over the documents of the pool (text, meta), taken where they are."""
    spark = pool.sparkSession
    schema = pa.schema([("sums", pa.list_(pa.float64()))])

    def total(f, state) -> np.ndarray:
        given = spark.sparkContext.broadcast(state)

        def run(batches):
            out = f([np.zeros((0, n)) for _, n in _SIZES], given.value)
            for b in batches:
                out = out + f(_arrays(b.columns), given.value)
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], schema=schema)

        parts = pool.coalesce(PARTIALS).mapInArrow(run, "sums array<double>").toArrow().column(0).to_pylist()  # PARTIALS rows
        given.unpersist()
        return np.sum(parts, axis=0) if parts else f([np.zeros((0, n)) for _, n in _SIZES], state)

    return total


def _fitted(table: DataFrame, labels: DataFrame, max_labelled: int, scratch: Scratch) -> Model:
    """The model, fitted on a sample of bounded size of the labelled documents and on all others."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    seen = hash_sample(table.join(marked, "doc_id"), "doc_id", max_labelled).toPandas()
    seen = seen.sort_values(["row", "doc_id"], ignore_index=True)  # row is a hash: folds are random
    stack = lambda frame, c, n: np.vstack(frame[c].to_list()).astype(float) if len(frame) else np.zeros((0, n))
    y = seen["label"].to_numpy(dtype=int)
    pool = None
    if len(np.unique(y)) > 1:
        pool = _over(scratch.write(table.join(marked, "doc_id", "left_anti").select("text", "meta"), "pool"))
    return co_train([stack(seen, c, n) for c, n in _SIZES], y, pool)


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected; cases as in :func:`quality_scores`.

    Rows are scored where they are: no text is shuffled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    table = scratch.write(feature_table(docs), "features")
    model = spark.sparkContext.broadcast(_fitted(table, labels, max_labelled, scratch))

    @F.pandas_udf("boolean")
    def good(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        none = lambda s: [None if v is None or v != v else v for v in s]
        rows = list(zip(none(text), none(lang), none(source), none(n_chars), strict=True))
        t, m = np.zeros((len(rows), TEXT_FEATURES), dtype=np.float32), np.zeros((len(rows), META_FEATURES), dtype=np.float32)
        for k, (x, *meta) in enumerate(rows):
            t[k], m[k] = text_features(x), meta_features(*meta)
        return pd.Series(model.value.scores(t.astype(float), m.astype(float))[2] >= threshold)

    have = {c.lower() for c in docs.columns}
    col = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    n_chars = F.coalesce(col("n_chars", "double"), F.length(col("text", "string")).cast("double"))
    return docs.where(good(col("text", "string"), col("lang", "string"), col("source", "string"), n_chars))
