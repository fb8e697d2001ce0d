"""Toxicity by maximum-scoring segments.

Token weights are log-odds between toxic and other labelled texts under
Dirichlet priors (Monroe et al., 2008); tokens whose log-odds are not
significant form one class, whose log-odds are slightly negative.  A linear
scan (Ruzzo & Tompa, 1999) finds every maximal-scoring passage of a text.
Under the scores' background distribution, passages of score s or more occur
in a text of n tokens with Gumbel-distributed maximum: expected
``K n exp(-lambda s)`` (Karlin & Altschul, 1990).  A text is described by the
significance of its best passage and by that of all passages together, and a
logistic curve over the two, fitted on the same labelled texts, is its score.

Labels of at most MAX_LABELLED texts, a pseudo-random choice by doc_id, are
learned from, which bounds the weighted tokens too; weights are looked up for
all tokens of all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwell.llm.scratch import Scratch, hash_sample
from sumwell.llm.text import END_HASH, encoded, mix, word_edges, word_slices

#: Labelled texts that the model is fitted on, at most.
MAX_LABELLED = 20_000
#: Significance of a token's log-odds.
LEAST_Z = 4.0
#: Log-odds that a weighted token has at least: weaker ones add up in long texts of any kind.
LEAST_ODDS = 1.5
#: Tokens that the prior is worth, as a share of the labelled tokens.
PRIOR = 0.1


def sample_labels(labels: DataFrame, column: str, learn_from: Column, limit: int = MAX_LABELLED) -> pd.DataFrame:
    """doc_id and label of at most ``limit`` labelled documents, chosen by a hash of doc_id."""
    rows = labels.where(learn_from & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    return hash_sample(rows, "doc_id", limit).toPandas()


def _token_counts(docs: DataFrame, sample: pd.DataFrame) -> DataFrame:
    """token, toxic, other: in how many contexts the sampled documents of either kind hold the token.

    A context is the token with its neighbours.  Copies of a document, exact
    or near, and texts that repeat themselves hold the same contexts, and so
    have no more say than one text.
    """
    ids = np.sort(sample["doc_id"].to_numpy(dtype=np.int64))
    toxic = sample.sort_values("doc_id")["label"].to_numpy(dtype=np.int64)
    given = docs.sparkSession.sparkContext.broadcast((ids, toxic))
    schema = pa.schema([("token", pa.int64()), ("context", pa.int64()), ("toxic", pa.int64())])

    def run(batches):
        ids, toxic = given.value
        for b in batches:
            if not len(ids):
                return
            doc = b.column(0).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
            mine = ids[at] == doc
            texts, label = b.column(1).filter(pa.array(mine)).to_pylist(), toxic[at[mine]]
            parts: list[list[np.ndarray]] = [[], [], []]
            for lo, hi, words, off in word_slices(texts):
                if not len(words):
                    continue
                left, right = np.roll(words, 1), np.roll(words, -1)
                filled = off[:-1][off[1:] > off[:-1]]
                left[filled], right[off[1:][off[1:] > off[:-1]] - 1] = END_HASH, END_HASH
                which = np.repeat(label[lo:hi], np.diff(off))
                around = mix(mix(left ^ words) + right)
                _, first = np.unique(around + which.astype(np.uint64), return_index=True)
                for p, x in zip(parts, (words[first].view(np.int64), around[first].view(np.int64), which[first]), strict=True):
                    p.append(x)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], schema=schema)

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "token long, context long, toxic long")
    once = found.distinct()
    return once.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other"))


@dataclass
class Weights:
    """Log-odds of the weighted tokens (by hash) and of all others; rate is the share of each under other texts."""

    tokens: np.ndarray
    scores: np.ndarray
    rest: float
    slope: float


def token_weights(counts: DataFrame) -> Weights:
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).first()
    n_t, n_o = float(total["t"] or 0), float(total["o"] or 0)
    if not n_t or not n_o:
        return Weights(np.empty(0, dtype=np.uint64), np.empty(0), -1.0, 1.0)
    prior = PRIOR * (n_t + n_o)
    a = (F.col("toxic") + F.col("other")) / F.lit(n_t + n_o) * F.lit(prior)
    y_t, y_o = F.col("toxic") + a, F.col("other") + a
    odds = F.log(y_t / (F.lit(n_t + prior) - y_t)) - F.log(y_o / (F.lit(n_o + prior) - y_o))
    z = odds / F.sqrt(1 / y_t + 1 / y_o)
    picked = counts.select("token", "toxic", "other", odds.alias("odds"), z.alias("z")).where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).toPandas().sort_values("token")
    rest_t, rest_o = n_t - picked["toxic"].sum(), n_o - picked["other"].sum()
    rest = min(-1e-4, float(np.log((rest_t + prior * 0.5) / (n_t + prior)) - np.log((rest_o + prior * 0.5) / (n_o + prior))))
    tokens = picked["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    scores, rate = picked["odds"].to_numpy(dtype=float), (picked["other"].to_numpy(dtype=float) + 0.5) / (n_o + 1)
    # lambda: the positive root of E exp(lambda s) = 1 under other texts
    lo, hi = 0.0, 1.0

    def excess(x):
        return float((rate * np.expm1(np.minimum(x * scores, 700))).sum() + (1 - rate.sum()) * np.expm1(x * rest))

    while len(scores) and excess(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return Weights(tokens[order], scores[order], rest, hi if len(scores) else 1.0)


def maximal_segments(at: np.ndarray, scores: np.ndarray, rest: float) -> list[tuple[float, int, int]]:
    """(score, first, last) of every maximal-scoring run, where tokens ``at`` score and all others have ``rest`` < 0.

    Ruzzo and Tompa's linear scan over the positive tokens; the tokens
    between two of them enter the running total at once.
    """
    out: list[list[float]] = []  # left total, right total, first, last
    total, before = 0.0, -1
    for p, s in zip(at.tolist(), scores.tolist(), strict=True):
        total += rest * (p - before - 1)
        before = p
        seg = [total, total + s, p, p]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= seg[0]:
                j -= 1
            if j < 0 or out[j][1] >= seg[1]:
                out.append(seg)
                break
            seg = [out[j][0], seg[1], out[j][2], seg[3]]
            del out[j:]
    return [(s[1] - s[0], int(s[2]), int(s[3])) for s in out]


def passages(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, n_tokens and the score, first and last token of each maximal passage of each text."""
    given = docs.sparkSession.sparkContext.broadcast(weights)
    kind = pa.struct([("score", pa.float64()), ("first", pa.int64()), ("last", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("passages", pa.list_(kind))])

    def run(batches):
        w = given.value
        for b in batches:
            n, found = np.zeros(len(b), dtype=np.int64), [[] for _ in range(len(b))]
            for lo, hi, words, off in word_slices(b.column(1).to_pylist()):
                n[lo:hi] = np.diff(off)
                if not len(w.tokens) or not len(words):
                    continue
                k = np.minimum(np.searchsorted(w.tokens, words), len(w.tokens) - 1)
                hit = np.flatnonzero(w.tokens[k] == words)
                cut = np.searchsorted(hit, off)
                for d in np.flatnonzero(np.diff(cut)):
                    h = hit[cut[d] : cut[d + 1]]
                    found[lo + d] = [{"score": s, "first": i, "last": j} for s, i, j in maximal_segments(h - off[d], w.scores[k[h]], w.rest)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(found, pa.list_(kind))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, passages array<struct<score: double, first: long, last: long>>")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        move = np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
        beta += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-9:
            break
    return beta


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn_from: Column, threshold: float = 0.5, max_labelled: int = MAX_LABELLED, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, score, predicted, n_passages, passages.

    ``labels`` (doc_id, toxic) marks some documents; those for which
    ``learn_from``, an expression over ``labels``, holds are learned from.
    ``passages`` lists each significant passage with its first and last token.
    Null and empty texts have no passage and get the score of such texts; so
    do all texts while no labels of both kinds are given, with the share of
    toxic labels as score (0 without labels).  Null doc_ids are scored, never
    learned from; labels that are neither 0 nor 1 are passed over; of
    contradicting labels 1 counts.  Repeated rows are scored one by one, an
    empty table gives an empty result, further columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "toxic")
    sample = sample_labels(labels, "toxic", learn_from, max_labelled)
    weights = token_weights(scratch.write(_token_counts(docs, sample), "counts"))
    found = scratch.write(passages(docs, weights), "passages")
    mean = float(sample["label"].mean()) if len(sample) else 0.0
    lam = weights.slope
    best = F.coalesce(F.array_max(F.transform("passages", lambda p: p["score"])), F.lit(0.0))
    mine = found.join(F.broadcast(docs.sparkSession.createDataFrame(sample.astype({"doc_id": "int64", "label": "int64"}), "doc_id long, label long")), "doc_id").select("doc_id", "label", "n_tokens", best.alias("best"), F.transform("passages", lambda p: p["score"]).alias("all"))
    fit = mine.groupBy("doc_id", "label").agg(F.max(F.struct("best", "n_tokens", "all")).alias("f")).select("doc_id", "label", "f.*").orderBy("doc_id").toPandas()  # a row per sampled document
    k = 0.1
    other = fit[(fit["label"] == 0) & (fit["best"] > 0)]
    if len(other) >= 20:  # K: expected number of passages at the median of the observed maxima
        s = float(other["best"].median())
        share = max(1e-6, float((fit[fit["label"] == 0]["best"] >= s).mean()))
        k = float(np.clip(-np.log1p(-min(share, 1 - 1e-6)) / (fit["n_tokens"].clip(lower=1).mean() * np.exp(-lam * s)), 1e-9, 10.0))

    def bits(score: float, n: int) -> float:
        return lam * score - np.log(k * max(n, 1))

    if fit["label"].nunique() == 2:
        x = np.array([[1.0, max(0.0, bits(b, n)) if b > 0 else 0.0, sum(max(0.0, bits(s, n)) for s in al)] for b, n, al in zip(fit["best"], fit["n_tokens"], fit["all"], strict=True)])
        scale = np.array([1.0, *np.maximum(1e-9, x[:, 1:].std(axis=0))])
        beta = _logistic(x / scale, fit["label"].to_numpy(dtype=float)) / scale
    else:
        beta = np.array([np.log((mean + 1e-9) / (1 - mean + 1e-9)), 0.0, 0.0])
    surprise = lambda s: F.greatest(F.lit(0.0), F.lit(lam) * s - F.log(F.lit(k) * F.greatest(F.col("n_tokens"), F.lit(1))))
    one = F.when(best > 0, surprise(best)).otherwise(0.0)
    everything = F.aggregate("passages", F.lit(0.0), lambda a, p: a + surprise(p["score"]))
    score = 1 / (1 + F.exp(-(F.lit(float(beta[0])) + F.lit(float(beta[1])) * one + F.lit(float(beta[2])) * everything)))
    out = found.select("doc_id", score.alias("score"), F.filter("passages", lambda p: surprise(p["score"]) > 0).alias("passages"))
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), "passages")


def passage_text(text: str, first: int, last: int) -> str:
    """The passage from token ``first`` to token ``last`` of a text."""
    data = encoded(text)
    starts, ends = word_edges(np.frombuffer(data, dtype=np.uint8))
    return text.encode("utf-8", "surrogatepass")[starts[first] : ends[last]].decode("utf-8", "surrogatepass")
