"""Benchmark decontamination by winnowing; DataFrame functions only.

A window is ``span`` consecutive words of a benchmark item; an item of fewer
words is one window of its own length.  Both sides are winnowed (Schleimer et
al., 2003): of the RUNS runs of k words in each window, k + RUNS - 1 = span,
the least hash is kept, the rightmost of equal ones, and only where it differs
from that of the window before.  Equal windows keep the same run, so the join
on kept hashes reaches every shared span of at least ``span`` words.  Hits are
then extended word by word to both sides; those that reach ``span`` words are
spans, and the spans of a document are united.

Documents are read once.  Fingerprints are made inside generated code and meet
those of the benchmark there, so that only hits are ever shuffled.  A
benchmark that is too large to be broadcast is joined by its fingerprints,
and the words around the hits are fetched afterwards.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumwell.llm.exact_dedup import free_name
from sumwell.llm.scratch import Scratch

#: Runs of words hashed per window, one of which is kept.
RUNS = 4
#: A benchmark whose fingerprints and the words around them take up to so many bytes is broadcast.
MAX_BROADCAST = 64 << 20
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone.  Texts in ASCII take the faster function, which is the same for them."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _NOT_WORD), "")


def _split_words(rows: DataFrame, *keys) -> DataFrame:
    """The keys, words, n_words and the hashes of the words."""
    rows = rows.select(*keys, words_of(F.col("text")).alias("words"))
    return rows.select("*", F.size("words").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def _runs_from(m: int, span: int) -> tuple[int, int]:
    """Runs hashed in a window of m words, and their length."""
    runs = min(RUNS, m) if m == span else 1
    return runs, m - runs + 1


def fingerprints(rows: DataFrame, span: int, lengths: list[int]) -> DataFrame:
    """The rows (words, n_words, hashes and more) by (m, at, print): the kept runs of windows of m words start at word ``at`` (from 0).

    A run is kept if it is the least of some window: as many runs to its left
    that are not less and to its right that are greater as a window has beside
    it.  Windows shorter than ``span`` are one run.  Each row also gives one
    with at = -1.
    """
    keep, n = [c for c in rows.columns if c != "hashes"], F.col("n_words")
    kept = [F.array(F.struct(F.lit(min(lengths, default=0)).alias("m"), F.lit(-1).alias("at"), F.lit(None).cast("long").alias("print")))]

    def hashed(m: int) -> Column:
        _, k = _runs_from(m, span)
        return F.transform(F.sequence(F.lit(0), n - F.lit(k)), lambda j: F.xxhash64(F.slice("hashes", j + 1, F.lit(k))))

    def least(m: int, i: Column) -> Column:
        own, beside = F.get(f"runs_{m}", i), _runs_from(m, span)[0] - 1
        before = [F.get(f"runs_{m}", i - F.lit(j)) >= own for j in range(1, beside + 1)]
        after = [F.get(f"runs_{m}", i + F.lit(j)) > own for j in range(1, beside + 1)]
        out = F.lit(beside == 0)
        for left in range(beside + 1) if beside else ():
            out = out | functools.reduce(Column.__and__, [*before[:left], *after[: beside - left]])
        return F.coalesce(out, F.lit(False))  # null beyond the ends of the text

    def places(m: int) -> Column:
        every = F.when(F.size(f"runs_{m}") > 0, F.sequence(F.lit(0), F.size(f"runs_{m}") - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(every, lambda i: least(m, i)), lambda i: F.struct(F.lit(m).alias("m"), i.alias("at"), F.get(f"runs_{m}", i).alias("print")))

    # selected in arrays: as generated code for a row per word this would be too long to be compiled
    runs = [F.when(n >= m, hashed(m)).otherwise(F.array().cast("array<bigint>")).alias(f"runs_{m}") for m in lengths]
    kept += [places(m) for m in lengths]
    return rows.select(*keep, *runs).select(*keep, F.explode(F.concat(*kept)).alias("p")).select(*keep, "p.m", "p.at", "p.print")


def _around(span: int) -> list[Column]:
    """The words of the run at ``at``, and RUNS - 1 words to its left, nearest first, and to its right."""
    _, k = _runs_from(span, span)
    at, reach = F.col("at"), min(RUNS, span) - 1
    size = F.when(F.col("m") == span, k).otherwise(F.col("m"))
    left = F.least(at, F.lit(reach))
    return [
        F.slice("words", at + 1, size).alias("run"),
        F.reverse(F.slice("words", at - left + 1, left)).alias("left"),
        F.slice("words", at + size + 1, F.lit(reach)).alias("right"),
    ]


def benchmark_runs(items: DataFrame, span: int) -> DataFrame:
    """m, print, run, left, right and the items that have this run in these words, of the kept runs of all items."""
    w = _split_words(items, F.col("item_id").cast("string").alias("item_id")).where("n_words > 0")
    w = w.withColumn("own", F.least("n_words", F.lit(span)))
    lengths = sorted(r["own"] for r in w.select("own").distinct().collect())  # up to span rows
    f = fingerprints(w, span, lengths).where("at >= 0 and m = own").select("item_id", "m", "print", *_around(span))
    short = F.col("m") < span
    none = F.array().cast("array<string>")
    f = f.select("item_id", "m", "print", "run", F.when(short, none).otherwise(F.col("left")).alias("left"), F.when(short, none).otherwise(F.col("right")).alias("right"))
    return f.groupBy("m", "print", "run", "left", "right").agg(F.collect_set("item_id").alias("items"))


def _common(a: str, b: str) -> Column:
    """Length of the common beginning of two arrays of words."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _spans(docs: DataFrame, items: DataFrame, span: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_words) of every row, and (doc_id, text_key, start, end, items) of the shared spans."""
    bench = scratch.write(benchmark_runs(items, span), "bench")
    words = F.aggregate(F.concat("run", "left", "right"), F.lit(0), lambda a, w: a + F.octet_length(w) + 8)
    ids = F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 8)
    found = bench.groupBy("m").agg(F.sum((words + ids + 64).cast("long")).alias("bytes")).collect()  # a row for each length up to span
    lengths, total = sorted(r["m"] for r in found), sum(r["bytes"] for r in found)
    local = total <= MAX_BROADCAST
    prints = bench.select("m", "print").distinct()
    keys = [F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key")]
    rows = fingerprints(_split_words(docs, *keys), span, lengths)
    names = ["doc_id", "text_key", "n_words", "m", "at", "print"]
    if not lengths:
        hits = rows.select(*names).withColumns({c: F.lit(None).cast("array<string>") for c in ("run", "left", "right")})
    elif local:  # the row at -1 stands for the document itself
        hits = rows.join(F.broadcast(prints.withColumn("hit", F.lit(True))), ["m", "print"], "left").where("at < 0 or hit")
        hits = hits.select(*names, *[F.when(F.col("at") >= 0, c).alias(n) for c, n in zip(_around(span), ("run", "left", "right"), strict=True)])
    else:
        hits = rows.select(*names)
        hits = hits.where("at >= 0").join(prints, ["m", "print"]).select(*names).unionByName(hits.where("at < 0"))
    hits = scratch.write(hits, "hits")
    base, hits = hits.where("at < 0").select("doc_id", "text_key", "n_words"), hits.where("at >= 0")
    if lengths and not local:
        places = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("m", "at", "print")).alias("places"))  # of one text
        places = places.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), "places")
        again = docs.select(*keys, "text")
        again = again.join(places, again["doc_id"].eqNullSafe(places["of"]) & (again["text_key"] == places["of_key"]))
        again = again.select("doc_id", "text_key", words_of(F.col("text")).alias("words"), F.explode("places").alias("p"))
        hits = again.select("doc_id", "text_key", "words", "p.*").select("doc_id", "text_key", "m", "at", "print", *_around(span))
    mine = bench.select("m", "print", F.col("run").alias("b_run"), F.col("left").alias("b_left"), F.col("right").alias("b_right"), "items")
    both = hits.join(F.broadcast(mine) if local else mine, ["m", "print"]).where("run = b_run")
    both = both.select("doc_id", "text_key", "m", "at", "items", F.size("run").alias("size"), _common("left", "b_left").alias("l"), _common("right", "b_right").alias("r"))
    spans = both.where("l + size + r >= m").select("doc_id", "text_key", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("size") + F.col("r")).alias("end"), "items")
    return base, spans


def contaminated_texts(docs: DataFrame, items: DataFrame, span: int = 13, scratch: Scratch | None = None) -> DataFrame:
    """doc_id and text_key (hash of the text) of the documents that hold a window; cases as in :func:`contamination`."""
    scratch = scratch or Scratch(docs.sparkSession, "winnow")
    return _spans(docs, items, span, scratch)[1].select("doc_id", "text_key").distinct()


def contamination(docs: DataFrame, items: DataFrame, span: int = 13, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Other columns of both tables are ignored.  Null and empty texts have no
    words, no hits and are clean; items without words and null items match
    nothing; null item_ids count as hits but not as items.  Empty tables give
    no rows, or rows without hits.  Repeated documents are judged one by one,
    repeated items once; of equal hashes in a window the last is kept, so ties
    lose nothing.  Texts count whole, whatever their length.
    """
    scratch = scratch or Scratch(docs.sparkSession, "winnow")
    base, spans = _spans(docs, items, span, scratch)
    spans = scratch.write(spans, "spans")
    items_of = spans.groupBy("doc_id", "text_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    before = Window.partitionBy("doc_id", "text_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.col("start"))))
    covered = spans.select("doc_id", "text_key", "start", "end").distinct().withColumn("new", new).groupBy("doc_id", "text_key").agg(F.sum("new").alias("n_hit"))
    found = covered.alias("c").join(items_of.alias("t"), F.col("c.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("c.text_key") == F.col("t.text_key"))).select("c.doc_id", "c.text_key", "n_hit", "items")
    base = base.alias("b")
    out = base.join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.text_key") == F.col("f.text_key")), "left")
    n_hit, n_words = F.coalesce("n_hit", F.lit(0)).cast("long"), F.col("n_words").cast("long")
    return out.select(
        F.col("b.doc_id").alias("doc_id"), n_words.alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= n_words)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, span: int = 13) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold a window of an item, however long they are.

    A window is ``span`` words of an item, or a whole item of fewer words.
    Rows are judged by their own text: one that shares its doc_id, or a null
    doc_id, with a contaminated one stays if it holds no window.  Other cases
    as in :func:`contamination`.
    """
    doc, text, key = (free_name(docs, f"winnow_{x}") for x in ("doc", "text", "key"))
    bad = contaminated_texts(docs, items, span).select(F.col("doc_id").alias(doc), F.col("text_key").alias(text))
    rows = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    left = rows.join(bad, rows["doc_id"].eqNullSafe(bad[doc]) & (rows[key] == bad[text]), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
