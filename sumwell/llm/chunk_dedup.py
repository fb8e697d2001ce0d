"""Substring dedup by content-defined chunking.

A gear rolling hash runs over the bytes of each text; a chunk ends where its
leading bits are zero, between MIN_CHUNK and MAX_CHUNK bytes.  Boundaries
depend on the 32 bytes before them only, so an insertion shifts none behind
it.  Chunks are equal when their 64-bit digests are.  All occurrences but the
first, by (doc_id, offset), are repeats; repeats that follow each other form a
span, and spans of at least ``min_words`` words are reported.

Only digests that occur again are shuffled with their positions: their bits
are set in a filter of fixed size, and tasks pass over all other chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sumwell.llm.scratch import Scratch
from sumwell.llm.text import mix

MIN_CHUNK, MAX_CHUNK = 12, 64
#: Leading zero bits at a boundary: one position in 16.
BITS = 4
#: Bits of the filter are 2 to this.
FILTER_BITS = 25
_SLICE = 1 << 20
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_WORD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gear_hash(a: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + gear[a[i]] modulo 2^32 at every byte, by doubling: each pass joins windows of twice the length."""
    h = _GEAR[a]
    for k in (1, 2, 4, 8, 16):
        if k < len(h):
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def boundaries(a: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text."""
    ends, last, n = [], 0, len(a)
    marks: list[int] = []
    for lo in range(0, n, _SLICE):  # 31 bytes of overlap give the same hashes as one pass
        from_ = max(0, lo - 31)
        h = gear_hash(a[from_ : lo + _SLICE])[lo - from_ :]
        marks += (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + lo + 1).tolist()
    for m in marks:
        if m - last < MIN_CHUNK:
            continue
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if m - last >= MIN_CHUNK:
            ends.append(m)
            last = m
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if n > last:
        ends.append(n)
    return np.array(ends, dtype=np.int64)


_POWER = np.cumprod(np.concatenate(([np.uint64(1)], np.full(MAX_CHUNK, _BASE))), dtype=np.uint64)


def chunks(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, digests and numbers of words begun, of the chunks of a text's UTF-8 bytes."""
    a = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(a):
        none = np.empty(0, dtype=np.int64)
        return none, none, none.view(np.uint64), none
    ends = boundaries(a)
    starts = np.concatenate(([0], ends[:-1]))
    within = np.arange(len(a)) - np.repeat(starts, ends - starts)
    digest = mix(np.add.reduceat(_WORD[a] * _POWER[within], starts) + (ends - starts).astype(np.uint64))
    space = (a == 32) | ((a - np.uint8(9)) <= 4)
    begins = ~space
    begins[1:] &= space[:-1]
    return starts, ends, digest, np.add.reduceat(begins.astype(np.int64), starts)


def _chunk_rows(batches) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("digest", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])
    for b in batches:
        held, size = [], 0
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s, _, d, _ = chunks(text)
            held.append((doc, s, d))
            size += len(s)
            if size > 100_000:
                yield _rows(held, schema)
                held, size = [], 0
        if held:
            yield _rows(held, schema)


def _rows(held, schema) -> pa.RecordBatch:
    n = [len(s) for _, s, _ in held]
    docs = pa.array([x for x, _, _ in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), n)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([d for _, _, d in held]).view(np.int64)), docs, pa.array(np.concatenate([s for _, s, _ in held]))], schema=schema)


def repeated_spans(docs: DataFrame, min_words: int = 25, scratch: Scratch | None = None) -> DataFrame:
    """One row per span of ``docs`` (doc_id, text) that occurs before: doc_id, span_start, span_end, n_words, n_chunks, keep_doc_id.

    Offsets are in bytes of the UTF-8 text.  keep_doc_id is the smallest
    document that holds first occurrences of the span's chunks; it may be the
    document itself, when it repeats its own text.  Null and empty texts have
    no chunks.  Rows that share a doc_id count as one document whose equal
    chunks at equal offsets are one chunk.  A null doc_id comes last and its
    spans are reported under null.  An empty table gives an empty result;
    texts count whole; further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "chunks")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(_chunk_rows, "digest long, doc_id long, at long")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "at")
    # groups are combined before the shuffle: a chunk that a third of all texts hold is one row per task
    again = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    again = scratch.write(again.select("digest", F.col("first.doc").alias("first_doc"), F.col("first.at").alias("first_at")), "again")
    mask = (1 << FILTER_BITS) - 1
    words = again.select(F.col("digest").bitwiseAND(F.lit(mask)).alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()  # 2^19 rows at most
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy()
    del words
    given = spark.sparkContext.broadcast(bits.view(np.uint64))
    schema = pa.schema([("digest", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("at", pa.int64()), ("end", pa.int64()), ("words", pa.int64())])

    def candidates(batches):
        table = given.value
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s, e, d, w = chunks(text)
                h = d & np.uint64(mask)
                k = np.flatnonzero((table[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1))
                if len(k):
                    for c, v in zip(cols, (d[k].view(np.int64), [doc] * len(k), k, s[k], e[k], w[k]), strict=True):
                        c.append(v)
            if cols[0]:
                docs_ = pa.array([x for c in cols[1] for x in c], pa.int64())
                flat = [pa.array(np.concatenate(c)) if i != 1 else docs_ for i, c in enumerate(cols)]
                yield pa.RecordBatch.from_arrays(flat, schema=schema)

    found = docs.mapInArrow(candidates, "digest long, doc_id long, seq long, at long, end long, words long")
    found = found.join(again, "digest").withColumn("doc", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    later = found.where("doc <> first_doc or at <> first_at").select("doc", "seq", "at", "end", "words", "first_doc").distinct()
    order = Window.partitionBy("doc").orderBy("seq")
    runs = later.withColumn("run", F.col("seq") - F.dense_rank().over(order))
    spans = runs.groupBy("doc", "run").agg(F.min("at").alias("span_start"), F.max("end").alias("span_end"), F.sum("words").alias("n_words"), F.count("*").alias("n_chunks"), F.min("first_doc").alias("keep"))
    null = lambda c: F.when(F.col(c) != F.lit((1 << 63) - 1), F.col(c))
    return spans.where(F.col("n_words") >= min_words).select(null("doc").alias("doc_id"), "span_start", "span_end", "n_words", "n_chunks", null("keep").alias("keep_doc_id"))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the spans (byte offsets), which shrink to whole characters."""
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for start, end in sorted(spans):
        while start < len(data) and data[start] & 0xC0 == 0x80:
            start += 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end > start:
            out.append(data[at : max(at, start)])
            at = max(at, end)
    return (b"".join(out) + data[at:]).decode("utf-8", "surrogatepass")
