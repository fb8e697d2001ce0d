"""Language-model scoring with a Katz backoff model over token pairs.

Counts are discounted by Good-Turing: seen c times counts as d(c) * c, for c
up to CUTOFF.  The mass that this frees in a context goes to the tokens that
did not follow it, in proportion to their own probability; the backoff weight
is the quotient of exactly these two sums, so that probabilities add up to one
in every context.  Single tokens back off to one unseen token in the same way.
A context whose counts are all above the cutoff frees one part in n + 1.

Every token of the training texts has counts of its own, as itself and as the
context of others, in tables partitioned by order.  Evaluation goes down the
orders per token: the pair if it was seen, else the context's weight times the
token, else the unseen token.  A text's score is therefore the sum of what it
gets from single tokens and weights, plus, for each seen pair, what the pair
gains over backing off; the parts come from different tables and add up.

The most frequent tokens and pairs, a fixed number of them, are looked up where
the text is.  A training text's pair that is not marked as repeated in a filter
of fixed size was seen once.  All other tokens and pairs go to the bucket of
the table that holds them: tasks pack what they look up by bucket, a bucket's
entries, a bounded number, are held by one task at a time, and what is looked
up streams past them.  Pairs seen once that neither filter asks for are not
dealt out; the filters only decide what moves, never what is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumwell.llm.scratch import Scratch, most_frequent
from sumwell.llm.text import END_HASH, mix, word_slices

#: Tokens that are looked up locally, at most.
LOCAL = 1 << 20
#: Pairs that are looked up locally, at most.
PAIRS = 1 << 19
#: Bits of the filters of repeated and of wanted pairs are 2 to this.
FILTER_BITS = 26
#: Training tokens whose counts are combined in a task before they are shuffled.
COMBINE = 3_000_000
#: Lookups or entries that a task holds before it sends them.
SEND = 1_000_000
#: Entries of a bucket, about.
BUCKET = 1 << 21
#: Counts above this are not discounted.
CUTOFF = 5
_HALF = np.uint64((1 << 32) - 1)
#: Stands for the context of a text's first token.
START_HASH = mix(np.array([0x57A27], dtype=np.uint64))[0]


def _with_ends(texts) -> "tuple":
    """(first, last + 1, token hashes, offsets) with the end token after each text's words."""
    for lo, hi, words, off in word_slices(texts):
        ends = off[1:]
        tokens = np.insert(words, ends, END_HASH)
        yield lo, hi, tokens, off + np.arange(len(off))


def good_turing(n: list[int], cutoff: int = CUTOFF) -> list[float]:
    """Discount factors d(1) to d(cutoff), from n[c] = number of kinds seen c times.

    Katz' form, which leaves counts above the cutoff alone and frees n(1) in
    all.  Where the counts of counts don't allow it (a ratio outside (0, 1]),
    the factor of absolute discounting by n1 / (n1 + 2 n2) stands in.
    """
    n1, n2, last = n[1], n[2], (cutoff + 1) * n[cutoff + 1]
    flat = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for c in range(1, cutoff + 1):
        d = 0.0
        if n1 and n[c] and n1 > last:
            share = last / n1
            d = ((c + 1) * n[c + 1] / (c * n[c]) - share) / (1 - share)
        out.append(d if 0.01 < d <= 1 else max(0.01, 1 - flat / c))
    return out


def counts_of_counts(table: DataFrame, cutoff: int = CUTOFF) -> list[int]:
    rows = table.where(F.col("c") <= cutoff + 1).groupBy("c").count().collect()  # cutoff + 1 rows
    n = [0] * (cutoff + 3)
    for r in rows:
        n[r["c"]] = r["count"]
    return n


@dataclass
class Lookup:
    """What every task holds of frequent tokens, contexts and pairs.  Sizes are bounded."""

    tokens: np.ndarray  # sorted hashes, with that of the start
    counts: np.ndarray
    all_tokens: bool  # no token was seen beyond these
    n: int
    v: int
    discounts: list[float]
    keep: float  # share of the discounted mass that single tokens keep
    unseen: float  # log10 P(unseen token)
    token_log: np.ndarray  # log10 P(token)
    weight_log: np.ndarray | None = None  # log10 of the backoff weight of each token as a context
    total_log: np.ndarray | None = None  # log10 of its count as a context
    pairs: np.ndarray | None = None  # sorted keys
    gains: np.ndarray | None = None
    all_pairs: bool = False
    pair_discounts: list[float] | None = None
    repeated: np.ndarray | None = None  # the filter of pairs seen more than once
    wanted: np.ndarray | None = None  # the filter of pairs that held-out texts look up
    buckets: int = 1

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if not k.startswith("_")}

    def _probe(self, name: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a sorted array of hashes, and whether they are there; an index by leading bits spares the search."""
        known = getattr(self, name)
        if not hasattr(self, "_index_" + name):
            bits = len(known).bit_length()
            edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
            setattr(self, "_index_" + name, (np.uint64(64 - bits), np.append(np.searchsorted(known, edges), len(known)).astype(np.int32)))
        shift, first = getattr(self, "_index_" + name)
        b = (hashes >> shift).astype(np.int64)
        at, end = first[b], first[b + 1]
        at = np.minimum(at, len(known) - 1)
        there = known[at] == hashes
        left = np.flatnonzero(~there & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit = known[at[left]] == hashes[left]
            there[left[hit]] = True
            left = left[~hit]
            left = left[at[left] + 1 < end[left]]
        return at, there

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among the tokens, and whether they are there."""
        return self._probe("tokens", hashes)


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    h = keys & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def _discounted(c: np.ndarray, discounts: list[float]) -> np.ndarray:
    return np.asarray(c, dtype=float) * np.concatenate(([1.0], discounts, [1.0]))[np.minimum(c, len(discounts) + 1)]


def _discounted_column(c: str, discounts: list[float]) -> Column:
    d = F.lit(1.0)
    for k, x in enumerate(discounts, 1):
        d = F.when(F.col(c) == k, F.lit(float(x))).otherwise(d)
    return d * F.col(c)


def _contexts(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The token before each token; every text has one token at least."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[off[:-1]] = START_HASH
    return before


def _pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (u << np.uint64(23) | u >> np.uint64(41)) ^ w


def _training_counts(docs: DataFrame, order: int) -> DataFrame:
    """w, c or u, w, c over the training texts, combined in tasks before they are shuffled."""
    names = ["w"] if order == 1 else ["u", "w"]
    schema = pa.schema([(x, pa.int64()) for x in [*names, "c"]])

    def run(batches):
        parts, size = [], 0

        def out():
            keys = [np.concatenate(k) for k in zip(*parts, strict=True)]
            # leading halves of both hashes bring equal pairs together; if others fall between, the next sum joins them
            at = np.argsort(keys[0] & ~_HALF | keys[1] >> np.uint64(32) if order > 1 else keys[0])
            keys = [k[at] for k in keys]
            new = np.ones(len(at) + 1, dtype=bool)
            new[1:-1] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            edge = np.flatnonzero(new)
            return pa.RecordBatch.from_arrays([*[pa.array(k[edge[:-1]].view(np.int64)) for k in keys], pa.array(np.diff(edge))], schema=schema)

        for b in batches:
            for _, _, tokens, off in _with_ends(b.column(0).to_pylist()):
                parts.append((tokens,) if order == 1 else (_contexts(tokens, off), tokens))
                size += len(tokens)
                if size >= COMBINE:
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    sql = ", ".join(f"{x} long" for x in [*names, "c"])
    dealt = docs.select("text").mapInArrow(run, sql).repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(_summed, sql)


def _summed(batches):
    """Sorted rows of keys and c -> one row for each key."""
    held = None  # the last key, whose rows may go on
    for b in batches:
        if not len(b):
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        cols = [x.to_numpy(zero_copy_only=False) for x in b.columns]
        start = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in cols[:-1]], axis=0))))
        out = pa.RecordBatch.from_arrays([*[pa.array(k[start]) for k in cols[:-1]], pa.array(np.add.reduceat(cols[-1], start))], schema=b.schema)
        held = out.slice(len(start) - 1)
        if len(start) > 1:
            yield out.slice(0, len(start) - 1)
    if held is not None:
        yield held


def _split(table: DataFrame, names: list[str], given, local: bool) -> DataFrame:
    """The rows of ``table`` whose tokens are all locally held, or the others."""
    columns = [table.columns.index(x) for x in names]

    def run(batches):
        for b in batches:
            there = np.ones(len(b), dtype=bool)
            for k in columns:
                there &= given.value.find(b.column(k).to_numpy(zero_copy_only=False).view(np.uint64))[1]
            yield b.filter(pa.array(there == local))

    return table.mapInArrow(run, table.schema)


def _context_sums(pairs: DataFrame, given, discounts: list[float]) -> DataFrame:
    """u, n, kept, lower: parts of each context's count, discounted count and single probabilities of locally held followers."""
    schema = pa.schema([("u", pa.int64()), ("n", pa.int64()), ("kept", pa.float64()), ("lower", pa.float64())])

    def run(batches):
        look = given.value
        held, size = [], 0

        def out():
            u, w, c = (np.concatenate(x) for x in zip(*held, strict=True))
            at, there = look.find(w.view(np.uint64))
            order = np.argsort(u, kind="stable")
            u = u[order]
            start = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            sums = [np.add.reduceat(x[order], start) for x in (c, _discounted(c, discounts), np.where(there, 10 ** look.token_log[at], 0.0))]
            return pa.RecordBatch.from_arrays([pa.array(u[start]), *map(pa.array, sums)], schema=schema)

        for b in batches:
            if len(b):
                held.append([x.to_numpy(zero_copy_only=False) for x in b.columns])
                size += len(b)
            if size >= COMBINE:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return pairs.mapInArrow(run, "u long, n long, kept double, lower double")


def _filter(keys: DataFrame) -> np.ndarray:
    """The filter with a bit for each of ``keys``, which tasks give as (w, bits) of its words; its size is fixed."""
    words = keys.groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy()
    return bits.view(np.uint64)


def _filter_words(parts: list[np.ndarray]) -> pa.RecordBatch:
    """(w, bits) of the filter's words that have a bit for one of the keys."""
    h = np.sort(np.concatenate(parts) & np.uint64((1 << FILTER_BITS) - 1))
    w = h >> np.uint64(6)
    start = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    bits = np.bitwise_or.reduceat(np.uint64(1) << (h & np.uint64(63)), start)
    return pa.RecordBatch.from_arrays([pa.array(w[start].view(np.int64)), pa.array(bits.view(np.int64))], names=["w", "bits"])


def _repeated(pairs: DataFrame) -> np.ndarray:
    """The filter of pairs seen more than once."""

    def run(batches):
        for b in batches:
            if len(b):
                yield _filter_words([_pair_keys(*(b.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1)))])

    return _filter(pairs.where("c > 1").select("u", "w").mapInArrow(run, "w long, bits long"))


def _wanted(look: Lookup, docs: DataFrame) -> np.ndarray:
    """The filter of pairs that held-out texts do not find locally."""
    given = docs.sparkSession.sparkContext.broadcast(look)

    def run(batches):
        held: list[np.ndarray] = []
        for b in batches:
            for part in _looked_up(given.value, b.column(0).to_pylist(), np.ones(len(b), dtype=bool)):
                held.append(part.keys[part.far])
                if sum(map(len, held)) >= SEND:
                    yield _filter_words(held)
                    held = []
        if sum(map(len, held)):
            yield _filter_words(held)

    out = _filter(docs.where("held_out").select("text").mapInArrow(run, "w long, bits long"))
    given.destroy()
    return out


#: Rows that meet in a bucket: entries (hashes; gains as float; counts as long, none for pairs), lookups (hashes; rows; hashes of
#: each row) and what a text has without them.
_INFO = pa.struct([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
_DEALT = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("values", pa.binary()), ("counts", pa.binary()), ("info", _INFO)])
_DEALT_SQL = "bucket long, kind int, keys binary, values binary, counts binary, info struct<row: long, doc_id: long, held_out: boolean, n_tokens: long, n_known: long, base: double, score: double>"
_ENTRY, _LOOKUP, _TEXT = range(3)


def _by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, positions of its keys in order)."""
    of = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(buckets + 1))
    for k in np.flatnonzero(edges[1:] > edges[:-1]):
        yield int(k), order[edges[k] : edges[k + 1]]


def _dealt(kind: int, rows: list[tuple]) -> pa.RecordBatch:
    """Rows (bucket, keys, values, counts) of a kind."""
    bucket, *blobs = zip(*rows, strict=True)
    columns = [pa.array([x.tobytes() for x in b], pa.binary()) for b in blobs]
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([kind] * len(rows), pa.int32()), *columns, pa.nulls(len(rows), _INFO)], schema=_DEALT)


def _deal_entries(keys: np.ndarray, gains: np.ndarray, counts: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    none = np.empty(0, dtype=np.int64)
    gains = gains.astype(np.float32)
    return _dealt(_ENTRY, [(k, keys[at], gains[at], none if counts is None else counts[at]) for k, at in _by_bucket(keys, buckets)])


def _packed(entries: DataFrame, buckets: int) -> DataFrame:
    """Rows (key, gain, c) or (u, w, gain) packed by bucket."""
    pairs = "u" in entries.columns

    def run(batches):
        held, size = [], 0

        def out():
            a, b, c = (np.concatenate(x) for x in zip(*held, strict=True))
            if pairs:
                return _deal_entries(_pair_keys(a.view(np.uint64), b.view(np.uint64)), c, None, buckets)
            return _deal_entries(a.view(np.uint64), b, c, buckets)

        for b in batches:
            if len(b):
                held.append([x.to_numpy(zero_copy_only=False) for x in b.columns])
                size += len(b)
            if size >= SEND:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return entries.mapInArrow(run, _DEALT_SQL)


def _near_pairs(pairs: DataFrame, given) -> DataFrame:
    """Entries of pairs of locally held tokens that a lookup can ask for, packed by bucket."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            look = given.value
            u, w, c = (x.to_numpy(zero_copy_only=False) for x in b.columns)
            u, w = u.view(np.uint64), w.view(np.uint64)
            keys = _pair_keys(u, w)
            k = np.flatnonzero((c > 1) | _marked(look.wanted, keys) | _marked(look.repeated, keys))
            (before, open_), (at, there) = look.find(u[k]), look.find(w[k])
            near = open_ & there
            k, before, at = k[near], before[near], at[near]
            held.append((keys[k], np.log10(_discounted(c[k], look.pair_discounts)) - look.total_log[before] - look.weight_log[before] - look.token_log[at]))
            size += len(k)
            if size >= SEND:
                yield _deal_entries(*map(np.concatenate, zip(*held, strict=True)), None, look.buckets)
                held, size = [], 0
        if size:
            yield _deal_entries(*map(np.concatenate, zip(*held, strict=True)), None, given.value.buckets)

    return pairs.mapInArrow(run, _DEALT_SQL)


def fit(docs: DataFrame, scratch: Scratch, local: int = LOCAL, most_pairs: int = PAIRS) -> tuple[Lookup, DataFrame]:
    """The bounded lookup, and all further entries that the texts of ``docs`` (doc_id, text, held_out) can ask for, packed by bucket.

    A gain is what an entry adds to a text's score: for a token that is not
    locally held, over the unseen token, its weight as a context included; for
    a pair all that it adds over backing off.
    """
    spark = docs.sparkSession
    train = docs.where(~F.col("held_out"))
    tokens = scratch.write(_training_counts(train, 1), "counts/order=1")
    facts = tokens.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(facts["n"] or 0), int(facts["v"])
    top = most_frequent(tokens, "c", local).toArrow()
    of_counts = counts_of_counts(tokens)
    discounts = good_turing(of_counts)
    freed = sum((1 - d) * c * of_counts[c] for c, d in enumerate(discounts, 1))
    keep = 1.0 if freed > 1e-9 * n or not n else n / (n + 1)
    keys = np.append(top["w"].to_numpy().view(np.uint64), START_HASH)
    counts = np.append(top["c"].to_numpy(), 0)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    unseen = (freed / n if keep == 1 else 1 / (n + 1)) if n else 1.0
    with np.errstate(divide="ignore"):
        token_log = np.log10(_discounted(counts, discounts) * keep / max(1, n))
    look = Lookup(keys, counts, len(top) == v, n, v, discounts, keep, float(np.log10(unseen)), token_log)
    given = spark.sparkContext.broadcast(look)

    pairs = scratch.write(_training_counts(train, 2), "counts/order=2", "zstd")
    kinds, d2 = pairs.count(), good_turing(counts_of_counts(pairs))
    look.buckets = max(2 * spark.sparkContext.defaultParallelism, kinds // BUCKET)
    sums = _context_sums(pairs, given, d2)
    single = (_discounted_column("c", discounts) * F.lit(keep / max(1, n))).alias("lower")
    if not look.all_tokens:
        far = scratch.write(_split(pairs, ["u", "w"], given, False), "far")
        rare = scratch.write(_split(tokens, ["w"], given, False), "rare")
        more = far.select("u", "w").join(rare, "w").select("u", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("kept"), single)
        sums = sums.unionByName(more)
    sums = sums.groupBy("u").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"), F.sum("lower").alias("lower"))
    none = F.col("kept") > F.col("n") * (1 - 1e-9)  # nothing freed
    free = F.when(none, 1 / (F.col("n") + 1)).otherwise(1 - F.col("kept") / F.col("n"))
    total = F.log10(F.when(none, F.col("kept") * (F.col("n") + 1) / F.col("n")).otherwise(F.col("n")))
    contexts = scratch.write(sums.select("u", F.log10(free / (1 - F.col("lower"))).alias("weight"), total.alias("total")), "contexts")

    mine = _split(contexts, ["u"], given, True).toArrow()  # a row per locally held token
    given.destroy()
    at, _ = look.find(mine["u"].to_numpy().view(np.uint64))
    look.weight_log, look.total_log = np.zeros(len(keys)), np.zeros(len(keys))
    look.weight_log[at], look.total_log[at] = mine["weight"].to_numpy(), mine["total"].to_numpy()
    look.pair_discounts = d2
    best = most_frequent(pairs, "c", most_pairs).toArrow()
    look.all_pairs = len(best) == kinds
    u, w = (best[x].to_numpy().view(np.uint64) for x in ("u", "w"))
    (a, here), (b, there) = look.find(u), look.find(w)
    near = here & there
    look.all_pairs &= bool(near.all())
    gain = np.log10(_discounted(best["c"].to_numpy(), d2)) - look.total_log[a] - look.weight_log[a] - look.token_log[b]
    key = _pair_keys(u, w)[near]
    order = np.argsort(key)
    look.pairs, look.gains = key[order], gain[near][order]
    look.wanted = _wanted(look, docs)
    look.repeated = _repeated(pairs)

    given = spark.sparkContext.broadcast(look)
    entries = _near_pairs(pairs, given)
    if not look.all_tokens:
        log = F.log10(_discounted_column("c", discounts) * F.lit(keep / n))
        known = tokens.select("w", log.alias("log"))
        count = F.log10(_discounted_column("c", d2))
        tail = far.join(known, "w").join(contexts, "u").select("u", "w", (count - F.col("total") - F.col("weight") - F.col("log")).alias("gain"))
        gain = log + F.coalesce("weight", F.lit(0.0)) - F.lit(look.unseen)
        single = rare.join(contexts.withColumnRenamed("u", "w"), "w", "left").select(F.col("w").alias("key"), gain.alias("gain"), "c")
        entries = entries.unionByName(_packed(tail, look.buckets)).unionByName(_packed(single, look.buckets))
    entries = scratch.write(entries, "entries")
    given.destroy()
    scratch.drop("counts", "contexts", "far", "rare")
    look.wanted = None
    return look, entries


@dataclass
class Part:
    """What some texts find locally: arrays by text, and by token with the text that it belongs to."""

    lo: int
    hi: int
    size: np.ndarray
    known: np.ndarray
    base: np.ndarray
    score: np.ndarray
    owner: np.ndarray
    keys: np.ndarray
    tokens: np.ndarray
    far: np.ndarray  # whether the pair is to be looked up elsewhere
    rare: np.ndarray  # whether the token is


def _looked_up(look: Lookup, texts, held_out: np.ndarray):
    """Parts of the texts; held_out tells for which of them pairs may be unseen."""
    smooth = np.log10(look.n + look.v + 1)
    once = float(np.log10(look.pair_discounts[0]))
    (start,), _ = look.find(np.array([START_HASH]))
    for lo, hi, t, off in _with_ends(texts):
        size = np.diff(off)
        owner = np.repeat(np.arange(hi - lo), size)
        at, there = look.find(t)
        before, open_ = np.empty_like(at), np.empty_like(there)
        before[1:], open_[1:] = at[:-1], there[:-1]
        before[off[:-1]], open_[off[:-1]] = start, True
        c = np.where(there, look.counts[at], 0)
        keys = _pair_keys(_contexts(t, off), t)
        single = np.where(there & (c > 0), look.token_log[at], look.unseen)
        weight = np.where(open_, look.weight_log[before], 0.0)
        value = single + weight
        near = open_ & there & (c > 0)
        far = near if look.all_tokens else np.ones(len(t), dtype=bool)
        if len(look.pairs):
            p, seen = look._probe("pairs", keys)
            value[seen] += look.gains[p[seen]]
            far = far & ~seen
        if look.all_pairs:
            far = np.zeros(len(t), dtype=bool)
        if look.repeated is not None:
            k = np.flatnonzero(far & near & ~held_out[lo:hi][owner])
            k = k[~_marked(look.repeated, keys[k])]
            value[k] = once - look.total_log[before[k]]
            far[k] = False
        sums = [np.bincount(owner, x, minlength=hi - lo) for x in ((c > 0).astype(float), np.log10(c + 1) - smooth, value)]
        yield Part(lo, hi, size, *sums, owner, keys, t, far, np.zeros(len(t), dtype=bool) if look.all_tokens else ~there)


def _met(batches):
    """Dealt rows, sorted by bucket and kind -> row, doc_id, held_out, n_tokens, n_known, base, score; what a bucket gives a text, or what it has by itself."""
    bucket, held, table = None, [], None
    for b in batches:
        infos, rows = [], []
        kinds, of, info = b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(5)
        for k, kind in enumerate(kinds):
            if of[k] != bucket:
                bucket, held, table = of[k], [], None
            if kind == _TEXT:
                infos.append(k)
                continue
            keys, values, counts = (np.frombuffer(b.column(j)[k].as_buffer(), dtype=t) for j, t in ((2, np.uint64), (3, np.float32 if kind == _ENTRY else np.int64), (4, np.int64)))
            if kind == _ENTRY:
                held.append((keys.copy(), values.copy(), counts.copy() if len(counts) else np.zeros(len(keys), dtype=np.int64)))
                continue
            if table is None:
                table = [np.concatenate(x) for x in zip(*held, strict=True)] if held else []
                if table:
                    order = np.argsort(table[0])
                    table = [x[order] for x in table]
                held = []
            if not table:
                continue
            order = np.argsort(keys)
            at = np.empty(len(keys), dtype=np.int64)
            at[order] = np.searchsorted(table[0], keys[order])
            at = np.minimum(at, len(table[0]) - 1)
            hit = table[0][at] == keys
            start = np.cumsum(counts) - counts
            c = np.where(hit, table[2][at], 0)
            some = np.add.reduceat(hit.astype(np.int64), start) > 0
            sums = [np.add.reduceat(x, start)[some] for x in ((c > 0).astype(np.int64), np.log10(c + 1.0), np.where(hit, table[1][at].astype(float), 0.0))]
            rows.append((values[some], *sums))
        if infos:
            yield pa.RecordBatch.from_struct_array(info.take(pa.array(infos)))
        if rows:
            row, known, base, score = (np.concatenate(x) for x in zip(*rows, strict=True))
            none = len(row)
            columns = [pa.array(row), pa.nulls(none, pa.int64()), pa.nulls(none, pa.bool_()), pa.nulls(none, pa.int64()), pa.array(known), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(_INFO)))


def score_texts(docs: DataFrame, learn_from: Column, local: int = LOCAL, most_pairs: int = PAIRS, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows for which ``learn_from``, an expression over
    doc_id and text, is true.  Null and empty texts are the end token alone.
    Without training texts every token is the unseen one, which then has all
    the probability.  Null doc_ids are learned from unless the expression says
    otherwise (null counts as true).  Repeated rows are scored one by one; an
    empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "katz")
    held = ~F.coalesce(learn_from, F.lit(True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    look, entries = fit(docs, scratch, local, most_pairs)
    given = spark.sparkContext.broadcast(look)

    def run(batches):
        look = given.value

        def sent(row, far):
            who, keys = (np.concatenate(x) for x in far)
            out = []
            for k, at in _by_bucket(keys, look.buckets):
                at = at[np.argsort(who[at], kind="stable")]
                first = np.flatnonzero(np.concatenate(([True], who[at][1:] != who[at][:-1])))
                out.append((k, keys[at], row[who[at][first]], np.diff(np.append(first, len(at)))))
            return _dealt(_LOOKUP, out)

        for b in batches:
            row, out_ = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            n, known, base, score = (np.zeros(len(b), dtype=t) for t in (np.int64, np.int64, float, float))
            far: list[list[np.ndarray]] = [[], []]  # text, hash
            size = 0
            for part in _looked_up(look, b.column(3).to_pylist(), out_):
                for x, y in zip((n, known, base, score), (part.size, part.known, part.base, part.score), strict=True):
                    x[part.lo : part.hi] = y
                for hashes, which in ((part.keys, part.far), (part.tokens, part.rare)):
                    k = np.flatnonzero(which)
                    if len(k):
                        far[0].append(part.owner[k] + part.lo)
                        far[1].append(hashes[k])
                        size += len(k)
                if size >= SEND:
                    yield sent(row, far)
                    far, size = [[], []], 0
            if size:
                yield sent(row, far)
            facts = pa.StructArray.from_arrays([b.column(0), b.column(1), *map(pa.array, (out_, n, known, base, score))], fields=list(_INFO))
            blank = pa.nulls(len(b), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(row % look.buckets), pa.array(np.full(len(b), _TEXT, dtype=np.int32)), blank, blank, blank, facts], schema=_DEALT)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    dealt = rows.mapInArrow(run, _DEALT_SQL).unionByName(entries).repartition(look.buckets, "bucket").sortWithinPartitions("bucket", "kind")
    parts = dealt.mapInArrow(_met, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    out = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score")
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(look.n).cast("long").alias("train_tokens"), "base_score", "score")
