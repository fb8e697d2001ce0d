"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two texts link when ``den * |A n B| >= num * |A u B|`` for their sets of word
shingles, that is when they share T = ceil(num (|A|+|B|) / (num+den)) shingles.

1. One pass hashes every whole text to its shingle set; texts with equal sets
   are one node from here on, so a group of copies of any size costs one node.
2. Shingles are put in one global order: those with short inverted lists
   first.  Linked sets share at least ``l`` of their first n - ceil(num n/den)
   + l shingles in any such order, so only those are listed.  Short lists are
   merged: they give pairs with their number of common entries, and pairs
   with fewer than l are dropped.  Long lists are not merged: who shares one
   only falls into the same cluster.
3. The sets of each cluster are searched for the required overlap: the
   entries of the query's short lists are merged and counted, and texts that
   reach T minus the number L of long lists are probed in those by binary
   search (DivideSkip).  Clusters larger than a block go block against block.

No step drops, caps or samples: the set of shingles that counts as frequent
is bounded, but any choice of it gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwell.llm.exact_dedup import free_name
from sumwell.llm.scratch import Scratch, components, most_frequent
from sumwell.llm.text import mix, shingle_sets

#: Lists longer than this are not merged.
SHORT_LIST = 32
#: Bound of the broadcast set of frequent shingles (8 bytes each).
MAX_FREQUENT = 500_000
#: Nodes of a cluster that are searched together.
BLOCK = 512
#: Names shared by different sets that are told apart; 10^11 sets have about 300.
MAX_CLASHES = 100_000
#: Bits of the filter that keeps texts outside all clusters from being hashed again.
FILTER_BITS = 23


class Rule:
    """Lengths that follow from the threshold num/den for a set of n shingles."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n):
        """Smallest overlap with any linked set."""
        return -(-self.num * n // self.den)

    def common(self, n):
        """Shingles that linked sets share at least within their prefixes."""
        return np.minimum(1 + n // 16, self.least(n))

    def prefix(self, n):
        return n - self.least(n) + self.common(n)

    def overlap(self, n, m):
        """Overlap at which sets of n and m shingles link."""
        return -(-self.num * (n + m) // (self.num + self.den))


def _arrays(parts: list[np.ndarray]) -> pa.Array:
    off = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64)))


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of the size and members of a shingle set."""
    v = np.array([mix(s ^ np.uint64(k)).sum(dtype=np.uint64) + np.uint64(len(s)) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], dtype=np.uint64)
    a, b = mix(v).view(np.int64)
    return int(a), int(b)


def _node(s: np.ndarray, clashes: frozenset[int]) -> tuple[int, int]:
    """Name of a shingle set and a second hash that tells sets of one name apart; known clashes get another name."""
    a, b = _set_hash(s)
    return (int(mix(np.array([a ^ (b >> 1)]).view(np.uint64)).view(np.int64)[0]) if a in clashes else a), b


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out():
        cols = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([_arrays(list(c)) if pa.types.is_list(f.type) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield out()
            held = []
    if held:
        yield out()


def shingle_table(docs: DataFrame, words: int, rule: Rule, clashes: frozenset[int]) -> DataFrame:
    """doc_id, row, node, check, n and the first shingles in hash order (some more than the prefix) of every text (doc_id, row, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("head", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            ids, keys, sets = b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(b.column(2).to_pylist(), words)

            def rows(ids=ids, keys=keys, sets=sets):
                for i, k, s in zip(ids, keys, sets, strict=True):
                    n = len(s)
                    yield i, k, *_node(s, clashes), n, s[: int(rule.prefix(n)) + 4 + n // 20]

            yield from _batches(rows(), schema)

    return docs.mapInArrow(run, "doc_id long, row long, node long, check long, n long, head array<long>")


def _nodes(docs: DataFrame, words: int, rule: Rule, scratch: Scratch) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """The shingle table, one row per node, and the names that different sets would share.

    With 64 bits about n^2 / 2^65 pairs of n sets share a name.  A second hash
    shows them, and the table is made again with other names for these.
    """
    clashes: frozenset[int] = frozenset()
    for k in range(3):
        table = scratch.write(shingle_table(docs, words, rule, clashes), f"table{k}")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
        nodes = table.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), first, (F.min("check") != F.max("check")).alias("clash"))
        nodes = scratch.write(nodes, f"nodes{k}")
        found = {r["node"] for r in nodes.where("clash").select("node").limit(MAX_CLASHES + 1).collect()}
        if not found:
            return table, nodes.drop("clash"), clashes
        if len(found) > MAX_CLASHES:
            break
        clashes |= found
        scratch.drop(f"table{k}", f"nodes{k}")
    raise ValueError("too many shingle sets share a hash")


def _first(s: np.ndarray, n: int, frequent: np.ndarray, want: int) -> tuple[np.ndarray, int] | None:
    """The first ``want`` shingles, infrequent before frequent, and how many are frequent; None if s doesn't reach so far."""
    at = np.searchsorted(frequent, s)
    often = frequent[np.minimum(at, len(frequent) - 1)] == s if len(frequent) else np.zeros(len(s), dtype=bool)
    rare = s[~often][:want]
    if len(rare) == want:
        return rare, 0
    if len(s) < n:
        return None
    return np.concatenate((rare, s[often][: want - len(rare)])), want - len(rare)


def _posted(rows, rule: Rule, frequent: np.ndarray):
    """(node, n, whole, rare, often) of (node, n, shingles): the prefix in the global order."""
    for node, n, s in rows:
        got = _first(s, n, frequent, int(rule.prefix(n))) if n else (s, 0)
        if got is None:
            yield node, n, False, s[:0], s[:0]
        else:
            k = len(got[0]) - got[1]
            yield node, n, True, got[0][:k], got[0][k:]


_POSTED = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_()), ("rare", pa.list_(pa.int64())), ("often", pa.list_(pa.int64()))])
_POSTED_SQL = "node long, n long, whole boolean, rare array<long>, often array<long>"


def _list_values(column: pa.Array) -> Iterator[np.ndarray]:
    flat, off = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    off = off - off[0]
    for k in range(len(column)):
        yield flat[off[k] : off[k + 1]]


def _short_list_pairs(rule: Rule, most: int):
    """Sorted postings (token, node, n) -> candidate pairs of the short lists, star edges (least = 0) of longer ones."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("least", pa.int64())])

    def pairs_of(token, node, n):
        """All lists in these rows are whole and short."""
        edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        size = np.diff(edge)
        for m in np.unique(size[size > 1]):
            at = edge[:-1][size == m][:, None] + np.arange(m)
            i, j = np.triu_indices(m, 1)
            for lo in range(0, len(at), max(1, 200_000 // len(i))):
                p, q = at[lo : lo + max(1, 200_000 // len(i))][:, i].ravel(), at[lo : lo + max(1, 200_000 // len(i))][:, j].ravel()
                np_, nq = n[p], n[q]
                need = rule.overlap(np_, nq)
                ok = (need <= np.minimum(np_, nq)) & (node[p] != node[q])
                p, q = p[ok], q[ok]
                a, b = np.maximum(node[p], node[q]), np.minimum(node[p], node[q])
                yield a, b, np.minimum(rule.common(n[p]), rule.common(n[q]))

    def run(batches):
        held, pivot = None, None  # rows of a list that may go on; the first node of a long one

        def emit(a, b, least):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, least)], schema=schema)

        def flush(token, node, n):
            for a, b, least in pairs_of(token, node, n):
                yield emit(a, b, least)

        for batch in batches:
            token, node, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(token):
                continue
            if pivot is not None:
                k = int(np.searchsorted(token != pivot[0], True)) if (token != pivot[0]).any() else len(token)
                if k:
                    yield emit(node[:k], np.full(k, pivot[1]), np.zeros(k, dtype=np.int64))
                token, node, n = token[k:], node[k:], n[k:]
                if not len(token):
                    continue
                pivot = None
            if held is not None:
                token, node, n = (np.concatenate(x) for x in zip(held, (token, node, n), strict=True))
                held = None
            edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
            size = np.diff(edge)
            keep = np.repeat(size <= most, size)
            for k in np.flatnonzero(size > most):
                lo, hi = edge[k], edge[k + 1]
                yield emit(node[lo + 1 : hi], np.full(hi - lo - 1, node[lo]), np.zeros(hi - lo - 1, dtype=np.int64))
            lo = edge[-2]
            if size[-1] > most:
                pivot = (token[lo], node[lo])
            else:
                held = (token[lo:], node[lo:], n[lo:])
            keep[lo:] = False
            yield from flush(token[keep], node[keep], n[keep])
        if held is not None:
            yield from flush(*held)

    return run


def divide_skip(sets: list[np.ndarray], queries: range, against: range, rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """(query, linked texts) for each query: the texts of ``against`` that share enough shingles with it.

    Inverted lists hold positions in ``against``.  A query's L longest lists
    are set aside; the others are merged with counts, and texts that reach
    T - L are probed in the long lists by binary search.  Where queries and
    index are the same block, only texts after the query are returned.
    """
    sizes = np.array([len(sets[k]) for k in against], dtype=np.int64)
    tokens = np.concatenate([sets[k] for k in against])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    edge = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1], [True])))
    keys, begin, length = tokens[edge[:-1]], edge[:-1], np.diff(edge)
    same = queries == against
    for q in queries:
        s = sets[q]
        at = np.searchsorted(keys, s)
        at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == s)]
        n, least = len(s), int(rule.least(len(s)))
        if len(at) < least:
            continue
        at = at[np.argsort(length[at], kind="stable")]
        # the share of lists to skip that the DivideSkip paper finds, mu = 0.0085
        skip = min(int(least / (0.0085 * np.log2(max(2, length[at[-1]])) + 1)), least - 1, int((length[at] > 8).sum()))
        short, long = at[: len(at) - skip], at[len(at) - skip :]
        lens = length[short]
        where = np.repeat(begin[short] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
        count = np.bincount(owner[where], minlength=len(sizes))
        need = rule.overlap(n, sizes)
        possible = (need <= np.minimum(n, sizes)) & (count >= need - len(long)) & (count > 0)
        if same:
            possible[: q - queries.start + 1] = False
        found = np.flatnonzero(possible)
        for k in long:
            if not len(found):
                break
            entries = owner[begin[k] : begin[k] + length[k]]
            hit = np.searchsorted(entries, found)
            count[found] += entries[np.minimum(hit, len(entries) - 1)] == found
        found = found[count[found] >= need[found]]
        if len(found):
            yield q, found + against.start


def _search_blocks(rule: Rule):
    """Sorted (cluster, i, j, side, node, copies, shingles) -> forest edges (a, b, null) and link counts (a, null, links)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def search(rows):
        split = next((k for k, r in enumerate(rows) if r[0]), len(rows))
        sets, nodes, copies = [r[3] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64)
        links, root = np.zeros(len(rows), dtype=np.int64), list(range(len(rows)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        parts = (range(split), range(split, len(rows))) if 0 < split < len(rows) else (range(len(rows)),) * 2
        for q, found in divide_skip(sets, *parts, rule):
            links[q] += copies[found].sum()
            links[found] += copies[q]
            for f in found.tolist():
                x, y = find(q), find(f)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    yield nodes[q], nodes[f], None
        for k in np.flatnonzero(links):
            yield nodes[k], None, int(links[k])

    def run(batches):
        def out(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        held, key, done = [], None, []
        for b in batches:
            head = [b.column(k).to_pylist() for k in range(6)]
            for c, i, j, side, node, copies, s in zip(*head, _list_values(b.column(6)), strict=True):
                if key != (c, i, j):
                    if len(held) > 1 and not (i != j and not held):
                        done += search(held)
                        if len(done) > 5000:
                            yield out(done)
                            done = []
                    held, key = [], (c, i, j)
                held.append((side, node, copies, s.copy()))
        if len(held) > 1:
            done += search(held)
        if done:
            yield out(done)

    return run


def _member_filter(ids: DataFrame) -> np.ndarray:
    """Bit per hash of the ids; bounded by FILTER_BITS whatever their number."""
    h = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = ids.select(h.alias("h")).groupBy(F.shiftright("h", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 31 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    out[words["w"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def _fetch_sets(docs: DataFrame, wanted: DataFrame, words: int, clashes: frozenset[int]) -> DataFrame:
    """(node, n, shingles) of the wanted (doc_id, node): their texts are hashed again, others are passed over."""
    bits = docs.sparkSession.sparkContext.broadcast(_member_filter(wanted))
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    hashed = docs.select("text", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("h"))

    def run(batches):
        table = bits.value
        for b in batches:
            h = b.column(1).to_numpy(zero_copy_only=False)
            some = b.column(0).filter(pa.array((table[h >> 5] >> (h & 31).astype(np.uint32)) & 1 == 1)).to_pylist()
            yield from _batches(((_node(s, clashes)[0], len(s), s) for s in shingle_sets(some, words)), schema, 500)

    got = hashed.mapInArrow(run, "node long, n long, shingles array<long>")
    # a false pass of the filter ends here; so do further copies of a node's text
    return got.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, short_list: int = SHORT_LIST, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; further columns are ignored): doc_id, n_shingles, component_id, n_links.

    component_id is the smallest doc_id reachable by links, n_links the number
    of other rows that the row itself links with, copies included.  Null,
    empty and wordless texts have no shingles, link with nothing and are their
    own component.  Rows with one text (also with one doc_id) are copies and
    link.  An empty table gives an empty result.  Texts of any length count
    whole.  A null doc_id takes part; it never becomes a component_id while a
    doc_id that is not null is reachable.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    table, named = _join(docs, words, Rule(num, den), short_list, block, scratch or Scratch(docs.sparkSession, "jaccard"))
    out = table.select("doc_id", "node", "n").join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, without those that link, directly or through others, with a row that stays.

    Of each component the row with the smallest doc_id stays, a null doc_id
    last; rows that share it are told apart by a hash of all their columns,
    and of rows that are equal in all columns one stays.  Texts without words
    link with nothing and stay, repeated or not.  Other cases as in
    :func:`jaccard_components`.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    key, doc, row, more = (free_name(docs, f"near_{x}") for x in ("key", "doc", "row", "more"))
    keyed = docs.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("row"), F.col("text").cast("string").alias("text"))
    table, named = _join(rows, words, Rule(num, den), SHORT_LIST, BLOCK, scratch)
    found = table.where("n > 0").join(named.select("node", "keep_doc", "keep_row"), "node")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col("row") == F.col("keep_row"))
    # rows that go, and rows that stay once although they occur again; nothing else needs a look
    marked = found.groupBy("doc_id", "row", stays.alias("stays")).agg(F.count("*").alias("n")).where("not stays or n > 1")
    marked = scratch.write(marked.select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("stays").alias(more)), "marked")
    same = lambda m: keyed["doc_id"].cast("long").eqNullSafe(m[doc]) & (keyed[key] == m[row])
    left = keyed.join(marked, same(marked), "left_anti")
    if marked.where(F.col(more)).limit(1).count():
        again = marked.where(F.col(more))
        left = left.unionByName(keyed.join(again, same(again), "left_semi").dropDuplicates(["doc_id", key]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def _join(docs: DataFrame, words: int, rule: Rule, short_list: int, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The shingle table of (doc_id, row, text), and node, component_id, keep_doc, keep_row, n_links of every node."""
    spark = docs.sparkSession
    table, nodes, clashes = _nodes(docs, words, rule, scratch)
    # one row of each node, joined by both keys so that a node's copies spread; repeated rows fall to dropDuplicates
    firsts = nodes.select(F.col("node").alias("of"), F.col("doc_id").alias("first"))
    heads = table.where("n > 0").join(firsts, (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "n", "head")
    heads = scratch.write(heads.dropDuplicates(["node"]), "heads")

    often = heads.select(F.explode("head").alias("t")).groupBy("t").count().where(F.col("count") > short_list)
    often = most_frequent(scratch.write(often, "often"), "count", MAX_FREQUENT).select("t").toPandas()["t"].to_numpy(dtype=np.int64)
    frequent = spark.sparkContext.broadcast(np.sort(often.view(np.uint64)))

    def from_heads(batches):
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _list_values(b.column(2)), strict=True)
            yield from _batches(_posted(rows, rule, frequent.value), _POSTED)

    posted = scratch.write(heads.mapInArrow(from_heads, _POSTED_SQL), "posted")
    rest = posted.where("not whole").select("node").join(nodes, "node").select("doc_id", "node")
    again = _fetch_sets(docs, rest, words, clashes).mapInArrow(from_heads, _POSTED_SQL)
    lists = scratch.write(posted.where("whole").unionByName(again), "lists")
    scratch.drop("heads", "posted")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    short = lists.select(F.explode("rare").alias("token"), "node", "n").repartition(parts, "token").sortWithinPartitions("token")
    pairs = short.mapInArrow(_short_list_pairs(rule, short_list), "a long, b long, least long")
    merged = pairs.groupBy("a", "b").agg(F.count("*").alias("common"), F.min("least").alias("least")).where("common >= least").select("a", "b")
    long = lists.where(F.size("often") > 0).select(F.explode("often").alias("token"), "node")
    hubs = long.groupBy("token").agg(F.min("node").alias("b"))  # at most MAX_FREQUENT rows
    stars = long.join(F.broadcast(hubs), "token").select(F.col("node").alias("a"), "b")
    edges = scratch.write(merged.unionByName(stars).where("a <> b").distinct(), "edges")
    clusters = components(edges, scratch, "cluster").select("node", F.col("component").alias("cluster"))
    clusters = scratch.write(clusters.join(nodes.select("node", "doc_id", "copies"), "node"), "clusters")

    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "cluster").select("node", "cluster", "copies", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    placed = placed.join(_fetch_sets(docs, clusters.select("doc_id", "node"), words, clashes), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("cluster", "own", other, "node", "copies", "shingles").select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "copies", "shingles")
    dealt = dealt.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side")
    found = scratch.write(dealt.mapInArrow(_search_blocks(rule), "a long, b long, links long"), "found")
    scratch.drop("lists", "edges")

    joined = components(found.where("b is not null").select("a", "b"), scratch, "component")
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.join(joined, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("first").alias("keep"))
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    named = named.join(low, "component").select("node", "component_id", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.row").alias("keep_row"), links)
    return table, scratch.write(named, "named")
