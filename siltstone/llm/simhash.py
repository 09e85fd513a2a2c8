"""SimHash near-duplicates, searched with BK-trees.

A document's fingerprint has 64 bits: bit b is set if it is set in over half of the XXH64 hashes of the document's
word shingles. Documents whose fingerprints differ in at most ``radius`` bits are linked, and a document's component
is everything reachable by links.

How it scales
* Equal fingerprints are merged first (partial aggregation), so copies never meet in one task.
* Two fingerprints at distance ``radius`` or less agree on at least ``k`` of ``radius + k`` bit blocks. Each
  combination of k blocks is a shard key; shards hold the fingerprints that agree there. ``k`` grows with the number of
  distinct fingerprints, so that random shards stay small.
* A shard much above the mean is cut in chunks of bounded size, dealt anew for every shard key. Members of a dense group
  meet in one chunk or another, so it becomes a component by a few rows a member. Only shards that still hold several
  components are then searched again, each pair of chunks as a shard: no pair of chunks is left out.
* Every task builds the BK-trees of its shards as one forest and queries them level by level with numpy. A shard gives
  only one edge a member, to the smallest fingerprint of its local component: never all pairs.
* Components are then joined by contracting those edges in Spark, each round written to the shared folder. A round sees
  only the edges between components that are not yet one.

Defined results: null text counts as no words; a text without words has fingerprint zero, which links like any other.
Rows without a doc_id get a fingerprint and the component of their group; they never name a component, so it is null
if no row of the group has an id. Repeated rows are kept, each with the same component. Extra columns are ignored, and
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import forget, met, modest_batches, narrow, private, wide, word_blocks, written

BITS = 64
#: Fingerprints that make up more than this part of all rows meet their rows by broadcast, the others by shuffle.
FREQUENT = 1000


def fingerprint_of(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The unsigned SimHash of one text."""
    import xxhash

    if not text:
        return 0
    hashed = functools.partial(xxhash.xxh64_intdigest, seed=seed)
    counts, total, tail = np.zeros(BITS, dtype=np.int64), 0, []
    short = True
    for block in word_blocks(text.encode("utf-8", "surrogatepass").lower()):
        words = tail + block.split()
        n = len(words) - width + 1
        if n <= 0:
            tail = words
            continue
        short = False
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        h = np.fromiter(map(hashed, grams), dtype="<u8", count=n)
        for at in range(0, n, 1 << 16):
            part = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
        tail = words[n:] if width > 1 else []
    if short:
        return hashed(b" ".join(tail)) if tail else 0
    return int((np.packbits(counts * 2 > total, bitorder="little")).view("<u8")[0])


def _udf(width: int, seed: int):
    @F.arrow_udf("long")
    def simhash(texts):
        import pyarrow as pa

        prints = (fingerprint_of(t.as_py(), width, seed) for t in texts)
        return pa.array(np.fromiter(prints, dtype=np.uint64, count=len(texts)).view(np.int64))

    return simhash


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, text: str = "text", into: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit column; all other columns stay on the JVM side."""
    modest_batches(docs.sparkSession)
    return docs.withColumn(into, _udf(width, seed)(F.col(text)))


def shard_masks(radius: int, distinct: int, most: int = 2048) -> list[int]:
    """Bit masks of which at least one is untouched by any ``radius`` differing bits.

    64 bits are cut in radius + k blocks; at least k stay equal. k is the smallest for which a random shard holds at
    most ``most`` of ``distinct`` fingerprints.
    """
    for k in range(1, 5):
        cuts = np.linspace(0, BITS, radius + k + 1).round().astype(int)
        blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in itertools.pairwise(cuts)]
        masks = [sum(c) for c in itertools.combinations(blocks, k)]
        if distinct <= most << min(m.bit_count() for m in masks):
            break
    return masks


def bk_forest(codes: np.ndarray, trees: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Builds one BK-tree per value of ``trees``, all at once.

    Returns each item's root, and the children's sorted keys (parent x 65 + distance) with the children in that order.
    """
    n = len(codes)
    _, first, tree = np.unique(trees, return_index=True, return_inverse=True)
    root = first[tree]
    at, waiting = root.copy(), np.flatnonzero(root != np.arange(n))
    keys, kids = [], []
    while len(waiting):
        edge = at[waiting] * (BITS + 1) + np.bitwise_count(codes[waiting] ^ codes[at[waiting]]).astype(np.int64)
        own, first, group = np.unique(edge, return_index=True, return_inverse=True)
        child = waiting[first]  # the first to arrive takes the place; the others go on below it
        keys.append(own)
        kids.append(child)
        at[waiting] = child[group]
        waiting = waiting[at[waiting] != waiting]
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    kid = np.concatenate(kids) if kids else np.zeros(0, np.int64)
    order = np.argsort(key)
    return root, key[order], kid[order]


def bk_links(codes: np.ndarray, trees: np.ndarray, radius: int, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a, b), a < b, within ``radius`` in the same tree, in blocks of queries that keep the frontier small."""
    root, key, kid = bk_forest(codes, trees)
    out_a, out_b = [], []
    _, tree, members = np.unique(trees, return_inverse=True, return_counts=True)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(members[tree]) // most)) + 1, [len(codes)]])
    for lo, hi in itertools.pairwise(starts):
        query = np.arange(lo, hi)
        node = root[lo:hi]
        while len(query):
            d = np.bitwise_count(codes[query] ^ codes[node]).astype(np.int64)
            near = (d <= radius) & (query < node)
            out_a.append(query[near])
            out_b.append(node[near])
            left = np.searchsorted(key, node * (BITS + 1) + np.maximum(d - radius, 0), "left")
            right = np.searchsorted(key, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            n = right - left
            at = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            query, node = np.repeat(query, n), kid[at]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_a) if out_a else empty), (np.concatenate(out_b) if out_b else empty)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each item's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _edges(radius: int, block: int):
    def shards(batches):
        import pyarrow as pa

        def edges(code, tree):
            order = np.lexsort((code, tree))  # so that a local root is the smallest fingerprint of its component
            code, tree = code[order], tree[order]
            a, b = bk_links(code.view(np.uint64), tree, radius)
            label = local_roots(len(code), a, b)
            moved = np.flatnonzero(label != np.arange(len(code)))
            pair = np.unique(np.stack([code[moved], code[label[moved]]]), axis=1)
            return pa.record_batch([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen, last = 0, None
        for batch in batches:  # sorted by shard
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            code = batch.column(4).to_numpy(zero_copy_only=False)
            if not len(code):
                continue
            fresh = np.zeros(len(code), bool)
            for i, c in enumerate(cols):
                fresh[1:] |= c[1:] != c[:-1]
                fresh[0] |= last is None or last[i] != c[0]
            tree = seen + np.cumsum(fresh)
            seen, last = int(tree[-1]), [c[-1] for c in cols]
            held.append((code, tree))
            if sum(len(x) for x, _ in held) < block:
                continue
            code, tree = (np.concatenate(x) for x in zip(*held, strict=True))
            done = tree != seen  # the last shard may go on in the next batch
            if done.any():
                yield edges(code[done], tree[done])
            held = [(code[~done], tree[~done])]
        if held:
            yield edges(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return shards


def _searched(dealt: DataFrame, radius: int, block: int) -> DataFrame:
    """Edges within each shard (c, k, i, j) of fingerprints fp."""
    sorted_ = dealt.repartition("c", "k", "i", "j").sortWithinPartitions("c", "k", "i", "j")
    return sorted_.select("c", "k", "i", "j", "fp").mapInArrow(_edges(radius, block), "a long, b long").distinct()


def links(prints: DataFrame, distinct: int, radius: int = 4, least_chunk: int = 512, block: int = 50_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints in column fp, whose components are those of all links."""
    masks = shard_masks(radius, distinct)
    bits = min(m.bit_count() for m in masks)
    chunk = max(least_chunk, 4 * (distinct >> bits))
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)]))
    rows = prints.select("fp", keyed.alias("s")).select("s.c", "s.k", "fp")
    large = rows.groupBy("c", "k").agg(F.count("*").alias("n")).filter(F.col("n") > chunk)
    few = narrow(distinct)
    large = written(large.select("c", "k", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("chunks")), "large", few)  # at most len(masks) x distinct / chunk
    own = F.pmod(F.xxhash64("fp", "c"), F.coalesce("chunks", F.lit(1))).cast("int")
    dealt = rows.join(large, ["c", "k"], "left").withColumns({"i": own, "j": own})
    edges = written(_searched(dealt, radius, block), "edges", few)
    if large.isEmpty():
        return edges
    part = components(edges, few)
    hot = rows.join(large, ["c", "k"]).join(part.withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("root", "fp"))
    hot = written(hot.select("c", "k", "fp", "chunks", "part", own.alias("own")), "hot", wide(prints.sparkSession, distinct))
    several = hot.groupBy("c", "k").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("c", "k")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.struct(F.least(F.col("own"), other).alias("i"), F.greatest(F.col("own"), other).alias("j")))
    across = hot.join(several, ["c", "k"], "left_semi").select("c", "k", "fp", F.explode(F.filter(pairs, lambda p: p["i"] < p["j"])).alias("p"))
    more = written(_searched(across.select("c", "k", "fp", "p.i", "p.j"), radius, block), "edges", few)
    forget(part, hot)
    return edges.unionByName(more)


def components(edges: DataFrame, files: int | None = None, most_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node reachable over stored edges (a, b). Nodes without an edge have no row.

    Each round gives every node the one of itself and its neighbours that is first in a random order, then that one's own;
    the next round only sees the edges left between those, each once. What a component has found is not looked at again.
    """
    levels, left = [], edges
    for round_ in range(most_rounds):
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(round_ // 8)).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        told = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("t")).select("t.*")
        first = told.groupBy("node").agg(F.min(ranked("other")).alias("other")).select("node", F.least(ranked("node"), "other")["node"].alias("to"))
        jump = first.select(F.col("node").alias("to"), F.col("to").alias("next"))
        level = written(first.join(jump, "to").select("node", F.col("next").alias("to")), "labels", files)
        levels.append(level)
        a, b = (level.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        both = left.join(a, "a").join(b, "b").filter("to_a <> to_b")
        old, left = left, written(both.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct(), "left", files)
        if round_:
            forget(old)
        if left.isEmpty():
            break
    else:
        raise RuntimeError("edges are left after all rounds")
    forget(left)
    label = levels[-1]
    for level in levels[-2::-1]:
        on = label.select(F.col("node").alias("to"), F.col("to").alias("next"))
        label = level.join(on, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    if len(levels) > 1:
        levels.append(label := written(label, "labels", files))
    least = label.groupBy("to").agg(F.min("node").alias("root"))
    out = written(label.join(least, "to").select("node", "root"), "labels", files)
    forget(*levels)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (signed long), fingerprint (hex), component_id for each row of ``docs``."""
    prints = written(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), width, seed).select("doc_id", "fp"), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    distinct, rows = nodes.agg(F.count("*"), F.sum("copies")).first()
    root = components(links(nodes.select("fp"), distinct, radius), narrow(distinct))
    linked = nodes.join(root, nodes.fp == root.node).select("fp", "least", "root")
    named = linked.groupBy("root").agg(F.min("least").alias("of_root"))
    named = linked.join(named, "root").select("fp", "of_root")
    nodes = written(nodes.join(named, "fp", "left").select("fp", "copies", F.coalesce("of_root", "least").alias("component_id")), "nodes", narrow(distinct))
    forget(root)
    frequent = F.col("copies") >= max(2, (rows or 0) // FREQUENT)  # fewer than 2 FREQUENT of them, whatever the rows
    hot = F.broadcast(nodes.filter(frequent).select("fp", "component_id", F.lit(True).alias("hot")))
    marked = prints.join(hot, "fp", "left")
    cold = marked.filter(F.col("hot").isNull()).select("doc_id", "fp").join(nodes.filter(~frequent), "fp")
    joined = marked.filter("hot").select("doc_id", "fp", "component_id").unionByName(cold.select("doc_id", "fp", "component_id"))
    return joined.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from ._shared import table

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component: the smallest doc_id, then the smallest SHA-256 digest, ids before nulls.

    Components are those of five-word shingles with a Jaccard similarity of at least 0.8: BK-trees over SimHash
    fingerprints propose, a prefix search that misses nothing adds to them, and an exact check decides (see
    ``jaccard``). If a doc_id has several texts, each component keeps its own document; rows without an id are judged like
    any other. Equal rows are copies. Only rows that may go, or stand more than once, are shuffled.
    """
    from . import jaccard

    groups, key = jaccard.near_duplicates(docs), F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest")
    rows = groups.groupBy("doc_id", "digest", "root").agg(F.count("*").alias("copies"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first"))
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    judged = rows.join(first, "root").withColumn("stays", own == F.col("first"))
    key_, stays = private(docs, "key", "stays")
    special = written(judged.filter("not stays or copies > 1").select(key.alias(key_), F.col("stays").alias(stays)), "special")
    digest = jaccard.digest_of(F.col("text"))
    found = met(docs, F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest), special, key_)
    plain = found.filter(F.col(stays).isNull())
    return plain.unionByName(found.filter(stays).dropDuplicates([key_])).select(*[F.col(f"`{c}`") for c in docs.columns])
