"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles.

Texts are linked if the sets of their five-word shingles have a similarity of at least 4/5; a text's component is
everything reachable by links.

How it scales
* Rows with the same set are one node, whose key is a hash of the set.
* The SimHash operator proposes first: BK-trees over the nodes' fingerprints link those within its radius. Pairs at 0.8
  lie up to 17 bits apart, and shards that allow for so many bits would hold nearly all pairs; so a second search adds
  what the fingerprints miss.
* Of two sets with n and m shingles and a similarity of 4/5 or more at least 4 (n + m) / 9 are shared, so the first
  n // 5 + COMMON and m // 5 + COMMON in any fixed order share a number that follows from n and m (``_needed``), COMMON at
  least for sets that are not tiny. The order puts shingles that are frequent in a sample of texts last; the sample makes
  groups small and never changes the result.
* The nodes of a shared shingle are first compared with one of them only; then, at some shingles, with the next NEXT of
  them in a random order. Those whose sketches agree (see below) are checked, so that a large family of near copies
  becomes a component by a few pairs a member.
* What is left are nodes that share a shingle, but not a component: loose families, and texts with a common passage. In
  the order of both sets, two at 4/5 have all that they share from their first shared shingle on, so that one stands early
  in both: within the first ninth, if they are of a size. Nodes only meet at shingles whose places in both sets could be
  their first. With rare shingles first, what is a text's own stands there instead, unless the texts are near copies, and
  a passage of many texts never does. No pair that can reach 4/5 is left out.
* Sets of n and m shingles at 4/5 differ in at most (n + m) / 9 shingles, and so do their parity sketches, which say for
  each of 1,024 hash values whether an odd number of shingles has it. The join gives out only pairs whose sketches agree
  that far: for loose families of texts of some thousand words or less, few of all pairs.
* Pairs are checked with the whole sets, made again from one text of each node in some pair.

Defined results: words and lower case are those of ``simhash.fingerprint_of``; fewer than five words are one shingle;
null texts and texts without words have the empty set, and are copies of each other.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded_threshold, bucket_of, forget, modest_batches, narrow, wide, word_blocks, written
from .simhash import components, links

WIDTH = 5
#: Texts in the sample for the order of shingles, and the most shingles it calls frequent.
SAMPLE, MOST_FREQUENT = 20_000, 400_000
COMMON, NEXT, SOME, TURNS = 10, 8, 8, 2
#: Columns of a parity sketch, 64 bits each.
SKETCH = [f"s{i}" for i in range(16)]
NO_ORDER = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def shingles_of(text: str | None, width: int = WIDTH, seed: int = 42) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's word shingles."""
    import xxhash

    hashed = functools.partial(xxhash.xxh64_intdigest, seed=seed)
    parts, tail = [], []
    for block in word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + block.split()
        n = len(words) - width + 1
        if n <= 0:
            tail = words
            continue
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        parts.append(np.unique(np.fromiter(map(hashed, grams), dtype="<u8", count=n)))
        tail = words[n:]
    if not parts and tail:
        parts.append(np.array([hashed(b" ".join(tail))], dtype="<u8"))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def _majority(hashes: np.ndarray) -> int:
    """The SimHash of a set: the bits that are set in over half of its hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _parities(hashes: np.ndarray) -> np.ndarray:
    """A set's parity sketch: bit i tells whether an odd number of its hashes has the low bits i."""
    counts = np.zeros(64 * len(SKETCH), np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.bincount((hashes[at : at + (1 << 16)] % len(counts)).astype(np.int64), minlength=len(counts))
    return np.packbits(counts & 1 == 1, bitorder="little").view("<i8")


def _near_enough(n: str, m: str, a: str, b: str) -> Column:
    """Whether sets of sizes ``n`` and ``m``, whose sketches' columns end in ``a`` and ``b``, may have a similarity of 4/5."""
    differ = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{c}{a}").bitwiseXOR(F.col(f"{c}{b}"))) for c in SKETCH])
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * differ <= F.col(n) + F.col(m))


def digest_of(text: Column) -> Column:
    """SHA-256 of a text; that of an empty one for null."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _sets(frequent, shingles=shingles_of, prints=True):
    """Key, fingerprint (0 if no ``prints``), hashes in the order of ``frequent`` and sketch of each text."""

    @F.arrow_udf("struct<key: long, fp: long, hashes: array<long>, sketch: struct<" + ", ".join(f"{c}: long" for c in SKETCH) + ">>")
    def sets(texts):
        import pyarrow as pa
        import xxhash

        common, counts = frequent.value
        keys, fps, sketches, rows = [], [], [], []
        for t in texts:
            h = shingles(t.as_py())
            keys.append(xxhash.xxh64_intdigest(h.tobytes()))
            fps.append(_majority(h) if prints else 0)
            sketches.append(_parities(h))
            if len(common) and len(h):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                h = h[np.lexsort((h, np.where(common[at] == h, counts[at], 0)))]
            rows.append(h)
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, "<u8"), *rows]).view(np.int64)
        key, fp = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (keys, fps))
        bits = np.array(sketches, np.int64).reshape(-1, len(SKETCH))
        sketch = pa.StructArray.from_arrays([pa.array(bits[:, i]) for i in range(len(SKETCH))], SKETCH)
        return pa.StructArray.from_arrays([key, fp, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), sketch], ["key", "fp", "hashes", "sketch"])

    return sets


def _frequent(docs: DataFrame, many: int, sample: int, shingles=shingles_of) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in several texts of a sample, sorted, and how many those are."""
    spark = docs.sparkSession
    every = max(1, many // sample)
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    none = spark.sparkContext.broadcast(NO_ORDER)
    hashes = some.select(F.explode(_sets(none, shingles, False)(F.col("text"))["hashes"]).alias("h"))
    counts = written(hashes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 2"), "frequent", 4)
    top = _top(counts, MOST_FREQUENT)
    forget(counts)
    return top


def _top(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles h of a stored table (h, n) and their counts n, at most ``most`` of them, those with large counts."""
    top = counts.filter(F.col("n") >= bounded_threshold(counts, most)).toArrow()
    h = top.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top.column("n").to_numpy().astype(np.int64)[order]


def _needed(n: Column, m: Column) -> Column:
    """How many shingles the beginnings of two alike sets of ``n`` and ``m`` share at least.

    The shared ones in a beginning are the first of all shared ones, and at most as many lie beyond it as it leaves out.
    """
    out = lambda k: F.greatest(F.lit(0), k - F.floor(k / 5) - COMMON)
    return F.ceil(4 * (n + m) / 9) - F.greatest(out(n), out(m))


def _enough(shared: DataFrame) -> DataFrame:
    """Of rows (a, n_a, b, n_b), one a shared shingle, the pairs (a, b) that share as many as they need."""
    pairs = shared.groupBy("a", "b").agg(F.count("*").alias("common"), F.max("n_a").alias("n"), F.max("n_b").alias("m"))
    pairs = pairs.filter("5 * least(n, m) >= 4 * greatest(n, m)").filter(F.col("common") >= _needed(F.col("n"), F.col("m")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _whole_sets(keys: DataFrame, sets: DataFrame, docs: DataFrame, many: int, shingles=shingles_of) -> DataFrame:
    """(key, hashes), stored: the whole sets of the nodes with these distinct keys, from one text each."""
    involved = written(sets.select("key", "digest").join(keys, "key").groupBy("key").agg(F.min("digest").alias("digest")), "involved", narrow(many))
    bucket = bucket_of(F.col("digest")).alias("bucket")  # spares most texts the shuffle; the join on the digest decides
    texts = docs.select("text", "digest").withColumn("bucket", bucket)
    texts = texts.join(F.broadcast(involved.select(bucket).distinct()), "bucket", "left_semi")
    texts = texts.groupBy("digest").agg(F.first("text").alias("text")).join(involved, "digest")  # copies merge before the shuffle
    none = docs.sparkSession.sparkContext.broadcast(NO_ORDER)
    some = written(texts.select("key", _sets(none, shingles, False)(F.col("text"))["hashes"].alias("hashes")), "involved_sets", wide(docs.sparkSession, many))
    forget(involved)
    return some


def _alike(pairs: DataFrame, sets: DataFrame, docs: DataFrame, many: int, shingles=shingles_of) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets have a similarity of 4/5 or more."""
    some = _whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), sets, docs, many, shingles)
    both = pairs.join(some.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(some.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    both = both.withColumn("shared", shared).withColumn("union", F.size("x") + F.size("y") - F.col("shared"))
    edges = written(both.filter("5 * shared >= 4 * union").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges", wide(docs.sparkSession, many))
    forget(some)
    return edges


def _next_ones(batches):
    """From (h, key, n, part, sketch) sorted: pairs (a, b) at most NEXT rows apart, of one h and two parts, that may have a similarity of 4/5."""
    import pyarrow as pa

    held = None  # the last rows of the batch before
    for batch in batches:
        h, key, n, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        sketch = np.stack([batch.column(4 + i).to_numpy(zero_copy_only=False) for i in range(len(SKETCH))], axis=1)
        rows = [h, key, n.astype(np.int64), part, sketch]
        old = 0
        if held is not None:
            old, rows = len(held[0]), [np.concatenate(x) for x in zip(held, rows, strict=True)]
        held = [x[-NEXT:] for x in rows]
        h, key, n, part, sketch = rows
        found = []
        for off in range(1, min(NEXT, len(h) - 1) + 1):
            y = np.arange(max(off, old), len(h))
            x = y - off
            may = (h[x] == h[y]) & (part[x] != part[y]) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
            x, y = x[may], y[may]
            differ = np.bitwise_count(sketch[x].view(np.uint64) ^ sketch[y].view(np.uint64)).sum(axis=1, dtype=np.int64)
            near = 9 * differ <= n[x] + n[y]
            found.append(np.stack([key[x[near]], key[y[near]]]))
        if found:
            pairs = np.concatenate(found, axis=1)
            pairs = np.unique(np.sort(pairs, axis=0), axis=1)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _some_pairs(open_: DataFrame, sketches: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs (a, b) of open members that may have a similarity of 4/5, a few a member, at some of their shingles.

    Which of a shingle's nodes meet is left to chance, and a group may be cut between tasks; ``_meeting`` finds the others.
    """
    some = open_.filter(F.pmod("h", F.lit(SOME)) == turn).select("h", "key", "n", "part").join(sketches, "key")
    some = some.select("h", "key", "n", "part", *SKETCH, F.xxhash64("key", "h").alias("spot"))
    return some.repartitionByRange("h", "spot").sortWithinPartitions("h", "spot").drop("spot").mapInArrow(_next_ones, "a long, b long").distinct()


def _meeting(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of placed members that may have a similarity of 4/5, if the shingle they meet at is their first."""
    early = members.filter(F.col("place") <= F.floor(F.col("n") / 5)).join(sketches, "key")
    one, other = (early.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "part", "place", *SKETCH)]) for x in "ab")
    most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))  # shared from here on
    may = (9 * most >= 4 * (F.col("n_a") + F.col("n_b"))) & _near_enough("n_a", "n_b", "_a", "_b")
    met = one.join(other, "h").filter(F.expr("part_a < part_b") & may)
    return met.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def _shared_shingles(batches):
    """From (h, key, n, place) sorted: each h of several keys with its keys, and key and n of the first. Holds one row between batches."""
    import pyarrow as pa

    held = None  # the last distinct row so far: h, key, n, place, first key of the group and its n, whether it was given out
    for batch in batches:
        h, key, size, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(h):
            continue
        given = first_held = None
        if held is not None:
            h, key, size, place = (np.concatenate([[x], y]) for x, y in zip(held[:4], (h, key, size, place), strict=True))
            first_held, given = held[4:6], held[6]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
        h, key, size, place = h[fresh], key[fresh], size[fresh], place[fresh]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.concatenate([start, [len(h)]]))
        first, first_n = np.repeat(key[start], n), np.repeat(size[start], n)
        several = np.repeat(n > 1, n)
        if held is not None:
            first[: n[0]], first_n[: n[0]] = first_held
            several[: n[0]] |= given  # a group that has been begun goes on
        out = several.copy()
        if given:
            out[0] = False
        held = (h[-1], key[-1], size[-1], place[-1], first[-1], first_n[-1], bool(several[-1]))
        if out.any():
            yield pa.record_batch([pa.array(x[out]) for x in (h, key, size, place, first, first_n)], names=["h", "key", "n", "place", "first", "first_n"])


def _proposed(nodes: DataFrame, many: int, radius: int = 4) -> DataFrame:
    """Distinct pairs (a, b) of nodes (key, fp) that SimHash's BK-trees link, as a star or chain a component."""
    by_print = written(nodes.groupBy("fp").agg(F.min("key").alias("first")), "by_print", narrow(many))
    same = nodes.join(by_print, "fp").filter("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    near = links(by_print.select("fp"), by_print.count(), radius)
    near = near.join(by_print.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(by_print.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    pairs = same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _beginnings(rows: DataFrame, order: tuple[np.ndarray, np.ndarray], *columns: str, shingles=shingles_of, prints=True) -> DataFrame:
    """key, fp, sketch, n (size of the set) and first (its beginning in that order) of rows (text and ``columns``)."""
    shared = rows.sparkSession.sparkContext.broadcast(order)
    sets = rows.select(*columns, _sets(shared, shingles, prints)(F.col("text")).alias("s")).select(*columns, "s.*")
    n = F.size("hashes")
    return sets.select(*columns, "key", "fp", "sketch.*", n.alias("n"), F.slice("hashes", 1, F.floor(n / 5).cast("int") + COMMON).alias("first"))


def _members(sets: DataFrame, files: int) -> DataFrame:
    """(h, key, n, place, first, first_n) of each shingle in the beginnings of several nodes; first is its smallest key."""
    rows = sets.select(F.posexplode("first").alias("place", "h"), "key", "n").select("h", "key", "n", "place")
    sorted_ = rows.repartition("h").sortWithinPartitions("h", "key")
    return written(sorted_.mapInArrow(_shared_shingles, "h long, key long, n int, place int, first long, first_n int"), "members", files)


def _placed(members: DataFrame, part: DataFrame, files: int) -> DataFrame:
    """Members with their component."""
    placed = members.select("h", "key", "n", "place").join(part.withColumnRenamed("node", "key"), "key", "left")
    return written(placed.select("h", "key", "n", "place", F.coalesce("root", "key").alias("part")), "placed", files)


def _open(placed: DataFrame, files: int) -> DataFrame:
    """Placed members of shingles that several components share."""
    several = placed.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("h")
    out = written(placed.join(several, "h", "left_semi"), "open", files)
    forget(placed)
    return out


def near_duplicates(docs: DataFrame, sample: int = SAMPLE, shingles=shingles_of, digest: Column | None = None, propose: bool = True) -> DataFrame:
    """doc_id, digest (of the text), root (key of the component) and component_id for each row of ``docs``.

    ``shingles`` gives a text's sorted distinct 64-bit hashes, spread over all bits. ``digest``, if ``docs`` has one, is the
    same for texts with the same set only. Without SimHash's proposals the prefix search alone finds the same links.
    """
    modest_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", (digest_of(F.col("text")) if digest is None else digest).alias("digest"))
    many = docs.count()
    few, more = narrow(many), wide(docs.sparkSession, many)
    order = _frequent(rows, many, sample, shingles)
    sets = written(_beginnings(rows, order, "doc_id", "digest", shingles=shingles, prints=propose), "sets", more)
    nodes = written(sets.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), *[F.min(c).alias(c) for c in SKETCH]), "nodes", few)
    members = _members(sets, more)
    pairs = _enough(members.filter("key <> first").selectExpr("first AS a", "first_n AS n_a", "key AS b", "n AS n_b"))
    pairs = written(pairs.unionByName(_proposed(nodes, many)).distinct() if propose else pairs, "pairs", few)
    edges = _alike(pairs, sets, rows, many, shingles)
    part = components(edges, few)
    open_ = _open(_placed(members, part, more), more)
    forget(members, part)
    sketches, tried = nodes.select("key", *SKETCH), [pairs]
    for turn in range(TURNS):
        near = _some_pairs(open_, sketches, turn).join(functools.reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
        tried.append(written(near, "near", more))
        found = _alike(tried[-1], sets, rows, many, shingles)
        edges = edges.unionByName(found)
        part = components(edges, few)
        open_ = _open(_placed(open_.drop("part"), part, more), more)
        forget(part)
    across = _meeting(open_, sketches).join(functools.reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
    across = written(across, "across", more)
    forget(open_)
    far = _alike(across, sets, rows, many, shingles)
    whole = components(edges.unionByName(far), few)
    rooted = nodes.join(whole.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    rooted = written(rooted, "rooted", few)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(named, "root").select("key", "root", "component_id"), "named", few)
    out = written(sets.select("doc_id", "digest", "key").join(named, "key").select("doc_id", "digest", "root", "component_id"), "groups", more)
    forget(sets, nodes, *tried, across, far, whole, rooted, named)
    return out
