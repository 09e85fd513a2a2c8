"""Exact and near deduplication: word shingles, MinHash signatures, banded LSH, verification, clusters.

Documents carry ``ord``, a total order; the first of equal documents survives. Near-duplicates are found within windows
of consecutive documents (or in one global window). A bucket joins its members to its first only, so it gives as many
pairs as members, whatever its size; a hot bucket is split by AQE's skew join because the bucket's first is a side of
its own. Candidates are verified with exact Jaccard similarity, and clusters come from min-label propagation. Such buckets
miss links: pairs that share no band, and pairs of members that are not the first. ``all_near_duplicates`` misses none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import modest_batches, stored

try:
    from _md5 import md5  # the interpreter's own: on short strings twice as fast as OpenSSL's
except ImportError:
    from hashlib import md5

PRIME = (1 << 61) - 1


def drop_exact_duplicates(docs: DataFrame, text: str = "text", order: str = "ord") -> DataFrame:
    """The first document of each text. Only digests and orders are shuffled and combined map-side, not texts."""
    keyed = docs.withColumn("_digest", F.sha2(F.col(text), 256))
    first = keyed.groupBy("_digest").agg(F.min(order).alias(order))
    return keyed.join(first, ["_digest", order], "left_semi").drop("_digest")


def _grams(words: list[bytes], k: int) -> np.ndarray:
    """Distinct hashes of the words' ``k``-grams, in order: the first four bytes of the MD5 digest of the joined words."""
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)] * min(1, len(words))
    hashes = np.frombuffer(b"".join([md5(g, usedforsecurity=False).digest() for g in grams]), ">u4")[::4].astype(np.int64)
    return hashes[np.sort(np.unique(hashes, return_index=True)[1])]


def spread_grams(text: str | None, k: int = 5) -> np.ndarray:
    """The hashes that ``shingle_hashes`` gives for a lower-cased text, each turned into another 64-bit number, sorted."""
    x = _grams([w.encode() for w in (text or "").split()], k).astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # one to one
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return np.sort(x)


def shingle_hashes(text: Column, k: int = 5) -> Column:
    """Distinct 32-bit hashes of the lower-cased word ``k``-grams; fewer words are one gram, no words give none."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def hashed(texts):
        import pyarrow as pa

        rows = [None if (x := lowered.as_py()) is None else _grams([w.encode() for w in x.split()], k) for lowered in texts]
        ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)]).astype(np.int32)
        flat = pa.array(np.concatenate([np.zeros(0, np.int64), *(r for r in rows if r is not None)]))
        return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([r is None for r in rows]))

    return hashed(F.lower(text))


def permutations(num_perm: int = 128, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, num_perm, dtype=np.uint64), rng.integers(0, 1 << 32, num_perm, dtype=np.uint64)


def _minima(x: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 512) -> np.ndarray:
    """Of (a x + b) mod 2^61-1 over x, for each a and b; a, x < 2^32, so that a x + b fits in 64 bits."""
    prime, out = np.uint64(PRIME), np.full(len(a), PRIME, np.uint64)
    for at in range(0, len(x), step):
        v = x[at : at + step, None] * a
        v += b
        high = v >> np.uint64(61)
        v &= prime
        v += high  # below 2^61 + 8, so at most one prime too much
        np.minimum(v, v - prime, out=v)  # where v is smaller, the difference wraps to a huge number
        np.minimum(out, v.min(0), out=out)
    return out


def minhash(hashes: Column, num_perm: int = 128, seed: int = 0) -> Column:
    """Minima of (a x + b) mod 2^61-1 over 32-bit hashes, vectorised; all 2^61-1 for no hashes."""
    a, b = permutations(num_perm, seed)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def signature(column):
        import pyarrow as pa

        out = np.full((len(column), num_perm), PRIME, np.uint64)
        for i, own in enumerate(column):
            out[i] = _minima(np.asarray(own.values if own.is_valid else [], np.uint64), a, b)
        return pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1).astype(np.int64)), num_perm).cast(pa.list_(pa.int64()))

    return signature(hashes)


def estimate_threshold(bands: int, rows: int) -> float:
    """Similarity at which a pair becomes likely to share a band."""
    return (1 / bands) ** (1 / rows)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays of distinct items; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def lsh_candidates(signed: DataFrame, num_perm: int = 128, bands: int = 16) -> DataFrame:
    """Distinct pairs (a, b): the first member of a bucket and another. ``signed`` has ord, window and sig."""
    if num_perm % bands:
        raise ValueError("the bands must divide the permutations")
    rows = num_perm // bands
    signed = stored(signed.select("ord", "window", "sig"), "signed")  # read twice
    cut = F.array(*[F.struct(F.lit(i).alias("band"), F.slice("sig", i * rows + 1, rows).alias("key")) for i in range(bands)])
    banded = signed.select("ord", "window", F.explode(cut).alias("x")).select("ord", "window", "x.band", "x.key")
    first = banded.groupBy("window", "band", "key").agg(F.min("ord").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return banded.join(first, ["window", "band", "key"]).filter("ord > a").select("a", F.col("ord").alias("b")).distinct()


def verify(pairs: DataFrame, shingled: DataFrame) -> DataFrame:
    """``pairs`` with their exact Jaccard similarity. ``shingled`` has ord and hashes."""
    a = shingled.select(F.col("ord").alias("a"), F.col("hashes").alias("ha"))
    b = shingled.select(F.col("ord").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", jaccard(F.col("ha"), F.col("hb")).alias("jaccard"))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) of every node of edges (a, b), a < b: root is the smallest node of its component."""
    ends = edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a"))
    label, before = stored(ends.groupBy("node").agg(F.min("root").alias("root")), "labels"), None
    for _ in range(most_rounds):
        total = label.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return label
        before = total
        a, b = (label.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        low = edges.join(a, "a").join(b, "b").select("a", "b", "ra", "rb", F.least("ra", "rb").alias("root"))
        told = low.select(F.explode(F.array("a", "b", "ra", "rb")).alias("node"), "root").groupBy("node").agg(F.min("root").alias("root"))
        jump = told.select(F.col("node").alias("root"), F.col("root").alias("next"))
        label = stored(told.join(jump, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
    raise RuntimeError("labels still fall after all rounds")


def numbered(docs: DataFrame, order, at: str = "rn") -> DataFrame:
    """Row numbers from 0 in a total order, without one task seeing all rows: range partitions and their offsets."""
    sorted_ = stored(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    from pyspark.sql import Window

    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_offset"))  # a row a partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return sorted_.withColumn("_row", within).join(offsets, "_part").withColumn(at, F.col("_row") + F.col("_offset") - 1).drop("_part", "_row", "_offset")


def near_duplicates(docs: DataFrame, num_perm: int = 128, bands: int = 16, check: bool = True, threshold: float = 0.8, text: str = "text", seed: int = 0) -> DataFrame:
    """(ord, root) of the documents to drop. ``docs`` has ord, text and window; windows are independent."""
    modest_batches(docs.sparkSession)
    shingled = stored(docs.select("ord", "window", shingle_hashes(F.col(text)).alias("hashes")), "shingles")
    pairs = lsh_candidates(shingled.select("ord", "window", minhash(F.col("hashes"), num_perm, seed).alias("sig")), num_perm, bands)
    if check:
        pairs = verify(pairs, shingled).filter(F.col("jaccard") >= threshold).select("a", "b")
    found = components(stored(pairs, "pairs"))
    return found.filter("node > root").select(F.col("node").alias("ord"), "root")


def all_near_duplicates(docs: DataFrame, text: str = "text", digest: str | None = None) -> DataFrame:
    """(ord, root) of the documents to drop: those linked, in any number of steps, to an earlier one, the first of which is root.

    Every pair with a Jaccard similarity of 0.8 or more is a link, whatever its buckets and however far apart it stands. ``digest`` names a column with the texts' digests, which spares making them.
    """
    from ..llm import jaccard

    own = F.sha2(F.coalesce(F.col(text), F.lit("")), 256) if digest is None else F.col(digest)
    lowered = docs.select(F.col("ord").alias("doc_id"), F.lower(F.col(text)).alias("text"), own.alias("digest"))
    found = jaccard.near_duplicates(lowered, shingles=spread_grams, digest=F.col("digest"), propose=False)
    return found.filter("doc_id > component_id").select(F.col("doc_id").alias("ord"), F.col("component_id").alias("root"))


def dedupe_stream(docs: DataFrame, num_perm: int = 128, bands: int = 16, check: bool = True, threshold: float = 0.8, order: str = "ord", text: str = "text") -> DataFrame:
    """``docs`` without those that ``near_duplicates`` finds among all of them."""
    named = docs.select(F.col(order).alias("ord"), F.col(text).alias("text"), F.lit(0).cast("long").alias("window"))
    return docs.join(near_duplicates(named, num_perm, bands, check, threshold).select(F.col("ord").alias(order)), order, "left_anti")


def windowed_near_dedupe(docs: DataFrame, window: int | None = 50_000, threshold: float = 0.8, order: str = "ord", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates of earlier documents in the same window of ``window`` documents (None: global)."""
    named = docs.select(F.col(order).alias("ord"), F.col(text).alias("text"))
    if window is None:
        cut = named.withColumn("window", F.lit(0).cast("long"))
    else:
        cut = numbered(named, ["ord"]).withColumn("window", F.floor(F.col("rn") / window)).drop("rn")
    gone = near_duplicates(cut, threshold=threshold).select(F.col("ord").alias(order))
    return docs.join(gone, order, "left_anti")
