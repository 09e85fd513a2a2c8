"""Exact searches of integer vectors: blocks of vectors, packs of queries, and waves that tighten what must be beaten.

Rows with the same vector (and label) are one node, which carries as many of its smallest ids as an answer can hold, so a
vector that a third of all rows have costs one row. Nodes are put in a total order and cut in blocks of bounded size.
Queries meet the blocks of their span in waves that grow: after each wave a query knows the k-th best score so far, and
meets only blocks in which a score of at least that is possible (the largest length in the block times its own). A task
holds one block and one pack of queries, and gives out at most k answers a query. No wave drops a pair that could count.

Where components are so large that sums could leave the exact integers of doubles, Python's integers take over; scores
beyond a long count as the long's end.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dedupe import numbered
from ._shared import forget, modest_batches, written

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Rows of a block, windows of a pack, queries that a task scores at a time.
BLOCK, PACK, STEP = 4096, 1024, 128


def taking_part(vectors: DataFrame, scale: int, id_col: str, vector: str, label: str | None = None) -> DataFrame:
    """(vec_id, label, embedding, dim) of rows with an id, a label and only finite components, also after scaling."""
    v = F.col("embedding")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * scale) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label) if label else F.lit(0)).cast("long").alias("label"), F.col(vector).alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    return rows.filter(~F.coalesce(bad, F.lit(True))).withColumn("dim", F.size(v)).distinct()


def _floored(scale: int):
    @F.arrow_udf("struct<v: array<double>, norm: double>")
    def floored(vectors):
        import pyarrow as pa

        ends = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
        flat = np.floor(np.asarray(vectors.flatten()).astype(np.float64) * scale)
        with np.errstate(over="ignore"):
            norm = np.sqrt(np.add.reduceat(flat * flat, ends[:-1])) if len(flat) else np.zeros(0)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(norm)], ["v", "norm"])

    return floored


def integers(rows: DataFrame, scale: int) -> DataFrame:
    """``rows`` with v, the integer components floor(scale * x) as doubles, and norm, its length."""
    return rows.withColumn("i", _floored(scale)(F.col("embedding"))).select(*[c for c in rows.columns if c != "embedding"], "i.v", "i.norm")


def blocks_of(rows: DataFrame, scale: int, k: int, order: list, size: int = BLOCK) -> DataFrame:
    """Stored blocks (dim, block, top, labels, rows) of the nodes in that order; rows are (label, ids, v), top their largest norm."""
    modest_batches(rows.sparkSession)
    rank = F.row_number().over(Window.partitionBy("embedding", "label").orderBy("vec_id"))
    few = rows.withColumn("r", rank).filter(F.col("r") <= k + 1)
    nodes = few.groupBy("embedding", "label").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("dim").alias("dim"))
    nodes = integers(nodes, scale).withColumns({"least": F.col("ids")[0], "code": F.xxhash64("v"), "down": -F.col("norm")})
    placed = numbered(nodes, ["dim", *order, "least", "code"]).withColumn("block", F.floor(F.col("rn") / size).cast("long"))
    blocks = placed.groupBy("dim", "block").agg(F.max("norm").alias("top"), F.collect_set("label").alias("labels"), F.collect_list(F.struct("label", "ids", "v")).alias("rows"))
    return written(blocks, "blocks")


def asking(rows: DataFrame, scale: int, every: int) -> DataFrame:
    """(query_id, label, dim, v, norm) of the rows whose id is divisible by ``every``, one an id: the smallest."""
    some = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    one = some.groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("label", "embedding")).alias("s"))
    return integers(one.select("query_id", "s.label", "s.embedding", F.size("s.embedding").alias("dim")), scale)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All integer inner products, cut off at the ends of a long; Python's integers, for components of any size."""
    large = lambda m: np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape)
    return np.clip(large(q) @ large(x).T, LEAST, MOST).astype(np.int64)


def safe(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether doubles hold all sums of products exactly, with room to spare for intervals."""
    return 4.0 * q.shape[1] * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) < 2.0**53


def best_of(window: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which answers are among the first k of their window: higher scores first, then smaller ids; equal answers count once."""
    order = np.lexsort((ids, ~score, window))
    rows = np.stack([window, ids, score])[:, order]
    order = order[np.concatenate([np.ones(min(1, len(order)), bool), (rows[:, 1:] != rows[:, :-1]).any(0)])]
    w = window[order]
    start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, int)
    place = np.arange(len(w)) - np.repeat(start, np.diff(np.append(start, len(w))))
    return order[place < k]


Finder = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def answers(rows, asked, find: Finder, k: int, same: bool | None):
    """(position in ``asked``, vec_id, score) of the first k of each window of a pack within one block (both Arrow structs)."""
    label, lists = np.asarray(rows.field("label")), rows.field("ids")
    per_node, ids = lists.value_lengths().to_numpy(zero_copy_only=False), np.asarray(lists.flatten())
    starts = np.concatenate([[0], np.cumsum(per_node)])
    x = np.asarray(rows.field("v").flatten()).reshape(len(label), -1)
    own = np.asarray(asked.field("query_id"))
    _, first, anchor = np.unique(own, return_index=True, return_inverse=True)
    q = np.asarray(asked.field("v").flatten()).reshape(len(own), -1)[first]
    lo, hi = (np.asarray(asked.field(c)) for c in ("least", "most"))
    by_id, node_of = np.argsort(ids, kind="stable"), np.repeat(np.arange(len(label)), per_node)
    exact, out = safe(q, x), []
    for at in range(0, len(first), STEP):
        mine = np.arange(at, min(at + STEP, len(first)))
        windows = np.flatnonzero((anchor >= at) & (anchor < at + STEP))
        ok = np.ones((len(mine), len(label)), bool)
        if same is not None:
            ok = (np.asarray(asked.field("label"))[first[mine]][:, None] == label[None, :]) == same
        name = own[first[mine]]
        left, right = (np.searchsorted(ids, name, side, sorter=by_id) for side in ("left", "right"))
        for r in np.flatnonzero(right > left):  # a node of no other id is no candidate
            held = node_of[by_id[left[r] : right[r]]]
            ok[r, held[per_node[held] == 1]] = False
        if exact:
            w, c, s = find(x, q[mine], ok, anchor[windows] - at, lo[windows], hi[windows], k)
        else:
            every = exact_scores(q[mine], x)[anchor[windows] - at]
            w, c = np.nonzero(ok[anchor[windows] - at] & (every >= lo[windows][:, None]) & (every <= hi[windows][:, None]))
            s = every[w, c]
        many = per_node[c]
        slot = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        got = ids[np.repeat(starts[c], many) + slot]
        w, s = windows[np.repeat(w, many)], np.repeat(s, many).astype(np.int64)
        other = got != own[w]
        w, got, s = w[other], got[other], s[other]
        keep = best_of(w, got, s, k)
        out.append((w[keep], got[keep], s[keep]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _scored(find: Finder, k: int, same: bool | None):
    def score(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, asked in zip(batch.column(0), batch.column(1), strict=True):
                w, ids, s = answers(rows.values, asked.values, find, k, same)
                keys = [np.asarray(asked.values.field(c))[w] for c in ("query_id", "part")]
                yield pa.record_batch([pa.array(c) for c in (*keys, ids, s)], names=["query_id", "part", "vec_id", "score"])

    return score


def search(queries: DataFrame, blocks: DataFrame, find: Finder, k: int, same: bool | None = None, growth: int = 8, pack: int = PACK) -> DataFrame:
    """Stored (query_id, part, vec_id, score, rank): the k best nodes' ids of each window, ranked from 1.

    ``queries`` is a stored table (query_id, part, label, dim, v, norm, least, most, from_block, to_block): windows whose
    answers have scores from ``least`` to ``most``, sought in the blocks of their span. ``find`` may leave out whatever
    cannot be among a window's k best; with ``same``, only nodes of the same label (true) or another one (false) count.
    """
    spark = queries.sparkSession
    size = queries.agg(F.count("*").alias("n"), F.max(F.col("to_block") - F.col("from_block")).alias("far")).first()
    key, rank = ["query_id", "part"], F.row_number().over(Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id"))
    best = spark.createDataFrame([], "query_id long, part long, vec_id long, score long, rank int")
    lo, hi, slots = 0, 1, F.lit(max(1, -(-size.n // pack)))
    while size.n and lo <= size.far:
        known = best.filter(F.col("rank") == k).select(*key, F.col("score").alias("floor"))
        live = queries.join(known, key, "left") if lo else queries.withColumn("floor", F.lit(None).cast("long"))
        live = live.withColumn("least", F.greatest("least", "floor")).filter(F.col("from_block") + lo <= F.col("to_block"))
        met = live.withColumn("block", F.explode(F.sequence(F.col("from_block") + lo, F.least(F.col("from_block") + hi - 1, "to_block"))))
        reach = F.col("norm") * F.col("top") * (1 + 1e-9) + 1
        met = met.join(blocks.select("dim", "block", "top"), ["dim", "block"]).filter(F.isnan(reach) | (reach >= F.col("least")))
        packed = met.groupBy("dim", "block", F.pmod(F.xxhash64("query_id"), slots).alias("slot")).agg(F.collect_list(F.struct("query_id", "part", "label", "v", "least", "most")).alias("asked"))
        found = packed.join(blocks.select("dim", "block", "rows"), ["dim", "block"]).select("rows", "asked")
        found = found.mapInArrow(_scored(find, k, same), "query_id long, part long, vec_id long, score long")
        found = found.unionByName(best.drop("rank")).distinct().withColumn("rank", rank).filter(F.col("rank") <= k)
        old, best = best, written(found, "best")
        forget(old)
        lo, hi = hi, hi + (hi - lo) * growth
    return best
