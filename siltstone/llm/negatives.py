"""Hard negatives by bit-sliced integer products: wrongly near rows of other labels, just below each positive.

Components are integers. Those of a block's candidates are shifted to be non-negative and taken apart into bit-planes,
matrices of zeros and ones. Planes are multiplied with the anchors most significant first. With p planes to go, what is
missing from a sum lies between 2 ** p - 1 times the sum of the anchor's negative components and as much of its positive
ones, so each score has an interval that every plane halves. A candidate is dropped once its interval cannot reach an
anchor's window, or stays below k candidates that are sure to be in it. What is left after the last plane has its exact
score. When few pairs are left, only those go on.

Two searches use this (see ``_blocks`` for blocks, packs and waves): an anchor's positives among the nodes of its own label,
which stand together in the order, and then its negatives among all others, where each positive has its own window of
scores and an anchor's windows share its sums.

Defined results: rows without an id or a label, null and empty vectors, and those with a null or non-finite component
(also after scaling) take no part; vectors only meet those of their own length. Equal rows count once. If different
rows share an id, each is a candidate and the smallest (label, then vector) is the anchor of that id; nothing of an
anchor's own id is its positive or negative. An anchor without positives has no rows, and neither has a positive with no
negative in its window; below zero the window is empty. Ties go to the smaller id. Scores beyond a long count as its
end. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as b
from ._shared import forget, table, written
from .topk import _kth_largest


def sliced(x, q, ok, window, least, most, k):
    """A finder (see ``_blocks.search``) of the k best scores in each window, plane by plane."""
    shift = max(0.0, -x.min(initial=0))
    codes = (x + shift).astype(np.int64)
    up, down = q.clip(min=0).sum(1), q.clip(max=0).sum(1)
    score = np.broadcast_to((-shift * q.sum(1))[:, None], ok.shape).copy()
    needed, most = least.astype(np.float64), most.astype(np.float64)
    layers = _layers(window)
    pairs = None
    for p in reversed(range(int(codes.max(initial=0)).bit_length())):
        plane, rest = ((codes >> p) & 1).astype(np.float64), float((1 << p) - 1)
        if pairs is None:
            score += (q @ plane.T) * float(1 << p)
            low, high = score + rest * down[:, None], score + rest * up[:, None]
            keep = np.zeros(ok.shape, bool)
            for layer in layers:
                r = window[layer]
                sure = ok[r] & (low[r] >= needed[layer][:, None]) & (high[r] <= most[layer][:, None])
                needed[layer] = np.maximum(needed[layer], _kth_largest(np.where(sure, low[r], -np.inf), k))
                keep[r] |= (high[r] >= needed[layer][:, None]) & (low[r] <= most[layer][:, None])
            ok = ok & keep
            if np.count_nonzero(ok) * 16 < ok.size:
                r, c = np.nonzero(ok)
                pairs = r, c, score[r, c]
                wanted, allowed = np.full(len(q), np.inf), np.full(len(q), -np.inf)
                np.minimum.at(wanted, window, needed)
                np.maximum.at(allowed, window, most)
        else:
            r, c, s = pairs
            s = s + float(1 << p) * np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[r[at : at + 65_536]], plane[c[at : at + 65_536]]) for at in range(0, len(r), 65_536))])
            on = (s + rest * up[r] >= wanted[r]) & (s + rest * down[r] <= allowed[r])
            pairs = r[on], c[on], s[on]
    r, c, s = pairs if pairs is not None else (*np.nonzero(ok), score[ok])
    return _in_windows(r, c, s, window, needed, most, len(q))


def _layers(window: np.ndarray) -> list[np.ndarray]:
    """Windows' positions in groups that hold each query once at most."""
    order = np.argsort(window, kind="stable")
    w = window[order]
    start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, int)
    place = np.arange(len(w)) - np.repeat(start, np.diff(np.append(start, len(w))))
    return [order[place == i] for i in range(int(place.max(initial=-1)) + 1)]


def _in_windows(r, c, s, window, least, most, many):
    """Each pair (query r, candidate c, score s) once for every window of the query that it lies in."""
    order = np.argsort(window, kind="stable")
    count = np.bincount(window, minlength=many)
    begin = np.cumsum(count) - count
    times = count[r]
    slot = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    w, c, s = order[np.repeat(begin[r], times) + slot], np.repeat(c, times), np.repeat(s, times)
    inside = (s >= least[w]) & (s <= most[w])
    return w[inside], c[inside], s[inside]


def hard_negatives(vectors: DataFrame, scale: int = 256, every: int = 100, positives: int = 5, k: int = 5, share: tuple[int, int] = (4, 5), block: int = b.BLOCK, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; see the module.

    Anchors are the rows whose id is divisible by ``every``; a negative's score is at least ``share`` (a fraction) of the
    positive's and at most the positive's.
    """
    rows = written(b.taking_part(vectors, scale, id_col, vector, label), "rows")
    blocks = b.blocks_of(rows, scale, max(k, positives), ["label"], block)
    anchors = written(b.asking(rows, scale, every), "anchors")
    span = [F.min("block").alias("from_block"), F.max("block").alias("to_block")]
    of_label = blocks.select("dim", "block", F.explode("labels").alias("label")).groupBy("dim", "label").agg(*span)
    any_score = {"part": F.lit(0).cast("long"), "least": F.lit(b.LEAST), "most": F.lit(b.MOST)}
    own = written(anchors.join(of_label, ["dim", "label"]).withColumns(any_score), "own")
    first = b.search(own, blocks, sliced, positives, same=True)
    near = first.select("query_id", F.col("vec_id").alias("part"), F.col("score").alias("most"))
    lower = F.ceil(F.col("most").cast("decimal(20,0)") * share[0] / share[1]).cast("long")
    asked = anchors.join(near.withColumn("least", lower).filter("least <= most"), "query_id").join(blocks.groupBy("dim").agg(*span), "dim")
    asked = written(asked, "asked")
    found = b.search(asked, blocks, sliced, k, same=False)
    out = found.join(asked.select("query_id", "part", "most"), ["query_id", "part"])
    out = written(out.select(F.col("query_id").alias("anchor_id"), F.col("part").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("most").alias("positive_score"), F.col("score").alias("negative_score")), "negatives")
    forget(rows, blocks, anchors, own, first, asked, found)
    return out


def relabelled(vectors: DataFrame) -> DataFrame:
    """The table with the label of each seventh vector moved on by one, which plants wrong labels."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", moved.alias("label"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Five negatives for each of the five positives of every vector whose id is divisible by 100."""
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


OP11_SQL = """
WITH ok AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, label, len(embedding) AS dim, unnest(range(len(embedding))) AS i, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM ok),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, sum(a.x * c.x)::BIGINT AS score
  FROM parts a JOIN parts c ON c.i = a.i AND c.dim = a.dim AND c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r
  FROM scores WHERE same),
found AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM positives JOIN scores USING (anchor_id)
  WHERE r <= 5 AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM found WHERE rank <= 5
"""
