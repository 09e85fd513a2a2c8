"""Exact top-k inner products of integer vectors: blocks by descending length, pruned by SVD-rotated partial sums.

Vectors stand in blocks by descending length, and queries meet them in that order, in waves (see ``_blocks``): a block
whose longest vector, times the query's length, stays below the query's k-th best score so far is never opened.

Within a block, queries and vectors are rotated to the right singular vectors of a sample, largest singular value first.
After the first coordinates, the inner product lies within the lengths of both remainders of the partial sum, by Cauchy
and Schwarz. The k-th largest lower end of a query is a score that must be reached, so candidates whose upper end is
below it go; this is repeated after further coordinates. What is left is scored by exact integer products. The rotation
decides how much is pruned and never what is found: it is fitted on a bounded sample (``sample`` vectors a table), and a
margin for rounding is added to every interval.

Vectors of equal lengths in random directions cannot be pruned much by any such bound; then nearly all pairs of a stated
query and a vector are multiplied, in blocks.

Defined results: rows without an id, null and empty vectors, and those with a null or non-finite component (also after
scaling) take no part; vectors only meet those of their own length. Equal rows count once. If different rows share an
id, each is a candidate, the smallest is the query of that id, and no answer names the query's own id. Scores beyond a
long count as its end. Ties go to the smaller id. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as b
from ._shared import forget, table, written


def fit_rotations(rows: DataFrame, scale: int, most: int) -> dict[int, np.ndarray]:
    """Right singular vectors by dimension, of the at most ``most`` rows with the smallest hashes."""
    found = b.integers(rows, scale).orderBy(F.xxhash64("v"), "vec_id").limit(most).select("v").toArrow().column("v").to_pylist()
    out = {}
    for dim in sorted({len(v) for v in found}):
        x = np.array([v for v in found if len(v) == dim])
        x /= max(1.0, np.abs(x).max())
        out[dim] = np.linalg.svd(x.T @ x)[0]  # singular vectors of x itself
    return out


def _kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity if it has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k]


def pruned_by(shared) -> b.Finder:
    """A finder of the k best (see ``_blocks.search``) that multiplies only what partial sums leave."""

    def find(x, q, ok, window, least, most, k):
        dim = x.shape[1]
        turn = shared.value.get(dim)
        y, z = (x, q) if turn is None else (x @ turn, q @ turn)
        margin = 1e-9 * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :] + 1e-6
        needed = np.full(len(q), -np.inf)
        needed[window] = least  # one window a query
        cuts = sorted({max(1, dim * part // 8) for part in (1, 2, 4)} - {dim})
        partial, done = np.zeros(ok.shape), 0
        for cut in cuts:
            partial += z[:, done:cut] @ y[:, done:cut].T
            done = cut
            spread = np.linalg.norm(z[:, cut:], axis=1)[:, None] * np.linalg.norm(y[:, cut:], axis=1)[None, :] + margin
            needed = np.maximum(needed, _kth_largest(np.where(ok, partial - spread, -np.inf), k))
            ok = ok & (partial + spread >= needed[:, None])
            if np.count_nonzero(ok) * 8 < ok.size:
                break
        r, c = np.nonzero(ok)
        if len(r) * 8 > ok.size:
            s = (q @ x.T)[r, c]
        else:
            s = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[r[at : at + 65_536]], x[c[at : at + 65_536]]) for at in range(0, len(r), 65_536))])
        full = np.full(ok.shape, -np.inf)
        full[r, c] = s
        keep = s >= np.maximum(needed, _kth_largest(full, k))[r]
        of = np.zeros(len(q), np.int64)
        of[window] = np.arange(len(window))
        return of[r[keep]], c[keep], s[keep]

    return find


def top_products(vectors: DataFrame, scale: int = 1024, every: int = 100, k: int = 10, sample: int = 32_768, block: int = b.BLOCK, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each row whose id is divisible by ``every``."""
    rows = written(b.taking_part(vectors, scale, id_col, vector), "rows")
    rotations = vectors.sparkSession.sparkContext.broadcast(fit_rotations(rows, scale, sample))  # a dim x dim matrix a length
    blocks = b.blocks_of(rows, scale, k, ["down"], block)
    span = blocks.groupBy("dim").agg(F.min("block").alias("from_block"), F.max("block").alias("to_block"))
    queries = b.asking(rows, scale, every).join(span, "dim")
    queries = written(queries.withColumns({"part": F.lit(0).cast("long"), "least": F.lit(b.LEAST), "most": F.lit(b.MOST)}), "queries")
    best = b.search(queries, blocks, pruned_by(rotations), k)
    forget(rows, blocks, queries)
    return best.select("query_id", "rank", "vec_id", "score")


def op12_top_products(spark, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every vector whose id is divisible by 100, with components floor(1024 x)."""
    return top_products(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH ok AS (
  SELECT DISTINCT vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, len(embedding) AS dim, unnest(range(len(embedding))) AS i, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM ok),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM parts q JOIN parts c ON c.i = q.i AND c.dim = q.dim AND c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
