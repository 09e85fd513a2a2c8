"""Approximate nearest neighbours on robust-pruned directed graphs, one a shard.

Every valid vector is indexed. Equal vectors are one node that carries its smallest ids (as many as an answer can
hold), so that a vector repeated a million times costs one row. Nodes are dealt to cells by the nearest of at most
``most_cells`` centroids, fitted on a bounded sample, and a cell's nodes at random in shards of bounded size. A shard's
graph grows in batches: greedy beam search from the medoid proposes neighbours, beside those of the same batch; relaxed
distance pruning keeps diverse ones (a candidate waits if a kept neighbour is ``alpha`` times nearer to it than the node
is), the nearest of those that wait take the places left, and reverse edges are pruned alike. Nodes that no path reaches in
the end are linked from the most similar one that can spare a link. Finished shards are rows of a stored table. How wide a
beam a shard takes is measured on a sample of its own nodes by brute force: vectors without structure, or of many
components, take more than families do. All similarities are doubles, for in single precision the members of a tight
family, or vectors far from the origin, are all equally near.

A query meets the shards of its nearest cells only. How many cells that takes is measured: a bounded sample of queries
is answered by brute force over all nodes in one scan, and the smallest number of cells that holds ``coverage`` of those
true neighbours is used. Vectors with structure need a few cells, however many there are; without any (random
directions) the measure says so and more cells are searched, for no index could do with less. Queries of a cell are
packed in blocks; each block is answered by beam search, all its queries at a time, with scores in double precision on
the original vectors. The best of all shards are merged by a ranked window.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do rows
without an id; vectors only meet those of their own length. Rows with a query's id are its own: no answer names them,
and if several rows share a query's id, its answers are the nearest to any of them. Ties go to the smaller id. Extra
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import modest_batches, table, written


def beam_search(x: np.ndarray, near: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the ``beam`` best nodes found for each unit query, best first; -1 where there are fewer."""
    many, n = len(queries), len(x)
    ids = np.full((many, beam), -1)
    sims = np.full((many, beam), -np.inf)
    open_ = np.zeros((many, beam), bool)
    seen = np.zeros((many, n), bool)
    ids[:, 0], sims[:, 0], open_[:, 0], seen[:, start] = start, queries @ x[start], True, True
    live = np.arange(many)
    while len(live):
        at = open_[live].argmax(1)  # the beam is sorted, so the first open one is the best
        node = ids[live, at]
        open_[live, at] = False
        hop = near[node]
        fresh = (hop >= 0) & ~seen[live[:, None], hop]
        rows, cols = np.nonzero(fresh)
        seen[live[rows], hop[rows, cols]] = True
        s = np.full(hop.shape, -np.inf)
        s[rows, cols] = np.einsum("ij,ij->i", queries[live[rows]], x[hop[rows, cols]])
        all_s = np.concatenate([sims[live], s], 1)
        order = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        sims[live] = np.take_along_axis(all_s, order, 1)
        ids[live] = np.where(np.isinf(sims[live]), -1, np.take_along_axis(np.concatenate([ids[live], hop], 1), order, 1))
        open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], 1), order, 1) & (ids[live] >= 0)
        live = live[open_[live].any(1)]
    return ids, sims


def robust_prune(x: np.ndarray, nodes: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node, up to ``degree`` diverse ones of its candidates, then the nearest of the others (-1: none).

    Without those others, the one in the middle of a family would be the only neighbour of all its members.
    """
    valid = (found >= 0) & (found != nodes[:, None])
    points = x[found]
    d = np.where(valid, 2 - 2 * np.einsum("bd,bcd->bc", x[nodes], points), np.inf)
    between = 2 - 2 * points @ points.transpose(0, 2, 1)
    rest = d.copy()
    out = np.full((len(nodes), degree), -1)
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = d.argmin(1)
        has = np.isfinite(d[rows, best])
        if not has.any():
            break
        out[has, k] = found[rows, best][has]
        rest[rows[has], best[has]] = np.inf
        d = np.where(has[:, None] & (alpha * between[rows, best] <= d), np.inf, d)
        d[rows, best] = np.inf
    short = np.flatnonzero((out < 0).any(1) & np.isfinite(rest).any(1))
    if len(short):
        by = np.argsort(rest[short], axis=1, kind="stable")[:, :degree]
        more = np.where(np.isfinite(np.take_along_axis(rest[short], by, 1)), np.take_along_axis(found[short], by, 1), -1)
        both = np.concatenate([out[short], more], 1)
        out[short] = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable")[:, :degree], 1)
    return out


def build_graph(x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, batch: int = 512, seed: int = 0) -> tuple[np.ndarray, int]:
    """Neighbours (n x degree, -1: none) and the start node, for unit vectors ``x``."""
    n = len(x)
    start = int((x @ x.mean(0)).argmax())
    if n <= degree + 1:  # all of them are neighbours
        near = np.tile(np.arange(n), (n, 1))
        near[np.arange(n), np.arange(n)] = -1
        return near, start
    near = np.full((n, degree), -1)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done = 1
    while done < n:
        nodes = order[done : done + min(batch, done)]
        found = _with_batch(x, nodes, *beam_search(x, near, start, x[nodes], beam))
        near[nodes] = robust_prune(x, nodes, found, degree, alpha)
        rows, cols = np.nonzero(near[nodes] >= 0)
        to, back = near[nodes][rows, cols], nodes[rows]
        new_to = ~(near[to] == back[:, None]).any(1)  # two of a batch may have chosen each other
        to, back = to[new_to], back[new_to]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        for lo in range(0, len(targets), batch):  # a node's old and new neighbours, pruned together
            t, f, c = targets[lo : lo + batch], first[lo : lo + batch], count[lo : lo + batch]
            new = np.full((len(t), int(c.max())), -1)
            slot = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            new[np.repeat(np.arange(len(t)), c), slot] = back[np.repeat(f, c) + slot]
            both = np.concatenate([near[t], new], 1)
            free = (both >= 0).sum(1) <= degree
            if free.any():
                left = np.argsort(both[free] < 0, axis=1, kind="stable")[:, :degree]
                near[t[free]] = np.take_along_axis(both[free], left, 1)
            full = np.flatnonzero(~free)
            for p in range(0, len(full), 64):
                own = full[p : p + 64]
                wide = int((both[own] >= 0).sum(1).max())
                left = np.argsort(both[own] < 0, axis=1, kind="stable")[:, :wide]
                near[t[own]] = robust_prune(x, t[own], np.take_along_axis(both[own], left, 1), degree, alpha)
        done += len(nodes)
    bridge(x, near, start, beam)
    return near, start


def _with_batch(x: np.ndarray, nodes: np.ndarray, found: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """The most similar of the nodes found and of those that join the graph with it, as many as were found."""
    among = x[nodes] @ x[nodes].T
    np.fill_diagonal(among, -np.inf)
    both = np.concatenate([sims, among], 1)
    best = np.argsort(-both, axis=1, kind="stable")[:, : found.shape[1]]
    ids = np.concatenate([found, np.broadcast_to(nodes, among.shape)], 1)
    return np.where(np.isinf(np.take_along_axis(both, best, 1)), -1, np.take_along_axis(ids, best, 1))


def bridge(x: np.ndarray, near: np.ndarray, start: int, beam: int) -> None:
    """Links nodes that no path from the start reaches from the most similar one that has a link to spare.

    To spare are free places, and links by which no node was reached first.
    """
    n, degree = near.shape
    first = np.zeros(near.shape, bool)
    reached = np.zeros(n, bool)
    reached[start], edge = True, np.array([start])
    lost = np.arange(n)
    while True:
        while len(edge):
            rows, cols = np.nonzero((near[edge] >= 0) & ~reached[near[edge]])
            edge_to, one = np.unique(near[edge[rows], cols], return_index=True)
            first[edge[rows[one]], cols[one]] = True
            reached[edge_to], edge = True, edge_to
        lost = lost[~reached[lost]]
        if not len(lost):
            return
        found = beam_search(x, near, start, x[lost[:1]], beam)[0][0]
        found = np.concatenate([found[found >= 0], np.flatnonzero(reached)])
        by = found[np.argmin(first[found].all(1))]
        at = int(np.flatnonzero(~first[by] & (near[by] < 0))[0]) if (~first[by] & (near[by] < 0)).any() else int(np.flatnonzero(~first[by])[-1])
        near[by, at], first[by, at] = lost[0], True
        reached[lost[0]], edge = True, lost[:1]


def beam_needed(x: np.ndarray, near: np.ndarray, start: int, k: int, beam: int, coverage: float = 0.98, sample: int = 256) -> int:
    """The beam, doubled until it finds ``coverage`` of the k nearest of a sample of nodes, or while that still helps."""
    some = np.linspace(0, len(x) - 1, min(sample, len(x))).astype(int)
    k = min(k + 1, len(x))  # each is its own nearest
    least = np.partition(x[some] @ x.T, len(x) - k, axis=1)[:, len(x) - k, None] - 1e-14
    before = -1.0
    while True:
        sims = beam_search(x, near, start, x[some], beam)[1]
        held = float((sims >= least).sum(1).clip(max=k).mean() / k)
        if held >= coverage or beam >= len(x) or held < before + 0.005:
            return beam
        before, beam = held, 2 * beam


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)  # doubles: in single precision all of a tight family are equally near


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of original vectors, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore", under="ignore"):
        sizes = (a * a).sum(1), (b * b).sum(1)
        out = (a * b).sum(1) / (np.sqrt(sizes[0]) * np.sqrt(sizes[1]))
    odd = ~np.isfinite(out) | (np.minimum(*sizes) < 1e-290) | (np.maximum(*sizes) > 1e290)  # squares beyond doubles: scale first
    if odd.any():
        x, y = (v[odd] / np.abs(v[odd]).max(1, keepdims=True) for v in (a, b))
        out[odd] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    return out


def _matrix(column, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten()).reshape(-1, dim)


def _builder(k: int, degree: int, beam: int, alpha: float):
    def build(key, group):
        import pyarrow as pa

        dim, cell, shard = (k.as_py() for k in key)
        ids = group.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)  # the same graph however the rows arrive
        vectors = _matrix(group.column("embedding"), dim)[order]
        x = _unit(vectors)
        near, start = build_graph(x, degree, beam, alpha)
        blob = pickle.dumps((vectors, [ids[i] for i in order], near.astype(np.int32), start, beam_needed(x, near, start, k, beam)), protocol=5)
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int32()), "shard": pa.array([shard], pa.int64()), "graph": pa.array([blob], pa.binary())})

    return build


def _searcher(k: int):
    def search(batches):
        import pyarrow as pa

        for batch in batches:
            for graph, queries in zip(batch.column(0), batch.column(1), strict=True):
                vectors, ids, near, start, beam = pickle.loads(graph.as_py())
                x, asked = _unit(vectors), queries.values
                own = np.asarray(asked.field("query_id"))
                wanted = _matrix(asked.field("embedding"), vectors.shape[1])
                out = []
                for lo in range(0, len(own), 256):
                    found, _ = beam_search(x, near, start, _unit(wanted[lo : lo + 256]), beam)
                    rows, cols = np.nonzero(found >= 0)
                    score = cosine(wanted[lo + rows], vectors[found[rows, cols]])
                    for r in range(len(found)):
                        mine = rows == r
                        named = sorted((-s, i) for s, node in zip(score[mine].tolist(), found[r, cols[mine]].tolist(), strict=True) for i in ids[node] if i != own[lo + r])
                        out += [(int(own[lo + r]), i, -s) for s, i in named[:k]]
                columns = [pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
                yield pa.record_batch(columns, names=["query_id", "vec_id", "score"])

    return search


def valid_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part."""
    v = F.col("embedding")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    return rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda c: c != 0)).withColumn("dim", F.size(v))


def fit_centroids(x: np.ndarray, cells: int, turns: int = 8, seed: int = 0) -> np.ndarray:
    """Unit centroids of spherical k-means on unit vectors; fewer if there are fewer different vectors."""
    x = np.unique(x, axis=0)
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(turns if len(centroids) < len(x) else 0):
        nearest = np.concatenate([(x[at : at + 4096] @ centroids.T).argmax(1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), centroids)
    return centroids


def _cells_of(shared, most: int):
    """Up to ``most`` cells of a vector, nearest first."""

    @F.arrow_udf("array<int>")
    def cells(vectors):
        import pyarrow as pa

        sizes, out = vectors.value_lengths().to_numpy(zero_copy_only=False), [None] * len(vectors)
        flat, ends = np.asarray(vectors.flatten()), np.cumsum(sizes)
        for dim in np.unique(sizes):
            rows, centroids = np.flatnonzero(sizes == dim), shared.value.get(int(dim))
            if centroids is None:
                centroids = np.ones((1, int(dim)))
            near = _unit(np.stack([flat[ends[r] - dim : ends[r]] for r in rows])) @ centroids.T
            for r, order in zip(rows, np.argsort(-near, axis=1, kind="stable")[:, :most], strict=True):
                out[r] = order.tolist()
        return pa.array(out, pa.list_(pa.int32()))

    return cells


def _by_dim(rows: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Unit vectors of the at most ``most`` rows with the smallest hashes, by their length."""
    found = rows.orderBy(F.xxhash64("embedding")).limit(most).select("embedding").toArrow().column("embedding").to_pylist()
    dims = {len(v) for v in found}
    return {d: _unit(np.array([v for v in found if len(v) == d])) for d in dims}


def _true_neighbours(asked: dict[int, np.ndarray], k: int):
    """The k most similar nodes of each sample query within a batch: (dim, q, score, cell)."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            column, cell = batch.column(0), np.asarray(batch.column(1))
            sizes, out = column.value_lengths().to_numpy(zero_copy_only=False), []
            flat, ends = np.asarray(column.flatten()), np.cumsum(sizes)
            for dim, queries in asked.items():
                rows = np.flatnonzero(sizes == dim)
                if not len(rows):
                    continue
                s = queries @ _unit(np.stack([flat[ends[r] - dim : ends[r]] for r in rows])).T
                best = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                out += [(dim, q, float(s[q, c]), int(cell[rows[c]])) for q in range(len(queries)) for c in best[q]]
            yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int32()))], names=["dim", "q", "score", "cell"])

    return scan


def build_index(rows: DataFrame, k: int = 5, shard_rows: int = 4096, most_cells: int = 1024, sample: int = 32_768, degree: int = 32, beam: int = 64, alpha: float = 1.2) -> tuple[DataFrame, DataFrame, dict[int, np.ndarray]]:
    """Stored tables (dim, cell, shard, graph) and (embedding, cell) over valid rows, and the centroids by dimension."""
    ranked = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    nodes = written(ranked.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("dim").alias("dim")), "nodes")
    cells = max(1, min(most_cells, 2 * nodes.count() // shard_rows))
    centroids = {d: fit_centroids(x, cells) for d, x in _by_dim(nodes, sample).items()}
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # at most most_cells vectors a dimension
    placed = written(nodes.withColumn("cell", _cells_of(shared, 1)(F.col("embedding"))[0]), "placed")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards"))  # a row a cell
    dealt = placed.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards"))).drop("shards")
    graphs = dealt.groupBy("dim", "cell", "shard").applyInArrow(_builder(k, degree, beam, alpha), "dim int, cell int, shard long, graph binary")
    return written(graphs, "index"), placed.select("embedding", "cell"), centroids


def cells_needed(queries: DataFrame, placed: DataFrame, centroids: dict[int, np.ndarray], k: int, coverage: float, sample: int = 256) -> int:
    """How many nearest cells hold ``coverage`` of the true neighbours of at most ``sample`` queries, by brute force."""
    asked = _by_dim(queries, sample)
    found = placed.mapInArrow(_true_neighbours(asked, k), "dim int, q int, score double, cell int")
    rank = F.row_number().over(Window.partitionBy("dim", "q").orderBy(F.desc("score"), "cell"))
    best = found.withColumn("r", rank).filter((F.col("r") > 1) & (F.col("r") <= k + 1)).collect()  # at most k a sample query; the first is itself
    ranks = []
    for dim, x in asked.items():
        place = np.argsort(np.argsort(-(x @ centroids[dim].T), axis=1, kind="stable"), axis=1) if dim in centroids else np.zeros((len(x), 1), int)
        ranks += [int(place[r.q, r.cell]) for r in best if r.dim == dim]
    ranks.sort()
    return ranks[min(len(ranks) - 1, int(np.ceil(coverage * len(ranks))) - 1)] + 1 if ranks else 1


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, beam: int = 64, block: int = 1024, coverage: float = 0.97, id_col: str = "vec_id", vector: str = "embedding", **index) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    modest_batches(vectors.sparkSession, 2000)
    rows = valid_vectors(vectors, id_col, vector)
    graphs, placed, centroids = build_index(rows, k, beam=beam, **index)
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "embedding", "dim")
    queries = written(queries.distinct(), "queries")
    cells = cells_needed(queries, placed, centroids, k, coverage)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    asked = written(queries.withColumn("cell", F.explode(_cells_of(shared, cells)(F.col("embedding")))), "asked")
    sizes = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))  # a row a cell
    packed = asked.join(F.broadcast(sizes), ["dim", "cell"])
    packed = packed.groupBy("dim", "cell", F.pmod(F.xxhash64("query_id", "embedding"), F.col("blocks")).alias("block"))
    packed = packed.agg(F.collect_list(F.struct("query_id", "embedding")).alias("asked"))  # about ``block`` queries each
    met = packed.join(graphs, ["dim", "cell"])
    found = met.select("graph", "asked").mapInArrow(_searcher(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"))
