"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow regression trees are boosted in cycles over the features, one feature a tree, and then over the pairs of
features that explain most of what is left. All trees of a feature (or pair) add up to one lookup table over its bins,
so a text's logit is a sum of table entries: a few vectorised additions, whatever the number of trees.

The features look at the whole text only, never at ids, languages or sources. They are computed inside an Arrow UDF, so
the other columns never leave the JVM and nothing is shuffled. The model is fitted on the driver from a sample of at
most ``most_rows`` labelled documents (those with the smallest hashes), which bounds what is broadcast and collected.

Defined results: null text counts as empty; empty texts are scored like any other. Labels that are null, or whose
doc_id is null, are ignored; repeated labels of a document count by their mean, one half counting as 1. Without labels
of both kinds the score is the smoothed share of 1s. If a labelled doc_id has several texts, one of them is learned from,
that with the smallest hash. Repeated rows are scored one by one, extra columns stay (but the score takes the place of a
column of its name); an empty table gives an empty result.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import crc_fold, modest_batches, private, table, with_results

FEATURES = ("log_chars", "mean_word", "upper", "digits", "symbols", "exclaims", "tables", "stops", "spaces", "beyond_ascii", "distinct_words", "distinct_lines", "mean_line", "longest_word", "packed", "upper_words", "stutter", "symbol_ends")

#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 symbol, 5 ! or ?, 6 bars and brackets, 7 sentence stops, 8 white space, 9 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _bytes, _class in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b"#$%&*+/=@\\^_`~", 4), (b"!?", 5), (b"|<>[]{}()", 6), (b".,;:'\"-", 7), (b" \t\n\r\x0b\x0c", 8), (range(128, 256), 9)):
    for _b in _bytes:
        _CLASS[_b] = _class


def features_of(text: str | None) -> list[float]:
    """The values of FEATURES for one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.zeros(10)
    for at in range(0, n, 1 << 20):
        kinds += np.bincount(_CLASS[np.frombuffer(data, np.uint8, min(1 << 20, n - at), at)], minlength=10)
    words, lines = data.split(), data.split(b"\n")
    many, letters = max(len(words), 1), max(kinds[1] + kinds[2] + kinds[9], 1)
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(data[at : at + (1 << 20)])) for at in range(0, n, 1 << 20)) + len(packer.flush())
    filled = [x for x in lines if x.strip()]
    return [
        float(np.log1p(n)),
        (n - kinds[8]) / many,
        kinds[2] / letters,
        kinds[3] / n,
        kinds[4] / n,
        kinds[5] / n,
        kinds[6] / n,
        kinds[7] / n,
        kinds[8] / n,
        kinds[9] / n,
        len(set(words)) / many,
        len(set(filled)) / max(len(filled), 1),
        float(np.log1p(n / len(lines))),
        float(np.log1p(max(map(len, words), default=0))),
        packed / n,
        sum(map(bytes.isupper, words)) / many,
        sum(map(operator.eq, words, words[1:])) / many,
        sum(w[-1] in b"#$%&*!|=~" for w in words) / many,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def features(texts):
    """FEATURES of a text column."""
    import pyarrow as pa

    return pa.array([features_of(t.as_py()) for t in texts], pa.list_(pa.float64()))


@dataclass
class AdditiveModel:
    """Logit = intercept + one table entry a feature + one a pair of features."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    intercept: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            logit += values[np.searchsorted(edges, x[:, f], "right")]
        for a, b, values in self.pairs:
            logit += values[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _cut_at(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, ridge: float) -> tuple[float, int]:
    """Best gain and cut of ordered bins; cut 0 is none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = np.where((nl >= least) & (nr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge), -1)
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def _line_tree(g, h, n, least, ridge) -> np.ndarray:
    """Values of a tree of depth two over the ordered bins of one feature."""
    out, _ = np.zeros(len(g)), None
    _, cut = _cut_at(g, h, n, least, ridge)
    if not cut:
        return out
    for lo, hi in ((0, cut), (cut, len(g))):
        _, inner = _cut_at(g[lo:hi], h[lo:hi], n[lo:hi], least, ridge)
        for a, b in ((lo, lo + inner), (lo + inner, hi)) if inner else ((lo, hi),):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _plane_tree(g, h, n, least, ridge) -> tuple[float, np.ndarray]:
    """Gain and values of a tree over a grid of two features: one cut of the first, one of the second on each side."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b, c = (g.T, h.T, n.T) if turned else (g, h, n)
        for cut in range(1, a.shape[0]):
            gain, values = 0.0, np.zeros_like(a)
            for rows in (slice(0, cut), slice(cut, None)):
                gs, hs, ns = a[rows].sum(0), b[rows].sum(0), c[rows].sum(0)
                got, inner = _cut_at(gs, hs, ns, least, ridge)
                gain += got
                if inner:
                    values[rows, :inner] = gs[:inner].sum() / (hs[:inner].sum() + ridge)
                    values[rows, inner:] = gs[inner:].sum() / (hs[inner:].sum() + ridge)
            if gain > best[0]:
                best = (gain, values.T if turned else values)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 150, n_pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, ridge: float = 2.0) -> AdditiveModel:
    """Cyclic boosting, stopped when a fifth of the rows, held back, no longer gains."""
    model = AdditiveModel()
    n, wide = x.shape if x.ndim == 2 else (0, len(FEATURES))
    ones = float(y.sum())
    model.intercept = float(np.log((ones + 1) / (n - ones + 1)))
    if not 0 < ones < n:
        return model
    least = max(3, min(20, n // 50))
    quantiles = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    model.edges = [quantiles(x[:, f], bins) for f in range(wide)]
    model.coarse = [quantiles(x[:, f], coarse_bins) for f in range(wide)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.coarse)]
    test = np.arange(n) % 5 == 4
    train = (~test).astype(float)
    logit = np.full(n, model.intercept)

    def grads():
        p = 1 / (1 + np.exp(-logit))
        return (y - p) * train, p * (1 - p) * train

    def loss():
        return float(np.logaddexp(0, np.where(y[test] > 0, -logit[test], logit[test])).mean()) if test.any() else 0.0

    best, patience = loss(), 0
    for _ in range(rounds):
        for f in range(wide):
            g, h = grads()
            size = len(model.tables[f])
            step = rate * _line_tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size), np.bincount(at[f], train, size), least, ridge)
            model.tables[f] += step
            logit += step[at[f]]
        now = loss()
        patience = 0 if now < best - 1e-4 else patience + 1
        best = min(best, now)
        if patience >= 8:
            break

    def grid(a, b, g, h):
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        cell = rough[a] * shape[1] + rough[b]
        return cell, shape, [np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (g, h, train)]

    g, h = grads()
    gains = sorted(((_plane_tree(*grid(a, b, g, h)[2], least, ridge)[0], a, b) for a in range(wide) for b in range(a + 1, wide)), reverse=True)
    chosen = [(a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))) for gain, a, b in gains[:n_pairs] if gain > 0]
    kept, best = [v.copy() for *_, v in chosen], loss()
    for _ in range(pair_rounds if chosen else 0):
        for a, b, values in chosen:
            g, h = grads()
            cell, _, sums = grid(a, b, g, h)
            step = rate * _plane_tree(*sums, least, ridge)[1]
            values += step
            logit += step.reshape(-1)[cell]
        if (now := loss()) < best:
            kept, best = [v.copy() for *_, v in chosen], now
    model.pairs = [(a, b, v) for (a, b, _), v in zip(chosen, kept, strict=True)]
    return model


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, text: str = "text", id_col: str = "doc_id", label: str = "quality") -> AdditiveModel:
    """Fits the model on labelled documents whose crc32(doc_id) mod 5 is not 0, at most ``most_rows`` of them."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (crc_fold(id_col, 5) != 0))
    known = known.groupBy(id_col).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(most_rows)  # so it is small enough to broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample.withColumnRenamed(id_col, "id")), "id")
    rows = rows.select("id", "y", F.xxhash64("text").alias("h"), features(F.col("text")).alias("x"))
    one = rows.groupBy("id").agg(F.min(F.struct("h", "x", "y")).alias("r"))  # so repeated ids count once
    found = sorted((r["id"], r.r.y, r.r.x) for r in one.toLocalIterator())
    return fit(np.array([r[2] for r in found]), np.array([r[1] for r in found]))


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the model's probability that a text is labelled 1."""
    modest_batches(docs.sparkSession)

    @F.arrow_udf(T.DoubleType())
    def scored(texts):
        import pyarrow as pa

        x = np.array([features_of(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))
        return pa.array(model.score(x))

    return docs.select(with_results(docs, docs.columns, {into: scored(F.col(text))}))


THRESHOLD = 0.3


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's score, by a model that has not seen the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    (own,) = private(docs, "score")
    return score(docs, model, into=own).filter(F.col(own) >= THRESHOLD).drop(own)
