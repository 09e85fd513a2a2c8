"""URL filters: host and path rules, and a character language-model ratio where no rule fits.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give each URL a log-likelihood; their
difference, divided by the URL's length and calibrated on URLs that were held back, decides.

Learning counts the character strings of all labelled URLs: each task merges its own counts, Spark adds them up, so what
is shuffled grows with the input only through tasks and new strings. A string is part of a model if its share of the
label's characters is at least ``share``, and so is a context; that rule is the same at any size, and it bounds the model
at ORDER / share strings a label. Totals and numbers of continuations, with which contexts pass on weight to the next
shorter ones as Witten and Bell did, are those of all counted strings, part of the model or not. Calibration reads a
histogram of bounded size. Pages are never shuffled.

The query takes the verdicts of its own rules as labels, and the models carry them to the URLs that no rule fits;
``learn`` takes any labels.

Defined results: a null URL, or one without ``://``, has empty host and path and fits no rule. Empty and null URLs are
allowed; so is everything if either label is missing. Repeated rows are each judged, extra columns stay (but results
take the place of columns of their names), an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import forget, modest_batches, private, table, with_results, written

ORDER = 6
SHARE = 1 / 200_000
_HOLD = 200_000

#: The rules of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_DIGITS = re.compile("[0-9]+")


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, with A-Z in lower case."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of the longest rule that fits host and path, and its verdict; null where none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def plain(url: str | None) -> str:
    """What the models read: lower case, without scheme, with runs of digits as one 0."""
    return _DIGITS.sub("0", (url or "").lower().partition("://")[2] or (url or "").lower())


def _count(batches):
    import pyarrow as pa

    counts: dict[bool, Counter] = {False: Counter(), True: Counter()}

    def flush():
        rows = [(label, s, n) for label, counter in counts.items() for s, n in counter.items()]
        for counter in counts.values():
            counter.clear()
        return pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.bool_(), pa.string(), pa.int64()))], names=["rejected", "string", "n"])

    for batch in batches:
        for url, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = plain(url) + "$"
            counts[label].update(text[max(0, i - k) : i + 1] for i in range(len(text)) for k in range(min(i + 1, ORDER)))
            if sum(map(len, counts.values())) > _HOLD:
                yield flush()
    if any(counts.values()):
        yield flush()


class MarkovModel:
    """Witten-Bell smoothed variable-order model over counted strings (a context and the character after it).

    ``contexts`` has each context's total and number of different continuations; without it they are taken from counts.
    """

    def __init__(self, counts: dict[str, int], contexts: dict[str, tuple[int, int]] | None = None):
        if contexts is None:
            total: Counter = Counter()
            kinds: Counter = Counter()
            for s, n in counts.items():
                total[s[:-1]] += n
                kinds[s[:-1]] += 1
            contexts = {c: (n, kinds[c]) for c, n in total.items()}
        self.base = 1 / 256
        self.share = {c: kinds / (total + kinds) for c, (total, kinds) in contexts.items()}
        chance: dict[str, float] = {}
        for s in sorted(counts, key=len):
            total, kinds = contexts[s[:-1]]
            lower = self._lower(chance, s[1:]) if len(s) > 1 else self.base
            chance[s] = (counts[s] + kinds * lower) / (total + kinds)
        self.log = {s: math.log(p) for s, p in chance.items()}
        self.log_share = {c: math.log(p) for c, p in self.share.items()}

    def _lower(self, chance: dict[str, float], s: str) -> float:
        weight = 1.0
        while s:
            if s in chance:
                return weight * chance[s]
            weight *= self.share.get(s[:-1], 1.0)
            s = s[1:]
        return weight * self.base

    def log_likelihood(self, text: str) -> float:
        out, log, share = 0.0, self.log, self.log_share
        for i in range(len(text)):
            s = text[max(0, i - ORDER + 1) : i + 1]
            while s:
                if (p := log.get(s)) is not None:
                    out += p
                    break
                out += share.get(s[:-1], 0.0)
                s = s[1:]
            else:
                out += math.log(self.base)
        return out


@dataclass
class RatioModel:
    """Difference of two models a character, and the line that calibrates it to log odds of rejection."""

    accepted: MarkovModel | None = None
    rejected: MarkovModel | None = None
    slope: float = 0.0
    offset: float = 0.0

    def difference(self, url: str | None) -> float:
        if not url or self.accepted is None or self.rejected is None:
            return 0.0
        text = plain(url) + "$"
        return (self.rejected.log_likelihood(text) - self.accepted.log_likelihood(text)) / len(text)

    def score(self, url: str | None) -> float:
        """Calibrated chance of rejection; 0 for empty URLs and without a model."""
        if not url or self.accepted is None or self.rejected is None:
            return 0.0
        return 1 / (1 + math.exp(-min(30, max(-30, self.slope * self.difference(url) + self.offset))))


def _scored(shared, method: str):
    @F.arrow_udf(T.DoubleType())
    def scored(urls):
        import pyarrow as pa

        of = getattr(shared.value, method)
        return pa.array([of(u) for u in urls.to_pylist()], pa.float64())

    return scored


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic line through weighted points, both labels counting alike."""
    w = weight / np.where(y > 0, weight[y > 0].sum(), weight[y == 0].sum())
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h = w * p * (1 - p) + 1e-9
        g = np.array([(w * (y - p) * x).sum() - 1e-3 * a, (w * (y - p)).sum()])
        m = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        step = np.clip(np.linalg.solve(m, g), -5, 5)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def learn(urls: DataFrame, share: float = SHARE) -> RatioModel:
    """Fits both models on rows (url, rejected boolean); every fifth, by hash, is held back to calibrate."""
    modest_batches(urls.sparkSession)
    rows = urls.select("url", F.col("rejected").cast("boolean").alias("rejected")).filter("url is not null and url <> '' and rejected is not null")
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    counted = rows.filter(~held).mapInArrow(_count, "rejected boolean, string string, n long").groupBy("rejected", "string").agg(F.sum("n").alias("n"))
    counts = written(counted.withColumn("context", F.expr("left(string, length(string) - 1)")), "strings")
    sizes = {r.rejected: r.n for r in counts.filter("context = ''").groupBy("rejected").agg(F.sum("n").alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return RatioModel()
    models = {}
    for label in (False, True):
        part, least = counts.filter(F.col("rejected") == label), share * sizes[label]
        strings = {r.string: r.n for r in part.filter(F.col("n") >= least).select("string", "n").toLocalIterator()}
        contexts = part.groupBy("context").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).filter(F.col("n") >= least)
        models[label] = MarkovModel(strings, {r.context: (r.n, r.kinds) for r in contexts.toLocalIterator()})
    forget(counts)
    model = RatioModel(models[False], models[True])
    shared = urls.sparkSession.sparkContext.broadcast(model)
    step = F.greatest(F.least(F.round(F.col("d") * 100), F.lit(1000.0)), F.lit(-1000.0)).cast("int")
    bins = rows.filter(held).withColumn("d", _scored(shared, "difference")(F.col("url"))).groupBy("rejected", step.alias("bin")).count().collect()  # at most 4002
    if len({r.rejected for r in bins}) == 2:
        bins.sort(key=lambda r: (r.rejected, r.bin))
        model.slope, model.offset = calibrate(*(np.array(v, float) for v in ([r.bin / 100 for r in bins], [r.rejected for r in bins], [r["count"] for r in bins])))
    else:
        model.slope = 10.0
    return model


def ruled(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """(url, rejected): the URLs that a rule fits, with its verdict as their label."""
    address = F.col(url)
    own = rule_of(host_of(address), path_of(address), rules)
    return pages.select(address.alias("url"), (own["verdict"] == "block").alias("rejected")).filter("rejected is not null")


def judge(pages: DataFrame, model: RatioModel, rules=RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (calibrated chance of rejection)."""
    modest_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # at most 2 ORDER / SHARE strings and as many contexts
    names, (score, host, path, rule) = pages.columns, private(pages, "score", "host", "path", "rule")
    out = pages.withColumns({score: _scored(shared, "score")(F.col(url)), host: host_of(F.col(url)), path: path_of(F.col(url))})
    out = out.withColumn(rule, rule_of(F.col(host), F.col(path), rules))
    own = F.when(F.col(score) >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    results = {"host": F.col(host), "path": F.col(path), "rule": F.col(f"{rule}.rule"), "verdict": F.coalesce(f"{rule}.verdict", own), "score": F.col(score)}
    return out.select(with_results(out, names, results))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule, verdict and score; the models learn from the URLs that a rule fits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, learn(ruled(pages))).select("page_id", "host", "path", "rule", "verdict", "score")
