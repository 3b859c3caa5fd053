"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins. Boosting goes round the features and adds, in turn, a
shallow tree over one feature's bins to that feature's lookup table; then the pairs of features
whose residuals interact most get two-dimensional tables the same way. A score is the logistic of
the intercept plus one table entry per feature and pair, so scoring is a few additions.

The fit uses a bounded sample of labelled rows (``SAMPLE_ROWS`` in expectation); scoring covers
every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import aside, by_value

by_value(__name__)

#: Expected number of labelled rows of each class that the fit may see at most.
SAMPLE_ROWS = 8000
ROUNDS, PAIR_ROUNDS, PAIRS, BINS, PAIR_BINS, RATE, LEAVES, LEAST = 120, 40, 8, 48, 8, 0.1, 4, 12

FEATURES = ("log_bytes", "log_words", "mean_word", "upper", "digit", "symbol", "bang", "bar", "stop_mark", "high", "control", "lines_per_word",
            "distinct", "top_word", "repeat_next", "repeat_lines", "mean_line", "case_words", "odd_words", "long_words")


def features(text: str | None) -> list[float]:
    """Numbers of one whole text; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m, per = len(words), 1.0 / max(n, 1)
    lower, upper = seen[97:123].sum(), seen[65:91].sum()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    share = 1.0 / max(m, 1)
    marks = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum() - seen[33] - seen[124] - seen[44] - seen[46]
    return [np.log1p(n), np.log1p(m), (n - seen[32] - seen[10]) * share, upper / max(upper + lower, 1), seen[48:58].sum() * per, marks * per, seen[33] * per, seen[124] * per,
            (seen[44] + seen[46]) * per, seen[128:].sum() * per, (seen[:32].sum() - seen[10]) * per, len(lines) * share, len(counts) / np.sqrt(max(m, 1)),
            max(counts.values(), default=0) * share, sum(map(bytes.__eq__, words, words[1:])) * share, 1 - len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)),
            sum(w.isupper() for w in counts) / max(len(counts), 1), sum(not w[-1:].isalnum() and w[-1] < 128 for w in counts) / max(len(counts), 1), sum(len(w) > 20 for w in counts) / max(len(counts), 1)]


@dataclass
class Model:
    """Cut points of each feature, a table for each feature, and tables for pairs of features."""
    base: float
    cuts: list
    tables: np.ndarray
    coarse: list
    pairs: list
    pair_tables: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, cut in enumerate(self.cuts):
            total += self.tables[f, np.searchsorted(cut, x[:, f], side="right")]
        for k, (a, b) in enumerate(self.pairs):
            total += self.pair_tables[k, np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 borders, halfway between neighbouring values at equal depth."""
    kinds = np.unique(values)
    if len(kinds) > bins:
        kinds = np.unique(np.quantile(values, np.linspace(0, 1, bins), method="nearest"))
    return (kinds[1:] + kinds[:-1]) / 2


def tree_leaves(grad: np.ndarray, hess: np.ndarray, count: np.ndarray, leaves: int, least: int) -> np.ndarray:
    """Newton step of each bin under a shallow tree: runs of bins split greedily where the loss
    falls most, each leaf holding ``least`` rows at least."""
    g, h, n = (np.concatenate(([0.0], np.cumsum(v))) for v in (grad, hess, count))
    fit = lambda G, H: G * G / (H + 1.0)
    borders = [0, len(grad)]
    while len(borders) <= leaves:
        best = (1e-9, None)
        for lo, hi in zip(borders, borders[1:]):
            mid = np.arange(lo + 1, hi)
            if not len(mid):
                continue
            gain = fit(g[mid] - g[lo], h[mid] - h[lo]) + fit(g[hi] - g[mid], h[hi] - h[mid]) - fit(g[hi] - g[lo], h[hi] - h[lo])
            gain[(n[mid] - n[lo] < least) | (n[hi] - n[mid] < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], int(mid[k]))
        if best[1] is None:
            break
        borders = sorted([*borders, best[1]])
    out = np.zeros(len(grad))
    for lo, hi in zip(borders, borders[1:]):
        out[lo:hi] = (g[hi] - g[lo]) / (h[hi] - h[lo] + 1.0)
    return out


def cross_leaves(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps of the four quarters under the best cross of one border on either axis, and
    the fall of the loss against no cut."""
    sums = [np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (grad, hess)]
    n, m = grad.shape
    i, j = np.arange(1, n)[:, None], np.arange(1, m)[None, :]
    out, best = np.zeros((n, m)), 0.0
    if n < 2 or m < 2:
        return out, best
    quarters = [(s[i, j], s[i, m] - s[i, j], s[n, j] - s[i, j], s[n, m] - s[i, m] - s[n, j] + s[i, j]) for s in sums]
    gain = sum(g * g / (h + 1.0) for g, h in zip(*quarters)) - sums[0][n, m] ** 2 / (sums[1][n, m] + 1.0)
    a, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    steps = [g[a, b] / (h[a, b] + 1.0) for g, h in zip(*quarters)]
    out[:a + 1, :b + 1], out[:a + 1, b + 1:], out[a + 1:, :b + 1], out[a + 1:, b + 1:] = steps
    return out, float(gain[a, b])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Model:
    """Cyclic boosting over the features, then over the strongest pairs. No rows, or rows of one
    class only, give that class's constant (no rows: 0.5)."""
    k = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Model(float(np.log(share / (1 - share))), [cut_points(x[:, f], BINS) if len(x) else np.empty(0) for f in range(k)], np.zeros((k, BINS + 1)),
                  [cut_points(x[:, f], PAIR_BINS) if len(x) else np.empty(0) for f in range(k)], [], np.zeros((0, PAIR_BINS + 1, PAIR_BINS + 1)))
    if not len(y) or y.min() == y.max():
        return model
    at = [np.searchsorted(model.cuts[f], x[:, f], side="right") for f in range(k)]
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for f in range(k):
            size = len(model.cuts[f]) + 1
            p = 1 / (1 + np.exp(-total))
            step = RATE * tree_leaves(np.bincount(at[f], y - p, size), np.bincount(at[f], p * (1 - p), size), np.bincount(at[f], minlength=size), LEAVES, LEAST)
            model.tables[f, :size] += step
            total += step[at[f]]
    coarse = [np.searchsorted(model.coarse[f], x[:, f], side="right") for f in range(k)]
    shape = (PAIR_BINS + 1, PAIR_BINS + 1)

    def grid(a, b, w):
        return np.bincount(coarse[a] * shape[1] + coarse[b], w, shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-total))
    gains = [(cross_leaves(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1], a, b) for a in range(k) for b in range(a + 1, k)]
    model.pairs = [(a, b) for gain, a, b in sorted(gains, key=lambda v: (-v[0], v[1:]))[:pairs] if gain > 1e-6]
    model.pair_tables = np.zeros((len(model.pairs), *shape))
    for _ in range(PAIR_ROUNDS):
        for i, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            step = RATE * cross_leaves(grid(a, b, y - p), grid(a, b, p * (1 - p)))[0]
            model.pair_tables[i] += step
            total += step[coarse[a], coarse[b]]
    return model


def featured(texts: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks 0 or 1.

    Of each class at most ``sample_rows`` rows are expected, taken by a hash of the id, so the
    sample, which is broadcast, and its features have a bound however large the tables are. A document labelled more
    than once counts with each label; null labels and ids teach nothing."""
    marked = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    sizes = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for y, n in sizes.items():
        rate = F.when(F.col("_y") == y, F.lit(min(1.0, sample_rows / n))).otherwise(rate)
    chosen = marked.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < rate * (1 << 20))

    @F.pandas_udf("array<double>")
    def numbers(texts: pd.Series) -> pd.Series:
        return pd.Series(list(featured(texts)))

    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id").select("_id", "_y", numbers("text").alias("x")).toPandas()
    rows = rows.sort_values(["_id", "_y"], kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["_y"].to_numpy(float))


def scorer(model: Model):
    """A column function: text -> score between 0 and 1."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(featured(texts)))

    return score


def classify(docs: DataFrame, labels: DataFrame, teach: Column | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the columns score (0 to 1, higher: quality 1 likelier) and predicted (0 or 1).

    Learns from the labelled rows where ``teach`` holds (all by default). Every row is scored by
    its whole text alone; null and empty texts score alike. Columns of ``docs`` called score or
    predicted come back as score_ and predicted_."""
    taught = docs if teach is None else docs.filter(teach)
    model = train(taught.select("doc_id", F.col(text).alias("text")), labels, sample_rows)
    free = aside(docs, ["score", "predicted"])
    return free.select("*", scorer(model)(text).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
