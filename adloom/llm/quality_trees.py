"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are Spark expressions; only a dozen numbers a document reach Python. Trees are complete, with features,
thresholds and leaves flattened into arrays, so that a batch of documents goes down all trees by index arithmetic.
Training takes at most `max_rows` labelled documents (those with the smallest hashes); their statistics come to the driver.

Cases: null text is the empty text; a null doc_id is not held out; repeated rows each get a row; unusable labels are
ignored; with labels of one class or none the score is their (smoothed) share of good ones; an empty table gives an empty
result; other columns are carried by `score` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import free_name, table
from adloom.llm.quality_rules import labelled_sample
from adloom.llm.textstats import FEATURES, features, statistics

MAX_ROWS, THRESHOLD = 20_000, 0.3


@dataclass
class Trees:
    """feature, threshold: (trees, 2**depth - 1); leaf: (trees, 2**depth); start: log odds before the first tree."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of label 1, for rows of statistics."""
        inner = self.feature.shape[1]
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):  # a complete tree of 2**depth - 1 inner nodes
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees for log loss; splits are sought over per-node histograms of gradients and curvatures."""
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    inner = 2**depth - 1
    none = Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y) or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    cuts = [np.unique(np.concatenate([c, (c[1:] + c[:-1]) / 2])) for c in cuts]
    n_bins, n_features = max(map(len, cuts)) + 1, x.shape[1]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    out, total = [], np.full(len(y), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = (node - first)[:, None] * (n_features * n_bins) + np.arange(n_features) * n_bins + binned
            grad, curve = (np.bincount(slot.ravel(), np.repeat(w, n_features), width * n_features * n_bins).reshape(width, n_features, n_bins) for w in (g, h))
            left_g, left_h = grad.cumsum(axis=2), curve.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g)**2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < least) | (all_h - left_h < least)] = 0
            for f, c in enumerate(cuts):
                gain[:, f, len(c):] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), n_bins)
                if gain[k, f, b] > 1e-9:
                    feature[first + k], threshold[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        total = total + leaf[at]
        out.append((feature, threshold, leaf))
    f, t, leaf = zip(*out, strict=True)
    return Trees(start, np.array(f), np.array(t), np.array(leaf))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, use: Column | None = None, **shape) -> Trees:
    """Trees learned from labels.quality; `use` is a condition on labels."""
    rows = labelled_sample(docs, labels, max_rows, use).toPandas().sort_values("_key")
    return fit(rows[list(FEATURES)].to_numpy(float), 1.0 - rows["_bad"].to_numpy(float), **shape)


def score(docs: DataFrame, trees: Trees, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """docs with one more column `out`: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    s = free_name(docs, "_stats")

    @F.pandas_udf("double")
    def probability(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series(shared.value.probability(np.column_stack(columns)))

    keep = [F.col(f"`{c}`") for c in docs.columns]
    stats = docs.select(*keep, statistics(F.col(f"`{text_col}`")).alias(s))
    # marked as not deterministic, it is worked out once, below any filter on the score
    return stats.select(*keep, probability.asNondeterministic()(*features(F.col(s))).alias(free_name(docs, out)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, learn_from: DataFrame | None = None, **training) -> DataFrame:
    """The documents that score the threshold or more; columns as in docs.

    The trees are learned from `learn_from` (docs itself if none is given): after a stage that rejects bad documents too few
    of those are left to learn what they look like.
    """
    out = free_name(docs, "quality_score")
    trees = train(docs if learn_from is None else learn_from, labels, **training)
    return score(docs, trees).where(F.col(out) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir) -> DataFrame:
    """op6: score and prediction of every document; a fifth is held out from learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    scored = score(docs.select("doc_id", "text"), train(docs, labels, use=fold != 0))
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
