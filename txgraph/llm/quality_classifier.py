"""Quality classifier (10): regularised quadratic discriminant over transformed statistics.

Each text gives a vector of document statistics (ratios on a log scale). Per class, the count,
sums and sums of products over all labelled training rows give mean and covariance; covariances
are standardised by the pooled deviations and shrunk towards the pooled one and the identity. A
score is the posterior of class 1 from the difference of the Mahalanobis log-densities, with the
classes' Cholesky factors computed once on the driver (d x d, d fixed).

Defined results: null or empty text gives the statistics of no words and is scored like any other;
labels null or other than 0 and 1 are left out; repeated labels count as often as they occur; with
labels of one class only, or none, every score is the share of class 1 (0.5 for none); a null id
is scored but not learned from; extra columns are ignored; no rows, no result rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.llm import textkernel as K
from txgraph.llm.common import fold, held_out, id_type, ids_and_texts, map_texts, memory_returned, written
from txgraph.llm.quality_rules import slice_stats

THRESHOLD = 0.3
TO_POOLED = 0.10
TO_IDENTITY = 0.05
_EPS = 1e-3
STATS = ("log_words", "word_chars", "symbols", "upper", "digits", "shouts", "bars", "dup_lines", "repeats", "distinct", "line_ends", "commas")
_CLASS = {
    "upper": K.byte_class([(0x41, 0x5A)]), "digits": K.byte_class([(0x30, 0x39)]), "shouts": K.byte_class([(0x21, 0x21), (0x3F, 0x3F)]),
    "bars": K.byte_class([(0x7C, 0x7C)]), "line_ends": K.byte_class([(0x0A, 0x0A)]), "commas": K.byte_class([(0x2C, 0x2C), (0x2E, 0x2E)]),
}


def document_stats(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Transformed statistics, one row per document of a slice."""
    s = slice_stats(data, offs)
    n, chars = s["n_words"].astype(float), np.maximum(s["word_chars"], 1).astype(float)
    words = np.maximum(n, 1)
    share = {k: K.counts_by(offs, np.flatnonzero(K.looked_up(t, data))) / chars for k, t in _CLASS.items()}
    starts, ends, bounds = K.words(data, offs, K.SPACE_WORD)
    doc = np.repeat(np.arange(len(n), dtype=np.uint64), np.diff(bounds))
    key = K.mix(K.hash_spans(data, starts, ends) + K.mix(doc + np.uint64(3)))
    order, new = K.dense_order(key)
    distinct = np.bincount(doc[order[new]].astype(np.int64), minlength=len(n)) if len(key) else np.zeros(len(n))
    lines = 1 + K.counts_by(offs, np.flatnonzero(data == 10))
    ratio = {**share, "symbols": s["n_symbols"] / chars, "dup_lines": s["n_dup_lines"] / lines, "repeats": s["n_repeat_words"] / words}
    cols = {"log_words": np.log1p(n), "word_chars": np.log1p(s["word_chars"] / words), "distinct": distinct / words}
    cols |= {k: np.log(v + _EPS) for k, v in ratio.items()}
    return np.column_stack([cols[c] for c in STATS])


def stats_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every document."""
    src = ids_and_texts(docs, id_col, text_col)

    def make():
        return lambda rows, data, offs: [rows.column(0), *document_stats(data, offs).T]

    return map_texts(src, f"doc_id {id_type(src)}, " + ", ".join(f"{c} double" for c in STATS), make)


@dataclass
class Discriminant:
    """Class means and Cholesky factors on standardised statistics."""

    prior: float
    scale: np.ndarray | None = None
    means: np.ndarray | None = None
    factors: np.ndarray | None = None

    def log_density(self, z: np.ndarray, c: int) -> np.ndarray:
        factor = self.factors[c]
        y = np.linalg.solve(factor, (z - self.means[c]).T)
        return -0.5 * (y * y).sum(axis=0) - np.log(np.diag(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1."""
        if self.factors is None:
            return np.full(len(x), self.prior)
        z = x / self.scale
        odds = self.log_density(z, 1) - self.log_density(z, 0) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """Learn from all labelled rows whose fold is not 0, in one aggregate per class."""
    known = labels.where(fold(id_col) != 0).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    pairs = list(combinations_with_replacement(range(len(STATS)), 2))
    rows = stats.where(fold() != 0).join(known, "doc_id").groupBy("label").agg(
        F.count("*").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in STATS), *(F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p_{i}_{j}") for i, j in pairs)).collect()
    by = {r["label"]: r for r in rows}
    total = sum(r["n"] for r in rows)
    if len(by) < 2:
        return Discriminant(prior=by[1]["n"] / total if 1 in by else (0.0 if by else 0.5))
    d, means, covs = len(STATS), [], []
    for c in (0, 1):
        r = by[c]
        mean = np.array([r[f"s_{x}"] for x in STATS]) / r["n"]
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"p_{i}_{j}"] / r["n"] - mean[i] * mean[j]
        means.append(mean)
        covs.append(cov)
    share = np.array([by[0]["n"], by[1]["n"]]) / total
    pooled = share[0] * covs[0] + share[1] * covs[1]
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    covs, pooled = [c / np.outer(scale, scale) for c in covs], pooled / np.outer(scale, scale)
    rest = 1 - to_pooled - to_identity
    factors = np.array([np.linalg.cholesky(rest * c + to_pooled * pooled + (to_identity + 1e-9) * np.eye(d)) for c in covs])
    return Discriminant(float(share[1]), scale, np.array(means) / scale, factors)


def score(stats: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of a statistics table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(k + 2).to_numpy(zero_copy_only=False) for k in range(len(STATS))])
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    src = stats.select("doc_id", held_out().alias("held_out"), *STATS)
    return src.mapInArrow(lambda batches: memory_returned(run(batches)), f"doc_id {id_type(src)}, held_out boolean, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, label_col: str = "quality") -> DataFrame:
    """Fit on the labelled documents and score every document; texts are read once."""
    stats = written(stats_table(docs), "quality-stats")
    return score(stats, fit(stats, labels, label_col), threshold)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, label_col: str = "quality", text_col: str = "text") -> DataFrame:
    """The rows scored at or above the threshold, columns unchanged; each row is judged by its own
    text, in place. Only labelled rows are read for the fit."""
    model = fit(stats_table(_labelled(docs, labels)), labels, label_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in K.slices(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(model.score(document_stats(data, offs)) >= threshold))

    return docs.mapInArrow(lambda batches: memory_returned(run(batches)), docs.schema)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").where(fold() != 0).join(labels.where(fold() != 0).select("doc_id").distinct(), "doc_id", "left_semi")
