"""Node classification re-aimed as Spark jobs (M1 M2 M3).

M1: weighted logistic regression on feature columns, k-hop ones from ``propagation.propagate`` included.
``fit_logistic`` takes Newton steps, one aggregate each, and reports whether the gradient vanished;
``logit_column`` scores from given coefficients as a plain expression. ``train_logistic`` is the MLlib form.
M2: score a feature table with a caller-supplied pandas function through ``mapInPandas`` (Arrow batches).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable, Optional, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_weight_column(df: DataFrame, label_col: str, pos_weight: Optional[float], col: str = "weight") -> DataFrame:
    """Weight pos_weight for positives, 1 for negatives (M3)."""
    w = 1.0 if pos_weight is None else float(pos_weight)
    return df.withColumn(col, F.when(F.col(label_col) == 1, F.lit(w)).otherwise(F.lit(1.0)))


def train_logistic(train: DataFrame, feature_cols: Sequence[str], label_col: str = "label",
                   pos_weight: Optional[float] = None, max_iter: int = 50, reg: float = 0.0):
    """Weighted logistic regression on node features (M1)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(feature_cols), outputCol="_features", handleInvalid="keep") \
        .transform(class_weight_column(train, label_col, pos_weight, "_weight")) \
        .withColumn("_label", F.col(label_col).cast("double"))
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight",
                            maxIter=max_iter, regParam=reg)
    return lr.fit(data)


def logistic_scores(model, df: DataFrame, feature_cols: Sequence[str], out_col: str = "score") -> DataFrame:
    """Raw logit of the positive class (the metrics threshold applies to this column): intercept + sum of coefficient *
    feature over numeric columns, NaN where one is missing. A plain expression, so no task gets the model itself."""
    at = model.coefficientMatrix.numRows - 1 and 1  # one row for two classes, else a row a class
    weights = model.coefficientMatrix.toArray()[at].tolist()
    x = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    z = reduce(lambda s, wc: s + F.lit(float(wc[0])) * x(wc[1]), zip(weights, feature_cols, strict=True), F.lit(float(model.interceptVector[at])))
    return df.withColumn(out_col, z)


def score_with(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], feature_cols: Sequence[str],
               keep_cols: Sequence[str], out_col: str = "score") -> DataFrame:
    """Apply a caller's pandas scoring function batch-wise (M2)."""
    keep = list(keep_cols)
    feats = list(feature_cols)
    schema = ", ".join([f"`{c}` {t}" for c, t in df.select(*keep).dtypes] + [f"`{out_col}` double"])

    def run(batches):
        for pdf in batches:
            out = pdf[keep].copy()
            out[out_col] = pd.Series(scorer(pdf[feats]), index=pdf.index).astype("float64")
            yield out

    return df.select(*dict.fromkeys(keep + feats)).mapInPandas(run, schema)


@dataclass(frozen=True)
class LogisticFit:
    """Coefficients with the fit's report: ``gradient`` is the largest absolute partial derivative of the mean
    loss over standardised features, ``converged`` whether it fell below the tolerance."""

    features: tuple
    coefficients: tuple
    intercept: float
    iterations: int
    loss: float
    gradient: float
    converged: bool


def _filled(c: str) -> Column:
    d = F.col(c).cast("double")
    return F.coalesce(F.nanvl(d, F.lit(0.0)), F.lit(0.0))


def logit_column(features: Sequence[str], coefficients: Sequence[float], intercept: float) -> Column:
    """intercept + sum of coefficient * feature; missing features count as 0."""
    return reduce(lambda z, cf: z + F.lit(float(cf[0])) * _filled(cf[1]), zip(coefficients, features), F.lit(float(intercept)))


def _sums(data: DataFrame, names: Sequence[str], z: Column) -> np.ndarray:
    """Weighted loss, gradient and upper Hessian of the logistic loss at logits ``z``: one aggregate."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z")))
    xs = [F.lit(1.0), *[F.col(c) for c in names]]
    loss = F.log1p(F.exp(-F.abs("_z"))) + F.greatest(F.col("_z"), F.lit(0.0)) - F.col("_y") * F.col("_z")
    aggs = [F.sum(F.col("_w")), F.sum(F.col("_w") * loss)]
    aggs += [F.sum(F.col("_w") * (F.col("_y") - F.col("_p")) * x) for x in xs]
    aggs += [F.sum(F.col("_w") * F.col("_p") * (F.lit(1.0) - F.col("_p")) * xs[i] * xs[j]) for i in range(len(xs)) for j in range(i, len(xs))]
    return np.array(data.withColumn("_z", z).withColumn("_p", p).agg(*aggs).first(), dtype=float)


def fit_logistic(train: DataFrame, feature_cols: Sequence[str], label_col: str = "label", pos_weight: Optional[float] = None,
                 max_iter: int = 50, tol: float = 1e-10, ridge: float = 0.0) -> LogisticFit:
    """Weighted logistic regression by Newton's method (M1), halving a step that does not lower the loss.

    Features are standardised inside (a constant one gets no coefficient); missing ones count as 0, rows without
    a label are left out. ``ridge`` is the L2 penalty on standardised coefficients, needed where classes separate:
    without it such a fit ends with ``converged`` False. The driver holds sums of the size features^2 only.
    """
    names = [f"_x{i}" for i in range(len(feature_cols))]
    y = F.col(label_col).cast("double")
    data = class_weight_column(train.where(y.isNotNull()), label_col, pos_weight, "_w").select(
        y.alias("_y"), "_w", *[_filled(c).alias(n) for c, n in zip(feature_cols, names)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        row = data.agg(F.count(F.lit(1)), *[F.avg(n) for n in names], *[F.stddev_pop(n) for n in names]).first()
        k = len(names)
        if not row[0]:
            raise ValueError("no labelled training row")
        mean, std = np.array(row[1 : k + 1], float), np.array(row[k + 1 :], float)
        used = [i for i in range(k) if std[i] > 0]
        scaled = data.select("_y", "_w", *[((F.col(names[i]) - F.lit(float(mean[i]))) / F.lit(float(std[i]))).alias(names[i]) for i in used])
        used_names = [names[i] for i in used]
        d = len(used) + 1
        penalty = np.array([0.0] + [ridge] * (d - 1))
        upper = np.triu_indices(d)

        def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            z = reduce(lambda s, bn: s + F.lit(float(bn[0])) * F.col(bn[1]), zip(b[1:], used_names), F.lit(float(b[0])))
            got = _sums(scaled, used_names, z)
            h = np.zeros((d, d))
            h[upper] = got[2 + d :] / got[0]
            h = h + np.triu(h, 1).T + np.diag(penalty)
            return got[1] / got[0] + 0.5 * float(penalty @ (b * b)), got[2 : 2 + d] / got[0] - penalty * b, h

        b = np.zeros(d)
        loss, grad, hess = at(b)
        n = 0
        while n < max_iter and np.abs(grad).max() > tol:
            step = np.linalg.lstsq(hess, grad, rcond=None)[0]
            for _ in range(30):
                n += 1
                new = at(b + step)
                if new[0] <= loss + 1e-12 * abs(loss):
                    break
                step = step / 2
            else:
                break
            b, (loss, grad, hess) = b + step, new
        coef = np.zeros(k)
        coef[used] = b[1:] / std[used]
        largest = float(np.abs(grad).max())
        return LogisticFit(tuple(feature_cols), tuple(coef.tolist()), float(b[0] - coef @ mean), n, float(loss), largest, largest <= max(tol, 1e-8))
    finally:
        data.unpersist()
