"""Evaluation metrics over a prediction table.

Predictions are a DataFrame (score, label); every metric is one aggregate, and
the precision-recall curve is a running sum over distinct scores computed with
the range-partitioned ``running_totals`` (no single-partition window).
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txgraph.operators.ids import running_totals

DEFAULT_THRESHOLD = 0.5  # fixed value of the original evaluation


def _pred(score: str, threshold: float) -> Column:
    return (F.col(score) > F.lit(threshold)).cast("int")


def precision_recall(preds: DataFrame, score: str = "score", label: str = "label",
                     threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Precision and recall at ``threshold`` applied to ``score`` (E3 E4); 0/0 -> 0.0."""
    y = F.col(label).cast("int")
    p = _pred(score, threshold)
    agg = preds.agg(F.sum(p * y).alias("tp"), F.sum(p).alias("pp"), F.sum(y).alias("ap"),
                    F.count(F.lit(1)).alias("n"))
    return agg.select(
        F.col("n").cast("bigint").alias("num_samples"),
        F.coalesce(F.col("tp") / F.when(F.col("pp") > 0, F.col("pp")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.col("tp") / F.when(F.col("ap") > 0, F.col("ap")), F.lit(0.0)).alias("recall"),
    )


def weighted_log_loss_expr(z: Column, y: Column, pos_weight: Optional[float]) -> Column:
    """Per-row logistic loss on logits with a positive-class weight (E5), overflow-safe."""
    w = F.lit(1.0 if pos_weight is None else float(pos_weight))
    y = y.cast("double")
    softplus_neg = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
    return (F.lit(1.0) - y) * z + (F.lit(1.0) + (w - F.lit(1.0)) * y) * softplus_neg


def weighted_log_loss(preds: DataFrame, score: str = "score", label: str = "label",
                      pos_weight: Optional[float] = None) -> DataFrame:
    return preds.agg(F.avg(weighted_log_loss_expr(F.col(score), F.col(label), pos_weight)).alias("loss"))


def pr_curve(preds: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Precision-recall curve (E6): one point per distinct score plus the (1, 0) end point.

    threshold t -> precision = tp/(tp+fp), recall = tp/P over rows with score >= t.
    """
    y = F.col(label).cast("bigint")
    per_score = preds.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(y).alias("pos"), F.count(F.lit(1)).alias("cnt"))
    run = running_totals(per_score, [], [F.col("threshold").desc()],
                         {"tp": F.col("pos"), "pp": F.col("cnt")}, inclusive=True)
    total_pos = preds.agg(F.sum(y)).first()[0] or 0
    pts = run.select(
        F.col("threshold").cast("double").alias("threshold"),
        (F.col("tp") / F.col("pp")).alias("precision"),
        (F.col("tp") / F.lit(float(total_pos)) if total_pos else F.lit(1.0)).alias("recall"),
    )
    end = preds.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                             F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def evaluation_summary(preds: DataFrame, mode: str, score: str = "score", label: str = "label",
                       threshold: float = DEFAULT_THRESHOLD, pos_weight: Optional[float] = None) -> DataFrame:
    """n, precision, recall, loss per mode in one aggregate."""
    y = F.col(label).cast("int")
    p = _pred(score, threshold)
    loss = weighted_log_loss_expr(F.col(score), F.col(label), pos_weight)
    agg = preds.agg(F.sum(p * y).alias("tp"), F.sum(p).alias("pp"), F.sum(y).alias("ap"),
                    F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"))
    return agg.select(
        F.lit(mode).alias("mode"),
        F.col("n").cast("bigint").alias("num_samples"),
        F.coalesce(F.col("tp") / F.when(F.col("pp") > 0, F.col("pp")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.col("tp") / F.when(F.col("ap") > 0, F.col("ap")), F.lit(0.0)).alias("recall"),
        F.col("loss"),
    )
