"""Node tables.

One ``groupBy(node_id)`` per node type computes the sampling time, the
latest row's features (``max_by`` on (timestamp, tie-break...)) and, for the
labelled type, the label roll-up. Partial aggregation keeps hot nodes cheap.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_table(
    rows: DataFrame,
    id_col: str,
    feature_cols: Sequence[str],
    order_cols: Sequence[str],
    time_col: str = "timestamp",
    labelled: bool = False,
    label_col: str = "label",
    split_cols: Sequence[str] = ("split_hpo", "split_full"),
) -> DataFrame:
    """node_id, time_attr, features of the latest row, [label, split codes]."""
    rows = rows.filter(F.col(id_col).isNotNull())
    aggs = [(F.max(time_col) if labelled else F.min(time_col)).cast("bigint").alias("time_attr")]
    if feature_cols:
        aggs.append(F.max_by(F.struct(*[F.col(c) for c in feature_cols]),
                             F.struct(*[F.col(c) for c in order_cols])).alias("_latest"))
    if labelled:
        aggs += [F.min(c).cast("int").alias(c) for c in split_cols]
        aggs.append(F.max(F.coalesce(F.col(label_col).cast("int"), F.lit(0))).cast("int").alias("label"))
    out = rows.groupBy(F.col(id_col).alias("node_id")).agg(*aggs)
    cols = ["node_id", "time_attr"]
    if feature_cols:
        cols += [F.col(f"_latest.{c}").alias(c) for c in feature_cols]
    if labelled:
        cols += list(split_cols) + ["label"]
    return out.select(*cols)


def first_row_features(rows: DataFrame, id_col: str, feature_cols: Sequence[str], order_col: str) -> DataFrame:
    """Features of the first row per node in row order (A8); the nodes alone without features."""
    if not feature_cols:
        return rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("node_id")).distinct()
    agg = F.min_by(F.struct(*[F.col(c) for c in feature_cols]), F.col(order_col)).alias("_first")
    return (rows.filter(F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).alias("node_id")).agg(agg)
            .select("node_id", *[F.col(f"_first.{c}").alias(c) for c in feature_cols]))
