"""Prequential (test-then-train style) evaluation over row batches.

Each batch is first added to the graph, then its own rows are scored on the updated graph; the scorer is
not refitted.

* ``asof_features``: what the graph says about every evaluated row right after its batch, for all batches in
  one plan: the row's own features, the state of its entities (features of the first row of the newest batch
  that holds them, U2) and running sums over each entity's items, versioned by batch. No driver loop.
* ``prequential_score``: a caller's pandas scorer over that table, batch-wise through Arrow.
* ``prequential_scores``: one fixed linear scorer, as a plain expression.
* ``prequential_loop``: the literal per-batch loop over ``DynamicGraph.update`` with either scorer; for small
  inputs and as the reference in tests.
"""

from __future__ import annotations

from typing import Callable, Optional, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.operators.ids import running_totals
from txgraph.operators.model import score_with
from txgraph.operators.sampling import aggregate_neighbors
from txgraph.plans.dynamic_graph import DynamicGraph


def _visible(rows: DataFrame, mode: str, batch_size: int, mask_col: str, index_col: str) -> tuple[DataFrame, str]:
    """Rows of the graph with the batch from which on they are visible (-1: already in it), and the evaluated mask."""
    if mode not in ("validation", "testing"):
        raise ValueError(mode)
    target = "val" if mode == "validation" else "test"
    preloaded = ["train"] + (["val"] if mode == "testing" else [])
    lo = rows.filter(F.col(mask_col) == target).agg(F.min(index_col)).first()[0]
    lo = 0 if lo is None else int(lo)
    batch = F.floor((F.col(index_col) - F.lit(lo)) / F.lit(batch_size)).cast("bigint")
    at = (F.when(F.col(mask_col).isin(preloaded), F.lit(-1).cast("bigint")).when(F.col(mask_col) == target, batch))
    return rows.withColumn("visible_at", at).filter(F.col("visible_at").isNotNull()), target


def asof_features(
    rows: DataFrame,
    *,
    item_col: str,
    item_features: Sequence[str],
    entities: dict,
    label_col: str,
    batch_size: int,
    mode: str = "testing",
    mask_col: str = "train_val_test_mask",
    index_col: str = "row_index",
) -> DataFrame:
    """batch_id, item, label, the item's features, and for each entity E of ``entities`` (name -> (key column,
    feature columns)): E__<feature> (its state after the row's batch), E__n_items and E__mean_<item feature>
    (over the items that point to it after the batch, one per row). Every row brings a new item. Null when the
    row has no such entity; a mean without values is null."""
    v, target = _visible(rows, mode, batch_size, mask_col, index_col)
    out = v.filter(F.col(mask_col) == target).select(
        F.col("visible_at").alias("batch_id"), F.col(item_col), F.col(label_col).cast("int").alias("label"),
        *[F.col(c).cast("double").alias(c) for c in item_features], *[F.col(k).alias(f"_key_{e}") for e, (k, _) in entities.items()])
    for e, (key, feats) in entities.items():
        first = F.struct(F.lit(0).alias("_"), *[F.col(c).cast("double").alias(c) for c in feats])
        versions = v.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k"), "visible_at").agg(
            F.min_by(first, F.col(index_col)).alias("_state"), F.count(F.lit(1)).alias("_n"),
            *[F.sum(F.col(c).cast("double")).alias(f"_s_{c}") for c in item_features], *[F.count(c).alias(f"_n_{c}") for c in item_features])
        sums = {"_rn": F.col("_n")} | {f"_r{x}_{c}": F.col(f"_{x}_{c}") for c in item_features for x in ("s", "n")}
        run = running_totals(versions, ["_k"], ["visible_at"], sums, inclusive=True)
        state = run.select(
            F.col("_k"), F.col("visible_at").alias("_at"), *[F.col(f"_state.{c}").alias(f"{e}__{c}") for c in feats], F.col("_rn").alias(f"{e}__n_items"),
            *[F.when(F.col(f"_rn_{c}") > 0, F.col(f"_rs_{c}") / F.col(f"_rn_{c}")).alias(f"{e}__mean_{c}") for c in item_features])
        out = out.join(state, (out[f"_key_{e}"] == state["_k"]) & (out["batch_id"] == state["_at"]), "left").drop("_k", "_at", f"_key_{e}")
    return out


def prequential_score(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], feature_cols: Optional[Sequence[str]] = None, **spec) -> DataFrame:
    """(batch_id, item, label, score): the caller's scorer on ``asof_features(rows, **spec)``, all batches in one plan."""
    x = asof_features(rows, **spec)
    keep = ["batch_id", spec["item_col"], "label"]
    return score_with(x, scorer, list(feature_cols or [c for c in x.columns if c not in keep]), keep)


def prequential_scores(
    rows: DataFrame,
    *,
    node_col: str,
    item_col: str,
    value_col: str,
    label_col: str,
    batch_size: int,
    mode: str = "testing",
    weights: Sequence[float] = (1.0, 1.0, 0.0),
    mask_col: str = "train_val_test_mask",
    index_col: str = "row_index",
) -> DataFrame:
    """Score = w0 * own value + w1 * mean value of the node's items in the graph after the
    item's batch + w2 (a fixed linear scorer over 2-hop neighbour means)."""
    v, target = _visible(rows, mode, batch_size, mask_col, index_col)
    per = v.filter(F.col(node_col).isNotNull()).groupBy(node_col, "visible_at").agg(
        F.sum(F.col(value_col).cast("double")).alias("s"), F.count(value_col).alias("n"))
    run = running_totals(per, [node_col], ["visible_at"], {"rs": F.col("s"), "rn": F.col("n")}, inclusive=True)
    ev = v.filter(F.col(mask_col) == target).withColumn("batch_id", F.col("visible_at"))
    run = run.select(F.col(node_col).alias("_node"), F.col("visible_at").alias("_vis"), "rs", "rn")
    j = ev.join(run, (ev[node_col] == run["_node"]) & (ev["batch_id"] == run["_vis"]), "left")
    mean = F.when(F.col("rn") > 0, F.col("rs") / F.col("rn"))
    w0, w1, w2 = weights
    score = (F.lit(w0) * F.coalesce(F.col(value_col).cast("double"), F.lit(0.0))
             + F.lit(w1) * F.coalesce(mean, F.lit(0.0)) + F.lit(w2))
    return j.select("batch_id", F.col(item_col), score.alias("score"), F.col(label_col).cast("int").alias("label"))


def prequential_loop(
    table_df: DataFrame,
    definition,
    *,
    item_type: str,
    item_col: str,
    label_col: str,
    batch_size: int,
    mode: str = "testing",
    node_type: Optional[str] = None,
    value_col: Optional[str] = None,
    weights: Sequence[float] = (1.0, 1.0, 0.0),
    scorer: Optional[Callable[[pd.DataFrame], pd.Series]] = None,
    mask_col: str = "train_val_test_mask",
    index_col: str = "row_index",
) -> DataFrame:
    """Literal loop: build on train, (testing: fold validation in first), then per batch update -> read the batch's
    items and their entities off the graph -> score. With ``scorer`` the table it gets is that of ``asof_features``;
    else the linear scorer over 2-hop means of ``value_col`` through ``node_type``. No row for an empty split."""
    target = "val" if mode == "validation" else "test"
    g = DynamicGraph.build(table_df.filter(F.col(mask_col) == "train"), definition, index_col)
    if mode == "testing":
        g = _fold(g, table_df.filter(F.col(mask_col) == "val"), batch_size, index_col)
    ev = table_df.filter(F.col(mask_col) == target)
    item = dict(table_df.dtypes)[item_col]
    out = table_df.sparkSession.createDataFrame([], f"batch_id bigint, `{item_col}` {item}, score double, label int")
    for b, incr in enumerate(_batches(ev, batch_size, index_col)):
        g = g.update(incr, index_col)
        if scorer is None:
            scored = _linear_scores(g, incr, item_type, node_type, item_col, value_col, weights)
        else:
            x = _graph_features(g, incr, item_type)
            own = definition.node_features[item_col]
            scored = score_with(x, scorer, [c for c in x.columns if c in own or c not in incr.columns], [item_col, label_col])
        scored = scored.select(F.lit(b).cast("bigint").alias("batch_id"), F.col(item_col), "score", F.col(label_col).cast("int").alias("label")).cache()
        scored.count()
        out = out.unionByName(scored)
    return out


def _linear_scores(g: DynamicGraph, incr: DataFrame, item_type: str, node_type: str, item_col: str, value_col: str, weights: Sequence[float]) -> DataFrame:
    hop1 = aggregate_neighbors(g.edge_frames(), g.features, how="mean", dst_types=[node_type])
    hop2 = aggregate_neighbors(g.edge_frames(), {node_type: hop1[node_type]}, how="sum", dst_types=[item_type])
    rows = incr.join(g.keys[item_type].withColumnRenamed("node_id", "_iid"), item_col)
    h = hop2[item_type].select(F.col("node_id").alias("_iid"), F.col(value_col).alias("_h"))
    w0, w1, w2 = weights
    return rows.join(h, "_iid", "left").withColumn(
        "score", F.lit(w0) * F.coalesce(F.col(value_col).cast("double"), F.lit(0.0)) + F.lit(w1) * F.coalesce(F.col("_h"), F.lit(0.0)) + F.lit(w2))


def _graph_features(g: DynamicGraph, incr: DataFrame, item_type: str) -> DataFrame:
    """Rows of the increment with the columns of ``asof_features``, read off the graph as it stands."""
    d = g.definition
    item_feats = [c for c in g.features[item_type].columns if c != "node_id"]
    out = incr
    for (s, r, t), edges in g.edge_frames().items():
        if s != item_type:
            continue
        key = d.column_of_type[t]
        # a mean over rows with a value: nulls are no observation
        x = edges.join(g.features[item_type].withColumnRenamed("node_id", "src"), "src")
        state = x.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias(f"{t}__n_items"), *[F.avg(c).alias(f"{t}__mean_{c}") for c in item_feats])
        if t in g.features:
            own = g.features[t]
            state = state.join(own.select("node_id", *[F.col(c).cast("double").alias(f"{t}__{c}") for c in own.columns if c != "node_id"]), "node_id", "left")
        out = out.join(g.keys[t].join(state, "node_id").drop("node_id"), key, "left")
    return out


def _batches(rows: DataFrame, batch_size: int, index_col: str):
    lo, hi = rows.agg(F.min(index_col), F.max(index_col)).first()
    for start in range(lo, hi + 1, batch_size) if lo is not None else ():
        yield rows.filter(F.col(index_col).between(start, start + batch_size - 1))


def _fold(g: DynamicGraph, rows: DataFrame, batch_size: int, index_col: str) -> DynamicGraph:
    for incr in _batches(rows, batch_size, index_col):
        g = g.update(incr, index_col)
    return g
