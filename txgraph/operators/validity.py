"""Node validity rules and node id assignment.

Every rule is a function of the node key, so validity is decided once per key
on the grouped key table (one shuffle) instead of per-row windows; the dense ids
are then numbered over valid keys only and looked up by key.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txgraph.definitions import NodeDef, Validity
from txgraph.functions import all_true
from txgraph.operators.ids import attach_ids, dense_ids


def key_stats(df: DataFrame, keys: list[str], v: Validity, cust_col: Optional[str]) -> DataFrame:
    """Distinct keys with the per-key counts the rules need.

    Distinct customers count null as one value (the original's unique count does).
    """
    aggs = [F.count(F.lit(1)).alias("_n_tx")]
    if v.needs_unique_customers:
        if cust_col is None:
            raise ValueError("unique-customer rules need the customer column")
        aggs.append((F.countDistinct(cust_col)
                     + F.max(F.when(F.col(cust_col).isNull(), 1).otherwise(0))).alias("_n_cust"))
    return df.groupBy(*keys).agg(*aggs)


def key_rules(keys: list[str], v: Validity) -> list[Column]:
    """Boolean rule columns over the key-stats table."""
    conds: list[Column] = []
    if v.all_not_null:
        conds += [F.col(k).isNotNull() for k in keys]
    if v.max_n_txs is not None:
        conds.append(F.col("_n_tx") < F.lit(v.max_n_txs))  # strict
    if v.needs_unique_customers:
        lo = v.min_n_unique_cids or 0
        hi = v.max_n_unique_cids or None  # a max of 0 also means unbounded
        conds.append(F.col("_n_cust") >= F.lit(lo))
        if hi is not None:
            conds.append(F.col("_n_cust") <= F.lit(hi))
    if v.min_length is not None:
        for n, k in zip(v.min_length, keys):
            if n is not None:
                conds.append(F.length(F.col(k)) > F.lit(n))  # strict, characters
    return conds


def valid_keys(df: DataFrame, node: NodeDef, cust_col: Optional[str] = None) -> DataFrame:
    """Distinct keys of a node type that pass all its rules (null rule -> invalid)."""
    keys = list(node.keys)
    stats = key_stats(df, keys, node.validity, cust_col)
    return stats.filter(all_true(key_rules(keys, node.validity))).select(*keys)


def node_key_table(df: DataFrame, node: NodeDef, id_col: str = "node_id",
                   cust_col: Optional[str] = None) -> DataFrame:
    """(keys..., id_col): dense 0-based ids of valid keys in key order."""
    keys = list(node.keys)
    return dense_ids(valid_keys(df, node, cust_col), keys, id_col, assume_distinct=True)


def assign_node_ids(df: DataFrame, node: NodeDef, id_col: str, cust_col: Optional[str] = None) -> DataFrame:
    """Rows keep coming through; invalid keys get a null id for this type only."""
    return attach_ids(df, node_key_table(df, node, id_col, cust_col), list(node.keys), id_col)
