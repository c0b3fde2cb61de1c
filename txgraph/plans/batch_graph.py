"""Batch heterogeneous graph build.

scan -> date window + user filters -> split codes -> [materialise] -> validity + dense ids
of all node types in one pass over stacked keys (looked up by key) -> [materialise] -> node tables
(one groupBy each) and edge lists. Only the columns of the asked node types are read. Everything stays a lazy
DataFrame; the driver only sees scalar statistics, partition offsets and at most k+1 category names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Iterable, Optional, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txgraph.definitions import BiEdge, GraphDefinition, MonoEdge
from txgraph.functions import all_true, from_epoch, to_columns
from txgraph.operators.edges import (bipartite_edges, expand_bag, merge_distinct, merge_weighted, monopartite_counts,
                                     monopartite_merged, monopartite_weighted, reverse_edges, single_valued_map)
from txgraph.operators.features import DEFAULT_MAX_ONEHOT, encode_node_features
from txgraph.operators.ids import StackedKeys, attach_ids, pin, releasing
from txgraph.operators.nodes import node_table
from txgraph.operators.splits import (DateSplit, add_split_codes, apply_filters, date_window_filter,
                                      epoch_window_filter, tag_inference)
from txgraph.operators.validity import key_rules
from txgraph.session import scratch_path

DATETIME = "DATETIME"
LOOKUP_ROWS = 200_000  # id tables of more rows are looked up through narrow rows
_ROW = "_txg_row"


def id_col(ntype: str) -> str:
    return f"{ntype}_node_id"


@dataclass
class HeteroGraph:
    definition: GraphDefinition
    nodes: dict = field(default_factory=dict)      # ntype -> DataFrame(node_id, time_attr, feats, [label...])
    edges: dict = field(default_factory=dict)      # (src, rel, dst) -> DataFrame(src, dst[, weight])
    key_tables: dict = field(default_factory=dict)  # ntype -> DataFrame(keys..., node_id)
    mono_sources: dict = field(default_factory=dict)  # mono triple -> [(primary id col, aux id col)]
    base: Optional[DataFrame] = None
    split: Optional[DateSplit] = None


def materialise(df: DataFrame, how: str = "persist") -> DataFrame:
    """Pin a reused intermediate: cache (default) or a written table in the shared scratch folder."""
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if how == "checkpoint":
        path = scratch_path(df.sparkSession, "base")
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)
    if how == "none":
        return df
    raise ValueError(how)


def base_columns(definition: GraphDefinition, types: Optional[Sequence[str]] = None, tie_cols: Sequence[str] = (),
                 cust_col: Optional[str] = None) -> list[str]:
    """Input columns that the node types (default: all) of a definition need, besides time and label."""
    needed = {c for t in (types or definition.nodes) for c in definition.nodes[t].required_columns}
    return sorted((needed | set(tie_cols) | ({cust_col} if cust_col else set())) - {"ONES"})


def prepare_base(
    df: DataFrame,
    definition: GraphDefinition,
    split: DateSplit,
    *,
    label: Column | str = "label",
    timestamp_col: str = "timestamp",
    datetime_col: Optional[str] = None,
    tie_cols: Sequence[str] = (),
    filters: Optional[Iterable] = None,
    inference_filters: Optional[Iterable] = None,
    cust_col: Optional[str] = None,
    types: Optional[Sequence[str]] = None,
) -> DataFrame:
    """Rows in the date window with split codes, label, ONES and only the columns that the node types
    (default: all) need. Without a datetime column the window is put on the raw epoch seconds."""
    if datetime_col is None:
        datetime_col = DATETIME
        df = epoch_window_filter(df, split, timestamp_col).withColumn(DATETIME, from_epoch(timestamp_col))
    else:
        df = date_window_filter(df, split, datetime_col)
    df = apply_filters(df, filters)
    label_c = to_columns([label])[0] if isinstance(label, str) else label
    df = add_split_codes(df, split, datetime_col)
    df = df.withColumns({"ONES": F.lit(1), "_label": label_c.cast("int")})
    df = tag_inference(df, inference_filters)
    keep = base_columns(definition, types, tie_cols, cust_col) + [timestamp_col, datetime_col, "_label", "split_hpo", "split_full", "ONES", "is_inference"]
    seen, cols = set(), []
    for c in keep:
        if c not in seen:
            seen.add(c)
            cols.append(c)
    return df.select(*cols).withColumnRenamed("_label", "label")


def build_graph(
    df: DataFrame,
    definition: GraphDefinition,
    split: DateSplit,
    *,
    label: Column | str = "label",
    timestamp_col: str = "timestamp",
    datetime_col: Optional[str] = None,
    tie_cols: Sequence[str] = (),
    filters: Optional[Iterable] = None,
    inference_filters: Optional[Iterable] = None,
    cust_col: Optional[str] = None,
    max_onehot: int = DEFAULT_MAX_ONEHOT,
    fit_split: int = 0,
    mono_form: str = "weighted",
    materialise_as: str = "persist",
    materialise_ids_as: str = "checkpoint",
) -> HeteroGraph:
    base = prepare_base(df, definition, split, label=label, timestamp_col=timestamp_col,
                        datetime_col=datetime_col, tie_cols=tie_cols, filters=filters,
                        inference_filters=inference_filters, cust_col=cust_col)
    g = HeteroGraph(definition=definition, split=split)
    with releasing():
        base = pin(base) if materialise_as == "persist" else materialise(base, materialise_as)
        g.key_tables, sizes = numbered_keys(base, definition, cust_col)
        # rows with all node ids: written once to the shared folder, so every node table,
        # edge list and count below starts from a flat scan instead of the id-assignment lineage
        base = materialise(attach_all_ids(base, definition, g.key_tables, sizes), materialise_ids_as)
    g.base = base
    order_cols = [timestamp_col, *tie_cols]
    for ntype in definition.primary_types:
        nd = definition.nodes[ntype]
        rows = base.filter(F.col(id_col(ntype)).isNotNull())
        enc = encode_node_features(rows, nd, id_col(ntype), split_col="split_full", order_cols=order_cols,
                                   max_onehot=max_onehot, fit_split=fit_split)
        g.nodes[ntype] = node_table(enc.df, id_col(ntype), enc.feature_cols, order_cols, timestamp_col,
                                    labelled=(ntype == definition.labelled))
    single = mono_single_valued(base, definition)
    g.edges = build_edges(base, definition, mono_form, single)
    for e in definition.edges:
        if isinstance(e, MonoEdge):
            g.mono_sources.setdefault((e.primary, e.relation, e.primary), []).append(
                (id_col(e.primary), id_col(e.auxiliary), single[(e.primary, e.auxiliary)]))
    return g


def key_tables(base: DataFrame, definition: GraphDefinition, cust_col: Optional[str] = None,
               types: Optional[Sequence[str]] = None) -> dict:
    """ntype -> (keys..., node_id)."""
    return numbered_keys(base, definition, cust_col, types)[0]


def numbered_keys(base: DataFrame, definition: GraphDefinition, cust_col: Optional[str] = None,
                  types: Optional[Sequence[str]] = None) -> tuple[dict, dict]:
    """(ntype -> (keys..., node_id), ntype -> how many). The keys of all types are counted, checked by their
    rules and numbered in one pass; the id tables are written to the shared folder."""
    types = list(types or definition.nodes)
    nodes = {t: definition.nodes[t] for t in types}
    by_customer = [t for t in types if nodes[t].validity.needs_unique_customers]
    if by_customer and cust_col is None:
        raise ValueError("unique-customer rules need the customer column")
    stacked = StackedKeys(base, {t: list(nodes[t].keys) for t in types}, [F.col(cust_col).alias("_extra0")] if by_customer else [])
    aggs = [F.count(F.lit(1)).alias("_n_tx")]
    if by_customer:
        asks = F.col("kind").isin(by_customer)
        aggs.append((F.countDistinct(F.when(asks, F.col("_extra0"))) + F.max(F.when(asks & F.col("_extra0").isNull(), 1).otherwise(0))).alias("_n_cust"))
    stats = stacked.rows.groupBy(*stacked.names).agg(*aggs)
    rules = [(F.col("kind") == t) & all_true(key_rules(stacked.columns[t], nodes[t].validity)) for t in types]
    ids, sizes = stacked.number(stats.where(reduce(lambda a, b: a | b, rules)))
    return {t: ids[t].toDF(*nodes[t].keys, "node_id") for t in types}, sizes


def attach_all_ids(base: DataFrame, definition: GraphDefinition, tables: dict, sizes: Optional[dict] = None,
                   lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """The rows with the ids of all types (J2). Types with small id tables are looked up one after the other,
    which Spark does without moving rows; if ``sizes`` tells of two or more larger ones, these are looked up
    together through narrow rows, and the wide rows move once instead of once a type."""
    large = [t for t in tables if sizes and sizes[t] > lookup_rows]
    large = large if len(large) > 1 else []
    out = _attach_narrow(base, definition, {t: tables[t] for t in large}) if large else base
    for t, kt in tables.items():
        if t not in large:
            out = attach_ids(out, kt.withColumnRenamed("node_id", id_col(t)), list(definition.nodes[t].keys), id_col(t))
    return out.select(*base.columns, *[id_col(t) for t in tables])


def _attach_narrow(base: DataFrame, definition: GraphDefinition, tables: dict) -> DataFrame:
    """Ids of the types through rows of (row number, type, key): one join with all id tables, one groupBy on
    the row number, one join with the rows. The numbered rows are written first, so a row keeps its
    number when tasks are run again. Null keys that a type's rules refuse never enter the join."""
    rows = materialise(base.withColumn(_ROW, F.monotonically_increasing_id()), "checkpoint")
    stacked = StackedKeys(rows, {t: list(definition.nodes[t].keys) for t in tables}, [F.col(_ROW).alias("_extra0")])
    refused = F.col("kind").isin([t for t in tables if definition.nodes[t].validity.all_not_null])
    ids = None
    for t, kt in tables.items():
        at = dict(zip(stacked.columns[t], definition.nodes[t].keys))
        one = kt.select(F.lit(t).alias("kind"), *[(F.col(at[n]) if n in at else F.lit(None)).cast(kind).alias(n) for (_, kind), n in stacked.slots.items()],
                        F.col("node_id").alias("_id"))
        ids = one if ids is None else ids.unionByName(one)
    found = attach_ids(stacked.rows.where(~(refused & stacked.has_null())), ids, stacked.names, "_id", null_key=stacked.has_null).where("_id IS NOT NULL")
    per_row = found.groupBy(F.col("_extra0").alias(_ROW)).agg(*[F.max(F.when(F.col("kind") == t, F.col("_id"))).alias(id_col(t)) for t in tables])
    return rows.join(per_row, _ROW, "left").drop(_ROW)


def mono_single_valued(base: DataFrame, definition: GraphDefinition) -> dict:
    """(primary, auxiliary) -> True when each primary node has one auxiliary value;
    one aggregate per primary type."""
    by_primary: dict = {}
    for e in definition.edges:
        if isinstance(e, MonoEdge):
            by_primary.setdefault(e.primary, []).append(e.auxiliary)
    out = {}
    for p, auxes in by_primary.items():
        flags = single_valued_map(base, id_col(p), [id_col(a) for a in dict.fromkeys(auxes)])
        out.update({(p, a): flags[id_col(a)] for a in auxes})
    return out


def build_edges(base: DataFrame, definition: GraphDefinition, mono_form: str = "weighted",
                single: Optional[dict] = None, sized: bool = False) -> dict:
    """Edge lists by triple. ``sized``: for callers that write pairs of primaries; these are counted first (a job a
    definition), and their tasks follow their number."""
    mono: dict = {}
    bi: dict = {}
    single = mono_single_valued(base, definition) if single is None else single
    for e in definition.edges:
        if isinstance(e, MonoEdge):
            mono.setdefault((e.primary, e.relation, e.primary), []).append(e.auxiliary)
        elif isinstance(e, BiEdge):
            fwd = bipartite_edges(base, id_col(e.src), id_col(e.dst))
            bi.setdefault((e.src, e.relation, e.dst), []).append(fwd)
            if e.reverse_relation is not None:
                bi.setdefault((e.dst, e.reverse_relation, e.src), []).append(reverse_edges(fwd))
    edges = {triple: merge_distinct(parts) for triple, parts in bi.items()}
    for triple, auxes in mono.items():
        p = triple[0]
        if len(auxes) > 1 and all(single[(p, a)] for a in auxes):
            merged = monopartite_merged(base, id_col(p), [id_col(a) for a in auxes], sized=sized)
        else:
            merged = merge_weighted([monopartite_weighted(base, id_col(p), id_col(a), one_value_per_primary=single[(p, a)], sized=sized) for a in auxes])
        edges[triple] = expand_bag(merged) if mono_form == "bag" else merged
    return edges


def graph_catalogue(graph: HeteroGraph) -> DataFrame:
    """Canonical triples with their edge counts (and weight sums), zero included (G1)."""
    spark = graph.base.sparkSession
    parts = []
    for (s, r, d) in graph.definition.canonical_edges:
        e = graph.edges.get((s, r, d))
        src = graph.mono_sources.get((s, r, d), [])
        if len(src) == 1 and e is not None and "weight" in e.columns:
            # exact counts from per-value counts: the pairs are never built just to be counted
            p_col, a_col, one = src[0]
            counted = monopartite_counts(graph.base, p_col, a_col, one)
        else:
            w = F.sum("weight") if e is not None and "weight" in e.columns else F.count(F.lit(1))
            counted = e.agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n_edges"), w.cast("decimal(38,0)").alias("n_bag"))
        parts.append(counted
                     .select(F.lit(s).alias("src_type"), F.lit(r).alias("relation"), F.lit(d).alias("dst_type"),
                             "n_edges", F.coalesce("n_bag", F.lit(0)).cast("decimal(38,0)").alias("n_bag")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def node_summary(graph: HeteroGraph) -> DataFrame:
    """Node counts per type (A2 A4)."""
    parts = [kt.agg(F.count(F.lit(1)).cast("bigint").alias("n_nodes")).select(F.lit(t).alias("node_type"), "n_nodes")
             for t, kt in graph.key_tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def data_checks(base: DataFrame, definition: GraphDefinition) -> DataFrame:
    """Data checks as a violations table (G2): rows without a node id, per type,
    and labelled keys that occur on more than one row."""
    aggs = [F.sum(F.when(F.col(id_col(t)).isNull(), 1).otherwise(0)).cast("bigint").alias(t)
            for t in definition.nodes]
    wide = base.agg(*aggs)
    stack = ", ".join([f"'{t}', `{t}`" for t in definition.nodes])
    nulls = wide.selectExpr(f"stack({len(definition.nodes)}, {stack}) as (node_type, n_bad)") \
        .select(F.lit("rows_without_node_id").alias("check"), "node_type", "n_bad")
    lab = definition.labelled
    dup = (base.filter(F.col(id_col(lab)).isNotNull()).groupBy(id_col(lab)).count().filter("count > 1")
           .agg(F.count(F.lit(1)).cast("bigint").alias("n_bad"))
           .select(F.lit("labelled_key_on_several_rows").alias("check"), F.lit(lab).alias("node_type"), "n_bad"))
    return nulls.unionByName(dup)
