"""Registered queries over the driver tables: one per operator group of the inventory.

Each callable takes (spark, sf_dir) and returns a DataFrame whose columns match
the DuckDB twin in ``txgraph.plans.oracle``. Doubles are rounded to 6 digits on
both sides; counts are bigint, codes int.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgraph.definitions import (TX_IDENTITY_EDGE_CENTRIC, TX_IDENTITY_NODE_CENTRIC, TX_NO_FEATURES,
                                 ColumnGraphDefinition, Feature, GraphDefinition, MonoEdge, Validity, auxiliary, primary)
from txgraph.functions import from_epoch, round6, signed_log
from txgraph.operators.edges import bipartite_edges, monopartite_counts, monopartite_weighted, reverse_edges
from txgraph.operators.features import (encode_node_features, fit_ordinal, fit_scaler, imbalance_ratio, imbalance_table,
                                        label_encoding, onehot_columns, target_encoding)
from txgraph.operators.ids import pin, releasing
from txgraph.operators.metrics import evaluation_summary, pr_curve, precision_recall, weighted_log_loss
from txgraph.operators.model import fit_logistic, logit_column, score_with
from txgraph.operators.nodes import node_table
from txgraph.operators.propagation import EdgeList, clique, pass_messages, propagate
from txgraph.operators.sampling import sample_neighbors
from txgraph.operators.splits import (SplitSettings, add_split_codes, apply_filters, batch_count, date_window_filter,
                                      positional_split, resolve_split, row_batches, split_summary, split_view, tag_inference)
from txgraph.operators.validity import node_key_table
from txgraph.plans.batch_graph import (attach_all_ids, base_columns, build_edges, build_graph, data_checks, graph_catalogue, id_col, numbered_keys,
                                      materialise, mono_single_valued, node_summary, prepare_base)
from txgraph.plans.dynamic_graph import DynamicGraph, TabularTable
from txgraph.plans.prequential import prequential_score, prequential_scores
from txgraph.session import scratch_path
from txgraph.sources.readers import read_csv, write_csv, write_graph, write_summary
from txgraph.sources.tables import event_view, table, transaction_view
from txgraph.streaming.native import compact_stream, edges, node_state, read_log, replay_pieces, run_graph_stream, with_pieces, write_replay_batches

# Query parameters (shared with the SQL twins).
TX_SPLIT = SplitSettings(date(1995, 1, 1), date(2001, 8, 1), gap_days=30, eval_days=180)
EV_SPLIT = SplitSettings(date(2024, 1, 1), date(2024, 1, 31), gap_days=2, eval_days=5)
RATIOS = (0.7, 0.15, 0.15)
EV_ORDER = ["ts", "event_id"]
TX_TIE = ["trans_num"]
EV_TIE = ["event_id"]
BATCH = 250
SCORE_CENTER, SCORE_SCALE = 50.0, 25.0


def _tx_base(spark, sf, definition: GraphDefinition, types, cust_col=None) -> DataFrame:
    """Base rows with the columns that the node types need; only the tables behind these are read."""
    needed = base_columns(definition, types, TX_TIE, cust_col)
    tx = transaction_view(spark, sf, [*needed, "ts", "timestamp", "label"])
    return prepare_base(tx, definition, resolve_split(TX_SPLIT), tie_cols=TX_TIE, datetime_col="ts", cust_col=cust_col, types=types)


def _with_ids(spark, sf, definition: GraphDefinition, types) -> DataFrame:
    with releasing():
        base = pin(_tx_base(spark, sf, definition, types))
        return materialise(attach_all_ids(base, definition, *numbered_keys(base, definition, types=types)), "checkpoint")


def _events_table(spark, sf) -> DataFrame:
    return positional_split(event_view(spark, sf), EV_ORDER, RATIOS)


def _graph_events(spark, sf) -> DataFrame:
    """``_events_table`` with the columns of ``ev_definition`` only: what is ordered and kept is every row."""
    return positional_split(event_view(spark, sf).select("event_id", "ts", "user_id", "value", "props", "label"), EV_ORDER, RATIOS)


# -- sources / projections / splits ---------------------------------------------------


def q_transaction_view(spark: SparkSession, sf: str) -> DataFrame:
    tx = transaction_view(spark, sf)
    return tx.select("trans_num", "cc_num", round6("amt").alias("amt"), "category", "timestamp", "label", "city",
                     "job", round6("city_pop").alias("city_pop"), "last", F.col("dob").cast("string").alias("dob"),
                     "merchant", F.col("first_order_date").cast("string").alias("first_order_date"),
                     "first_order_merchant")


def q_date_split_counts(spark, sf):
    split = resolve_split(TX_SPLIT)
    tx = date_window_filter(transaction_view(spark, sf, ["ts", "timestamp", "label"]), split, "ts")  # bounds on the stored column
    df = add_split_codes(tx.withColumn("DATETIME", from_epoch("timestamp")), split, "DATETIME")
    return split_summary(df, ["split_hpo", "split_full"], "label", "timestamp")


def q_filtered_dataset(spark, sf):
    tx = transaction_view(spark, sf, ["trans_num", "ts", "amt", "category", "label"])
    split = resolve_split(TX_SPLIT)
    df = apply_filters(date_window_filter(tx, split, "ts"), ["amt > 100000", F.col("category") != "5-LOW"])
    df = tag_inference(df, ["label IS NOT NULL"])
    return df.select("trans_num", F.col("is_inference").cast("int").alias("is_inference"))


def q_positional_split(spark, sf):
    return _events_table(spark, sf).select("event_id", "row_index", "train_val_test_mask")


def q_row_batches(spark, sf):
    test = split_view(_events_table(spark, sf), "test")
    b = row_batches(test, BATCH)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                     F.min("row_index").alias("first_index"), F.max("row_index").alias("last_index"))


# -- node ids and validity ----------------------------------------------------------------


def q_node_ids_customer(spark, sf):
    tx = transaction_view(spark, sf, ["cc_num"])
    nd = primary(["cc_num"], (), Validity(all_not_null=True))
    return node_key_table(tx, nd)


def q_node_ids_composite(spark, sf):
    tx = transaction_view(spark, sf, ["merchant", "category"])
    nd = primary(["merchant", "category"], (), Validity())
    return node_key_table(tx, nd)


def q_validity_max_txs(spark, sf):
    li = table(spark, sf, "lineitem")
    nd = primary(["l_suppkey"], (), Validity(all_not_null=True, max_n_txs=600))
    return node_key_table(li, nd)


def q_validity_unique_customers(spark, sf):
    tx = transaction_view(spark, sf, ["city", "cc_num"])
    nd = primary(["city"], (), Validity(all_not_null=True, min_n_unique_cids=55, max_n_unique_cids=66))
    return node_key_table(tx, nd, cust_col="cc_num")


def q_validity_unique_customers_nulls(spark, sf):
    """Unique-value rule over a nullable column: null counts as one value."""
    tx = transaction_view(spark, sf, ["job", "city", "first_order_merchant"])
    nd = primary(["job"], (), Validity(all_not_null=True, min_n_unique_cids=1, max_n_unique_cids=0))
    keys = node_key_table(tx, nd, cust_col="first_order_merchant")
    nd2 = primary(["city"], (), Validity(all_not_null=True, max_n_unique_cids=40))
    keys2 = node_key_table(tx, nd2, cust_col="first_order_merchant")
    return keys.select(F.lit("job").alias("rule"), F.col("job").alias("key"), "node_id").unionByName(
        keys2.select(F.lit("city").alias("rule"), F.col("city").alias("key"), "node_id"))


def q_validity_min_length(spark, sf):
    tx = transaction_view(spark, sf, ["city", "job"])
    nd = primary(["city", "job"], (), Validity(all_not_null=True, min_length=(6, 8)))
    return node_key_table(tx, nd)


# -- node tables and features --------------------------------------------------------------


def q_customer_nodes(spark, sf):
    d = TX_IDENTITY_EDGE_CENTRIC
    base = _with_ids(spark, sf, d, ["CUSTOMER"])
    rows = base.filter(F.col(id_col("CUSTOMER")).isNotNull())
    enc = encode_node_features(rows, d.nodes["CUSTOMER"], id_col("CUSTOMER"), order_cols=["timestamp", *TX_TIE])
    nt = node_table(enc.df, id_col("CUSTOMER"), enc.feature_cols, ["timestamp", *TX_TIE])
    return nt.select("node_id", "time_attr", round6("city_pop_log_standardize").alias("city_pop_log_standardize"))


def q_transaction_nodes(spark, sf):
    d = TX_IDENTITY_NODE_CENTRIC
    base = _with_ids(spark, sf, d, ["TRANSACTION"])
    rows = base.filter(F.col(id_col("TRANSACTION")).isNotNull())
    enc = encode_node_features(rows, d.nodes["TRANSACTION"], id_col("TRANSACTION"),
                               order_cols=["timestamp", *TX_TIE])
    nt = node_table(enc.df, id_col("TRANSACTION"), enc.feature_cols, ["timestamp", *TX_TIE], labelled=True)
    return nt.select("node_id", "time_attr", *[round6(c).alias(c) for c in enc.feature_cols],
                     "split_hpo", "split_full", "label")


def q_feat_signed_log(spark, sf):
    tx = transaction_view(spark, sf, ["trans_num", "amt", "city_pop"])
    return tx.select("trans_num", round6(signed_log("amt")).alias("amt_log"),
                     round6(signed_log("city_pop")).alias("city_pop_log"))


def q_feat_standardize(spark, sf):
    d = TX_IDENTITY_EDGE_CENTRIC
    base = _with_ids(spark, sf, d, ["CUSTOMER"])
    rows = base.filter(F.col(id_col("CUSTOMER")).isNotNull())
    enc = encode_node_features(rows, d.nodes["CUSTOMER"], id_col("CUSTOMER"), order_cols=["timestamp", *TX_TIE])
    return enc.df.select("trans_num", round6("city_pop_log_standardize").alias("city_pop_log_standardize"))


def q_feat_onehot_rare(spark, sf):
    d = TX_IDENTITY_NODE_CENTRIC
    base = _with_ids(spark, sf, d, ["TRANSACTION"])
    rows = base.filter(F.col(id_col("TRANSACTION")).isNotNull())
    cols = onehot_columns(rows, Feature("category", "categorical", "N/A", ("onehot",)), k=3)
    hot = F.coalesce(*[F.when(c == 1.0, F.lit(name)) for name, c in cols]) if cols else F.lit(None)
    return rows.select("trans_num", hot.cast("string").alias("hot_column"),
                       F.lit(len(cols)).cast("int").alias("n_dummies"))


def _part_rows(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand")


def q_feat_label(spark, sf):
    out, name = label_encoding(_part_rows(spark, sf), Feature("p_brand", "categorical", "N/A", ("label",)),
                               "p_partkey", normalise=False)
    return out.select("p_partkey", round6(name).alias(name))


def q_feat_label_norm(spark, sf):
    out, name = label_encoding(_part_rows(spark, sf), Feature("p_brand", "categorical", "N/A", ("label_norm",)),
                               "p_partkey", normalise=True)
    return out.select("p_partkey", round6(name).alias(name))


def _ev_rows(spark, sf) -> DataFrame:
    ev = event_view(spark, sf)
    split = resolve_split(EV_SPLIT)
    return add_split_codes(date_window_filter(ev, split, "ts"), split, "ts")


def q_feat_target(spark, sf):
    rows = _ev_rows(spark, sf)
    out, name = target_encoding(rows, Feature("props", "categorical", "N/A", ("target",)), "label", "split_full",
                                ["timestamp", *EV_TIE])
    return out.select("event_id", round6(name).alias(name))


def q_zscore_train_fit(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    t = TabularTable.create(orders, ["o_orderdate", "o_orderkey"], RATIOS, numeric=["o_totalprice"])
    scaler = fit_scaler(t.view("train"), ["o_totalprice"], ddof=0)
    return scaler.transform(t.df).select("o_orderkey", round6("o_totalprice").alias("z"))


def q_ordinal_encode(spark, sf):
    t = _events_table(spark, sf)
    enc = fit_ordinal(split_view(t, "train"), ["props"])
    return enc.transform(t).select("event_id", F.col("props").cast("bigint").alias("props_code"))


def q_imbalance_ratio(spark, sf):
    t = _events_table(spark, sf)
    return imbalance_table(split_view(t, "train"), "label").select(round6("imbalance_ratio").alias("imbalance_ratio"))


def q_feat_label_numeric(spark, sf):
    """Numeric categories are ranked as numbers."""
    out, name = label_encoding(table(spark, sf, "part").select("p_partkey", "p_size"),
                               Feature("p_size", "categorical", 0, ("label",)), "p_partkey", normalise=False)
    return out.select("p_partkey", round6(name).alias(name))


def q_ordinal_encode_numeric(spark, sf):
    t = _events_table(spark, sf)
    enc = fit_ordinal(split_view(t, "train"), ["user_id"])
    return enc.transform(t).select("event_id", F.col("user_id").cast("bigint").alias("user_code"))


def q_zscore_with_nan(spark, sf):
    """NaN is left out of the fit and stays NaN (shown as null)."""
    price = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    orders = table(spark, sf, "orders").select("o_orderdate", "o_orderkey", price.cast("double").alias("x"))
    t = TabularTable.create(orders, ["o_orderdate", "o_orderkey"], RATIOS, numeric=["x"])
    z = fit_scaler(t.view("train"), ["x"], ddof=0).transform(t.df)
    return z.select("o_orderkey", F.when(~F.isnan("x"), round6("x")).alias("z"))


def q_num_batches(spark, sf):
    """Batches over an index with gaps (the rows above the centre value)."""
    test = split_view(_events_table(spark, sf), "test").filter(F.col("value") > SCORE_CENTER)
    return batch_count(test, BATCH)


# -- edges and graphs ---------------------------------------------------------------------


def q_edges_mono_customer(spark, sf):
    d = TX_NO_FEATURES
    base = _with_ids(spark, sf, d, ["TRANSACTION", "CUSTOMER"])
    return monopartite_weighted(base, id_col("TRANSACTION"), id_col("CUSTOMER"))


def q_edges_mono_weighted_nation(spark, sf):
    d = TX_IDENTITY_EDGE_CENTRIC
    base = _with_ids(spark, sf, d, ["CUSTOMER", "CITY"])
    return monopartite_weighted(base, id_col("CUSTOMER"), id_col("CITY"), sized=True)


def q_edges_bipartite(spark, sf):
    d = TX_IDENTITY_NODE_CENTRIC
    base = _with_ids(spark, sf, d, ["TRANSACTION", "MERCHANT"])
    return bipartite_edges(base, id_col("TRANSACTION"), id_col("MERCHANT"))


def q_edges_reverse(spark, sf):
    d = TX_IDENTITY_NODE_CENTRIC
    base = _with_ids(spark, sf, d, ["TRANSACTION", "CUSTOMER"])
    return reverse_edges(bipartite_edges(base, id_col("TRANSACTION"), id_col("CUSTOMER")))


_EV_DEF = dict(
    node_features={"event_id": ["value"], "user_id": ["value"], "props": []},
    label_node_col="event_id", label_col="label",
    edges={("user", "sends", "event"): ("user_id", "event_id"),
           ("event", "sent_by", "user"): ("event_id", "user_id"),
           ("event", "has", "property"): ("event_id", "props")},
)


def ev_definition() -> ColumnGraphDefinition:
    return ColumnGraphDefinition(**_EV_DEF)


def q_edges_rowwise(spark, sf):
    t = _graph_events(spark, sf)
    g = DynamicGraph.build(t, ev_definition())
    return g.edges[("user", "sends", "event")]


def _full_graph(spark, sf, d: GraphDefinition):
    tx = transaction_view(spark, sf)
    return build_graph(tx, d, resolve_split(TX_SPLIT), tie_cols=TX_TIE, datetime_col="ts")


def q_graph_summary(spark, sf):
    return node_summary(_full_graph(spark, sf, TX_IDENTITY_EDGE_CENTRIC))


def q_graph_checks(spark, sf):
    g = _full_graph(spark, sf, TX_IDENTITY_EDGE_CENTRIC)
    return data_checks(g.base, g.definition)


_TWO_DEFINITIONS = GraphDefinition(
    identifier="CUSTOMERS_BY_CITY_OR_MERCHANT",
    nodes={"CUSTOMER": primary(["cc_num"], (), Validity(all_not_null=True)),
           "CITY": auxiliary(["city"], Validity(all_not_null=True)),
           "FIRST_ORDER_MERCHANT": auxiliary(["first_order_merchant"], Validity(all_not_null=True))},
    edges=[MonoEdge("CUSTOMER", "CITY", "LINKED"), MonoEdge("CUSTOMER", "FIRST_ORDER_MERCHANT", "LINKED")],
    labelled="CUSTOMER",
)


def q_edges_two_definitions(spark, sf):
    """Two shared-attribute definitions of one triple: weights add up."""
    d = _TWO_DEFINITIONS
    base = _with_ids(spark, sf, d, list(d.nodes))
    return build_edges(base, d, sized=True)[("CUSTOMER", "LINKED", "CUSTOMER")]


def q_graph_written_back(spark, sf):
    """Node tables and edge lists of a full build, written (S5), read back and counted."""
    path = scratch_path(spark, "graph")
    write_graph(_full_graph(spark, sf, TX_IDENTITY_NODE_CENTRIC), path)
    parts = []
    for kind, col in (("nodes", "ntype"), ("edges", "etype")):
        rows = spark.read.parquet(f"{path}/{kind}").groupBy(col).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
        parts.append(rows.select(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("name"), "n_rows"))
    return parts[0].unionByName(parts[1])


def _long_counts(catalogue: DataFrame) -> DataFrame:
    """Decimal counts as bigint, the type of the DuckDB twins (the library keeps decimals)."""
    return catalogue.withColumns({c: F.col(c).cast("bigint") for c in ("n_edges", "n_bag")})


def q_preset_edge_centric(spark, sf):
    return _long_counts(graph_catalogue(_full_graph(spark, sf, TX_IDENTITY_EDGE_CENTRIC)))


def q_preset_node_centric(spark, sf):
    return _long_counts(graph_catalogue(_full_graph(spark, sf, TX_IDENTITY_NODE_CENTRIC)))


def q_preset_shared_attributes(spark, sf):
    """Edge counts of the transaction-level shared-attribute graph, computed exactly
    from per-value counts (the city / segment squares are never materialised)."""
    d = TX_NO_FEATURES
    base = _with_ids(spark, sf, d, list(d.nodes))
    single = mono_single_valued(base, d)  # one aggregate for all attribute types
    parts = []
    for e in d.edges:
        c = monopartite_counts(base, id_col(e.primary), id_col(e.auxiliary), single[(e.primary, e.auxiliary)])
        parts.append(c.select(F.lit(e.primary).alias("src_type"), F.lit(e.relation).alias("relation"),
                              F.lit(e.primary).alias("dst_type"), "n_edges", "n_bag"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _long_counts(out)


def q_homogeneous_nodes(spark, sf):
    g = DynamicGraph.build(_graph_events(spark, sf), ev_definition())
    nodes, _ = g.homogeneous()
    return nodes.select("hid", "ntype", "orig_id", *[round6(c).alias(c) for c in nodes.columns if c.startswith("x_")],
                        round6("label").alias("label"))


def q_homogeneous_edges(spark, sf):
    _, edges = DynamicGraph.build(_graph_events(spark, sf), ev_definition()).homogeneous()
    return edges.select("src", "dst", "etype", "orig_eid")


def _increment(spark, sf):
    t = _graph_events(spark, sf)
    g = DynamicGraph.build(split_view(t, "train"), ev_definition())
    return g.update(split_view(t, "val"))


def q_increment_new_ids(spark, sf):
    g = _increment(spark, sf)
    parts = [g.keys[t].select(F.lit(t).alias("ntype"), F.col(c).cast("string").alias("key"), "node_id")
             for t, c in g.definition.column_of_type.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_increment_features(spark, sf):
    g = _increment(spark, sf)
    return g.features["user"].select("node_id", round6("value").alias("value"))


def q_increment_edges(spark, sf):
    g = _increment(spark, sf)
    parts = [e.select(F.lit(r).alias("etype"), "src", "dst", "row_index") for (s, r, d), e in g.edges.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _three_increments(spark, sf):
    """Train rows as the first state, the validation rows as three increments, folders merged after the second."""
    t = _graph_events(spark, sf)
    g = DynamicGraph.build(split_view(t, "train"), ev_definition())
    val = split_view(t, "val")
    lo, hi = val.agg(F.min("row_index"), F.max("row_index")).first()
    third = (hi - lo + 3) // 3
    for i in range(3):
        g = g.update(val.where(F.col("row_index").between(lo + i * third, lo + (i + 1) * third - 1)), max_parts=2)
    return g


def q_increments_new_ids(spark, sf):
    g = _three_increments(spark, sf)
    parts = [g.keys[t].select(F.lit(t).alias("ntype"), F.col(c).cast("string").alias("key"), "node_id")
             for t, c in g.definition.column_of_type.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_increments_features(spark, sf):
    g = _three_increments(spark, sf)
    return g.features["user"].join(g.keys["user"], "node_id").select(F.col("user_id"), round6("value").alias("value"))


def q_increments_edges(spark, sf):
    g = _three_increments(spark, sf)
    parts = [e.select(F.lit(r).alias("etype"), "src", "dst", "row_index") for (s, r, d), e in g.edges.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_STREAM_NODES = {"event": "event_id", "user": "user_id", "property": "props"}
_STREAM_EDGES = {("user", "sends", "event"): ("user_id", "event_id"),
                 ("event", "has", "property"): ("event_id", "props")}
_STREAM_FEATS = {"event": ["value"], "user": ["value"]}


def _stream_out(spark, sf):
    """Events replayed in time order, one micro-batch a week (of one file for each ``PIECE_ROWS`` rows of the largest
    week); the state is compacted half way, and the stream goes on behind the snapshot."""
    ev = table(spark, sf, "events").withColumn("week", F.floor(F.unix_date(F.to_date("ts")) / 7).cast("int"))
    lo, hi = ev.agg(F.min("week"), F.max("week")).first()
    pieces = replay_pieces(ev, "week")
    if pieces > 1:
        ev = with_pieces(ev, pieces)
    source, out = scratch_path(spark, "replay"), None
    for part in (ev.where(F.col("week") <= (lo + hi) // 2), ev.where(F.col("week") > (lo + hi) // 2)):
        if out is not None:
            compact_stream(spark, out)
        write_replay_batches(part, "week", source)
        out = run_graph_stream(spark, source, ev.schema, _STREAM_NODES, _STREAM_EDGES, _STREAM_FEATS, ["ts", "event_id"], out,
                               max_files_per_trigger=pieces, tasks=pieces)
    return out


def q_stream_graph_features(spark, sf):
    st = node_state(spark, _stream_out(spark, sf))
    return st.select("ntype", "key", round6("value").alias("value"), F.col("n_obs").cast("bigint").alias("n_obs"))


def q_stream_edges(spark, sf):
    e = edges(read_log(spark, _stream_out(spark, sf)))
    return e.groupBy("etype").agg(F.count(F.lit(1)).cast("bigint").alias("n_edges"),
                                  F.countDistinct("src", "dst").cast("bigint").alias("n_distinct"))


# -- sampling, aggregation, metrics, model ---------------------------------------------------


def _sampling_inputs(spark, sf):
    d = TX_IDENTITY_EDGE_CENTRIC
    tid, cid, city = id_col("TRANSACTION"), id_col("CUSTOMER"), id_col("CITY")
    base = _with_ids(spark, sf, d, ["TRANSACTION", "CUSTOMER", "CITY"])
    made_by = bipartite_edges(base, tid, cid)
    relations = {("CUSTOMER", "MADE", "TRANSACTION"): reverse_edges(made_by),
                 ("TRANSACTION", "MADE_BY", "CUSTOMER"): made_by,
                 ("CUSTOMER", "HAS_SAME_CITY", "CUSTOMER"): clique(base, "CUSTOMER", "HAS_SAME_CITY", cid, city)}
    times = {"TRANSACTION": base.filter(F.col(tid).isNotNull()).groupBy(F.col(tid).alias("node_id")).agg(F.max("timestamp").alias("time_attr")),
             "CUSTOMER": base.filter(F.col(cid).isNotNull()).groupBy(F.col(cid).alias("node_id")).agg(F.min("timestamp").alias("time_attr"))}
    seeds = base.filter((F.col("split_full") == 2) & F.col(tid).isNotNull()).select(F.col(tid).alias("node_id")).distinct()
    in_city = {("TRANSACTION", "IN_SAME_CITY", "TRANSACTION"): clique(base, "TRANSACTION", "IN_SAME_CITY", tid, city)}
    return relations, in_city, seeds, times


FANOUTS = [10, 15]


def q_neighbor_sample_2hop(spark, sf):
    """Hop 1 draws 15 (the last fan-out) per relation, hop 2 10; transactions of one city bind in both."""
    relations, in_city, seeds, _ = _sampling_inputs(spark, sf)
    s = sample_neighbors(relations | in_city, {"TRANSACTION": seeds}, FANOUTS, seed=0)
    return s.select("hop", "relation", "src", "dst").distinct()


def q_neighbor_sample_temporal_last(spark, sf):
    relations, _, seeds, ta = _sampling_inputs(spark, sf)
    s = sample_neighbors(relations, {"TRANSACTION": seeds}, FANOUTS, seed=0, time_attr=ta, strategy="last")
    return s.select("hop", "relation", "src", "dst", "seed_time").distinct()


def q_neighbor_sample_temporal_uniform(spark, sf):
    relations, _, seeds, ta = _sampling_inputs(spark, sf)
    s = sample_neighbors(relations, {"TRANSACTION": seeds}, FANOUTS, seed=0, time_attr=ta, strategy="uniform")
    return s.select("hop", "relation", "src", "dst", "seed_time").distinct()


def _linear_graph(spark, sf):
    """Relations and features of transactions and customers; customers of one city as a clique."""
    d = TX_IDENTITY_EDGE_CENTRIC
    tid, cid = id_col("TRANSACTION"), id_col("CUSTOMER")
    base = _with_ids(spark, sf, d, ["TRANSACTION", "CUSTOMER", "CITY"])
    made_by = bipartite_edges(base, tid, cid)
    tx_x = (base.filter(F.col(tid).isNotNull()).groupBy(F.col(tid).alias("node_id")).agg(F.max(signed_log("amt")).alias("amt_log")))
    cu_x = (base.filter(F.col(cid).isNotNull()).groupBy(F.col(cid).alias("node_id"))
            .agg(F.max_by(signed_log("city_pop"), F.struct("timestamp", *TX_TIE)).alias("city_pop_log")))
    same_city = clique(base, "CUSTOMER", "HAS_SAME_CITY", cid, id_col("CITY"))
    return EdgeList("TRANSACTION", "MADE_BY", "CUSTOMER", made_by), same_city, EdgeList("CUSTOMER", "MADE", "TRANSACTION", reverse_edges(made_by)), {"TRANSACTION": tx_x, "CUSTOMER": cu_x}


def q_neighbor_aggregate(spark, sf):
    made_by, same_city, _, x = _linear_graph(spark, sf)
    out = pass_messages([made_by, same_city], x, how="sum")["CUSTOMER"]
    return out.select("node_id", round6("amt_log").alias("amt_log"), round6("city_pop_log").alias("city_pop_log"))


def q_propagated_features(spark, sf):
    """Two hops of mean messages over transactions, customers and the city clique: the k-hop feature table."""
    made_by, same_city, _, x = _linear_graph(spark, sf)
    edges = materialise(made_by.edges, "checkpoint")  # both hops read it in both directions
    made_by, made = replace(made_by, edges=edges), EdgeList("CUSTOMER", "MADE", "TRANSACTION", reverse_edges(edges))
    out = propagate(x, [made_by, same_city, made], hops=2)
    cols = ["amt_log_h1", "city_pop_log_h1", "amt_log_h2", "city_pop_log_h2"]
    parts = []
    for t, own in (("CUSTOMER", "city_pop_log"), ("TRANSACTION", "amt_log")):
        have = out[t].columns
        parts.append(out[t].select(F.lit(t).alias("ntype"), "node_id", round6(own).alias("own"),
                                   *[round6(F.col(c) if c in have else F.lit(0.0)).alias(c) for c in cols]))
    return parts[0].unionByName(parts[1])


def _predictions(spark, sf) -> DataFrame:
    t = _events_table(spark, sf)
    return split_view(t, "test").select(
        "event_id", ((F.col("value") - F.lit(SCORE_CENTER)) / F.lit(SCORE_SCALE)).alias("score"), "label")


def _pos_weight(spark, sf):
    return imbalance_ratio(split_view(_events_table(spark, sf), "train"), "label")


def q_precision_recall(spark, sf):
    p = precision_recall(_predictions(spark, sf))
    return p.select("num_samples", round6("precision").alias("precision"), round6("recall").alias("recall"))


def q_weighted_log_loss(spark, sf):
    w = _pos_weight(spark, sf)
    return weighted_log_loss(_predictions(spark, sf), pos_weight=w).select(round6("loss").alias("loss"))


def q_pr_curve(spark, sf):
    c = pr_curve(_predictions(spark, sf))
    return c.select(round6("threshold").alias("threshold"), round6("precision").alias("precision"),
                    round6("recall").alias("recall"))


def q_evaluation_summary(spark, sf):
    w = _pos_weight(spark, sf)
    s = evaluation_summary(_predictions(spark, sf), "testing", pos_weight=w)
    return s.select("mode", "num_samples", round6("precision").alias("precision"), round6("recall").alias("recall"),
                    round6("loss").alias("loss"))


def q_summary_written_back(spark, sf):
    """The evaluation summary through its sink (S6) and back."""
    summary = q_evaluation_summary(spark, sf)
    path = scratch_path(spark, "summary")
    write_summary(summary, path)
    return spark.read.schema(summary.schema).json(path)


def q_score_linear(spark, sf):
    """A caller's pandas scorer, applied batch-wise (M2)."""
    test = split_view(_events_table(spark, sf), "test")
    return score_with(test, lambda x: (x["value"] - SCORE_CENTER) / SCORE_SCALE, ["value"], ["event_id"]) \
        .select("event_id", round6("score").alias("score"))


def q_prequential_scores(spark, sf):
    t = _events_table(spark, sf)
    s = prequential_scores(t, node_col="user_id", item_col="event_id", value_col="value", label_col="label",
                           batch_size=BATCH, mode="testing")
    # means over 2-decimal values can end exactly on a 7th-digit 5: compare at 9 digits
    return s.select("batch_id", "event_id", F.round("score", 9).alias("score"), "label")


def _custom_scorer(x):
    """A caller's model over the as-of table: own value, state and history of the user, history of the property."""
    z = (0.8 * (x["value"] - SCORE_CENTER) + 0.5 * (x["user__value"].fillna(SCORE_CENTER) - SCORE_CENTER)
         + 0.3 * (x["user__mean_value"].fillna(SCORE_CENTER) - SCORE_CENTER) - 0.2 * (x["property__mean_value"].fillna(SCORE_CENTER) - SCORE_CENTER)) / SCORE_SCALE
    return z + 0.1 * np.log1p(x["user__n_items"].fillna(0.0)) - 0.05 * np.log1p(x["property__n_items"].fillna(0.0))


def q_prequential_custom_scorer(spark, sf):
    """Every test batch scored by a caller's pandas model on the graph as of its batch, in one plan."""
    s = prequential_score(_events_table(spark, sf), _custom_scorer, item_col="event_id", item_features=["value"],
                          entities={"user": ("user_id", ["value"]), "property": ("props", [])}, label_col="label", batch_size=BATCH)
    return s.select("batch_id", "event_id", round6("score").alias("score"), "label")


TRAIN_FEATURES = ["value", "user_mean"]


def q_train_score_nodes(spark, sf):
    """M1 M2: mean of the user's training events as a feature, weighted logistic regression fitted until its gradient
    vanishes, logits of the test rows."""
    t = _events_table(spark, sf)
    user_mean = (split_view(t, "train").groupBy("user_id").agg(F.avg("value").alias("user_mean")))
    x = t.join(user_mean, "user_id", "left").withColumn("user_mean", F.coalesce("user_mean", F.lit(0.0)))
    w = imbalance_ratio(split_view(t, "train"), "label")
    fit = fit_logistic(split_view(x, "train"), TRAIN_FEATURES, "label", pos_weight=w)
    if not fit.converged:
        raise RuntimeError(f"no optimum after {fit.iterations} steps: {fit}")
    return split_view(x, "test").select("event_id", round6(logit_column(fit.features, fit.coefficients, fit.intercept)).alias("score"), "label")


def q_csv_round_trip(spark, sf):
    path = scratch_path(spark, "region-csv")
    write_csv(table(spark, sf, "region"), path)
    return read_csv(spark, path).select("r_regionkey", "r_name")


QUERIES = {
    "transaction_view": q_transaction_view,
    "date_split_counts": q_date_split_counts,
    "filtered_dataset": q_filtered_dataset,
    "positional_split": q_positional_split,
    "row_batches": q_row_batches,
    "node_ids_customer": q_node_ids_customer,
    "node_ids_composite": q_node_ids_composite,
    "validity_max_txs": q_validity_max_txs,
    "validity_unique_customers": q_validity_unique_customers,
    "validity_unique_customers_nulls": q_validity_unique_customers_nulls,
    "validity_min_length": q_validity_min_length,
    "customer_nodes": q_customer_nodes,
    "transaction_nodes": q_transaction_nodes,
    "feat_signed_log": q_feat_signed_log,
    "feat_standardize": q_feat_standardize,
    "feat_onehot_rare": q_feat_onehot_rare,
    "feat_label": q_feat_label,
    "feat_label_norm": q_feat_label_norm,
    "feat_target": q_feat_target,
    "zscore_train_fit": q_zscore_train_fit,
    "ordinal_encode": q_ordinal_encode,
    "imbalance_ratio": q_imbalance_ratio,
    "feat_label_numeric": q_feat_label_numeric,
    "ordinal_encode_numeric": q_ordinal_encode_numeric,
    "zscore_with_nan": q_zscore_with_nan,
    "num_batches": q_num_batches,
    "edges_mono_customer": q_edges_mono_customer,
    "edges_mono_weighted_nation": q_edges_mono_weighted_nation,
    "edges_bipartite": q_edges_bipartite,
    "edges_reverse": q_edges_reverse,
    "edges_rowwise": q_edges_rowwise,
    "graph_summary": q_graph_summary,
    "graph_checks": q_graph_checks,
    "preset_shared_attributes": q_preset_shared_attributes,
    "preset_node_centric": q_preset_node_centric,
    "preset_edge_centric": q_preset_edge_centric,
    "homogeneous_nodes": q_homogeneous_nodes,
    "homogeneous_edges": q_homogeneous_edges,
    "edges_two_definitions": q_edges_two_definitions,
    "graph_written_back": q_graph_written_back,
    "increment_new_ids": q_increment_new_ids,
    "increment_features": q_increment_features,
    "increment_edges": q_increment_edges,
    "increments_new_ids": q_increments_new_ids,
    "increments_features": q_increments_features,
    "increments_edges": q_increments_edges,
    "stream_graph_features": q_stream_graph_features,
    "stream_edges": q_stream_edges,
    "neighbor_sample_2hop": q_neighbor_sample_2hop,
    "neighbor_sample_temporal_last": q_neighbor_sample_temporal_last,
    "neighbor_sample_temporal_uniform": q_neighbor_sample_temporal_uniform,
    "neighbor_aggregate": q_neighbor_aggregate,
    "propagated_features": q_propagated_features,
    "precision_recall": q_precision_recall,
    "weighted_log_loss": q_weighted_log_loss,
    "pr_curve": q_pr_curve,
    "evaluation_summary": q_evaluation_summary,
    "summary_written_back": q_summary_written_back,
    "score_linear": q_score_linear,
    "prequential_scores": q_prequential_scores,
    "prequential_custom_scorer": q_prequential_custom_scorer,
    "train_score_nodes": q_train_score_nodes,
    "csv_round_trip": q_csv_round_trip,
}
