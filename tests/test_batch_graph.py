from datetime import date

from pyspark.sql import functions as F

from txgraph.definitions import (BiEdge, DefinitionError, Feature, GraphDefinition, MonoEdge, Validity, auxiliary,
                                 primary, TX_IDENTITY_EDGE_CENTRIC)
from txgraph.operators.edges import expand_bag, merge_distinct
from txgraph.operators.splits import SplitSettings, resolve_split
from txgraph.plans.batch_graph import attach_all_ids, build_graph, graph_catalogue, numbered_keys
from txgraph.session import scratch_path
from txgraph.sources.readers import write_graph
from txgraph.sources.tables import transaction_view

import pytest

SF = "/root/testdata/sf0.001"
SPLIT = SplitSettings(date(1995, 1, 1), date(2001, 8, 1), 30, 180)


def test_definition_checks():
    with pytest.raises(DefinitionError):
        GraphDefinition("x", {"T": primary(["a"])}, [MonoEdge("T", "C", "r")], "T")
    with pytest.raises(DefinitionError):
        GraphDefinition("x", {"T": primary(["a"]), "C": auxiliary(["c"])}, [BiEdge("T", "r", "C")], "T")
    with pytest.raises(DefinitionError):
        GraphDefinition("x", {"T": auxiliary(["a"])}, [], "T")
    with pytest.raises(DefinitionError):
        Feature("a", "categorical", "N/A", ("onehot", "label"))
    with pytest.raises(DefinitionError):
        Feature("a", "numeric", 0.0, ("onehot",))
    with pytest.raises(DefinitionError):
        primary(["a"], (), Validity(min_length=(1, 2)))
    assert TX_IDENTITY_EDGE_CENTRIC.canonical_edges[:2] == [("TRANSACTION", "MADE_BY", "CUSTOMER"),
                                                           ("CUSTOMER", "MADE", "TRANSACTION")]


def test_build_graph_end_to_end(spark):
    tx = transaction_view(spark, SF)
    split = resolve_split(SPLIT)
    d = TX_IDENTITY_EDGE_CENTRIC
    g = build_graph(tx, d, split, tie_cols=["trans_num"], datetime_col="ts", materialise_as="checkpoint")
    cat = {(r["src_type"], r["relation"], r["dst_type"]): (r["n_edges"], r["n_bag"]) for r in graph_catalogue(g).collect()}
    assert set(cat) == set(d.canonical_edges)
    # weighted form sums to the bag form, which equals the row-level self-join count
    e = g.edges[("CUSTOMER", "HAS_SAME_CITY", "CUSTOMER")]
    assert expand_bag(e).count() == cat[("CUSTOMER", "HAS_SAME_CITY", "CUSTOMER")][1]
    b = g.base.select("CUSTOMER_node_id", "CITY_node_id").na.drop()
    brute = (b.alias("x").join(b.alias("y"), F.col("x.CITY_node_id") == F.col("y.CITY_node_id"))
             .filter(F.col("x.CUSTOMER_node_id") != F.col("y.CUSTOMER_node_id")).count())
    assert brute == cat[("CUSTOMER", "HAS_SAME_CITY", "CUSTOMER")][1]
    # forward and reverse bipartite edges have equal counts; ids are dense
    assert cat[("TRANSACTION", "MADE_BY", "CUSTOMER")][0] == cat[("CUSTOMER", "MADE", "TRANSACTION")][0]
    tn = g.nodes["TRANSACTION"]
    n = tn.count()
    assert tn.agg(F.min("node_id"), F.max("node_id")).first() == (0, n - 1)
    assert {"label", "split_hpo", "split_full", "amt_log_standardize"} <= set(tn.columns)
    out = scratch_path(spark, "graph-out")
    write_graph(g, out)
    assert spark.read.parquet(f"{out}/nodes").filter("ntype = 'TRANSACTION'").count() == n


def test_standardize_uses_full_training_rows(spark):
    tx = transaction_view(spark, SF)
    split = resolve_split(SPLIT)
    d = GraphDefinition("t", {"T": primary(["trans_num"], [Feature("amt", "numeric", 0.0, ("standardize",))],
                                           Validity(all_not_null=True))}, [], "T")
    full = build_graph(tx, d, split, tie_cols=["trans_num"], datetime_col="ts", fit_split=0)
    train_rows = full.base.filter("split_full = 0")
    m = train_rows.agg(F.avg("amt"), F.stddev_samp("amt")).first()
    r = full.nodes["T"].join(full.base.select(F.col("T_node_id").alias("node_id"), "amt"), "node_id").first()
    assert abs(r["amt_standardize"] - (r["amt"] - m[0]) / (m[1] + 1e-12)) < 1e-9


def test_repeated_bipartite_triple_is_concatenated_and_distinct(spark):
    """Several definitions of one triple give every edge once."""
    first = spark.createDataFrame([(1, 10), (2, 20)], "src long, dst long")
    second = spark.createDataFrame([(2, 20), (3, 30)], "src long, dst long")
    merged = merge_distinct([first, second])
    assert sorted(map(tuple, merged.collect())) == [(1, 10), (2, 20), (3, 30)]
    assert merge_distinct([]) is None


def test_ids_through_narrow_rows_equal_lookups_one_by_one(spark):
    strict = Validity(all_not_null=True)
    nodes = {"T": primary(["a"], (), strict), "C": auxiliary(["b"]), "P": auxiliary(["b", "c"]), "D": auxiliary(["c"], strict)}
    d = GraphDefinition("x", nodes, [MonoEdge("T", "C", "r"), MonoEdge("T", "P", "s"), MonoEdge("T", "D", "t")], "T")
    rows = [(i if i % 5 else None, None if i % 3 == 0 else f"b{i % 7}", None if i % 4 == 0 else float(i % 6), f"wide {i}") for i in range(400)]
    base = spark.createDataFrame(rows, "a long, b string, c double, other string").repartition(5)
    tables, sizes = numbered_keys(base, d)
    plain = attach_all_ids(base, d, tables)
    narrow = attach_all_ids(base, d, tables, sizes, lookup_rows=0)
    assert narrow.columns == plain.columns
    assert sorted(map(str, narrow.collect())) == sorted(map(str, plain.collect()))
    got = narrow.agg(*[F.countDistinct(f"{t}_node_id").alias(t) for t in nodes]).first().asDict()
    assert got == sizes and sizes["C"] == 8  # the null key is a node where the rules allow it
    some = attach_all_ids(base, d, tables, sizes, lookup_rows=sizes["D"])
    assert sorted(map(str, some.collect())) == sorted(map(str, plain.collect()))
