import logging

import pytest
from pyspark.sql import functions as F

from txgraph.definitions import ColumnGraphDefinition, DefinitionError
from txgraph.operators.splits import with_row_index
from txgraph.plans.dynamic_graph import DynamicGraph, TabularTable

EDGES2 = {("customer", "sends", "transaction"): ("test_customer", "test_id"),
          ("transaction", "sent_to", "counterparty"): ("test_id", "test_counterparty")}


def _defn(features=None, label=None):
    feats = features or {"test_id": [], "test_customer": [], "test_counterparty": []}
    return ColumnGraphDefinition(feats, "test_id" if label else None, label, EDGES2)


def _edges(g, et):
    return [(r["src"], r["dst"]) for r in g.edges[et].orderBy("row_index").collect()]


def _feat(g, t, c):
    return [r[c] for r in g.features[t].orderBy("node_id").collect()]


def _rows(df):
    return with_row_index(df, ["test_id"])


def test_definition_errors(caplog):
    with pytest.raises(DefinitionError, match="unknown-column. test_customer"):
        ColumnGraphDefinition({"test_id": []}, None, None, {("customer", "makes", "transaction"): ("test_customer", "test_id")})
    with pytest.raises(DefinitionError, match="type-with-many-columns. customer"):
        ColumnGraphDefinition({"test_id": [], "test_customer": [], "test_counterparty": []}, None, None,
                              {("customer", "makes", "transaction"): ("test_customer", "test_id"),
                               ("customer", "does", "transaction"): ("test_counterparty", "test_id")})
    with pytest.raises(DefinitionError, match="column-with-many-types. test_customer"):
        ColumnGraphDefinition({"test_id": [], "test_customer": []}, None, None,
                              {("customer", "makes", "transaction"): ("test_customer", "test_id"),
                               ("client", "does", "transaction"): ("test_customer", "test_id")})
    with pytest.raises(DefinitionError, match="label-without-edges"):
        ColumnGraphDefinition({"test_id": [], "test_customer": [], "test_counterparty": []}, "test_counterparty", "label",
                              {("customer", "makes", "transaction"): ("test_customer", "test_id")})
    with caplog.at_level(logging.WARNING):
        d = ColumnGraphDefinition({"test_id": [], "test_customer": [], "test_counterparty": []}, None, None,
                                  {("customer", "makes", "transaction"): ("test_customer", "test_id")})
    assert "test_counterparty" not in d.node_features and "no-edges" in caplog.text
    assert d.node_type("test_id") == "transaction" and d.node_type("test_customer") == "customer"


def test_build_connectivity_and_features(spark, minimal):
    rnd = [0.12, 0.46, 0.64, 0.18, 0.18]
    df = minimal.join(spark.createDataFrame(list(zip(range(1, 6), rnd)), "test_id long, random_feature double"), "test_id")
    g = DynamicGraph.build(_rows(df), _defn({"test_id": ["test_amount"], "test_customer": ["category_len"],
                                             "test_counterparty": ["random_feature"]}))
    assert sum(g.num_nodes.values()) == 15
    assert _edges(g, ("customer", "sends", "transaction")) == [(i, i) for i in range(5)]
    assert _edges(g, ("transaction", "sent_to", "counterparty")) == [(i, i) for i in range(5)]
    assert _feat(g, "customer", "category_len") == [5.0] * 5
    assert _feat(g, "counterparty", "random_feature") == rnd
    assert _feat(g, "transaction", "test_amount") == [100, 200, 300, 400, 500]


def test_labels(spark, minimal):
    df = minimal.withColumn("label", F.lit(1.0))
    g = DynamicGraph.build(_rows(df), ColumnGraphDefinition({"test_id": [], "test_customer": []}, "test_id", "label",
                                                            {("customer", "sends", "transaction"): ("test_customer", "test_id")}))
    assert [r["label"] for r in g.labels.orderBy("node_id").collect()] == [1.0] * 5


def _incr(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("row_index", F.col("test_id") + 100)


def test_update_connections(spark, minimal):
    g = DynamicGraph.build(_rows(minimal), _defn())
    inc = _incr(spark, [(6, "B", "ddd"), (7, "C", "eee"), (8, "F", "aaa")], "test_id long, test_customer string, test_counterparty string")
    g2 = g.update(inc)
    assert sum(g2.num_nodes.values()) == 19
    assert _edges(g2, ("customer", "sends", "transaction")) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (1, 5), (2, 6), (5, 7)]
    assert _edges(g2, ("transaction", "sent_to", "counterparty")) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 3), (6, 4), (7, 0)]
    assert sum(g.num_nodes.values()) == 15  # pure function: old state untouched


def test_update_new_and_known_features(spark, minimal):
    feats = {"test_id": ["test_amount"], "test_customer": ["category_len"], "test_counterparty": ["random_feature"]}
    df = minimal.withColumn("random_feature", F.col("test_id") / 10.0)
    g = DynamicGraph.build(_rows(df), _defn(feats))
    schema = "test_id long, test_customer string, test_counterparty string, test_amount long, category_len double, random_feature double"
    g_new = g.update(_incr(spark, [(6, "F", "fff", 600, 6.0, 0.6), (7, "G", "ggg", 700, 6.0, 0.7),
                                   (8, "H", "hhh", 800, 6.0, 0.8)], schema))
    assert _feat(g_new, "customer", "category_len") == [5.0] * 5 + [6.0] * 3
    assert _feat(g_new, "transaction", "test_amount") == [100, 200, 300, 400, 500, 600, 700, 800]
    g_old = g.update(_incr(spark, [(6, "B", "aaa", 600, 7.0, 0.5)], schema))
    assert _feat(g_old, "customer", "category_len") == [5.0, 7.0, 5.0, 5.0, 5.0]
    assert _feat(g_old, "counterparty", "random_feature") == [0.5, 0.2, 0.3, 0.4, 0.5]
    assert _feat(g_old, "transaction", "test_amount") == [100, 200, 300, 400, 500, 600]


def test_update_labels_appended(spark, minimal):
    d = ColumnGraphDefinition({"test_id": [], "test_customer": []}, "test_id", "label",
                              {("customer", "sends", "transaction"): ("test_customer", "test_id")})
    g = DynamicGraph.build(_rows(minimal.withColumn("label", F.lit(1))), d)
    g2 = g.update(_incr(spark, [(6, "B", 0), (7, "C", 0), (8, "F", 0)], "test_id long, test_customer string, label long"))
    assert [r["label"] for r in g2.labels.orderBy("node_id").collect()] == [1, 1, 1, 1, 1, 0, 0, 0]


def test_fold_of_increments_equals_rebuild(spark, minimal):
    rows = _rows(minimal)
    full = DynamicGraph.build(rows, _defn())
    part = DynamicGraph.build(rows.filter("row_index < 2"), _defn())
    for lo in (2, 4):
        part = part.update(rows.filter(f"row_index >= {lo} and row_index < {lo + 2}"))
    for t in full.keys:
        assert sorted(full.keys[t].collect()) == sorted(part.keys[t].collect())


def test_homogeneous_view(spark, minimal):
    feats = {"test_id": ["test_amount"], "test_customer": ["category_len"], "test_counterparty": ["random_feature"]}
    df = minimal.withColumn("random_feature", F.col("test_id") / 10.0).withColumn("label", F.lit(1))
    g = DynamicGraph.build(_rows(df), ColumnGraphDefinition(feats, "test_id", "label", EDGES2))
    nodes, edges = g.homogeneous()
    rows = nodes.orderBy("hid").collect()
    assert [r["ntype"] for r in rows] == ["counterparty"] * 5 + ["customer"] * 5 + ["transaction"] * 5
    assert [r["orig_id"] for r in rows] == list(range(5)) * 3
    x = [[r["x_0"], r["x_1"], r["x_2"]] for r in rows]
    assert x[:5] == [[v / 10.0, 0.0, 0.0] for v in range(1, 6)]
    assert x[5:10] == [[0.0, 5.0, 0.0]] * 5
    assert x[10:] == [[0.0, 0.0, float(v)] for v in (100, 200, 300, 400, 500)]
    assert [r["label"] for r in rows] == [0.0] * 10 + [1.0] * 5
    assert edges.count() == 10


def test_tabular_roles_and_preprocess(spark, minimal):
    with pytest.raises(DefinitionError):
        TabularTable.create(minimal, ["test_id"], (0.5, 0.25, 0.25), numeric=["test_amount"], categorical=["test_amount"])
    t = TabularTable.create(minimal, ["test_id"], (0.5, 0.25, 0.25), numeric=["test_amount"], categorical=["test_category"])
    assert t.view("train").count() == 3
    pre = t.preprocess()
    assert [r["test_category"] for r in pre.df.orderBy("test_id").collect()] == [0, 1, 2, 3, 4]
    sub = TabularTable.create(minimal, ["test_id"], (0.5, 0.25, 0.25), required_columns=["test_id"])
    assert len(sub.df.columns) == 3


def _bytes(g):
    import glob
    import os

    return sum(os.path.getsize(f) for t in g.tables for p, _ in t.parts for f in glob.glob(p.removeprefix("file:") + "/*.parquet"))


def test_increments_write_only_their_rows(spark):
    """Three increments of 20 rows on a state of 20,000: the state's folders stay, what is written follows the increment;
    merging folders changes no answer."""
    df = spark.range(20_060).selectExpr("id AS test_id", "concat('c', id % 5000 + id DIV 20020) AS test_customer", "concat('p', id % 300) AS test_counterparty",
                                        "id % 13 AS test_amount", "CAST(id % 2 AS DOUBLE) AS label", "id AS row_index")
    d = ColumnGraphDefinition({"test_id": ["test_amount"], "test_customer": ["test_amount"], "test_counterparty": []}, "test_id", "label", EDGES2)
    g = first = DynamicGraph.build(df.where("row_index < 20000"), d)
    for i in range(3):
        before = g
        g = g.update(df.where(f"row_index >= {20000 + 20 * i} AND row_index < {20020 + 20 * i}"))
        assert all(t.parts[: len(b.parts)] == b.parts for t, b in zip(g.tables, before.tables))
        assert sum(t.last_rows for t in g.tables) <= 20 * len(g.tables)
    assert _bytes(g) - _bytes(first) < _bytes(first) / 5
    whole = DynamicGraph.build(df, d)
    small = g.compact()
    assert all(len(t.parts) == 1 for t in small.tables) and all(len(t.compact(3).parts) == 2 for t in g.tables)  # the large first folder stays
    for a in (g, small):
        assert a.num_nodes == whole.num_nodes
        for t in whole.keys:
            key = d.column_of_type[t]
            assert sorted(a.keys[t].select(key).collect()) == sorted(whole.keys[t].select(key).collect())
            assert a.keys[t].select("node_id").distinct().count() == whole.num_nodes[t]
        assert all(sorted(a.edges[e].collect()) == sorted(g.edges[e].collect()) and a.edges[e].count() == 20_060 for e in whole.edges)
        assert a.labels.count() == 20_060 and sorted(a.features["customer"].collect()) == sorted(g.features["customer"].collect())
    newest = df.where("row_index >= 20000 AND test_customer = 'c1'").orderBy("row_index").first()
    got = g.features["customer"].join(g.keys["customer"], "node_id").where("test_customer = 'c1'").first()
    assert got["test_amount"] == newest["test_amount"]


def test_fused_fitting_runs_one_job_for_any_number_of_features(spark):
    from txgraph.definitions import Feature, primary
    from txgraph.operators.features import encode_node_features

    cols = {f"n{i}": F.col("id") * (i + 1) for i in range(6)} | {f"c{i}": F.concat(F.lit("v"), F.col("id") % (i + 2)) for i in range(6)}
    df = spark.range(60).withColumns(cols).withColumns({"split_full": F.lit(0), "label": F.lit(1), "timestamp": F.col("id")}).cache()
    df.count()

    def jobs(k):
        feats = [Feature(f"n{i}", "numeric", 0.0, ("log", "standardize")) for i in range(k)] + [Feature(f"c{i}", "categorical", "N/A", ("onehot",)) for i in range(k)]
        tracker, group = spark.sparkContext.statusTracker(), f"fit-{k}"
        spark.sparkContext.setJobGroup(group, group)
        out = encode_node_features(df, primary(["id"], feats), "id")
        n = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("", "")
        return n, out.feature_cols

    (one, _), (six, names) = jobs(1), jobs(6)
    assert one == six and names[:2] == ["n0_log_standardize", "n1_log_standardize"] and names[6:8] == ["c0_v1", "c1_v1"]


def test_graph_events_order_all_rows_of_the_definition_only(spark, tmp_path):
    """The rows that are sorted and kept in memory hold the definition's columns, no others; positions are the same."""
    from txgraph.plans import registry

    rows = [(i, 1000 * (7 * i % 10), i % 3, "error" if i % 4 == 0 else "view", float(i), f"p{i % 2}") for i in range(10)]
    df = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string")
    df.selectExpr("event_id", "timestamp_millis(t) AS ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    got, whole = registry._graph_events(spark, str(tmp_path)), registry._events_table(spark, str(tmp_path))
    assert not {"event_type", "timestamp"} & set(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(*got.columns).collect()))
