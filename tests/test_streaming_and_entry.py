from pyspark.sql import functions as F

from txgraph.plans.prequential import prequential_loop, prequential_score, prequential_scores
from txgraph.plans.registry import ev_definition
from txgraph.operators.splits import positional_split
from txgraph.session import scratch_path
from txgraph.streaming.native import (compact_stream, edges, graph_log, latest_node_features, newest_state, node_id, node_state, observations,
                                      read_log, replay_pieces, run_graph_stream, with_pieces, write_replay_batches)

SF = "/root/testdata/sf0.001"


NODES = {"event": "event_id", "user": "user_id", "property": "props"}
EDGES = {("user", "sends", "event"): ("user_id", "event_id"), ("event", "has", "property"): ("event_id", "props")}
FEATS = {"event": ["value"], "user": ["value"]}
ORDER = ["ts", "event_id"]


def _rows(df):
    return sorted(map(str, df.collect()))


def test_stream_with_snapshot_equals_batch(spark):
    """Four micro-batches in two runs, a snapshot between them: the state is that of the batch build, and reads no log
    that the snapshot covers."""
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("part", F.least(F.floor(F.col("event_id") / 20), F.lit(3)).cast("int"))
    src, out = scratch_path(spark, "ev-src"), None
    covered = []
    for lo, hi in ((0, 2), (2, 4)):
        write_replay_batches(ev.where(f"part >= {lo} AND part < {hi}" if hi < 4 else f"part >= {lo}"), "part", src)
        out = run_graph_stream(spark, src, ev.schema, NODES, EDGES, FEATS, ORDER, out)
        state = newest_state(observations(read_log(spark, out)))
        assert _rows(node_state(spark, out)) == _rows(state.select(*node_state(spark, out).columns))
        covered.append(compact_stream(spark, out))
    assert covered[0] < covered[1] == compact_stream(spark, out)
    cols = ["ntype", "key", "value", "n_obs"]
    batch = latest_node_features(observations(graph_log(ev, NODES, EDGES, FEATS, ORDER)))
    assert _rows(node_state(spark, out).select(*cols)) == _rows(batch.select(*cols))
    assert edges(read_log(spark, out)).where("etype = 'user__sends__event'").count() == ev.count()
    # a snapshot is what is read: with the log behind it empty, its own rows are the state
    snap = spark.read.parquet(f"{out}/snapshot/upto={covered[1]}")
    assert _rows(snap.select(*cols)) == _rows(batch.select(*cols))


def test_micro_batches_come_in_index_order(spark):
    """Batches written in any order by parallel tasks are replayed by number: the newest value of every batch lies in a
    later micro-batch."""
    ev = spark.range(400).selectExpr("id AS event_id", "id % 7 AS user_id", "CAST(id AS DOUBLE) AS value", "CAST(NULL AS STRING) AS props", "id AS ts",
                                     "CAST(100 - id DIV 50 AS INT) AS part")
    src = write_replay_batches(ev, "part", scratch_path(spark, "ordered"))
    out = run_graph_stream(spark, src, ev.schema, NODES, EDGES, FEATS, ORDER)
    got = observations(read_log(spark, out).where("name = 'event'")).withColumn("ingest", F.lit(0))
    log = read_log(spark, out).where("name = 'event' AND kind = 'observations'").groupBy("ingest").agg(F.min("ord.event_id").alias("lo"), F.count("*").alias("n"))
    order = [r["lo"] for r in log.orderBy("ingest").collect()]
    assert order == [350, 300, 250, 200, 150, 100, 50, 0] and got.count() == 400


def test_large_batches_are_cut_in_pieces(spark):
    """A batch of many rows is several files and tasks of one micro-batch; log and order are those of whole batches."""
    ev = spark.range(400).selectExpr("id AS event_id", "id % 7 AS user_id", "CAST(id AS DOUBLE) AS value", "CAST(NULL AS STRING) AS props", "id AS ts",
                                     "CAST(100 - id DIV 100 AS INT) AS part")
    pieces = replay_pieces(ev, "part", piece_rows=30)
    cut = with_pieces(ev, pieces)
    src = write_replay_batches(cut, "part", scratch_path(spark, "pieces"))
    files = spark.read.parquet(src).withColumn("f", F.input_file_name()).groupBy("part").agg(F.countDistinct("f").alias("n")).collect()
    assert pieces == 4 and [r["n"] for r in files] == [4] * 4
    out = run_graph_stream(spark, src, cut.schema, NODES, EDGES, FEATS, ORDER, max_files_per_trigger=pieces, tasks=pieces)
    log = read_log(spark, out)
    seen = log.withColumn("f", F.input_file_name()).where("name = 'event' AND kind = 'observations'").groupBy("ingest").agg(
        F.min("ord.event_id").alias("lo"), F.count("*").alias("n"), F.countDistinct("f").alias("files"))
    assert [(r["lo"], r["n"], r["files"]) for r in seen.orderBy("ingest").collect()] == [(x, 100, 4) for x in (300, 200, 100, 0)]
    whole = newest_state(observations(graph_log(ev, NODES, EDGES, FEATS, ORDER)))
    assert _rows(node_state(spark, out)) == _rows(whole)


def test_node_ids_are_wide_and_typed(spark):
    r = spark.range(1).select(node_id("user", "id").alias("a"), node_id("event", "id").alias("b"), F.octet_length(node_id("user", "id")).alias("n")).first()
    assert r["n"] == 16 and r["a"] != r["b"]


def _events(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").filter("event_id < 200")
    ev = ev.withColumn("label", (F.col("event_type") == "error").cast("int"))
    ev = ev.withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value")))  # some items without a value
    return positional_split(ev, ORDER, (0.7, 0.15, 0.15)).cache()


def _scored(df):
    return sorted((r["batch_id"], r["event_id"], round(r["score"], 9), r["label"]) for r in df.collect())


def test_prequential_closed_form_equals_loop(spark):
    t = _events(spark).where("value IS NOT NULL")
    closed = prequential_scores(t, node_col="user_id", item_col="event_id", value_col="value", label_col="label",
                                batch_size=16, mode="validation")
    loop = prequential_loop(t, ev_definition(), item_type="event", node_type="user", item_col="event_id",
                            value_col="value", label_col="label", batch_size=16, mode="validation")
    assert _scored(closed) == _scored(loop) and loop.count() > 0


def test_prequential_custom_scorer_equals_loop(spark, mode="testing"):
    """A caller's pandas model on the as-of table of one plan, and on the graph of every batch."""
    t = _events(spark)
    scorer = lambda x: (x["value"].fillna(-1.0) + 2 * x["user__value"].fillna(-3.0) + x["user__mean_value"].fillna(0.0) * x["user__n_items"].fillna(0.0)
                        - 0.5 * x["property__mean_value"].fillna(7.0) + 0.25 * x["property__n_items"].fillna(0.0))
    one = prequential_score(t, scorer, item_col="event_id", item_features=["value"], label_col="label", batch_size=16, mode=mode,
                            entities={"user": ("user_id", ["value"]), "property": ("props", [])})
    loop = prequential_loop(t, ev_definition(), item_type="event", item_col="event_id", label_col="label", batch_size=16, mode=mode, scorer=scorer)
    assert _scored(one) == _scored(loop) and loop.select("batch_id").distinct().count() > 1


def test_prequential_on_an_empty_split(spark):
    t = _events(spark).where("train_val_test_mask <> 'test'")
    loop = prequential_loop(t, ev_definition(), item_type="event", item_col="event_id", label_col="label", batch_size=100, scorer=lambda x: x["value"])
    one = prequential_score(t, lambda x: x["value"], item_col="event_id", item_features=["value"], label_col="label", batch_size=9, entities={"user": ("user_id", [])})
    assert loop.count() == one.count() == 0


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() == 10 and set(df.columns) == {"src_type", "relation", "dst_type", "n_edges", "n_bag"}
    q, sql = E.queries(), E.oracle_sql()
    own = {k for k in q if k != "pipeline" and not k.startswith("op")}  # the training-data queries have their own tests
    assert set(sql) <= set(q) and own <= set(sql)
