import math

from pyspark.sql import functions as F

from txgraph.definitions import GraphDefinition, MonoEdge, Validity, auxiliary, primary
from txgraph.operators.edges import expand_bag, monopartite_counts, monopartite_weighted
from txgraph.operators.metrics import evaluation_summary, pr_curve, precision_recall, weighted_log_loss
from txgraph.plans.batch_graph import build_edges, id_col


def _rows(spark):
    # (primary, aux): primary 1 has two rows on value 10, primary 4 has two values
    rows = [(1, 10), (1, 10), (2, 10), (3, 20), (4, 20), (4, 10), (5, None), (None, 20)]
    return spark.createDataFrame(rows, "p long, a long")


def _bag_brute(rows):
    out = []
    for p1, a1 in rows:
        for p2, a2 in rows:
            if None not in (p1, a1, p2, a2) and a1 == a2 and p1 != p2:
                out.append((p1, p2))
    return out


def test_weighted_equals_bag_join(spark):
    df = _rows(spark)
    brute = sorted(_bag_brute([tuple(r) for r in df.collect()]))
    for rows in (1, 2, 2048):  # a grid cell per pair, small cells, one cell
        w = monopartite_weighted(df, "p", "a", block_rows=rows)
        assert sorted(tuple(r) for r in expand_bag(w).collect()) == brute
        pairs = {(r["src"], r["dst"]): r["weight"] for r in w.collect()}
        assert all(pairs[(b, a)] == v for (a, b), v in pairs.items())  # symmetric
        assert all(a != b for a, b in pairs)                           # no self loops
    c = monopartite_counts(df, "p", "a").first()
    assert c["n_bag"] == len(brute) and c["n_edges"] == len(set(brute))


def test_counts_single_value_formula(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "p long, a long")
    c = monopartite_counts(df, "p", "a").first()
    assert c["n_edges"] == c["n_bag"] == 3 * 10 * 9


def test_two_definitions_without_a_shuffle_of_pairs(spark):
    """Weights of several definitions add up where the pairs meet; a primary with two values goes the general way."""
    d = GraphDefinition("two", {"P": primary(["k"], (), Validity(all_not_null=True)), "A": auxiliary(["a"], Validity(all_not_null=True)),
                                "B": auxiliary(["b"], Validity(all_not_null=True))},
                        [MonoEdge("P", "A", "LINKED"), MonoEdge("P", "B", "LINKED")], "P")
    one = [(1, 10, 7), (1, 10, None), (2, 10, 7), (2, 10, 7), (3, 20, 7), (4, 20, None), (5, None, 8), (6, None, 8), (7, None, None), (None, 10, 7)]
    for rows, single in ((one, True), (one + [(4, 10, 8)], False)):
        base = spark.createDataFrame(rows, f"{id_col('P')} long, {id_col('A')} long, {id_col('B')} long")
        brute = {}
        for at in (1, 2):
            for pair in _bag_brute([(r[0], r[at]) for r in rows]):
                brute[pair] = brute.get(pair, 0) + 1
        e = build_edges(base, d)[("P", "LINKED", "P")]
        assert {(r["src"], r["dst"]): r["weight"] for r in e.collect()} == brute and e.count() == len(brute)
        plan = e._jdf.queryExecution().optimizedPlan().toString()
        assert ("Aggregate [src" not in plan) == single


def test_grid_cells_keep_their_partitions(spark):
    """A few rows that grow to their square: the join's tasks are not coalesced by the size of its input."""
    df = spark.range(64).selectExpr("id AS p", "id % 4 AS a")
    w = monopartite_weighted(df, "p", "a", block_rows=2, one_value_per_primary=True)
    assert w.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and w.count() == 4 * 16 * 15


def test_pairs_of_a_hot_value_are_stored_in_few_bytes(spark, tmp_path):
    """The pairs of a value repeat short runs, whatever its primaries' ids and rows; none is lost or made twice."""
    df = spark.range(2503).selectExpr("xxhash64(id) AS p", "7 AS a", "explode(sequence(1, 1 + pmod(hash(id), 9)))").drop("col")
    monopartite_weighted(df, "p", "a", one_value_per_primary=True, sized=True).write.parquet(f"{tmp_path}/pairs")
    back = spark.read.parquet(f"{tmp_path}/pairs")
    rows, alone = df.count(), df.groupBy("p").count().selectExpr("sum(count * count)").first()[0]
    got = back.selectExpr("count(*)", "count(DISTINCT src, dst)", "sum(weight)").first()
    assert tuple(got) == (2503 * 2502, 2503 * 2502, rows * rows - alone)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * got[0]


def test_two_definitions_are_stored_in_few_bytes(spark, tmp_path):
    """A hot value beside one of small groups: weights follow the counts of rows but for the few pairs that share both."""
    d = GraphDefinition("two", {"P": primary(["k"], (), Validity(all_not_null=True)), "A": auxiliary(["a"], Validity(all_not_null=True)),
                                "B": auxiliary(["b"], Validity(all_not_null=True))},
                        [MonoEdge("P", "A", "LINKED"), MonoEdge("P", "B", "LINKED")], "P")
    base = spark.range(2503).selectExpr(f"xxhash64(id) AS {id_col('P')}", f"7L AS {id_col('A')}", f"id div 5 AS {id_col('B')}", "explode(sequence(1, 1 + pmod(hash(id), 9)))").drop("col")
    build_edges(base, d, sized=True)[("P", "LINKED", "P")].write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs").selectExpr("count(*)", "count(DISTINCT src, dst)", "sum(weight)").first()
    bag = lambda on: base.groupBy(on).count().selectExpr("sum(count * count)").first()[0]
    assert tuple(got) == (2503 * 2502, 2503 * 2502, bag(id_col("A")) + bag(id_col("B")) - 2 * bag(id_col("P")))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * got[0]


def test_tasks_follow_the_number_of_pairs(spark, monkeypatch):
    monkeypatch.setattr("txgraph.operators.edges.PAIRS_A_TASK", 100)
    df = spark.range(64).selectExpr("id AS p", "id % 4 AS a")
    w = monopartite_weighted(df, "p", "a", block_rows=4, one_value_per_primary=True, sized=True)
    assert w.rdd.getNumPartitions() == 11 and w.count() == w.distinct().count() == 4 * 16 * 15


def test_blocks_of_any_size_keep_all_pairs(spark):
    """Tiles of a multiple of 8 rows and one for the rest, in one block or several."""
    df = spark.range(90).selectExpr("id AS p", "CAST(floor(sqrt(id)) AS int) AS a").unionByName(spark.range(1000, 1093).selectExpr("id AS p", "99 AS a"))
    want = {(r["x"], r["y"]) for r in df.selectExpr("p AS x", "a").join(df.selectExpr("p AS y", "a"), "a").filter("x != y").collect()}
    for rows in (1, 3, 8, 20, 41):
        got = [(r["src"], r["dst"]) for r in monopartite_weighted(df, "p", "a", block_rows=rows, one_value_per_primary=True).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_precision_recall_zero_division(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 0)], "score double, label int")
    r = precision_recall(df).first()
    assert (r["num_samples"], r["precision"], r["recall"]) == (2, 0.0, 0.0)


def test_weighted_loss_matches_textbook(spark):
    data = [(2.0, 1), (-1.0, 0), (0.3, 1), (-40.0, 1), (35.0, 0)]
    df = spark.createDataFrame(data, "score double, label int")
    w = 2.5
    sig = lambda z: 1 / (1 + math.exp(-z))
    exp = []
    for z, y in data:
        lp = math.log(sig(z)) if z > -30 else z - math.log1p(math.exp(z))
        lq = math.log(1 - sig(z)) if z < 30 else -z - math.log1p(math.exp(-z))
        exp.append(-(w * y * lp + (1 - y) * lq))
    got = weighted_log_loss(df, pos_weight=w).first()["loss"]
    assert abs(got - sum(exp) / len(exp)) < 1e-9
    s = evaluation_summary(df, "testing", pos_weight=w).first()
    assert s["num_samples"] == 5 and abs(s["loss"] - got) < 1e-12


def test_pr_curve_brute_force(spark):
    data = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1), (0.3, 1)]
    df = spark.createDataFrame(data, "score double, label int")
    got = sorted(((r["threshold"] if r["threshold"] is not None else -1), r["precision"], r["recall"])
                 for r in pr_curve(df).collect())
    P = sum(y for _, y in data)
    exp = []
    for t in sorted({s for s, _ in data}):
        sel = [y for s, y in data if s >= t]
        exp.append((t, sum(sel) / len(sel), sum(sel) / P))
    exp.append((-1, 1.0, 0.0))
    assert got == sorted(exp)
