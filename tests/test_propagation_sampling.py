"""Messages over cliques, k hops, samplers from lists and the Newton fit, against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from txgraph.operators.model import fit_logistic, logit_column, train_logistic
from txgraph.operators.propagation import Clique, EdgeList, clique, pass_messages, propagate
from txgraph.operators.sampling import Lists, _drawn, sample_neighbors


def _cliques(spark, seed, multi):
    rng = random.Random(seed)
    rows = {(p, rng.randrange(6)) for p in range(40) for _ in range(1 + (multi and rng.random() < 0.5))}
    if not multi:
        rows = {(p, max(v for q, v in rows if q == p)) for p, _ in rows}
    rows.add((99, 77))  # alone with its value
    x = {p: (rng.uniform(-5, 5), rng.choice([None, 1.0])) for p in range(38)}  # 38, 39 and 99 have no features
    return sorted(rows), x, spark.createDataFrame(sorted(rows), "node_id long, value long"), spark.createDataFrame([(p, *v) for p, v in x.items()], "node_id long, a double, b double")


@pytest.mark.parametrize("how", ["sum", "mean", "gcn"])
@pytest.mark.parametrize("multi", [False, True])
def test_clique_messages_equal_those_over_pairs(spark, how, multi):
    rows, x, members, feats = _cliques(spark, 3, multi)
    pairs = [(p, q) for p, v in rows for q, w in rows if v == w and p != q]  # p -> q, once for each shared value
    deg = {q: sum(1 for _, t in pairs if t == q) for q in range(100)}
    want = {}
    for q in {t for _, t in pairs}:
        for i in (0, 1):
            got = [(x.get(p, (0, 0))[i] or 0.0) / (math.sqrt(deg[p] * deg[q]) if how == "gcn" else 1.0) for p, t in pairs if t == q]
            want[q, i] = sum(got) / (len(got) if how == "mean" else 1)
    got = pass_messages([Clique("T", "SAME", members)], {"T": feats}, how)["T"].collect()
    assert {r["node_id"] for r in got} == {q for q, _ in want}
    for r in got:
        assert abs(r["a"] - want[r["node_id"], 0]) < 1e-9 and abs(r["b"] - want[r["node_id"], 1]) < 1e-9


def test_weighted_clique(spark):
    rows = [(1, 7, 2.0), (2, 7, 3.0), (3, 7, 1.0), (1, 8, 1.0), (3, 8, 5.0)]
    c = Clique("T", "S", spark.createDataFrame(rows, "node_id long, value long, w double"), "w")
    x = spark.createDataFrame([(1, 1.0), (2, 10.0), (3, 100.0)], "node_id long, a double")
    got = {r["node_id"]: r["a"] for r in pass_messages([c], {"T": x}, "sum")["T"].collect()}
    assert got == {1: 2 * 3 * 10 + 2 * 100 + 5 * 100, 2: 3 * 2 * 1 + 3 * 100, 3: 2 * 1 + 3 * 10 + 5 * 1}


def test_propagate_over_two_relations_equals_matrices(spark):
    rng = np.random.default_rng(5)
    n, m = 12, 5
    e = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, n, 30), rng.integers(0, m, 30))})
    val = rng.integers(0, 3, m)
    xi, xu = rng.normal(size=n), rng.normal(size=m)
    to_user = np.zeros((m, n))
    for a, b in e:
        to_user[b, a] = 1
    to_item = to_user.T / np.maximum(to_user.sum(0), 1)[:, None]
    to_user = to_user / np.maximum(to_user.sum(1), 1)[:, None]
    same = (val[:, None] == val[None, :]) & ~np.eye(m, dtype=bool)
    same = same / np.maximum(same.sum(1), 1)[:, None]
    edges = spark.createDataFrame(e, "src long, dst long")
    relations = [EdgeList("item", "by", "user", edges), EdgeList("user", "made", "item", edges.selectExpr("dst AS src", "src AS dst")),
                 clique(spark.createDataFrame([(i, int(v)) for i, v in enumerate(val)], "u long, v long"), "user", "same", "u", "v")]
    x = {"item": spark.createDataFrame([(i, float(v)) for i, v in enumerate(xi)], "node_id long, x double"),
         "user": spark.createDataFrame([(i, float(v)) for i, v in enumerate(xu)], "node_id long, x double")}
    got = propagate(x, relations, 3)
    want = {"item": [xi], "user": [xu]}
    for _ in range(3):
        i, u = want["item"][-1], want["user"][-1]
        want["item"].append(to_item @ u)
        want["user"].append(to_user @ i + same @ u)
    for t in x:
        assert got[t].columns == ["node_id", "x", "x_h1", "x_h2", "x_h3"]
        for r in got[t].collect():
            assert np.allclose(list(r)[1:], [w[r["node_id"]] for w in want[t]])


def _h(seed, src):
    return hashlib.md5(f"{seed}:{src}".encode()).hexdigest()


def _brute_sample(relations, times, seeds, fanouts, seed, strategy):
    """relations: triple -> set of (src, dst); one draw per destination, relation and hop; seeds stay."""
    frontier = {t: set(f) for t, f in seeds.items()}
    out = set()
    for hop, k in enumerate(reversed(fanouts), 1):
        nxt = {t: set(f) for t, f in frontier.items()}
        for (s, r, d), edges in relations.items():
            for node, at in frontier.get(d, ()):
                cand = [a for a, b in edges if b == node]
                if strategy:
                    cand = [a for a in cand if times[s].get(a) is not None and (at is None or times[s][a] <= at)]
                cand.sort(key=(lambda a: (-times[s][a], a)) if strategy == "last" else lambda a: (_h(seed + hop, a), a))
                for a in cand[:k]:
                    out.add((hop, r, a, node, at))
                    nxt.setdefault(s, set()).add((a, at))
        frontier = nxt
    return out


@pytest.mark.parametrize("strategy", [None, "last", "uniform"])
def test_samples_equal_brute_force_over_pairs(spark, strategy):
    rng = random.Random(11)
    users = {u: rng.randrange(1000) if rng.random() < 0.95 else None for u in range(150)}
    city = sorted({(u, rng.choice([0, 0, 0, 1, 2])) for u in users} | {(u, 9) for u in range(20)})  # one long list; some read two
    made = sorted({(rng.randrange(150), i) for i in range(60) for _ in range(3)})
    items = {i: rng.randrange(1000) for i in range(60)}
    pairs = {(a, b) for a, v in city for b, w in city if v == w and a != b}
    relations = {("user", "made", "item"): set(made), ("item", "by", "user"): {(b, a) for a, b in made}, ("user", "same", "user"): pairs}
    times = {"user": users, "item": items}
    seeds = {"item": {(i, items[i] if strategy else None) for i in range(0, 60, 7)}}
    e = spark.createDataFrame(made, "src long, dst long")
    frames = {("user", "made", "item"): e, ("item", "by", "user"): e.selectExpr("dst AS src", "src AS dst"),
              ("user", "same", "user"): clique(spark.createDataFrame(city, "u long, v long"), "user", "same", "u", "v")}
    ta = {t: spark.createDataFrame(list(x.items()), "node_id long, time_attr long") for t, x in times.items()}
    got = sample_neighbors(frames, {"item": spark.createDataFrame([(i,) for i, _ in seeds["item"]], "node_id long")}, [4, 2, 3], seed=5,
                           time_attr=ta if strategy else None, strategy=strategy or "uniform").collect()
    got = [(r["hop"], r["relation"], r["src"], r["dst"], r["seed_time"]) for r in got]
    assert len(got) == len(set(got))
    assert set(got) == _brute_sample(relations, times, seeds, [4, 2, 3], 5, strategy)


def test_pairs_of_a_value_are_never_built(spark):
    """A list of 5,000 readers of one value: the plan's joins stay near readers x (k + 1)."""
    n = 5000
    members = spark.range(n).selectExpr("id AS u", "0 AS v")
    seeds = spark.range(n).selectExpr("id AS node_id")
    got = sample_neighbors({("u", "same", "u"): clique(members, "u", "same", "u", "v")}, {"u": seeds}, [3])
    assert got.count() == 3 * n
    x = spark.range(n).selectExpr("id AS node_id", "CAST(id AS DOUBLE) AS a")
    s = pass_messages([clique(members, "u", "same", "u", "v")], {"u": x}, "sum")["u"]
    assert s.where(f"abs(a - ({n * (n - 1) / 2} - node_id)) > 1e-6").count() == 0


def _train(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 50.0] + [3.0, 0.0]
    y = rng.random(n) < 1 / (1 + np.exp(-(0.7 * (x[:, 0] - 3) - 0.02 * x[:, 1] - 0.3)))
    return x, y, spark.createDataFrame([(float(a), float(b), 1.0, int(c)) for (a, b), c in zip(x, y)], "a double, b double, one double, label int")


def test_newton_fit_has_no_gradient_and_equals_mllib(spark):
    x, y, df = _train(spark)
    fit = fit_logistic(df, ["a", "b", "one"], pos_weight=2.0)
    assert fit.converged and fit.gradient < 1e-8 and fit.coefficients[2] == 0.0
    z = fit.intercept + x @ np.array(fit.coefficients[:2])
    w = np.where(y, 2.0, 1.0)
    r = w * (y - 1 / (1 + np.exp(-z)))
    assert abs(r.sum()) < 1e-4 and np.abs(r @ x).max() < 1e-3
    m = train_logistic(df, ["a", "b"], "label", pos_weight=2.0, max_iter=200)
    assert np.allclose(m.coefficients.toArray(), fit.coefficients[:2], rtol=1e-3)
    s = df.limit(3).select("a", "b", "one", logit_column(fit.features, fit.coefficients, fit.intercept).alias("s")).collect()
    assert all(abs(r["s"] - (fit.intercept + fit.coefficients[0] * r["a"] + fit.coefficients[1] * r["b"])) < 1e-12 for r in s)


def test_separable_classes_do_not_converge_without_ridge(spark):
    df = spark.createDataFrame([(float(v), int(v > 0)) for v in range(-9, 10)], "a double, label int")
    assert not fit_logistic(df, ["a"], max_iter=15).converged
    assert fit_logistic(df, ["a"], ridge=0.01).converged
    with pytest.raises(ValueError):
        fit_logistic(df.where("a > 99"), ["a"])


def test_temporal_uniform_cuts_lists_before_readers(spark):
    """The candidates of a (list, time) are cut to what a reader can draw before they are joined to its many readers."""
    items = spark.range(60).selectExpr("0L AS value", "id AS src")
    readers = spark.range(60).selectExpr("id AS dst", "0L AS value")
    times = spark.range(60).selectExpr("id AS node_id", "id AS time_attr")
    frontier = spark.range(60).selectExpr("id AS node_id", "45L AS seed_time")
    got = _drawn(Lists(items, readers, True), frontier, 3, 1, times, "uniform")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number()") == 3  # blocks, lists at a time, readers
    by_hash = sorted(range(46), key=lambda i: hashlib.md5(f"1:{i}".encode()).hexdigest())
    want = {(d, s) for d in range(60) for s in [x for x in by_hash if x != d][:3]}
    assert {(r["dst"], r["src"]) for r in got.collect()} == want


def _counted(df, seen):
    """The rows; ``seen`` counts how often they are made."""
    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_hops_read_what_was_written(spark):
    """Features and clique members, edge lists and times are made once, however many hops read them."""
    seen = spark.sparkContext.accumulator(0)
    x = _counted(spark.createDataFrame([(i, float(i)) for i in range(6)], "node_id long, v double"), seen)
    members = _counted(spark.createDataFrame([(i, i % 2) for i in range(6)], "node_id long, value long"), seen)
    out = propagate({"N": x}, [Clique("N", "same", members)], hops=3)["N"].collect()
    assert len(out) == 6 and seen.value == 12
    assert {r["node_id"]: r["v_h1"] for r in out} == {i: (sum(range(i % 2, 6, 2)) - i) / 2 for i in range(6)}
    seen = spark.sparkContext.accumulator(0)
    edges = _counted(spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)], "src long, dst long"), seen)
    times = _counted(spark.createDataFrame([(i, 5) for i in range(6)], "node_id long, time_attr long"), seen)
    seeds = spark.createDataFrame([(0,)], "node_id long")
    got = sample_neighbors({("N", "next", "N"): edges}, {"N": seeds}, [2, 2], time_attr={"N": times}, strategy="last")
    assert sorted((r["hop"], r["src"], r["dst"]) for r in got.collect()) == [(1, 5, 0), (2, 4, 5), (2, 5, 0)]
    assert seen.value == 12
