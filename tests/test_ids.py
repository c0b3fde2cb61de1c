import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from txgraph.operators.ids import dense_ids, running_totals, top_k_per_group


def test_dense_ids_match_dense_rank_nulls_first(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, "a", "b", "c"]), rnd.randint(0, 5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k1 string, k2 long")
    got = dense_ids(df, ["k1", "k2"], "id", num_partitions=16)
    w = Window.orderBy(F.col("k1").asc_nulls_first(), F.col("k2").asc_nulls_first())
    exp = df.distinct().withColumn("id", F.dense_rank().over(w) - 1)
    assert sorted(map(str, got.collect())) == sorted(map(str, exp.collect()))
    ids = sorted(r["id"] for r in got.collect())
    assert ids == list(range(len(ids)))


def test_dense_ids_more_partitions_than_keys_and_offset(spark):
    df = spark.createDataFrame([(x,) for x in [5, 3, 3, 9]], "k long")
    got = {r["k"]: r["id"] for r in dense_ids(df, ["k"], "id", offset=10, num_partitions=32).collect()}
    assert got == {3: 10, 5: 11, 9: 12}


def test_dense_ids_empty(spark):
    df = spark.createDataFrame([], "k long")
    assert dense_ids(df, ["k"], "id").count() == 0


def test_running_totals_match_window(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["x", "y", "z"]) if i % 7 else "x", rnd.randint(0, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "o long, g string, v long")
    got = running_totals(df, ["g"], ["o"], {"s": F.col("v")}, inclusive=False, num_partitions=13)
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    exp = df.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert sorted(got.collect()) == sorted(exp.select("o", "g", "v", "s").collect())
    got_inc = running_totals(df, [], ["o"], {"s": F.col("v")}, inclusive=True, num_partitions=5)
    w2 = Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    exp2 = df.withColumn("s", F.sum("v").over(w2))
    assert sorted(got_inc.collect()) == sorted(exp2.collect())


def test_top_k_per_group_exact(spark):
    rows = [(g, i) for g in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "g long, i long")
    got = top_k_per_group(df, ["g"], [F.col("i").desc()], 4, num_salts=7)
    assert sorted(got.collect()) == sorted([(g, i) for g in range(3) for i in range(46, 50)])


def test_hot_group_is_spread_over_chunks(spark):
    # one group holds most rows: the chunked running sum must still be exact
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "o long, g string, v long")
    got = running_totals(df, ["g"], ["o"], {"s": F.col("v")}, inclusive=True, num_partitions=12)
    hot = sorted((r["o"], r["s"]) for r in got.filter("g = 'hot'").collect())
    assert [s for _, s in hot] == list(range(1, len(hot) + 1))
    ranged = df.repartitionByRange(12, "g", "o").withColumn("pid", F.spark_partition_id())
    assert ranged.filter("g = 'hot'").select("pid").distinct().count() > 1
