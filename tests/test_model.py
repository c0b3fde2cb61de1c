from pyspark.sql import functions as F

from txgraph.operators.model import class_weight_column, logistic_scores, score_with, train_logistic


def test_score_with_caller_function(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 2)) for i in range(50)], "id long, a double, b double")
    out = score_with(df, lambda pdf: pdf["a"] * 2 + pdf["b"], ["a", "b"], ["id"])
    got = {r["id"]: r["score"] for r in out.collect()}
    assert got == {i: 2.0 * i + (i % 2) for i in range(50)}


def test_weighted_logistic_separates(spark):
    rows = [(float(x), 1 if x > 0 else 0) for x in range(-20, 21) if x != 0]
    df = spark.createDataFrame(rows, "x double, label int")
    w = class_weight_column(df, "label", 3.0).agg(F.sum("weight")).first()[0]
    assert w == 20 * 3.0 + 20
    model = train_logistic(df, ["x"], "label", pos_weight=1.0, max_iter=50, reg=0.01)
    scored = logistic_scores(model, df, ["x"]).collect()
    assert all((r["score"] > 0) == (r["label"] == 1) for r in scored)


def test_logistic_scores_are_plain_expressions(spark):
    """No function of the model or of vectors is sent to tasks; missing features give NaN, as MLlib's raw prediction does."""
    df = spark.createDataFrame([(float(x), float(x % 3), int(x > 0)) for x in range(-9, 10)], "x double, v double, label int")
    model = train_logistic(df, ["x", "v"], "label", reg=0.1)
    out = logistic_scores(model, df.unionByName(spark.createDataFrame([(1.0, None, 1)], df.schema)), ["x", "v"])
    assert "UDF" not in out._jdf.queryExecution().optimizedPlan().toString()
    a, b, c = *model.coefficients, model.intercept
    rows = out.collect()
    assert all(abs(r["score"] - (a * r["x"] + b * r["v"] + c)) < 1e-9 for r in rows[:-1]) and rows[-1]["score"] != rows[-1]["score"]
