from datetime import date, datetime

from pyspark.sql import functions as F

from txgraph.operators.splits import (SplitSettings, add_split_codes, num_batches, positional_split,
                                      resolve_split, row_batches, split_view)


def test_resolve_split_dates():
    s = resolve_split(SplitSettings(date(2024, 1, 1), date(2024, 1, 31), 2, 5))
    assert s.to_test == date(2024, 1, 29) and s.from_test == date(2024, 1, 24)
    assert s.to_validation == s.from_test and s.from_validation == date(2024, 1, 19)
    assert s.to_train_full == date(2024, 1, 22) and s.to_train_hpo == date(2024, 1, 17)
    assert s.report()["TEST"] == (s.from_test, s.to_test)


def test_boundary_midnight_inclusive(spark):
    s = resolve_split(SplitSettings(date(2024, 1, 1), date(2024, 1, 31), 2, 5))
    rows = [(1, datetime(2024, 1, 24, 0, 0, 0)), (2, datetime(2024, 1, 24, 0, 0, 1)),
            (3, datetime(2024, 1, 29, 0, 0, 0)), (4, datetime(2024, 1, 29, 0, 0, 1)),
            (5, datetime(2024, 1, 20, 0, 0, 0))]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    got = {r["id"]: (r["split_hpo"], r["split_full"]) for r in add_split_codes(df, s, "ts").collect()}
    assert got[1] == (1, 2)      # shared boundary: validation in tuning, test in full
    assert got[2] == (2, 2)
    assert got[3] == (2, 2)
    assert got[4] == (3, 3)      # one second after to_test: none
    assert got[5] == (1, 0)      # full training covers the tuning validation period


def test_positional_split_counts(spark, minimal):
    t = positional_split(minimal, ["test_id"], (0.5, 0.25, 0.25))
    masks = [r["train_val_test_mask"] for r in t.orderBy("row_index").collect()]
    assert masks == ["train"] * 3 + ["val", "test"]
    t2 = positional_split(minimal, ["test_id"], (0.7, 0.15, 0.15))
    assert split_view(t2, "train").count() == 4 and split_view(t2, "val").count() == 1
    assert split_view(t2, "test").count() == 0
    assert [r["row_index"] for r in t.orderBy("test_id").collect()] == [0, 1, 2, 3, 4]


def test_row_batches_of_one(spark, minimal):
    t = positional_split(minimal, ["test_id"], (0.5, 0.25, 0.25))
    b = row_batches(t, 1)
    assert [(r["batch_id"], r["test_id"]) for r in b.orderBy("batch_id").collect()] == [(i, i + 1) for i in range(5)]
    assert num_batches(t, 1) == 5 and num_batches(t, 2) == 3
