import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from txgraph.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8)
    yield s


# F-1 minimal sample (5 rows) and F-3 enriched sample
MINIMAL = {
    "test_id": [1, 2, 3, 4, 5],
    "test_amount": [100, 200, 300, 400, 500],
    "test_customer": ["A", "B", "C", "D", "E"],
    "test_counterparty": ["aaa", "bbb", "ccc", "ddd", "eee"],
    "test_category": ["cat_1", "cat_2", "cat_3", "cat_4", "cat_5"],
}
RANDOM_FEATURE = [0.12, 0.46, 0.64, 0.18, 0.18]


@pytest.fixture()
def minimal(spark):
    rows = list(zip(*MINIMAL.values()))
    df = spark.createDataFrame(rows, "test_id long, test_amount long, test_customer string, "
                                     "test_counterparty string, test_category string")
    return df.withColumn("category_len", __import__("pyspark.sql.functions", fromlist=["length"]).length("test_category").cast("double"))


@pytest.fixture()
def enriched(spark):
    rows = [(i, float(a), c, cp, cat, 5.0, r, lab) for i, a, c, cp, cat, r, lab in zip(
        MINIMAL["test_id"], MINIMAL["test_amount"], MINIMAL["test_customer"], MINIMAL["test_counterparty"],
        MINIMAL["test_category"], RANDOM_FEATURE, [1, 1, 0, 1, 1])]
    return spark.createDataFrame(rows, "test_id long, test_amount double, test_customer string, test_counterparty string, "
                                       "test_category string, category_len double, random_feature double, label long")
