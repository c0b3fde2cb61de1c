"""Driver tables and the transaction / event views used as graph input."""

from __future__ import annotations

from typing import Iterable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgraph.functions import epoch_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_MERCHANT = {"merchant", "first_order_merchant"}
_FIRST = {"first_order_date", "first_order_merchant"}
_CUSTOMER = {"city", "job", "city_pop"}


def transaction_view(spark: SparkSession, sf_dir: str, columns: Optional[Iterable[str]] = None) -> DataFrame:
    """Card-transaction shaped view over orders, customer, nation and lineitem.

    trans_num=o_orderkey, cc_num=o_custkey, amt=o_totalprice, category=o_orderpriority,
    ts=o_orderdate, label = 1 for 'F', 0 for 'O', null otherwise; customer identity
    attributes from customer/nation plus derived ones; merchant = smallest l_suppkey.

    With ``columns`` only the tables behind these columns are read and joined: a left join of another
    table would cost its shuffle although nothing of it is used.
    """
    want = None if columns is None else set(columns)
    needs = lambda names: want is None or bool(want & names)
    v = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    if needs(_MERCHANT):
        # partial (map-side) aggregation shrinks lineitem to one row per order before the shuffle
        merchant = (table(spark, sf_dir, "lineitem")
                    .groupBy("l_orderkey").agg(F.min("l_suppkey").alias("merchant")))
        v = v.join(merchant, v.o_orderkey == merchant.l_orderkey, "left").drop("l_orderkey")
    first = None
    if needs(_FIRST):
        aggs = [F.to_date(F.min("o_orderdate")).alias("first_order_date")]
        if needs({"first_order_merchant"}):
            aggs.append(F.min_by("merchant", F.struct("o_orderdate", "o_orderkey")).alias("first_order_merchant"))
        first = v.groupBy(F.col("o_custkey").alias("f_custkey")).agg(*aggs)
    if needs(_CUSTOMER):
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
        # nation is a fixed 25-row dimension: broadcasting it is size-bounded by definition
        nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
        cust = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        v = v.join(cust, v.o_custkey == cust.c_custkey, "left")
    if first is not None:
        v = v.join(first, v.o_custkey == first.f_custkey, "left")
    cc = F.col("o_custkey")
    made = {
        "trans_num": F.col("o_orderkey"),
        "cc_num": cc,
        "amt": F.col("o_totalprice"),
        "category": F.col("o_orderpriority"),
        "ts": F.col("o_orderdate"),
        "timestamp": epoch_seconds("o_orderdate"),
        "label": F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(F.lit(None)).cast("int"),
        "city": F.col("n_name"),
        "job": F.col("c_mktsegment"),
        "city_pop": F.col("c_acctbal"),
        "last": F.concat(F.lit("L"), (cc % 97).cast("string")),
        "dob": F.date_add(F.lit("1950-01-01").cast("date"), ((cc * 37) % 18000).cast("int")),
        "merchant": F.col("merchant"),
        "first_order_date": F.col("first_order_date"),
        "first_order_merchant": F.col("first_order_merchant"),
    }
    return v.select(*[c.alias(n) for n, c in made.items() if want is None or n in want])


# DuckDB twin of transaction_view (same column names and values).
TX_VIEW_SQL = """
tx AS (
  SELECT o.o_orderkey AS trans_num, o.o_custkey AS cc_num, o.o_totalprice AS amt,
         o.o_orderpriority AS category, o.o_orderdate AS ts,
         CAST(epoch(o.o_orderdate) AS BIGINT) AS "timestamp",
         CAST(CASE WHEN o.o_orderstatus = 'F' THEN 1 WHEN o.o_orderstatus = 'O' THEN 0 END AS INTEGER) AS label,
         n.n_name AS city, c.c_mktsegment AS job, c.c_acctbal AS city_pop,
         'L' || CAST(o.o_custkey % 97 AS VARCHAR) AS "last",
         CAST(DATE '1950-01-01' + CAST((o.o_custkey * 37) % 18000 AS INTEGER) AS DATE) AS dob,
         m.merchant, f.first_order_date, f.first_order_merchant
  FROM orders o
  LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS merchant FROM lineitem GROUP BY l_orderkey) m
         ON o.o_orderkey = m.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN (
     SELECT o2.o_custkey,
            CAST(min(o2.o_orderdate) AS DATE) AS first_order_date,
            arg_min_null(m2.merchant, (o2.o_orderdate, o2.o_orderkey)) AS first_order_merchant
     FROM orders o2
     LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS merchant FROM lineitem GROUP BY l_orderkey) m2
            ON o2.o_orderkey = m2.l_orderkey
     GROUP BY o2.o_custkey) f ON o.o_custkey = f.o_custkey
)
"""


def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a transaction table: event -> user -> property; label = error event."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", "user_id", "event_type", "value", "props",
        epoch_seconds("ts").alias("timestamp"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


EVENT_VIEW_SQL = """
ev AS (
  SELECT event_id, ts, user_id, event_type, "value", props,
         CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp",
         CAST(event_type = 'error' AS INTEGER) AS label
  FROM events
)
"""
