"""Headline-query benchmark: prints one JSON line.

Runs registered queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS]; each query is executed to completion through the ``noop``
sink (the whole plan runs, nothing is collected). One warm-up pass, then the
median of $BENCH_REPEAT timed passes per query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from txgraph.plans.registry import QUERIES  # noqa: E402
from txgraph.session import local_session  # noqa: E402

HEADLINE = [
    "node_ids_composite",          # W3 dense ids
    "customer_nodes",              # G3 node table with standardised features
    "transaction_nodes",           # G3 + one-hot + labels
    "edges_mono_customer",         # G4 transactions sharing a customer
    "edges_mono_weighted_nation",  # G4 weighted customer-customer edges by nation
    "preset_edge_centric",         # G6 full build + catalogue
    "feat_target",                 # W6 leak-free target encoding
    "stream_graph_features",       # T3 native streaming features
    "pr_curve",                    # E6
    "prequential_scores",          # T4
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=parts, app="txgraph-bench")
    results = {}
    for name in only:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        times = []
        for _ in range(repeat):
            spark.catalog.clearCache()  # operators persist their inputs; a timed pass starts cold
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        results[name] = round(statistics.median(times), 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(results.values()), 3), "unit": "sec",
                      "queries": results, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
