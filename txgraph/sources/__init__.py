"""Sources and sinks (S1-S6) and the transaction views over the driver tables."""

from txgraph.sources.readers import (  # noqa: F401
    read_csv,
    read_parquet,
    read_increments_stream,
    write_csv,
    write_graph,
    write_summary,
)
from txgraph.sources.tables import event_view, table, transaction_view  # noqa: F401
