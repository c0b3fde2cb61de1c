"""Column-expression helpers (all JVM-side built-ins; no Python UDFs)."""

from txgraph.functions.exprs import (  # noqa: F401
    all_true,
    epoch_seconds,
    fill_null_nan,
    from_epoch,
    round6,
    signed_log,
    to_columns,
)
