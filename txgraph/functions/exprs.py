"""Scalar feature functions (X1 X3 X4 X15 X17 X18, P3) as Spark Columns."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Union

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Union[Column, str]


def to_columns(exprs: Iterable[ColumnLike] | None) -> list[Column]:
    """Accept Columns or SQL expression strings (filters, label, derived columns)."""
    out = []
    for e in exprs or ():
        out.append(F.expr(e) if isinstance(e, str) else e)
    return out


def all_true(exprs: Iterable[ColumnLike]) -> Column:
    """AND of conditions where a null condition counts as false."""
    cols = to_columns(exprs)
    if not cols:
        return F.lit(True)
    return F.coalesce(reduce(lambda a, b: a & b, cols), F.lit(False))


def signed_log(c: ColumnLike) -> Column:
    """sign(x) * ln(|x| + 1)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.signum(c) * F.log1p(F.abs(c))


def fill_null_nan(c: ColumnLike, value: float) -> Column:
    """Fill null, then NaN, and cast to double."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("double")
    return F.coalesce(F.nanvl(d, F.lit(float(value))), F.lit(float(value)))


def from_epoch(c: ColumnLike) -> Column:
    """Epoch seconds -> timestamp_ntz (UTC wall clock)."""
    c = F.col(c) if isinstance(c, str) else c
    # epoch + interval on timestamp_ntz: independent of the session time zone
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=c.cast("decimal(18,6)"))


def epoch_seconds(c: ColumnLike) -> Column:
    """timestamp_ntz -> whole epoch seconds (bigint), independent of the session zone."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("timestamp_ntz")
    return (
        F.unix_date(F.to_date(c)).cast("bigint") * 86400
        + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    ).cast("bigint")


def round6(c: ColumnLike) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)
