"""Date and positional splits, filters and row batches."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from typing import Iterable, Optional, Sequence, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txgraph.functions import all_true, to_columns
from txgraph.operators.ids import row_index

TRAIN, VALIDATION, TEST, NONE = 0, 1, 2, 3
MASK_VALUES = ("train", "val", "test")


@dataclass(frozen=True)
class SplitSettings:
    """from/to may be dates or Column expressions evaluated on the table (one agg)."""

    from_date: Union[date, Column, str]
    to_date: Union[date, Column, str]
    gap_days: int
    eval_days: int


@dataclass(frozen=True)
class DateSplit:
    from_date: date
    to_train_hpo: date
    to_train_full: date
    from_validation: date
    to_validation: date
    from_test: date
    to_test: date

    def report(self) -> dict:
        """Split name -> (from, to), inclusive (P10)."""
        return {
            "TRAIN_HYPERPARAM_OPT": (self.from_date, self.to_train_hpo),
            "TRAIN_FULL": (self.from_date, self.to_train_full),
            "VALIDATION": (self.from_validation, self.to_validation),
            "TEST": (self.from_test, self.to_test),
        }


def _as_date(v) -> date:
    if isinstance(v, datetime):
        return v.date()
    if isinstance(v, date):
        return v
    return date.fromisoformat(str(v)[:10])


def resolve_split(settings: SplitSettings, df: Optional[DataFrame] = None) -> DateSplit:
    """Seven split dates from settings (P7 X16). Column bounds need ``df``: one small agg."""
    bounds = {}
    exprs = {}
    for name in ("from_date", "to_date"):
        v = getattr(settings, name)
        if isinstance(v, (Column, str)) and not _looks_like_date(v):
            exprs[name] = to_columns([v])[0]
        else:
            bounds[name] = _as_date(v)
    if exprs:
        if df is None:
            raise ValueError("expression split bounds need the table")
        row = df.agg(*[F.to_date(e).alias(k) for k, e in exprs.items()]).first()
        for k in exprs:
            bounds[k] = _as_date(row[k])
    gap, ev = timedelta(days=settings.gap_days), timedelta(days=settings.eval_days)
    to_test = bounds["to_date"] - gap
    from_test = to_test - ev
    to_val = from_test
    from_val = to_val - ev
    return DateSplit(
        from_date=bounds["from_date"],
        to_train_hpo=from_val - gap,
        to_train_full=from_test - gap,
        from_validation=from_val,
        to_validation=to_val,
        from_test=from_test,
        to_test=to_test,
    )


def _looks_like_date(v) -> bool:
    if not isinstance(v, str):
        return False
    try:
        date.fromisoformat(v[:10])
        return len(v) == 10
    except ValueError:
        return False


def _ts(d: date) -> Column:
    """Date as midnight timestamp_ntz literal: bounds compare as midnight, inclusive."""
    return F.lit(d.isoformat()).cast("date").cast("timestamp_ntz")


def between_dates(c: Union[str, Column], lo: date, hi: date) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.between(_ts(lo), _ts(hi))


def date_window_filter(df: DataFrame, split: DateSplit, datetime_col: str) -> DataFrame:
    """Rows in [from_date, to_test] (F1). Filter the raw column so Parquet stats apply."""
    return df.filter(between_dates(datetime_col, split.from_date, split.to_test))


def apply_filters(df: DataFrame, filters: Optional[Iterable] = None) -> DataFrame:
    """User filters AND-ed (F2); each may be a Column or SQL string."""
    cols = to_columns(filters)
    for c in cols:
        df = df.filter(c)
    return df


def tag_inference(df: DataFrame, filters: Optional[Iterable] = None, col: str = "is_inference") -> DataFrame:
    """Scoring-eligibility tag (F3): true where all scoring filters hold."""
    return df.withColumn(col, all_true(filters) if filters else F.lit(True))


def split_code_hpo(datetime_col: str, s: DateSplit) -> Column:
    """Tuning split code (P8): validation is tested before test at the shared boundary."""
    return (F.when(between_dates(datetime_col, s.from_date, s.to_train_hpo), F.lit(TRAIN))
            .when(between_dates(datetime_col, s.from_validation, s.to_validation), F.lit(VALIDATION))
            .when(between_dates(datetime_col, s.from_test, s.to_test), F.lit(TEST))
            .otherwise(F.lit(NONE)))


def split_code_full(datetime_col: str, s: DateSplit) -> Column:
    """Full-training split code (P9): 0 train, 2 test, 3 gap."""
    return (F.when(between_dates(datetime_col, s.from_date, s.to_train_full), F.lit(TRAIN))
            .when(between_dates(datetime_col, s.from_test, s.to_test), F.lit(TEST))
            .otherwise(F.lit(NONE)))


def add_split_codes(df: DataFrame, s: DateSplit, datetime_col: str,
                    hpo_col: str = "split_hpo", full_col: str = "split_full") -> DataFrame:
    return df.withColumns({hpo_col: split_code_hpo(datetime_col, s), full_col: split_code_full(datetime_col, s)})


def epoch_window_filter(df: DataFrame, split: DateSplit, epoch_col: str) -> DataFrame:
    """``date_window_filter`` on a column of epoch seconds: the same rows through integer bounds, which reach
    the Parquet reader where a comparison of the derived datetime cannot (F1 P3)."""
    seconds = lambda d: (d - date(1970, 1, 1)).days * 86400
    return df.filter(F.col(epoch_col).between(F.lit(seconds(split.from_date)), F.lit(seconds(split.to_test))))


def split_summary(df: DataFrame, split_cols: Sequence[str], label_col: str, datetime_col: str) -> DataFrame:
    """Per split code (or codes): rows, positives, first and last datetime (P10)."""
    return df.groupBy(*split_cols).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.sum(F.coalesce(F.col(label_col), F.lit(0))).cast("bigint").alias("n_pos"),
        F.min(datetime_col).alias("first_ts"),
        F.max(datetime_col).alias("last_ts"),
    )


def with_row_index(df: DataFrame, order_cols: Sequence[str], col: str = "row_index") -> DataFrame:
    """0-based row index in a declared total order (P6), without a global window."""
    return row_index(df, order_cols, col)


def check_ratios(ratios: Sequence[float]) -> None:
    if len(ratios) != 3 or abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError(f"train/val/test ratios must be three numbers summing to 1, got {ratios}")


def positional_mask(n_rows: int, ratios: Sequence[float], index_col: str = "row_index") -> Column:
    """'train' / 'val' / 'test' by position (P11); ``<=`` on a 0-based index."""
    check_ratios(ratios)
    _, val, test = ratios
    idx = F.col(index_col)
    return (F.when(idx <= F.lit(n_rows * (1 - test - val)), F.lit("train"))
            .when(idx <= F.lit(n_rows * (1 - test)), F.lit("val"))
            .otherwise(F.lit("test")))


def positional_split(df: DataFrame, order_cols: Sequence[str], ratios: Sequence[float],
                     index_col: str = "row_index", mask_col: str = "train_val_test_mask") -> DataFrame:
    """Row index + positional train/val/test mask (P6 P11). One count action."""
    check_ratios(ratios)
    n = df.count()
    return with_row_index(df, order_cols, index_col).withColumn(mask_col, positional_mask(n, ratios, index_col))


def split_view(df: DataFrame, which: str, mask_col: str = "train_val_test_mask") -> DataFrame:
    """train / val / test view."""
    if which not in MASK_VALUES:
        raise ValueError(f"unknown split {which!r}")
    return df.filter(F.col(mask_col) == which)


def row_batches(df: DataFrame, batch_size: int, index_col: str = "row_index", batch_col: str = "batch_id") -> DataFrame:
    """batch id = (row_index - min) div size (T1 F7 A3): min is one small agg."""
    if batch_size < 1:
        raise ValueError("batch size must be positive")
    lo = df.agg(F.min(index_col)).first()[0]
    lo = 0 if lo is None else int(lo)
    return df.withColumn(batch_col, F.floor((F.col(index_col) - F.lit(lo)) / F.lit(batch_size)).cast("bigint"))


def batch_count(df: DataFrame, batch_size: int, index_col: str = "row_index") -> DataFrame:
    """One row, n_batches: batches that ``row_batches`` forms, gaps in the index included."""
    span = F.max(index_col) - F.min(index_col)
    return df.agg(F.coalesce(F.floor(span / F.lit(batch_size)) + 1, F.lit(0)).cast("bigint").alias("n_batches"))


def num_batches(df: DataFrame, batch_size: int, index_col: str = "row_index") -> int:
    """``batch_count`` as a number."""
    return batch_count(df, batch_size, index_col).first()[0]
