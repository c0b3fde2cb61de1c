"""Leak-free feature encodings.

Row-level encodings are computed over the rows of one node type (rows with a
non-null id for it); statistics use training rows only (``fit_split`` code on the
split column). Scalars (mean, std, counts) are fetched with one small aggregate
and inlined as literals, so the row-level plan stays one codegen stage.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Optional, Sequence, Union

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from txgraph.definitions import Feature, NodeDef
from txgraph.functions import fill_null_nan, signed_log
from txgraph.operators.ids import StackedKeys, attach_ids, dense_ids, running_totals

# Fixed values shared with the original pipeline.
RARE_VALUE = "RARE_VALUE"
TARGET_FALLBACK = 0.05
STD_EPSILON = 1e-12
DEFAULT_MAX_ONEHOT = 100


def _lit_double(v: Optional[float]) -> Column:
    return F.lit(None).cast("double") if v is None else F.lit(float(v))


def _clean(c: Column) -> Column:
    """Null for null or NaN (the original drops both before mean/std)."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def train_mean_std(df: DataFrame, exprs: Sequence[Column], split_col: str, fit_split: int = 0) -> list[tuple]:
    """Mean and sample std of each expression over training rows, nulls/NaN removed (A10 F14): one aggregate."""
    xs = [F.when(F.col(split_col) == fit_split, _clean(e)) for e in exprs]
    if not xs:
        return []
    row = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)], *[F.stddev_samp(x).alias(f"s{i}") for i, x in enumerate(xs)]).first()
    return [(row[f"m{i}"], row[f"s{i}"]) for i in range(len(xs))]


def standardize(expr: Column, mean: Optional[float], std: Optional[float]) -> Column:
    """(x - mean) / (std + 1e-12) (X2); unknown stats give null (later filled)."""
    return (expr - _lit_double(mean)) / (_lit_double(std) + F.lit(STD_EPSILON))


def numeric_features(df: DataFrame, features: Sequence[Feature], split_col: str, fit_split: int = 0) -> dict:
    """output name -> column: steps in list order, then fill null/NaN and cast to double (X1 X2 X3 X4). The statistics
    of all features that wait for one are fitted together, so there are as many aggregates as the longest
    chain of standardise steps (one, as a rule), however many features."""
    exprs = {f.output_name: F.col(f.source).cast("double") for f in features}
    todo = {f.output_name: list(f.steps or ()) for f in features}
    while any(todo.values()):
        for name, steps in todo.items():
            while steps and steps[0] != "standardize":
                step = steps.pop(0)
                if step != "log":  # pragma: no cover - checked in Feature
                    raise ValueError(step)
                exprs[name] = signed_log(exprs[name])
        waiting = [name for name, steps in todo.items() if steps]
        for name, (m, s) in zip(waiting, train_mean_std(df, [exprs[n] for n in waiting], split_col, fit_split)):
            exprs[name] = standardize(exprs[name], m, s)
            todo[name].pop(0)
    return {f.output_name: fill_null_nan(exprs[f.output_name], float(f.fill_value)).alias(f.output_name) for f in features}


def filled_category(f: Feature) -> Column:
    return F.coalesce(F.col(f.source).cast("string"), F.lit(str(f.fill_value)))


def ranked_category(df: DataFrame, f: Feature) -> Column:
    """The filled category in its own type, so that numbers rank as numbers; text when the fill
    value does not fit a numeric column."""
    kind = df.schema[f.source].dataType
    if isinstance(kind, NumericType) and isinstance(f.fill_value, (int, float)) and not isinstance(f.fill_value, bool):
        return F.coalesce(F.col(f.source), F.lit(f.fill_value).cast(kind))
    return filled_category(f)


def head_categories(df: DataFrame, cats: dict, k: int) -> dict:
    """name -> (its k most frequent categories, ties by value (O2); whether any are left out), for all
    columns of ``cats`` together: one count of (column, category), of which each task hands on at most k + 1 rows a
    column (A12). At most k + 1 names a column reach the driver."""
    if not cats:
        return {}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in cats.items()])).alias("x")
    counts = df.select(each).groupBy("x.name", "x.value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("name").orderBy(F.desc("n"), F.asc("value"))
    rows = counts.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1).collect()
    found: dict = {n: [] for n in cats}
    for r in sorted(rows, key=lambda r: r["i"]):
        found[r["name"]].append(r["value"])
    return {n: (v[:k], len(v) > k) for n, v in found.items()}


def onehot_by_source(df: DataFrame, features: Sequence[Feature], k: int = DEFAULT_MAX_ONEHOT) -> dict:
    """source column -> its (name, column) list: rare collapse + one-hot with the smallest surviving
    category dropped (X6 X7), the heads of all features from one count."""
    cats = {f.source: filled_category(f) for f in features}
    out: dict = {}
    for source, (top, has_rare) in head_categories(df, cats, k).items():
        cat = cats[source]
        collapsed = F.when(cat.isin(top), cat).otherwise(F.lit(RARE_VALUE)) if has_rare else cat
        values = sorted(set(top) | ({RARE_VALUE} if has_rare else set()))
        out[source] = [(f"{source}_{v}", (collapsed == F.lit(v)).cast("double")) for v in values[1:]]
    return out


def onehot_columns(df: DataFrame, f: Feature, k: int = DEFAULT_MAX_ONEHOT) -> list[tuple[str, Column]]:
    """``onehot_by_source`` of one feature."""
    return onehot_by_source(df, [f], k)[f.source]


def label_encodings(df: DataFrame, features: Sequence[Feature]) -> tuple[DataFrame, list[str]]:
    """1-based dense rank of each feature's category (X8 W7); with the step ``label_norm`` divided by the
    number of categories (X9 W8). The categories of all features are ranked in one pass."""
    cats = {f.output_name: ranked_category(df, f) for f in features}
    with_cats = df.withColumns({f"_cat_{n}": c for n, c in cats.items()})
    stacked = StackedKeys(with_cats, {n: [f"_cat_{n}"] for n in cats})
    ranks, how_many = stacked.number(stacked.rows.distinct())
    out = with_cats
    for f in features:
        n = f.output_name
        table = ranks[n].toDF(f"_cat_{n}", "_rank")
        value = (F.col("_rank") + 1).cast("double")
        if "label_norm" in (f.steps or ()):
            value = value / F.lit(float(max(how_many[n], 1)))
        out = attach_ids(out, table, [f"_cat_{n}"], "_rank", null_safe=False).withColumn(n, value).drop("_rank", f"_cat_{n}")
    return out, list(cats)


def label_encoding(df: DataFrame, f: Feature, id_col: str, normalise: bool) -> tuple[DataFrame, str]:
    """``label_encodings`` of one feature, normalised or not."""
    out, names = label_encodings(df, [replace(f, steps=("label_norm" if normalise else "label",))])
    return out, names[0]


def target_encoding(df: DataFrame, f: Feature, label_col: str, split_col: str,
                    order_cols: Sequence[str], fit_split: int = 0, train_mean: Optional[tuple] = None) -> tuple[DataFrame, str]:
    """Mean training label of strictly earlier rows of the same category.

    Falls back to the training label mean (``train_mean``: a one-tuple with it, if known), then 0.05. Later
    labels never leak.
    """
    cat_col = f"_cat_{f.source}"
    y = _clean(F.col(label_col))
    is_fit = F.col(split_col) == fit_split
    train_mean = df.agg(F.avg(F.when(is_fit, y))).first()[0] if train_mean is None else train_mean[0]
    with_cat = df.withColumn(cat_col, filled_category(f))
    run = running_totals(
        with_cat, [cat_col], list(order_cols),
        {"_sum_y": F.when(is_fit & y.isNotNull(), y).otherwise(F.lit(0.0)),
         "_cnt_y": F.when(is_fit & y.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")},
        inclusive=False,
    )
    mean = F.when(F.col("_cnt_y") > 0, F.col("_sum_y") / F.col("_cnt_y"))
    name = f.output_name
    value = F.coalesce(mean, _lit_double(train_mean), F.lit(TARGET_FALLBACK)).cast("double")
    return run.withColumn(name, value).drop("_sum_y", "_cnt_y", cat_col), name


@dataclass
class EncodedRows:
    df: DataFrame
    feature_cols: list[str]


def encode_node_features(
    rows: DataFrame,
    node: NodeDef,
    id_col: str,
    *,
    label_col: str = "label",
    split_col: str = "split_full",
    order_cols: Sequence[str] = ("timestamp",),
    max_onehot: int = DEFAULT_MAX_ONEHOT,
    fit_split: int = 0,
) -> EncodedRows:
    """Per-feature dispatch (X14): rows of one node type -> row-level feature columns, in the order of the
    features. What is fitted is fitted for all features of a kind together: one aggregate for means and deviations, one for
    category heads, one ranking for labels, one mean label; only target encodings run on their own."""
    df = rows
    kinds: dict = {"numeric": [], "onehot": [], "label": [], "target": [], None: []}
    for f in node.features:
        if f.kind not in ("numeric", "categorical"):  # pragma: no cover - rejected by Feature
            raise ValueError(f.kind)
        step = (f.steps or (None,))[0]
        kinds["numeric" if f.kind == "numeric" else "label" if step in ("label", "label_norm") else step].append(f)
    plain = numeric_features(df, kinds["numeric"], split_col, fit_split) | {f.output_name: filled_category(f) for f in kinds[None]}
    hot = onehot_by_source(df, kinds["onehot"], max_onehot)
    if kinds["label"]:
        df, _ = label_encodings(df, kinds["label"])
    if kinds["target"]:
        mean = (df.agg(F.avg(F.when(F.col(split_col) == fit_split, _clean(F.col(label_col))))).first()[0],)
        for f in kinds["target"]:
            df, _ = target_encoding(df, f, label_col, split_col, order_cols, fit_split, mean)
    names: list[str] = []
    for f in node.features:
        names += [n for n, _ in hot[f.source]] if f in kinds["onehot"] else [f.output_name]
    plain |= {n: c for cols in hot.values() for n, c in cols}
    return EncodedRows(df.withColumns(plain) if plain else df, names)


# ---------------------------------------------------------------------------
# Row-wise (positional-split) preprocessing: fitted scaler and ordinal encoder.
# ---------------------------------------------------------------------------


@dataclass
class Scaler:
    """Per-column mean and population std of the values that are neither null nor NaN; a zero std
    scales by 1 (A14)."""

    stats: dict

    def transform(self, df: DataFrame) -> DataFrame:
        """z-score columns in place (X11)."""
        return df.withColumns({
            c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()
        })


def fit_scaler(df: DataFrame, columns: Sequence[str], ddof: int = 0) -> Scaler:
    if not columns:
        return Scaler({})
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = df.agg(*[F.avg(_clean(F.col(c))).alias(f"m_{i}") for i, c in enumerate(columns)],
                 *[std(_clean(F.col(c))).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
    stats = {}
    for i, c in enumerate(columns):
        m = row[f"m_{i}"] or 0.0
        s = row[f"s_{i}"]
        stats[c] = (float(m), 1.0 if (s is None or s == 0.0) else float(s))
    return Scaler(stats)


@dataclass
class OrdinalEncoder:
    """Sorted distinct categories per column -> 0..k-1; unseen and missing -> -1."""

    tables: dict  # column -> DataFrame(value, code)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, t in self.tables.items():
            code = f"_code_{c}"
            t2 = t.select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(code))
            out = out.join(t2, out[c] == t2[f"_v_{c}"], "left").drop(f"_v_{c}")
            out = out.withColumn(c, F.coalesce(F.col(code), F.lit(-1)).cast("double")).drop(code)
        return out


def fit_ordinal(df: DataFrame, columns: Sequence[str]) -> OrdinalEncoder:
    tables = {}
    for c in columns:
        vals = df.select(F.col(c).alias("value")).filter(F.col("value").isNotNull())
        tables[c] = dense_ids(vals, ["value"], "code")
    return OrdinalEncoder(tables)


def imbalance_table(df: DataFrame, label_col: str) -> DataFrame:
    """One row, imbalance_ratio: negatives / positives (A13 M3); null when there are no positives."""
    y = F.col(label_col).cast("double")
    pos = F.sum(F.when(y != 0, 1).otherwise(0)).cast("double")
    neg = F.sum(F.when(y == 0, 1).otherwise(0)).cast("double")
    return df.agg(F.when(pos > 0, neg / pos).alias("imbalance_ratio"))


def imbalance_ratio(df: DataFrame, label_col: str) -> Optional[float]:
    """``imbalance_table`` as a number; None when there are no positives."""
    return imbalance_table(df, label_col).first()[0]
