"""Row-wise graph with positional splits and increments.

State is a set of append-only tables keyed by node id (never by arrival order): ``keys[ntype]``
(key, node_id), ``features[ntype]`` (node_id, feats...), ``edges[triple]`` (src, dst, row_index), ``labels``
(node_id, label). ``update`` is a pure function (state, increment) -> state that writes the increment's
rows and shares all older folders; state keys are scanned for the increment's keys, not shuffled or rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.definitions import ColumnGraphDefinition, DefinitionError
from txgraph.operators.deltas import DeltaTable
from txgraph.operators.features import fit_ordinal, fit_scaler, imbalance_ratio
from txgraph.operators.ids import attach_ids, dense_ids, pin, releasing
from txgraph.operators.nodes import first_row_features
from txgraph.operators.splits import positional_split, split_view
from txgraph.session import scratch_path

MAX_PARTS = 16  # folders of a table before ``update`` merges the small ones


@dataclass
class TabularTable:
    """A table with declared column roles, a row index and a positional split mask."""

    df: DataFrame
    numeric: list = field(default_factory=list)
    categorical: list = field(default_factory=list)
    text: list = field(default_factory=list)

    @classmethod
    def create(cls, df: DataFrame, order_cols: Sequence[str], ratios: Sequence[float],
               required_columns: Optional[Sequence[str]] = None, numeric=(), categorical=(), text=()) -> "TabularTable":
        roles = [set(numeric), set(categorical), set(text)]
        for i in range(3):
            for j in range(i + 1, 3):
                if roles[i] & roles[j]:
                    raise DefinitionError(f"column roles overlap: {roles[i] & roles[j]}")
        cols = list(dict.fromkeys(list(required_columns or df.columns) + list(order_cols)))
        return cls(positional_split(df.select(*cols), order_cols, ratios), list(numeric), list(categorical), list(text))

    def view(self, which: str) -> DataFrame:
        return split_view(self.df, which)

    def imbalance_ratio(self, label_col: str) -> Optional[float]:
        return imbalance_ratio(self.view("train"), label_col)

    def preprocess(self) -> "TabularTable":
        """Scaler fitted on train rows (population std), encoder on the whole table."""
        scaler = fit_scaler(self.view("train"), self.numeric, ddof=0)
        encoder = fit_ordinal(self.df, self.categorical)
        return replace(self, df=encoder.transform(scaler.transform(self.df)))


@dataclass(frozen=True)
class DynamicGraph:
    definition: ColumnGraphDefinition
    key_table: dict = field(default_factory=dict)      # ntype -> DeltaTable(key, node_id)
    feature_table: dict = field(default_factory=dict)  # ntype -> DeltaTable(node_id, feats...), newest row of a node
    edge_table: dict = field(default_factory=dict)     # triple -> DeltaTable(src, dst, row_index)
    label_table: Optional[DeltaTable] = None           # DeltaTable(node_id, label), first label of a node
    num_nodes: dict = field(default_factory=dict)
    version: int = 0

    @property
    def keys(self) -> dict:
        return {t: d.read() for t, d in self.key_table.items()}

    @property
    def features(self) -> dict:
        return {t: d.read() for t, d in self.feature_table.items()}

    @property
    def edges(self) -> dict:
        return {et: d.read() for et, d in self.edge_table.items()}

    @property
    def labels(self) -> Optional[DataFrame]:
        return None if self.label_table is None else self.label_table.read()

    # -- build (G7) -------------------------------------------------------
    @classmethod
    def build(cls, rows: DataFrame, definition: ColumnGraphDefinition, order_col: str = "row_index") -> "DynamicGraph":
        with releasing():
            keys = {t: DeltaTable.create(dense_ids(rows.select(col).filter(F.col(col).isNotNull()), [col], "node_id"), f"keys-{t}")
                    for t, col in definition.column_of_type.items()}
            g = cls(definition, keys, num_nodes={t: k.rows for t, k in keys.items()})
            parts = g._parts(rows, g.keys, order_col)
        return cls(definition, keys, {t: DeltaTable.create(df, f"features-{t}", ["node_id"]) for t, df in parts["features"].items()},
                   {et: DeltaTable.create(df, "edges-" + et[1]) for et, df in parts["edges"].items()},
                   None if parts["labels"] is None else DeltaTable.create(parts["labels"], "labels", ["node_id"], "oldest"), g.num_nodes)

    def _parts(self, rows: DataFrame, keys: dict, order_col: str) -> dict:
        """What the rows add to each table. The rows with their ids are written once and read by all of them."""
        d = self.definition
        for t, col in d.column_of_type.items():
            rows = attach_ids(rows, keys[t].withColumnRenamed("node_id", f"{col}__id"), [col], f"{col}__id", null_safe=False)
        read = [f"{c}__id" for c in d.column_of_type.values()] + [c for f in d.node_features.values() for c in f] + [order_col] + ([d.label_col] if d.label_col else [])
        path = scratch_path(rows.sparkSession, "rows-with-ids")
        rows = rows.select(*dict.fromkeys(read))
        rows.write.parquet(path)
        rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
        return {"features": {d.node_type(c): first_row_features(rows, f"{c}__id", feats, order_col) for c, feats in d.node_features.items()},
                "edges": {et: _edges(rows, d, et, order_col) for et in d.edges},
                "labels": _labels(rows, d, order_col) if d.label_col is not None else None}

    # -- increments (G8) ----------------------------------------------------
    def update(self, incr: DataFrame, order_col: str = "row_index", max_parts: int = MAX_PARTS) -> "DynamicGraph":
        """With one increment folded in: unseen keys get the next ids in key order, known nodes take the increment's
        first row (J6 U2), edges and labels of new nodes are added. Written are the increment's rows; tables with
        more than ``max_parts`` folders merge their small ones."""
        v, num, keys, ids = self.version + 1, dict(self.num_nodes), {}, {}
        with releasing():
            for t, col in self.definition.column_of_type.items():
                table = self.key_table[t]
                incoming = pin(incr.select(col).filter(F.col(col).isNotNull()).distinct())  # read for known and for new keys
                path = scratch_path(incr.sparkSession, f"known-{t}")
                table.read().join(incoming, col).select(col, "node_id").write.parquet(path)  # of the state only the increment's keys
                known = incr.sparkSession.read.schema(table.schema).parquet(path)
                new = incoming.join(known, col, "left_anti")
                keys[t] = table.append(dense_ids(new, [col], "node_id", offset=num[t], assume_distinct=True), v)
                num[t] += keys[t].last_rows
                ids[t] = known.select(col, "node_id").unionByName(keys[t].raw(keys[t].parts[-1:]).select(col, "node_id"))
            parts = self._parts(incr, ids, order_col)
        add = lambda tables, new: {k: d.append(new[k], v) for k, d in tables.items()}
        labels = None if self.label_table is None else self.label_table.append(parts["labels"], v)
        return replace(self, key_table=keys, feature_table=add(self.feature_table, parts["features"]), edge_table=add(self.edge_table, parts["edges"]),
                       label_table=labels, num_nodes=num, version=v).compact(max_parts)

    def compact(self, max_parts: int = 1) -> "DynamicGraph":
        """The same graph in fewer folders (all tables with more than ``max_parts``)."""
        small = lambda tables: {k: d.compact(max_parts) for k, d in tables.items()}
        return replace(self, key_table=small(self.key_table), feature_table=small(self.feature_table), edge_table=small(self.edge_table),
                       label_table=self.label_table and self.label_table.compact(max_parts))

    @property
    def tables(self) -> list[DeltaTable]:
        return [*self.key_table.values(), *self.feature_table.values(), *self.edge_table.values(), *([self.label_table] if self.label_table else [])]

    # -- views (G9 G17) -----------------------------------------------------
    def homogeneous(self) -> tuple[DataFrame, DataFrame]:
        """One id space: types sorted by name, cumulative offsets, block-padded features.

        Returns nodes (hid, ntype, orig_id, x_0..x_{F-1}, label) and edges
        (src, dst, etype, orig_eid).
        """
        d = self.definition
        types = sorted(self.num_nodes)
        widths = {t: len(d.node_features.get(d.column_of_type[t], [])) for t in types}
        total = sum(widths.values())
        parts, off, foff = [], 0, 0
        label_type = d.label_node_type
        for t in types:
            feats = d.node_features.get(d.column_of_type[t], [])
            ids = self.keys[t].select("node_id")
            x = ids.join(self.features[t], "node_id", "left") if feats else ids
            cols = [F.lit(0.0)] * total
            for i, c in enumerate(feats):
                cols[foff + i] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            if t == label_type and self.labels is not None:
                x = x.join(self.labels, "node_id", "left")
                lab = F.coalesce(F.col("label").cast("double"), F.lit(0.0))
            else:
                lab = F.lit(0.0)
            parts.append(x.select((F.col("node_id") + F.lit(off)).alias("hid"), F.lit(t).alias("ntype"),
                                  F.col("node_id").alias("orig_id"),
                                  *[c.alias(f"x_{i}") for i, c in enumerate(cols)], lab.alias("label")))
            off += self.num_nodes[t]
            foff += widths[t]
        nodes = parts[0]
        for p in parts[1:]:
            nodes = nodes.unionByName(p)
        offsets, acc = {}, 0
        for t in types:
            offsets[t] = acc
            acc += self.num_nodes[t]
        eparts = []
        for (s, r, dd), e in self.edges.items():
            eparts.append(e.select((F.col("src") + F.lit(offsets[s])).alias("src"),
                                   (F.col("dst") + F.lit(offsets[dd])).alias("dst"),
                                   F.lit(r).alias("etype"), F.col("row_index").alias("orig_eid")))
        edges = eparts[0]
        for p in eparts[1:]:
            edges = edges.unionByName(p)
        return nodes, edges

    def edge_frames(self) -> dict:
        return {et: e.select("src", "dst") for et, e in self.edges.items()}


def _edges(with_ids: DataFrame, d: ColumnGraphDefinition, etype, order_col: str) -> DataFrame:
    s, t = d.edges[etype]
    return (with_ids.select(F.col(f"{s}__id").alias("src"), F.col(f"{t}__id").alias("dst"),
                            F.col(order_col).alias("row_index"))
            .na.drop(subset=["src", "dst"]))


def _labels(with_ids: DataFrame, d: ColumnGraphDefinition, order_col: str) -> DataFrame:
    c = d.label_node_col
    return (with_ids.filter(F.col(f"{c}__id").isNotNull())
            .groupBy(F.col(f"{c}__id").alias("node_id"))
            .agg(F.min_by(F.col(d.label_col).cast("double"), F.col(order_col)).alias("label")))
