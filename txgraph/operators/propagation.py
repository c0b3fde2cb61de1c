"""Linear message passing over edge lists and over shared values.

Nodes that share a value form a clique whose edges are quadratic in its size. A sum over such
neighbours needs no pair: it is the value's total minus the node's own part. A mean divides by
the value's weight minus the node's own, and the symmetric normalisation 1 / sqrt(deg_src * deg_dst)
splits into a factor on each side, so both stay sums over rows of (node, value).

``propagate`` repeats this over k hops and all relations: the feature table of a linear graph
network without a training loop, one written table per node type and hop.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Optional, Sequence, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txgraph.session import scratch_path


@dataclass(frozen=True)
class EdgeList:
    """Explicit edges ``src -> dst`` [with a weight column]."""

    src_type: str
    relation: str
    dst_type: str
    edges: DataFrame
    weight: Optional[str] = None


@dataclass(frozen=True)
class Clique:
    """Nodes of one type linked when they share a value: distinct (node_id, value) rows. With a weight
    column a pair weighs the product of its two weights. Neighbours that share several values count once
    for each, as in the weighted edge list."""

    node_type: str
    relation: str
    members: DataFrame
    weight: Optional[str] = None

    @property
    def src_type(self) -> str:
        return self.node_type

    @property
    def dst_type(self) -> str:
        return self.node_type


Relation = Union[EdgeList, Clique]


def clique(rows: DataFrame, node_type: str, relation: str, node_id: str, value: str) -> Clique:
    """Clique of the nodes on rows that share ``value``; nulls link nothing."""
    pairs = rows.select(F.col(node_id).alias("node_id"), F.col(value).alias("value")).na.drop().distinct()
    return Clique(node_type, relation, pairs)


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _edge_messages(r: EdgeList, x: DataFrame, feats: list, how: str) -> DataFrame:
    w = F.col(r.weight).cast("double") if r.weight and r.weight in r.edges.columns else F.lit(1.0)
    e = r.edges.select("src", "dst", w.alias("_w"))
    if how == "gcn":
        d_out = e.groupBy("src").agg(F.sum("_w").alias("_dout"))
        d_in = e.groupBy("dst").agg(F.sum("_w").alias("_din"))
        e = e.join(d_out, "src").join(d_in, "dst").withColumn("_w", F.col("_w") / F.sqrt(F.col("_dout") * F.col("_din")))
    j = e.join(x.withColumnRenamed("node_id", "src"), "src")
    total = F.sum("_w") if how == "mean" else F.lit(1.0)
    return j.groupBy(F.col("dst").alias("node_id")).agg(*[(F.sum(F.col(c) * F.col("_w")) / total).alias(c) for c in feats])


def _clique_messages(r: Clique, x: DataFrame, feats: list, how: str) -> DataFrame:
    w = F.col(r.weight).cast("double") if r.weight else F.lit(1.0)
    m = r.members.select("node_id", "value", w.alias("_w"))

    def with_totals(rows: DataFrame, cols: dict) -> DataFrame:
        """Rows with the sums of ``cols`` over all members of their value."""
        return rows.join(rows.groupBy("value").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in cols.items()]), "value")

    if how == "sum":
        m = m.withColumn("_deg", F.lit(1.0))
    else:
        degree = with_totals(m, {"d": F.col("_w")}).groupBy("node_id").agg(F.sum(F.col("_w") * (F.col("_t_d") - F.col("_w"))).alias("_deg"))
        m = m.join(degree.where("_deg > 0"), "node_id")
    # members without features are neighbours with zeros
    part = (lambda c: _zero(c) / F.sqrt("_deg")) if how == "gcn" else _zero
    j = m.join(x, "node_id", "left").select("node_id", "value", "_w", "_deg", *[part(c).alias(c) for c in feats])
    j = with_totals(j, {c: F.col("_w") * F.col(c) for c in feats} | {"n": F.lit(1)}).where("_t_n > 1")
    own = lambda c: F.col("_w") * (F.col(f"_t_{c}") - F.col("_w") * F.col(c))
    scale = {"sum": F.lit(1.0), "mean": F.max("_deg"), "gcn": F.sqrt(F.max("_deg"))}[how]
    return j.groupBy("node_id").agg(*[(F.sum(own(c)) / scale).alias(c) for c in feats])


def pass_messages(relations: Sequence[Relation], features: dict, how: str = "sum", dst_types: Optional[Sequence[str]] = None) -> dict:
    """One hop: per destination type the in-neighbours' features aggregated per relation ('sum', 'mean'
    or 'gcn'), then summed over relations. ntype -> DataFrame(node_id, features); nodes without an
    in-neighbour are absent. Relations whose source type has no features are skipped; missing features are 0."""
    if how not in ("sum", "mean", "gcn"):
        raise ValueError(how)
    per_type: dict = {}
    for r in relations:
        if r.src_type not in features or (dst_types and r.dst_type not in dst_types):
            continue
        x = features[r.src_type]
        feats = [c for c in x.columns if c != "node_id"]
        x = x.select("node_id", *[_zero(c).alias(c) for c in feats])
        made = (_clique_messages if isinstance(r, Clique) else _edge_messages)(r, x, feats, how)
        per_type.setdefault(r.dst_type, []).append(made)
    out = {}
    for t, parts in per_type.items():
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p, allowMissingColumns=True)
        cols = [c for c in u.columns if c != "node_id"]
        out[t] = u.groupBy("node_id").agg(*[F.sum(_zero(c)).alias(c) for c in cols])
    return out


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def propagate(features: dict, relations: Sequence[Relation], hops: int, how: str = "mean") -> dict:
    """ntype -> DataFrame(node_id, <feature>..., <feature>_h1..., <feature>_hk...) for every node that
    has a feature row; features of other types that reach a node are columns of it too, 0 where nothing arrives.

    Each hop is written to the shared scratch folder: the next one starts from a scan, so plans do not
    grow with the hops and a lost executor costs a re-read. So are the features and the members of cliques, which
    a hop reads several times; an edge list is read once a hop, as it is given.
    """
    features = {t: _kept(f, f"features-{t}") for t, f in features.items()}
    relations = [replace(r, members=_kept(r.members, f"members-{r.relation}")) if isinstance(r, Clique) else r for r in relations]
    out = dict(features)
    now = features
    for h in range(1, hops + 1):
        reached = pass_messages(relations, now, how)
        now = {}
        for t, r in reached.items():
            if t not in features:
                continue
            cols = [c for c in r.columns if c != "node_id"]
            path = scratch_path(r.sparkSession, f"hop{h}-{t}")
            features[t].select("node_id").join(r, "node_id", "left").fillna(0.0, cols).write.parquet(path)
            now[t] = r.sparkSession.read.schema(f"node_id {dict(features[t].dtypes)['node_id']}, " + ", ".join(f"`{c}` double" for c in cols)).parquet(path)
            out[t] = out[t].join(now[t].select("node_id", *[F.col(c).alias(f"{c}_h{h}") for c in cols]), "node_id")
    return out
