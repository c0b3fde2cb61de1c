"""Neighbour sampling (G10 G11) and aggregation over explicit edges.

A relation is a set of lists and who reads them: an edge list is one list of sources per
destination, a shared attribute one list of nodes per value, read by the same nodes. Samples are drawn from
the lists, so the pairs of a shared value are never built.

Hops go from the last entry of ``fanouts`` to the first (the sampling starts at the output layer), and the
nodes of a hop stay in the frontier of the next, as in the public documentation of layered neighbour samplers.

* uniform: the neighbours with the smallest hash of (seed + hop, neighbour). All nodes share that order, so
  the first k + 1 of a list hold what any of its readers draws from it.
* time-respecting, 'last': a list in time order is a row of positions; the position of the seed's time is found
  once per (list, time), and the k + 1 positions before it are read.
* time-respecting, 'uniform': a list in time order is cut into blocks of 32 * 8^i positions that keep their k + 1
  smallest hashes; the positions before the seed's time are a few blocks of each size.

Rows before the final ranking: frontier rows x lists of a node x (k + 1) [x blocks], whatever the lists' lengths.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional, Sequence, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txgraph.operators.ids import running_totals, top_k_per_group
from txgraph.operators.propagation import Clique, EdgeList, pass_messages

_BASE_BITS = 5   # positions of a block of the smallest size: 2^5
_RADIX_BITS = 3  # blocks of one size in the next


@dataclass(frozen=True)
class Lists:
    """In-neighbours as shared lists: ``items`` (value, src) distinct; ``readers`` (dst, value) distinct, None
    when the list's value is the reading node itself."""

    items: DataFrame
    readers: Optional[DataFrame] = None
    exclude_self: bool = False


def as_lists(relation: Union[DataFrame, Clique, EdgeList, Lists]) -> Lists:
    if isinstance(relation, Lists):
        return relation
    if isinstance(relation, Clique):
        m = relation.members
        return Lists(m.select("value", F.col("node_id").alias("src")), m.select(F.col("node_id").alias("dst"), "value"), True)
    edges = relation.edges if isinstance(relation, EdgeList) else relation
    return Lists(edges.select(F.col("dst").alias("value"), "src").distinct())


def _hash_order(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("src").cast("string")))


def _positions(items: DataFrame, reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with their position in time order within the list (``at``; of equal times the larger id first),
    and (value, seed_time) with the number of items no later (``before``)."""
    far = F.lit((1 << 63) - 1)
    marks = items.select("value", F.col("nb_time").alias("t"), F.lit(0).alias("kind"), F.col("src"), F.lit(None).cast("bigint").alias("seed_time"))
    asked = reads.select("value", "seed_time").distinct().select(
        "value", F.coalesce("seed_time", far).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(dict(items.dtypes)["src"]).alias("src"), "seed_time")
    run = running_totals(marks.unionByName(asked), ["value"], [F.col("t"), F.col("kind"), F.col("src").desc(), F.col("seed_time").asc_nulls_last()],
                         {"at": F.when(F.col("kind") == 0, 1).otherwise(0).cast("bigint")})
    return (run.where("kind = 0").select("value", "src", F.col("t").alias("nb_time"), "at"),
            run.where("kind = 1").select("value", "seed_time", F.col("at").alias("before")))


def _range(lo: str, hi: str) -> str:
    return f"CASE WHEN {lo} < {hi} THEN sequence({lo}, {hi} - 1) ELSE array() END"


def _earlier_by_hash(items: DataFrame, asked: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """(value, seed_time, src, nb_time): a superset of the k smallest hashes among the items before each time."""
    last = items.agg(F.max("at")).first()[0] or 0
    levels = [_BASE_BITS]
    while (last >> (levels[-1] + _RADIX_BITS)) > 0:
        levels.append(levels[-1] + _RADIX_BITS)
    per_item = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.shiftright("at", b).alias("block")) for b in levels]))
    blocks = top_k_per_group(items.select("value", "src", "nb_time", per_item.alias("x")).select("value", "src", "nb_time", "x.*"),
                             ["value", "bits", "block"], order, k)
    parts = []
    for i, b in enumerate(levels):  # whole blocks of this size behind the whole blocks of the next
        lo = f"shiftleft(shiftright(before, {levels[i + 1]}), {_RADIX_BITS})" if i + 1 < len(levels) else "0L"
        parts.append(f"transform({_range(lo, f'shiftright(before, {b})')}, y -> struct({b} AS bits, y AS block))")
    want = asked.select("value", "seed_time", F.explode(F.expr(f"flatten(array({', '.join(parts)}))")).alias("x")).select("value", "seed_time", "x.*")
    whole = want.join(blocks, ["value", "bits", "block"]).select("value", "seed_time", "src", "nb_time")
    rest = f"shiftleft(shiftright(before, {_BASE_BITS}), {_BASE_BITS})"
    tail = asked.select("value", "seed_time", F.explode(F.expr(_range(rest, "before"))).alias("at")).join(items, ["value", "at"])
    return whole.unionByName(tail.select("value", "seed_time", "src", "nb_time"))


def _drawn(lists: Lists, frontier: DataFrame, fanout: int, seed: int, times: Optional[DataFrame], strategy: str) -> DataFrame:
    """(dst, seed_time, src) drawn for each frontier row (node_id, seed_time)."""
    here = frontier.select(F.col("node_id").alias("dst"), "seed_time")
    reads = here.withColumn("value", F.col("dst")) if lists.readers is None else here.join(lists.readers, "dst")
    k = fanout + int(lists.exclude_self)
    items = lists.items.join(reads.select("value").distinct(), "value", "left_semi")
    order = [_hash_order(seed), F.col("src").asc()]
    if times is None:
        got = reads.join(top_k_per_group(items, ["value"], order, k), "value")
    else:
        timed = items.join(times.where("time_attr IS NOT NULL").select(F.col("node_id").alias("src"), F.col("time_attr").cast("bigint").alias("nb_time")), "src")
        placed, asked = _positions(timed, reads)
        if strategy == "last":
            order = [F.col("nb_time").desc(), F.col("src").asc()]
            at = F.explode(F.expr(_range(f"greatest(before - {k}, 0L)", "before"))).alias("at")
            near = asked.select("value", "seed_time", at).join(placed, ["value", "at"]).drop("at")
        else:
            # of a list and a time no reader draws past the first k: cut before the readers multiply the rows
            near = top_k_per_group(_earlier_by_hash(placed, asked, k, order), ["value", "seed_time"], order, k)
        near = near.withColumnRenamed("seed_time", "_seed_time")
        got = reads.join(near, (reads["value"] == near["value"]) & reads["seed_time"].eqNullSafe(near["_seed_time"])).drop("_seed_time", near["value"])
    if lists.exclude_self:
        got = got.where("src <> dst")
    got = got.drop("value")
    return top_k_per_group(got.distinct() if lists.readers is not None else got, ["dst", "seed_time"], order, fanout)


def sample_neighbors(
    relations: dict,
    seeds: dict,
    fanouts: Sequence[int],
    seed: int = 0,
    time_attr: Optional[dict] = None,
    strategy: str = "uniform",
) -> DataFrame:
    """Multi-hop sampled edges: (hop, src_type, relation, dst_type, src, dst, seed_time).

    ``relations``: triple -> DataFrame(src, dst), ``Clique`` or ``Lists``; ``seeds``: ntype -> DataFrame(node_id
    [, seed_time]). Hop 1 draws with the last fan-out, per relation. With ``time_attr`` (ntype -> DataFrame(node_id,
    time_attr)) only neighbours whose time is <= the seed's time are eligible (G11): 'last' takes the most recent
    ones (ties by node id), 'uniform' a hash-random subset; nodes of these types without a time are never drawn, and a
    seed without one sees all that have one. A frontier row is a node with its seed's time, so seeds that share a node
    never see past their own time.
    """
    if strategy not in ("uniform", "last"):
        raise ValueError(strategy)
    frontier = {t: f.select(F.col("node_id"), (F.col("seed_time").cast("bigint") if "seed_time" in f.columns
                                               else F.lit(None).cast("bigint")).alias("seed_time")).distinct()
                for t, f in seeds.items()}
    if time_attr is not None:
        time_attr = {t: _kept(ta, f"times-{t}") for t, ta in time_attr.items()}
        frontier = {t: _with_seed_time(f, time_attr.get(t)) for t, f in frontier.items()}
    frontier = {t: _kept(f, f"frontier-{t}") for t, f in frontier.items()}  # each relation reads it several times
    lists: dict = {}
    out = []
    for hop, fanout in enumerate(reversed(list(fanouts)), start=1):
        reached = dict(frontier)
        for (s, r, d), relation in relations.items():
            if d not in frontier:
                continue
            times = None if time_attr is None else time_attr.get(s)
            if (s, r, d) not in lists:
                lists[(s, r, d)] = _kept_lists(as_lists(relation), r)
            got = _drawn(lists[(s, r, d)], frontier[d], fanout, seed + hop, times, strategy)
            got = _kept(got.select("src", "dst", "seed_time"), f"hop{hop}-{r}")
            out.append(got.select(F.lit(hop).alias("hop"), F.lit(s).alias("src_type"), F.lit(r).alias("relation"),
                                  F.lit(d).alias("dst_type"), "src", "dst", "seed_time"))
            nodes = got.select(F.col("src").alias("node_id"), "seed_time")
            reached[s] = reached[s].unionByName(nodes) if s in reached else nodes
        if hop < len(list(fanouts)):
            frontier = {t: _kept(f.distinct(), f"frontier-{t}") for t, f in reached.items()}
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A hop's sample, written to the shared folder: the next hop and the result read it, none draws again."""
    from txgraph.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _kept_lists(lists: Lists, name: str) -> Lists:
    return Lists(_kept(lists.items, f"items-{name}"), None if lists.readers is None else _kept(lists.readers, f"readers-{name}"), lists.exclude_self)


def _with_seed_time(frontier: DataFrame, ta: Optional[DataFrame]) -> DataFrame:
    if ta is None:
        return frontier
    return (frontier.drop("seed_time")
            .join(ta.select("node_id", F.col("time_attr").cast("bigint").alias("seed_time")), "node_id", "left"))


def aggregate_neighbors(edges: dict, features: dict, how: str = "sum", dst_types: Optional[Sequence[str]] = None,
                        weight_col: Optional[str] = None) -> dict:
    """``pass_messages`` over explicit edge lists: triple -> DataFrame(src, dst[, weight])."""
    return pass_messages([EdgeList(s, r, d, e, weight_col) for (s, r, d), e in edges.items()], features, how, dst_types)
