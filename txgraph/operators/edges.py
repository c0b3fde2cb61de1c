"""Edge builders.

Monopartite edges (primaries sharing an auxiliary value) are quadratic per
value. They are built from the pre-aggregated (aux, primary, rows) table, so the
self-join sees one row per distinct primary instead of one per transaction; the
pair multiplicity of the row-level join becomes a ``weight`` (rows_a * rows_b,
summed over shared values). The square of a hot value is a grid: its primaries are cut
into blocks and these into tiles, and each pair of a block and a tile is a join key of its own, so
the sides are copied as often as there are tiles and blocks, and no key owns more than one cell. Several definitions of one triple whose
primaries have one value each are paired with all their values at hand, so no pair is shuffled to add up its weights.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.session import shuffle_partitions

BLOCK_ROWS = 4096  # primaries on one side of a grid cell
TILE_ROWS = 512  # primaries on its other side
PLAIN_ROWS = 64  # up to so many primaries of a value are cut anyhow
PAIRS_A_TASK = 1 << 25  # at 65,536 rows of a block's side, which a Parquet dictionary of 1 MB holds


def bipartite_edges(df: DataFrame, src_id: str, dst_id: str) -> DataFrame:
    """Distinct (src, dst) with nulls dropped (G5 F5 A9); map-side partial dedup."""
    return (df.select(F.col(src_id).alias("src"), F.col(dst_id).alias("dst"))
            .na.drop(subset=["src", "dst"]).dropDuplicates(["src", "dst"]))


def reverse_edges(edges: DataFrame) -> DataFrame:
    """The same list flipped (G5 reverse)."""
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols)


def _pair_counts(df: DataFrame, primary_id: str, aux_id: str) -> DataFrame:
    return (df.select(F.col(aux_id).alias("aux"), F.col(primary_id).alias("p"))
            .na.drop(subset=["aux", "p"])
            .groupBy("aux", "p").agg(F.count(F.lit(1)).alias("c")))


def single_valued_map(df: DataFrame, primary_id: str, aux_ids: list) -> dict:
    """For several auxiliary id columns at once: does every primary have at most one value?
    One two-level aggregate (min != max per primary), one job."""
    per_p = df.filter(F.col(primary_id).isNotNull()).groupBy(primary_id).agg(
        *[(F.min(a) != F.max(a)).cast("int").alias(f"_m{i}") for i, a in enumerate(aux_ids)])
    row = per_p.agg(*[F.coalesce(F.max(f"_m{i}"), F.lit(0)).alias(f"_m{i}") for i in range(len(aux_ids))]).first()
    return {a: row[f"_m{i}"] == 0 for i, a in enumerate(aux_ids)}


def single_valued(counts: DataFrame) -> bool:
    """True when no primary has two auxiliary values (one small aggregate, stops at the first hit)."""
    return counts.groupBy("p").count().filter("count > 1").limit(1).count() == 0


def _grid(members: DataFrame, block_rows: int, sized: bool = False) -> DataFrame:
    """(src, dst, a_<column>..., b_<column>...): ordered pairs of distinct primaries of ``members`` (aux, p, columns...)
    with one aux value. A cell pairs a block with a tile of a block. Both travel as arrays in the order of the columns and are
    unfolded in the cell's task, so a cell's pairs repeat one short run of ``dst`` and, where the columns are alike, of what is
    computed from them: stored by column they take few bytes (a tile has a multiple of 8 rows, as encoders pack values by
    eights; the rest of a block, under 8 rows, is one more tile; values of few primaries need neither). The cells are few small rows that grow to their squares, so
    their partitions are given by number: Spark would coalesce them by the size of the rows before the join. ``sized``
    counts the pairs first (a job) and gives each task about ``PAIRS_A_TASK``."""
    rest = [c for c in members.columns if c not in ("aux", "p")]
    degree = members.groupBy("aux").agg(F.count(F.lit(1)).alias("deg"))
    n = shuffle_partitions(members.sparkSession)
    if sized:
        pairs = degree.agg(F.sum(F.col("deg").cast("double") * F.col("deg"))).first()[0] or 0
        n = max(n, ceil(pairs / PAIRS_A_TASK))
    s = F.greatest(F.lit(1), F.ceil(F.col("deg") / F.lit(block_rows))).cast("bigint")
    blocks = degree.select("aux", s.alias("s"), F.ceil(F.col("deg") / (s * F.lit(min(TILE_ROWS, block_rows)))).cast("bigint").alias("k"),
                           F.when(F.col("deg") > PLAIN_ROWS, 8).otherwise(1).alias("u"))
    cut = members.join(blocks, "aux").withColumn("own", F.pmod(F.xxhash64("p"), F.col("s")))
    block = cut.groupBy("aux", "s", "k", "u", "own").agg(F.sort_array(F.collect_list(F.struct(*rest, "p"))).alias("all"))
    slots = F.col("k") + F.when(F.col("u") > 1, 1).otherwise(0)
    whole = (F.size("all") - F.size("all") % F.col("u")).cast("int")
    wide = (F.col("u") * F.ceil(F.col("whole") / (F.col("u") * F.col("k")))).cast("int")
    starts = F.concat(F.when(F.col("whole") > 0, F.sequence(F.lit(1), F.col("whole"), F.col("wide"))).otherwise(F.array().cast("array<int>")),
                      F.when(F.size("all") > F.col("whole"), F.array(F.col("whole") + 1)).otherwise(F.array().cast("array<int>")))
    end = lambda i: F.when(i > F.col("whole"), F.size("all")).otherwise(F.least(i + F.col("wide") - 1, F.col("whole")))
    tiles = F.transform(starts, lambda i: F.slice("all", i, end(i) - i + 1))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), c - 1))
    left = block.select("aux", F.col("own").alias("row"), upto(F.col("s") * slots).alias("col"), F.col("all").alias("a"))
    right = (block.withColumn("whole", whole).withColumn("wide", wide)
             .select("aux", "s", (F.col("own") * slots).alias("first"), F.posexplode(tiles).alias("i", "b"))
             .select("aux", (F.col("first") + F.col("i")).alias("col"), upto(F.col("s")).alias("row"), "b"))
    at = ["aux", "row", "col"]
    left = left.repartition(n, *at).select(*at, F.explode("a").alias("a")).select(*at, F.col("a.p").alias("src"), *[F.col(f"a.{c}").alias(f"a_{c}") for c in rest])
    right = right.repartition(n, *at).select(*at, F.explode("b").alias("b")).select(*at, F.col("b.p").alias("dst"), *[F.col(f"b.{c}").alias(f"b_{c}") for c in rest])
    return left.join(right, at).filter(F.col("src") != F.col("dst"))


def monopartite_weighted(
    df: DataFrame,
    primary_id: str,
    aux_id: str,
    block_rows: int = BLOCK_ROWS,
    one_value_per_primary: Optional[bool] = None,
    sized: bool = False,
) -> DataFrame:
    """(src, dst, weight): ordered pairs of distinct primaries sharing an aux value.

    ``weight`` equals the number of rows the row-level self-join would emit for the
    pair; summing weights gives the bag edge count. When every primary has a single
    auxiliary value (checked unless given), pairs from different values cannot meet,
    so the final re-aggregation over (src, dst) — a shuffle of all pairs — is skipped.
    ``sized``: for callers that write the pairs (see ``_grid``).
    """
    counts = _pair_counts(df, primary_id, aux_id)
    if one_value_per_primary is None:
        one_value_per_primary = single_valued(counts)
    pairs = _grid(counts, block_rows, sized).select("src", "dst", (F.col("a_c") * F.col("b_c")).cast("bigint").alias("weight"))
    if one_value_per_primary:
        return pairs
    return pairs.groupBy("src", "dst").agg(F.sum("weight").cast("bigint").alias("weight"))


def monopartite_merged(df: DataFrame, primary_id: str, aux_ids: Sequence[str], block_rows: int = BLOCK_ROWS,
                       sized: bool = False) -> DataFrame:
    """(src, dst, weight) over several definitions of one triple, weights added up (G4 U1), for primaries with at most
    one value of each auxiliary. A row holds all values of its primary, so the definition that pairs two primaries
    first knows the weight of the others too, which leave that pair out: pairs are neither shuffled nor aggregated."""
    k = range(len(aux_ids))
    own = df.filter(F.col(primary_id).isNotNull()).groupBy(F.col(primary_id).alias("p")).agg(
        *[F.count(a).alias(f"c{i}") for i, a in enumerate(aux_ids)], *[F.max(a).alias(f"v{i}") for i, a in enumerate(aux_ids)])  # counts first: weights follow them
    meet = [F.coalesce(F.col(f"a_v{i}") == F.col(f"b_v{i}"), F.lit(False)) for i in k]
    parts = []
    for i in k:
        pairs = _grid(own.filter(F.col(f"v{i}").isNotNull()).withColumn("aux", F.col(f"v{i}")), block_rows, sized)
        weight = reduce(lambda x, y: x + y, [F.when(meet[j], F.col(f"a_c{j}") * F.col(f"b_c{j}")).otherwise(F.lit(0)) for j in k[i:]])
        parts.append(reduce(lambda x, j: x.filter(~meet[j]), k[:i], pairs).select("src", "dst", weight.cast("bigint").alias("weight")))
    return union_edges(parts)


def expand_bag(weighted: DataFrame) -> DataFrame:
    """Bag form: one row per row-level join match (only when explicitly asked for)."""
    return (weighted.select("src", "dst", F.explode(F.sequence(F.lit(1), F.col("weight"))).alias("_k"))
            .drop("_k"))


def union_edges(parts: list[DataFrame]) -> Optional[DataFrame]:
    """Concatenate edge lists of the same triple."""
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def merge_distinct(parts: list[DataFrame]) -> Optional[DataFrame]:
    """Several bipartite definitions of one triple: concatenated, each edge once."""
    u = union_edges(parts)
    return u if u is None or len(parts) == 1 else u.dropDuplicates(["src", "dst"])


def merge_weighted(parts: list[DataFrame]) -> Optional[DataFrame]:
    """Several monopartite definitions of one triple: weights add up."""
    u = union_edges(parts)
    if u is None or len(parts) == 1:
        return u
    return u.groupBy("src", "dst").agg(F.sum("weight").cast("bigint").alias("weight"))


def rowwise_edges(df: DataFrame, src_id: str, dst_id: str, order_col: Optional[str] = None) -> DataFrame:
    """One edge per row, duplicates kept (G7); ``order_col`` keeps the row position."""
    cols = [F.col(src_id).alias("src"), F.col(dst_id).alias("dst")]
    if order_col:
        cols.append(F.col(order_col).alias("row_index"))
    return df.select(*cols)


_WIDE, _SUM = "decimal(18,0)", "decimal(38,0)"


def monopartite_counts(df: DataFrame, primary_id: str, aux_id: str,
                       one_value_per_primary: Optional[bool] = None) -> DataFrame:
    """Exact (n_edges, n_bag) of a monopartite edge type without materialising pairs
    when every primary has at most one auxiliary value (the common case: a
    transaction has one city). Otherwise pairs that share several values are counted once: only
    primaries with several values can be in such a pair, so only their pairs are built.

    n_bag  = sum over values g of (rows_g^2 - sum_p rows_pg^2)
    n_edges = sum over g of (d_g^2 - d_g), d_g = distinct primaries with value g, less
              (m - 1) for each pair that shares m > 1 values
    Both are decimal(38,0): a value shared by 10^10 rows has more pairs than a bigint holds.
    """
    counts = _pair_counts(df, primary_id, aux_id)
    per_aux = counts.groupBy("aux").agg(F.sum("c").cast(_WIDE).alias("s"), F.sum((F.col("c").cast(_WIDE) * F.col("c").cast(_WIDE)).cast(_SUM)).cast(_SUM).alias("s2"),
                                        F.count(F.lit(1)).cast(_WIDE).alias("d"))
    many = not (single_valued(counts) if one_value_per_primary is None else one_value_per_primary)
    sums = per_aux.agg(
        F.coalesce(F.sum(F.col("d") * F.col("d") - F.col("d")), F.lit(0)).cast(_SUM).alias("n_edges"),
        F.coalesce(F.sum(F.col("s") * F.col("s") - F.col("s2")), F.lit(0)).cast(_SUM).alias("n_bag"))
    if many:
        several = counts.join(counts.groupBy("p").count().filter("count > 1").select("p"), "p", "left_semi")
        shared = monopartite_weighted(several.select("p", "aux"), "p", "aux", one_value_per_primary=True)  # a row per shared value
        again = shared.groupBy("src", "dst").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast(_SUM).alias("again"))
        sums = sums.crossJoin(F.broadcast(again)).select((F.col("n_edges") - F.col("again")).cast(_SUM).alias("n_edges"), "n_bag")  # one row each
    return sums
