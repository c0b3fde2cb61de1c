"""Conversation prefix trie (13): one node for each distinct sequence of first turns.

1. One sort by conversation: tasks walk the turns and chain their digests, one row per prefix
   (128-bit digest of the prefix, that of its parent, bytes of its last text, prefixes still to come).
2. One aggregate over the digests gives the distinct nodes: members, smallest member, and the prefix
   rows below a node, which bound the nodes of its subtree.
3. Subtrees of at most ``SHARD_ROWS`` such rows stay whole. A task puts the digests of its subtrees into
   a minimal perfect hash (every slot is checked against the stored digest), scatters the counts into
   flat arrays and adds them up through the array of parent slots, deepest nodes first.
4. The nodes above (the crown; by the bound at most rows / ``SHARD_ROWS`` of one depth) need no walk: each node
   belongs to the path of its smallest member, so the sum over a subtree is, over its members, the sum
   of what each member's path holds at that depth or deeper: one window and one aggregate.
5. Ends of a node are joined to texts of bounded size by range of (node, conversation) and hashed in
   order from these, so a node where very many conversations end costs a stream of chunks, not a list.

Defined results: a null role or text counts as empty; null turns come first, equal turns in the order of
their content's digest; rows with a null conv_id belong to no conversation; repeated rows are turns of
their own; a text of any length is hashed where it is read and goes no further; an empty table has no node,
not even a root; extra columns are ignored. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txgraph.llm import textkernel as K
from txgraph.llm.common import written

FAMILY = 5          # a conversation borrows the first turns of conversation c - c % FAMILY
HEAD_MOD = 9        # as many as crc32(c) % HEAD_MOD
SHARD_ROWS = 4096   # prefix rows of a subtree that is kept whole
CHUNK_NODES = 1 << 16
END_CHARS = 64 << 10
_ROOT = bytes(16)
_PREFIX = "conv_id long, depth long, hi long, lo long, phi long, plo long, bytes long, rest long"
_SHARD = "hi long, lo long, phi long, plo long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class SlotTable:
    """Minimal perfect hash over distinct 128-bit keys.

    In each level keys that meet no other take the next slots, the others go on to the next level.
    A looked-up key is compared with the one that its slot holds; -1 if it is another.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        n = len(hi)
        self.levels: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        slot, left, base = np.empty(n, np.int64), np.arange(n), 0
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("equal digests in a shard")
            seed, size = len(self.levels), 2 * len(left) + 8
            at = self._place(hi[left], lo[left], seed, size)
            alone = np.bincount(at, minlength=size)[at] == 1
            held = np.zeros(size, bool)
            held[at[alone]] = True
            rank = base + np.cumsum(held) - 1
            self.levels.append((seed, size, held, rank))
            slot[left[alone]] = rank[at[alone]]
            base += int(alone.sum())
            left = left[~alone]
        self.hi, self.lo = np.empty(n, np.int64), np.empty(n, np.int64)
        self.hi[slot], self.lo[slot] = hi, lo
        if not np.array_equal(self.find(hi, lo), slot):
            raise ValueError("a digest did not come back from its slot")

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, seed: int, size: int) -> np.ndarray:
        x = K.mix(hi.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) ^ lo.view(np.uint64)
        return (K.mix(x) % np.uint64(size)).astype(np.int64)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that are not in the table."""
        out, todo = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for seed, size, held, rank in self.levels:
            at = self._place(hi[todo], lo[todo], seed, size)
            hit = held[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        known = out >= 0
        known[known] = (self.hi[out[known]] == hi[known]) & (self.lo[out[known]] == lo[known])
        return np.where(known, out, -1)


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by family, its first conversation first: a prefix row for every rebuilt turn."""
    names = [x.split()[0] for x in _PREFIX.split(", ")]
    out: list[tuple] = []
    family = conv = None
    head: list[tuple[bytes, int]] = []  # first turns of the family's first conversation
    of_head = False
    at = borrow = length = depth = 0
    digest = _ROOT

    def turn(item: bytes, size: int) -> None:
        nonlocal digest, depth
        parent, digest, depth = digest, hashlib.blake2b(digest + item, digest_size=16).digest(), depth + 1
        out.append((conv, depth, *_halves(digest), *_halves(parent), size, length - depth + 1))

    def ready() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    for batch in batches:
        for g, c, n, h, item, size in zip(*(x.to_pylist() for x in batch.columns)):
            if g != family:
                family, head = g, []
            if c != conv:
                conv, at, digest, depth, borrow, of_head = c, 0, _ROOT, 0, h, c == g
                length = (min(h, n) if of_head else min(h, len(head))) + max(0, n - h)
                out.append((conv, 0, 0, 0, 0, 0, 0, length + 1))
                if not of_head:
                    for x in head[:h]:
                        turn(*x)
            at += 1
            if of_head and at < HEAD_MOD:
                head.append((item, size))
            if of_head or at > borrow:
                turn(item, size)
            if len(out) >= 20_000:
                yield ready()
    yield ready()


def prefix_rows(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """(conv_id, depth, digest halves, parent's halves, bytes of the last text, rest): a row per prefix of
    each conversation, the empty one included. ``rebuild``: with the first turns of its family's head."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    conv = F.col("conv_id").cast("long")
    item = F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    src = conversations.where(conv.isNotNull()).select(
        (conv - conv % FAMILY if rebuild else conv).alias("g"), conv.alias("conv_id"), "turn",
        F.unhex(F.substring(F.sha2(item, 256), 1, 32)).alias("item"), F.octet_length(text("text")).cast("long").alias("bytes"))
    borrow = F.crc32(F.col("conv_id").cast("string")) % HEAD_MOD if rebuild else F.lit(0)
    rows = src.repartition("g").withColumn("n", F.count("*").over(Window.partitionBy("g", "conv_id"))).withColumn("h", borrow.cast("long"))
    ordered = rows.sortWithinPartitions("g", F.col("conv_id") != F.col("g"), "conv_id", F.col("turn").asc_nulls_first(), "item", "bytes")
    return ordered.select("g", "conv_id", "n", "h", "item", "bytes").mapInArrow(_chained, _PREFIX)


def _sums_of_subtrees(cols: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Parent's id, children, leaves and saved bytes of the nodes of whole subtrees, in the rows' order."""
    table = SlotTable(cols["hi"], cols["lo"])
    n, slot, parent = len(cols["hi"]), table.find(cols["hi"], cols["lo"]), table.find(cols["phi"], cols["plo"])
    parent[cols["depth"] == 0] = -1  # the root's parent digest is its own
    up, depth, conv, saved = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    up[slot], depth[slot], conv[slot], saved[slot] = parent, cols["depth"], cols["conv_id"], (cols["n_convs"] - 1) * cols["bytes"]
    children = np.bincount(up[up >= 0], minlength=n)
    leaves = (children == 0).astype(np.int64)
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        level = level[up[level] >= 0]
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    of = np.where(up >= 0, conv[np.maximum(up, 0)], 0)
    return [of[slot], children[slot], leaves[slot], saved[slot], up[slot] < 0]


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by subtree; whole subtrees are summed together, about ``CHUNK_NODES`` nodes at once."""
    names = [x.split()[0] for x in _SHARD.split(", ")]

    def summed(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables)
        c = {x: t.column(x).to_numpy() for x in ("hi", "lo", "phi", "plo", "conv_id", "depth", "n_convs", "bytes")}
        of, children, leaves, saved, top = _sums_of_subtrees(c)
        got = {**c, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "parent_conv_id": of}
        return pa.RecordBatch.from_arrays(
            [pa.array(got[x], pa.int64(), mask=top if x == "parent_conv_id" else None) for x in names[:-1]] + [pa.array(top)], names=names)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= CHUNK_NODES:  # cut before the last subtree that has begun
            hi, lo = batch.column("rhi").to_numpy(), batch.column("rlo").to_numpy()
            new = np.concatenate(([(hi[0], lo[0]) != (held[-1].column("rhi")[-1].as_py(), held[-1].column("rlo")[-1].as_py())], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])))
            starts = np.flatnonzero(new)
            if len(starts):
                yield summed([*held, batch.slice(0, int(starts[0]))])
                held, size, batch = [], 0, batch.slice(int(starts[0]))
        held.append(batch)
        size += batch.num_rows
    if held:
        yield summed(held)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (hi, lo, conv_id) rows: ids of a node joined to texts of at most about END_CHARS."""
    node, first, ids, size, out = None, 0, [], 0, []

    def close() -> None:
        if ids:
            out.append((*node, first, ",".join(ids)))

    def ready() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["hi", "lo", "first", "ids"])

    for batch in batches:
        for hi, lo, c in zip(*(x.to_pylist() for x in batch.columns)):
            if (hi, lo) != node or size > END_CHARS:
                close()
                node, first, ids, size = (hi, lo), c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        yield ready()
    close()
    yield ready()


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by node and first id: the digest of each node's comma-joined ids."""
    node, sha, out = None, hashlib.sha256(), []

    def ready() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], names=["hi", "lo", "ends_sha256"])

    for batch in batches:
        for hi, lo, ids in zip(*(x.to_pylist() for x in batch.columns)):
            if (hi, lo) == node:
                sha.update(b"," + ids.encode())
            else:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (hi, lo), hashlib.sha256(ids.encode())
        yield ready()
    if node:
        out.append((*node, sha.hexdigest()))
    yield ready()


def ends(prefixes: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of the nodes at which conversations end."""
    last = prefixes.where("rest = 1").select("hi", "lo", "conv_id")
    chunks = last.repartitionByRange("hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id").mapInArrow(_joined_ids, "hi long, lo long, first long, ids string")
    return chunks.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").select("hi", "lo", "ids").mapInArrow(_hashed_ids, "hi long, lo long, ends_sha256 string")


def trie_nodes(prefixes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the prefix rows: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. ``prefixes`` is read several times: give a written table."""
    key, parent = ["hi", "lo"], ["phi", "plo"]
    one = lambda c: F.max(c).alias(c)  # noqa: E731  the same in all rows of a node
    nodes = written(prefixes.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("rest").alias("below"), *map(one, ("depth", "bytes", *parent))), "trie-nodes")
    crown = nodes.where(F.col("below") > shard_rows)
    above = written(prefixes.select("conv_id", "depth", *key).join(crown.select(*key), key), "trie-crown")  # members of the crown's nodes
    deepest = above.groupBy("conv_id").agg(F.max("depth").alias("e"))
    root_of = (prefixes.select("conv_id", "depth", F.col("hi").alias("rhi"), F.col("lo").alias("rlo")).join(deepest, "conv_id", "left")
               .where("depth = coalesce(e, -1) + 1").select("conv_id", "rhi", "rlo"))
    whole = nodes.where(F.col("below") <= shard_rows).join(root_of, "conv_id")  # by the path of the smallest member
    shards = written(whole.select(*key, *parent, "conv_id", "depth", "n_convs", "bytes", "rhi", "rlo").repartition("rhi", "rlo")
                     .sortWithinPartitions("rhi", "rlo").mapInArrow(_sharded, _SHARD), "trie-shards")

    tops = shards.where("top AND depth > 0")
    up = [*parent, *key, "conv_id", "depth", "n_convs"]
    children = crown.where("depth > 0").select(*parent).unionByName(tops.select(*parent)).groupBy(*parent).agg(F.count("*").alias("n_children"))
    kept = crown.join(children.select(F.col("phi").alias("hi"), F.col("plo").alias("lo"), "n_children"), key, "left").fillna(0, ["n_children"])
    held = (kept.select("conv_id", "depth", F.expr("IF(n_children = 0, 1L, 0L)").alias("leaves"), F.expr("(n_convs - 1) * bytes").alias("saved"))
            .unionByName(tops.select("conv_id", "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))))
    null = F.lit(None).cast("long")
    paths = (above.join(held.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "depth", *key, F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
             .unionByName(held.select("conv_id", "depth", null.alias("hi"), null.alias("lo"), "leaves", "saved")))
    deeper = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, 0)
    total = (paths.withColumns({"leaves": F.sum("leaves").over(deeper), "saved": F.sum("saved").over(deeper)}).where("hi IS NOT NULL")
             .groupBy(*key).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
    upper = (kept.select(*up, "n_children").join(total, key).withColumn("top", F.lit(True))
             .unionByName(tops.select(*up, "n_children", "n_leaves", "saved_tokens", "top")))
    upper = upper.join(crown.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("above")), parent, "left")
    upper = upper.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("above")))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = upper.select(*key, *cols).unionByName(shards.where("NOT top OR depth = 0").select(*key, *cols))
    return every.join(ends(prefixes), key, "left").select(*cols, F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, rebuild: bool = True, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trie of (rebuilt) conversations, a row per node."""
    return trie_nodes(written(prefix_rows(conversations, rebuild), "trie-prefixes"), shard_rows)
