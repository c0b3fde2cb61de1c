"""MinHash near-duplicates (3): a multi-index Hamming join of signatures, confirmed on full sets.

A document's set is its distinct word shingles; its signature is ``SYMBOLS`` min-hashes, ``INDEXED``
of them of b = 16 bits and the others of 8. Documents of at least 80 % similarity differ in 20 % of
the symbols on average, and in more than ``INDEX_DISTANCE`` of the 64 indexed ones, or ``DISTANCE`` of
all 256, with a probability below 10^-6 each. By the pigeonhole principle two signatures within
the first have, in at least one of the ``CHUNKS`` chunks of four symbols, no more than one differing
symbol: every chunk is indexed under its four variants with one symbol left out, and each pair
within the threshold meets in a bucket. Pairs met are compared over all symbols.

1. Equal sets are one class, with the smallest id as its representative (partial aggregation takes
   care of large groups of copies); only representatives are indexed.
2. A star round pairs every member with the smallest and the largest bucket member it meets most
   often; the pairs within the threshold are confirmed on full sets, and components are found.
3. Only buckets that still hold several components are compared within, in blocks of ``BLOCK``
   members, so any bucket size fits a task: in two rounds every node gives its nearest node of
   another component, then all pairs of different components within the threshold are confirmed. A bucket
   in which a round meets no such pair is done: components only grow together. No pair
   within the threshold is left unexamined unless its ends are already in one component; pairs
   inside a component are never made. In the last round members of ``SMALL`` shingles at most bring
   their whole sets, so pairs of two such members that cannot be links end in the task that meets them.

Defined results: null or empty text, or one without words, has no shingles and is its own
component; rows that repeat an id and text share a component; a null id is linked with nothing
(component null, kept); rows of one id with different texts are judged by their texts; extra
columns are ignored; no rows, no result rows. Ids may be of any type that has an order; the smallest id
is the smallest in that order (text by UTF-8 bytes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from txgraph.llm import textkernel as K
from txgraph.llm.common import ids_and_texts, map_texts, memory_returned, written
from txgraph.operators.ids import attach_ids, dense_ids, releasing
from txgraph.session import handed_over, scratch_scope

WORDS = 5
SIMILARITY = 80
SYMBOLS = 256
INDEXED = 64
CHUNKS = 16
INDEX_DISTANCE = 2 * CHUNKS - 2  # at most one error in some chunk
DISTANCE = 86
BLOCK = 2048
SMALL = 512
HUB_BLOCK = 512  # pairs of one hub confirmed together
HOT_CLASS = 65536  # copies of one text that take their class from one row
_SIZE = INDEXED // CHUNKS
_KEEP = [[j for j in range(_SIZE) if j != out] for out in range(_SIZE)]
_rng = np.random.default_rng(17)
_XOR = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK_MUL = _rng.integers(1, 1 << 63, _SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK_ADD = _rng.integers(0, 1 << 63, (CHUNKS, _SIZE), dtype=np.uint64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document of a slice, and their bounds. With fewer words than
    a shingle has, the whole sequence is one."""
    low = K.LOWER[data]
    starts, ends, bounds = K.words(low, offs, K.SPACE_WORD)
    h = K.hash_spans(low, starts, ends)
    n_docs = len(bounds) - 1
    begins = K.starts_within(bounds, words)
    grams = K.gram_hashes(h, words)[begins] if len(begins) else np.zeros(0, np.uint64)
    doc = np.searchsorted(bounds, begins, side="right") - 1
    sizes = np.diff(bounds)
    few = np.flatnonzero((sizes > 0) & (sizes < words))
    if len(few):
        whole = np.array([K.gram_hashes(h[bounds[d] : bounds[d + 1]], int(sizes[d]))[0] for d in few], dtype=np.uint64)
        grams, doc = np.concatenate((grams, K.mix(whole + sizes[few].astype(np.uint64)))), np.concatenate((doc, few))
    order, new = K.dense_order(K.mix(grams + K.mix(doc.astype(np.uint64) + np.uint64(11))))
    first = order[new]
    first = first[np.argsort(doc[first], kind="stable")]
    return grams[first], np.searchsorted(doc[first], np.arange(n_docs + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Signatures of the documents that have a set: the indexed symbols, then the others."""
    begin = bounds[:-1][np.diff(bounds) > 0]
    low = np.empty((len(begin), SYMBOLS), dtype=np.uint16)
    for k in range(SYMBOLS if len(begin) else 0):
        low[:, k] = (K.mix(np.minimum.reduceat((sets ^ _XOR[k]) * _MUL[k], begin)) & np.uint64(0xFFFF)).astype(np.uint16)
    rest = low[:, INDEXED:].astype(np.uint8)
    return [a.tobytes() + b.tobytes() for a, b in zip(low[:, :INDEXED], rest)]


def sketches(src: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, 128-bit set hash (hi, lo) and signature; the last three null for an empty set."""
    def make():
        def f(rows, data, offs):
            sets, bounds = shingle_sets(data, offs, words)
            size = np.diff(bounds)
            has = size > 0
            begin = bounds[:-1][has]
            keys = []
            for salt in (1, 2):
                v = np.zeros(len(size), np.uint64)
                if len(begin):
                    v[has] = np.add.reduceat(K.mix(sets + K.mix(np.full(1, salt, np.uint64))), begin)
                keys.append(pa.array(K.mix(v + size.astype(np.uint64)).view(np.int64), mask=~has))
            sig = signatures(sets, bounds)
            texts = np.full(len(size), None, dtype=object)
            texts[has] = sig
            return [rows.column(0), size, *keys, pa.array(texts, pa.binary())]

        return f

    return map_texts(src, "doc_id long, n_shingles long, hi long, lo long, sig binary", make)


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SYMBOLS + INDEXED)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing symbols of signatures (rows, or one against rows)."""
    wide = 2 * INDEXED
    first = (np.ascontiguousarray(x[..., :wide]).view(np.uint16) != np.ascontiguousarray(y[..., :wide]).view(np.uint16)).sum(axis=-1)
    return first + (x[..., wide:] != y[..., wide:]).sum(axis=-1)


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """Bucket keys (documents x CHUNKS x variants): a chunk with one of its symbols left out."""
    indexed = np.ascontiguousarray(sig[:, : 2 * INDEXED]).view(np.uint16)
    wide = (indexed.astype(np.uint64) + np.uint64(1)).reshape(-1, CHUNKS, _SIZE) * _CHUNK_MUL
    return np.stack([K.mix(wide[:, :, kept].sum(axis=2) + _CHUNK_ADD[:, v]) for v, kept in enumerate(_KEEP)], axis=2)


def _bucket_rows(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                keys = bucket_keys(_symbols(part.column(1))).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), keys.shape[1]))], names=["key", "node"])

    return classes.select("node", "sig").mapInArrow(lambda batches: memory_returned(run(batches)), "key long, node long")


def _star_pairs(buckets: DataFrame) -> DataFrame:
    """For every node the smallest and the largest bucket member it meets in most buckets."""
    def most(hub: str) -> DataFrame:
        met = buckets.where(F.col(hub) != F.col("node")).groupBy("node", F.col(hub).alias("hub")).agg(F.count("*").alias("n"))
        return met.groupBy("node").agg(F.max(F.struct("n", (-F.col("hub")).alias("hub"))).alias("m")).select("node", (-F.col("m.hub")).alias("hub"))

    return most("lo").unionByName(most("hi")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _within(pairs: DataFrame, classes: DataFrame, distance: int) -> DataFrame:
    """The pairs (a, b) whose signatures lie within the threshold."""
    sig = classes.select("node", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = distances(_symbols(batch.column(2)), _symbols(batch.column(3))) <= distance
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], names=["a", "b"])

    return both.mapInArrow(lambda batches: memory_returned(run(batches)), "a long, b long").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs whose full sets reach the similarity; texts are read again only for their ends.

    The end of a pair that is in more pairs is its hub: pairs are dealt to blocks of about ``HUB_BLOCK`` members
    of one hub, so a member's set moves once a pair and a hub's set once a block. Ids of several sets are
    confirmed by any of them, each set being an end (and a hub) of its own."""
    pairs = written(pairs, "near-pairs")
    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("degree")), "near-nodes")

    def make():
        def f(rows, data, offs):
            sets, bounds = shingle_sets(data, offs, words)
            own = [np.sort(sets[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            return [rows.column(0), rows.column(2), pa.array([x.tobytes() for x in own], pa.binary())]

        return f

    found = map_texts(docs.join(nodes, "doc_id").select("doc_id", "text", "degree"), "node long, degree long, set binary", make).distinct()
    sets = written(found.withColumn("code", F.xxhash64("set")), "near-sets")
    end = lambda side: sets.select(*(F.col(c).alias(f"{c}_{side}") for c in ("node", "degree", "code")))
    ends = pairs.join(end("a"), F.col("a") == F.col("node_a")).join(end("b"), F.col("b") == F.col("node_b"))
    by_a = F.col("degree_a") >= F.col("degree_b")
    either = lambda c, yes, no: F.when(by_a, F.col(f"{c}_{yes}")).otherwise(F.col(f"{c}_{no}"))
    blocks = F.ceil(F.greatest("degree_a", "degree_b") / HUB_BLOCK).cast("int")
    dealt = ends.select(either("node", "a", "b").alias("hub"), either("code", "a", "b").alias("hub_code"), either("node", "b", "a").alias("member"), either("code", "b", "a").alias("code"), blocks.alias("blocks"))
    dealt = written(dealt.withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")).drop("blocks"), "near-dealt")
    hubs = dealt.select("hub", "hub_code", "block").distinct()
    hub_rows = hubs.join(sets.select(F.col("node").alias("hub"), F.col("code").alias("hub_code"), "set"), ["hub", "hub_code"]).select("hub", "hub_code", "block", F.lit(None).cast("long").alias("member"), "set")
    member_rows = dealt.join(sets.select(F.col("node").alias("member"), "code", "set"), ["member", "code"]).select("hub", "hub_code", "block", "member", "set")
    rows = hub_rows.unionByName(member_rows).repartition("hub", "hub_code", "block").sortWithinPartitions("hub", "hub_code", "block", F.col("member").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, against = None, []  # sets of one hub: one, unless two have the same code
        for batch in batches:
            hubs, codes, blocks, members = (batch.column(k).to_pylist() for k in range(4))
            a, b = [], []
            for i, (hub, member) in enumerate(zip(hubs, members)):
                x = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                if member is None:
                    if key != (hub, codes[i], blocks[i]):
                        key, against = (hub, codes[i], blocks[i]), []
                    against.append(x.copy())  # outlives its batch
                elif any(linked(x, y, similarity) for y in against):
                    a.append(min(hub, member))
                    b.append(max(hub, member))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return written(rows.mapInArrow(lambda batches: memory_returned(run(batches)), "a long, b long").distinct(), "near-links")


def _last_written(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` wrote last, which it returns; the tables it wrote on the way (the sets of a round above all) are
    removed, so the disk holds those of one round."""
    with scratch_scope(spark) as paths:
        out = make()
        path = paths.pop()
    handed_over(path)
    return out


def linked(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    """Whether two sorted sets reach the similarity; the shorter one is looked up in the longer."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or len(x) * 100 < similarity * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= similarity * (len(x) + len(y) - both)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b). Labels take
    the minimum over neighbours and then the label of their label, until nothing changes; each
    round is written to the shared folder."""
    ends = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-ends")
    labels = written(ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "near-labels")
    while True:
        near = ends.join(labels.toDF("b", "c"), "b").groupBy("a").agg(F.min("c").alias("c"))
        moved = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("mid"))
        jump = moved.join(labels.toDF("mid", "up"), "mid").select("node", F.least("mid", "up").alias("component"), "old")
        new = written(jump, "near-labels")
        if new.where("component <> old").limit(1).count() == 0:
            return new.select("node", "component")
        labels = new.select("node", "component")


def _with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links: the components of the links between components."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    above = components(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    nodes = labels.unionByName(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels.select("node"), "node", "left_anti").withColumn("component", F.col("node")))
    return written(nodes.join(above.toDF("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component")), "near-labels")


def _small_sets(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, small): the sorted low halves of a node's shingle hashes; null where the set is larger
    than ``SMALL``, two halves are equal or the id has several sets. Equal shingles have equal halves, so
    an intersection counted on them is never too small."""
    def make():
        def f(rows, data, offs):
            sets, bounds = shingle_sets(data, offs, words)
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                half = np.unique(sets[a:b].astype(np.uint32)) if b - a <= SMALL else sets[:0]
                out.append(half.tobytes() if 0 < len(half) == b - a else None)
            return [rows.column(0), pa.array(out, pa.binary())]

        return f

    found = map_texts(docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi").select("doc_id", "text"), "node long, small binary", make)
    one = (F.count("small") == F.count("*")) & (F.min("small") == F.max("small"))
    return written(found.groupBy("node").agg(F.when(one, F.max("small")).alias("small")), "near-small")


def possible(sets: list[np.ndarray | None], i: int, others: np.ndarray, similarity: int) -> np.ndarray:
    """Flags of the ``others`` that can reach the similarity with set ``i``; true where either is unknown."""
    out = np.ones(len(others), dtype=bool)
    known = np.array([k for k, j in enumerate(others) if sets[j] is not None], dtype=np.int64)
    if sets[i] is None or not len(known):
        return out
    there = [sets[j] for j in others[known]]
    size = np.array([len(x) for x in there])
    every = np.concatenate(there)
    at = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
    both = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.cumsum(size) - size)
    out[known] = 100 * both >= similarity * (len(sets[i]) + size - both)
    return out


def _residual(buckets: DataFrame, classes: DataFrame, labels: DataFrame, src: DataFrame, words: int, similarity: int, distance: int, block: int, nearest: bool) -> DataFrame:
    """(a, b, d, key): pairs of different components within the threshold, their distance and their bucket, of the buckets
    that hold several components; with ``nearest`` one pair for each member of a bucket's block at most. A bucket that
    gives no row has no such pair, nor will it have one later, when components have grown together."""
    rows = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = written(rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n"), "near-mixed")
    rows = rows.join(mixed, "key")
    if nearest:
        rows = rows.withColumn("small", F.lit(None).cast("binary"))
    else:
        nodes = written(rows.select("node").distinct(), "near-nodes")
        rows = rows.join(_small_sets(nodes, src, words), "node", "left")
    rows = rows.join(classes.select("node", "sig"), "node")
    # a bucket of many members is cut into blocks, compared two by two
    cuts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), cuts).cast("int")
    units = (rows.select("key", "node", "component", "sig", "small", own.alias("own"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("other"))
             .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "component", "sig", "own", "small"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, x, y, node, comp, sig, own, sets in _units(batches):
            left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
            keys = bucket_keys(sig).reshape(len(node), -1)
            here = np.int64(key).view(np.uint64)
            out: tuple[list, list, list, list] = [], [], [], []
            for i in left:
                j = right[right > i] if x == y and not nearest else right
                j = j[comp[j] != comp[i]]
                d = distances(sig[i], sig[j])
                j, d = j[d <= distance], d[d <= distance]
                if len(j) and nearest:
                    at = np.argmin(d)
                    j, d = j[[at]], d[[at]]
                elif len(j):  # a pair is given out by the first bucket both are in
                    first = keys[i][np.argmax(keys[j] == keys[i], axis=1)] == here
                    j, d = j[first], d[first]
                    can = possible(sets, i, j, similarity)
                    j, d = j[can], d[can]
                for column, x_ in zip(out, (np.full(len(j), node[i]), node[j], d, np.full(len(j), np.int64(key)))):
                    column.append(x_)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int64()) for v in out], names=["a", "b", "d", "key"])

    found = units.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(lambda batches: memory_returned(run(batches)), "a long, b long, d long, key long").where("a <> b")
    return written(found, "near-found")


def _residual_pairs(found: DataFrame, nearest: bool) -> DataFrame:
    """The pairs (a, b) of ``_residual``; with ``nearest`` the nearest one of each member."""
    if nearest:
        found = found.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Units of equal (key, x, y) in sorted batches; one has at most two blocks of rows."""
    rest: pa.Table | None = None

    def out(t: pa.Table) -> tuple:
        c = [x.combine_chunks() for x in t.columns]
        c = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in c]
        return c[0][0].as_py(), c[1][0].as_py(), c[2][0].as_py(), c[3].to_numpy(), c[4].to_numpy(), _symbols(c[5]), c[6].to_numpy(), [None if x is None else np.frombuffer(x, np.uint32) for x in c[7].to_pylist()]

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        cols = [table.column(k).to_numpy() for k in range(3)]
        cuts = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
        at = 0
        for c in cuts.tolist():
            if c - at > 1:
                yield out(table.slice(at, c - at))
            at = c
        rest = table.slice(at)
    if rest is not None and rest.num_rows > 1:
        yield out(rest)


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, distance: int = DISTANCE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over
    links of at least ``similarity`` percent), kept (doc_id = component_id)."""
    if similarity < SIMILARITY:
        raise ValueError(f"similarity {similarity}: signature distance and buckets find links from {SIMILARITY} percent on only")
    src = ids_and_texts(docs, id_col, text_col)
    if not isinstance(src.schema["doc_id"].dataType, IntegralType):
        return _by_numbers(src, words, similarity, distance, block)
    src = src.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = written(sketches(src, words), "near-sketches")
    classes = written(known.where("hi IS NOT NULL AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.count("*").alias("n")), "near-classes")
    keys = _bucket_rows(classes)
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    buckets = written(keys.join(shared.select("key", "lo", "hi"), "key"), "near-buckets")
    spark = src.sparkSession
    labels = components(_last_written(spark, lambda: _confirmed(_within(_star_pairs(buckets), classes, distance), src, words, similarity)))
    left = buckets.select("key", "node")
    for nearest in (True, True, False):
        found = _last_written(spark, lambda: _residual(left, classes, labels, src, words, similarity, distance, block, nearest))
        if nearest:  # buckets without a pair of two components within the threshold are done
            left = written(left.join(found.select("key").distinct(), "key", "left_semi"), "near-left")
        more = _last_written(spark, lambda: _confirmed(_residual_pairs(found, nearest), src, words, similarity))
        labels = _with_links(labels, more)
    # a class of very many copies is dealt over several keys; there are at most rows / HOT_CLASS of them
    cuts = F.ceil(F.col("n") / HOT_CLASS).cast("int")
    first = classes.select("hi", "lo", "node", cuts.alias("cuts")).join(labels, "node", "left").select("hi", "lo", "cuts", F.coalesce("component", "node").alias("component"))
    first = written(first, "near-components")
    hot = written(first.where("cuts > 1").select("hi", "lo", "cuts"), "near-hot")
    alone = F.col("hi").isNull() | F.col("doc_id").isNull()
    rows = known.select("doc_id", "n_shingles", "hi", "lo", F.monotonically_increasing_id().alias("row")).where(~alone).join(hot, ["hi", "lo"], "left")
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("cuts")).cast("int"), F.lit(0))).drop("cuts", "row")
    spread = first.select("hi", "lo", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"), F.col("component").alias("component_id"))
    out = rows.join(spread, ["hi", "lo", "part"], "left").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(known.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _by_numbers(src: DataFrame, words: int, similarity: int, distance: int, block: int) -> DataFrame:
    """Ids that are not whole numbers are numbered in their order, so the smallest id has the smallest number."""
    with releasing():
        numbers = written(dense_ids(src.where("doc_id IS NOT NULL"), ["doc_id"], "number"), "near-numbers")
    rows = attach_ids(src, numbers, ["doc_id"], "number").select("number", "text")
    found = near_duplicates(written(rows, "near-numbered"), words, similarity, distance, block, id_col="number")
    found = found.toDF("number", "n_shingles", "component", "kept")
    for number, name in (("number", "doc_id"), ("component", "component_id")):
        found = attach_ids(found, numbers.select(F.col("number").alias(number), F.col("doc_id").alias(name)), [number], name)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays: the rows of the smallest id, without rows that repeat its
    id and text; columns are unchanged. Rows with a null id stay. Only rows of ids that several rows have are moved
    to find repeated ones."""
    gone = written(near_duplicates(docs, words, similarity, id_col=id_col, text_col=text_col).where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct(), "near-gone")
    twice = written(docs.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col(id_col).isNotNull() & (F.col("n") > 1)).select(id_col), "near-twice")
    kept = docs.join(gone, id_col, "left_anti")  # a null id matches none
    once = kept.join(twice, id_col, "left_anti")
    more = kept.join(twice, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return once.unionByName(more).select(*docs.columns)
