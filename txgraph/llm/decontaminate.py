"""Benchmark decontamination (7): suffix arrays over the training words, searched with every
suffix of the test items.

Each task builds word-level suffix arrays over shards of its documents (a shard is a slice of
text; a document lies in one shard, so nothing is shuffled). Every test suffix is looked up by
binary search; the suffixes that share its first ``window`` words form an interval, all of whose
places are hits, and runs of hits on one diagonal are the longest verbatim matches. The test items
are sent to the tasks in blocks of at most ``BLOCK_WORDS`` words, one pass over the documents per
block; a benchmark of any size is searched whole.

Defined results: a null or empty text has no words and no hits; an item of fewer than ``window``
words is one window, one without words is none; repeated rows give repeated results; a null id is
kept; extra columns are ignored; no documents, no result rows; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.llm import textkernel as K
from txgraph.llm.common import id_type, ids_and_texts, map_texts, memory_returned

WINDOW = 10
BLOCK_WORDS = 1_000_000
SHARD_BYTES = 2 << 20


class Suffixes:
    """Test suffixes of one block, as hashes of their first ``window`` words."""

    def __init__(self, items: list[tuple], window: int):
        data = np.frombuffer(b"".join((t or "").encode() for _, t in items), dtype=np.uint8)
        offs = np.concatenate(([0], np.cumsum([len((t or "").encode()) for _, t in items]))).astype(np.int64)
        self.items = [i for i, _ in items]
        h, bounds = lower_words(data, offs)
        n = np.diff(bounds)
        self.word = h
        count = np.where(n == 0, 0, np.maximum(n - window + 1, 1))
        self.item = np.repeat(np.arange(len(n)), count)
        self.offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        self.begin = bounds[:-1][self.item] + self.offset
        self.length = np.minimum(n, window)[self.item]


def lower_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased (A-Z) texts, and the first word of each."""
    low = K.LOWER[data]
    starts, ends, bounds = K.words(low, offs, K.ALNUM_WORD)
    return K.hash_spans(low, starts, ends), bounds


def search(sym: np.ndarray, order: np.ndarray, queries: list[np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query its interval [lo, hi) of the suffix array, by binary search one word at a
    time (queries[d] is word d of every query; a query ends at its length)."""
    m, n = len(lengths), len(sym)
    lo, hi = np.zeros(m, np.int64), np.full(m, len(order), np.int64)
    for d, word in enumerate(queries):
        live = np.flatnonzero((d < lengths) & (lo < hi))
        if not len(live):
            break
        w = word[live]
        edges = []
        for right in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                got = sym[np.minimum(order[np.minimum(mid, n - 1)] + d, n - 1)]
                less = (got <= w) if right else (got < w)
                a = np.where(open_ & less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            edges.append(a)
        lo[live], hi[live] = edges
    return lo, hi


def shard_matches(h: np.ndarray, bounds: np.ndarray, tests: Suffixes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, test suffix, length) of every occurrence of a test window in the shard's words."""
    n_docs = len(bounds) - 1
    none = np.zeros(0, np.int64)
    if not len(h) or not len(tests.begin):
        return none, none, none
    # the shard's text: words, every document closed by a symbol of its own
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    place = np.arange(len(h)) + doc
    text = np.empty(len(h) + n_docs, dtype=np.uint64)
    text[place] = h
    text[bounds[1:] + np.arange(n_docs)] = K.mix(np.arange(n_docs, dtype=np.uint64) ^ np.uint64(0x5A5A5A5A5A5A5A5A))
    order, levels = K.suffix_array(text, depth=max(window, 2))
    sym, word_of = levels[0], None
    vocabulary, first = np.unique(text, return_index=True)
    at = np.minimum(np.searchsorted(vocabulary, tests.word), len(vocabulary) - 1)
    word_of = np.where(vocabulary[at] == tests.word, sym[first[at]], -1)
    absent = np.concatenate(([0], np.cumsum(word_of < 0)))
    able = np.flatnonzero(absent[tests.begin + tests.length] == absent[tests.begin])
    if not len(able):
        return none, none, none
    queries = [word_of[np.minimum(tests.begin[able] + d, len(word_of) - 1)] for d in range(window)]
    lo, hi = search(sym, order, queries, tests.length[able])
    size = hi - lo
    total = int(size.sum())
    which = np.repeat(np.arange(len(able)), size)
    slot = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    back = np.full(len(text), -1, np.int64)
    back[place] = np.arange(len(h))
    return back[order[slot]], able[which], tests.length[able][which]


def longest(start: np.ndarray, suffix: np.ndarray, length: np.ndarray, tests: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join windows that follow one another in both texts: (item, start word, words)."""
    if not len(start):
        return start, start, start
    item, diagonal = tests.item[suffix], start - tests.offset[suffix]
    by = np.lexsort((start, diagonal, item))
    item, diagonal, start, length = item[by], diagonal[by], start[by], length[by]
    new = np.concatenate(([True], (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (start[1:] != start[:-1] + 1)))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(by)) - 1
    return item[at], start[at], start[last] + length[last] - start[at]


def _one_block(docs: DataFrame, tests: Suffixes, window: int) -> DataFrame:
    kind = id_type(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tests)  # at most BLOCK_WORDS words

    def make():
        tests = shared.value

        def f(rows, data, offs):
            h, bounds = lower_words(data, offs)
            start, suffix, length = shard_matches(h, bounds, tests, window)
            hit = K.cover(start, length, len(h)) if len(start) else np.zeros(len(h), bool)
            n_hit = K.counts_by(bounds, np.flatnonzero(hit))
            matches: list[list] = [[] for _ in range(len(rows))]
            item, first, words = longest(start, suffix, length, tests)
            doc = np.searchsorted(bounds, first, side="right") - 1
            for d, i, a, n in zip(doc.tolist(), item.tolist(), (first - bounds[doc]).tolist(), words.tolist()):
                matches[d].append({"item": tests.items[i], "start": a, "words": n})
            return [rows.column(0), np.diff(bounds), n_hit, matches]

        return f

    return map_texts(docs, f"doc_id {kind}, n_words long, n_hit long, matches array<struct<item:string,start:long,words:long>>", make, SHARD_BYTES)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, matches (item, first word, words: the longest
    verbatim matches of ``window`` words or more)."""
    src = ids_and_texts(docs, id_col, text_col)
    parts = [_one_block(src, tests, window) for tests in _blocks(benchmark, window, block_words, item_col, item_text_col)]
    return parts[0] if len(parts) == 1 else _united(parts)


def _blocks(benchmark: DataFrame, window: int, block_words: int, item_col: str, item_text_col: str) -> Iterator[Suffixes]:
    """The test items in blocks, one at a time on the driver; the number of blocks follows from
    the measured size of the benchmark."""
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    chars = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + int(chars) // (2 * block_words)  # a word and its separator have two bytes at least
    for b in range(n_blocks):
        block = tests if n_blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b)
        yield Suffixes([(r["item"], r["text"]) for r in block.collect()], window)


def _united(parts: list[DataFrame]) -> DataFrame:
    """Matches of all blocks of the benchmark, one row per document; the hit words are the union
    of the match spans. Rows are told apart by their place in the input."""
    numbered = [p.withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.lit(b)) for b, p in enumerate(parts)]
    all_ = numbered[0]
    for p in numbered[1:]:
        all_ = all_.unionByName(p)
    one = all_.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    hit = F.expr("""aggregate(array_sort(transform(matches, m -> struct(m.start AS a, m.start + m.words AS b))),
        struct(0L AS n, 0L AS e), (s, m) -> struct(s.n + greatest(0L, m.b - greatest(m.a, s.e)) AS n, greatest(s.e, m.b) AS e), s -> s.n)""")
    return one.select("doc_id", "n_words", hit.alias("n_hit"), "matches")


def with_digest(matches: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, matches."""
    items = F.array_sort(F.array_distinct(F.expr("transform(matches, m -> m.item)")))
    return matches.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
                          (F.col("n_hit") > 0).alias("contaminated"), "matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows without a hit; their columns are unchanged, no row is moved. Each row is judged by
    its own text, so repeated or null ids need no rule; a null text has no hit and stays."""
    at = docs.columns.index(text_col)
    for tests in _blocks(benchmark, window, block_words, item_col, item_text_col):
        docs = _without_hits(docs, at, tests, window)
    return docs


def _without_hits(docs: DataFrame, at: int, tests: Suffixes, window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tests)  # at most BLOCK_WORDS words

    def run(batches):
        for batch in batches:
            for a, b, data, offs in K.slices(batch.column(at), SHARD_BYTES):
                h, bounds = lower_words(data, offs)
                start, _, _ = shard_matches(h, bounds, shared.value, window)
                hit = np.zeros(b - a, bool)
                hit[np.searchsorted(bounds, start, side="right") - 1] = True
                yield batch.slice(a, b - a).filter(pa.array(~hit))

    return docs.mapInArrow(lambda batches: memory_returned(run(batches)), docs.schema)
