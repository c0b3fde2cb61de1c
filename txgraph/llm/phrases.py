"""Phrase collocation mining (12): the best-scoring phrases of two to four words in each language.

Best-first branch and bound. A phrase that begins with p and has a occurrences scores at most
floor(2000000 a / (f(first word) + a)), because what follows its first word occurs at least a times; this
grows with a <= f(p), so the prefix count bounds every phrase that grows from p, and in the same way
the count of a last part bounds every phrase that ends in it. For each language

1. words and pairs with ``MIN_COUNT`` occurrences are counted; the pairs are scored in full;
2. the frontier is all parts whose bound reaches a threshold, first the score of the language's
   ``BATCH`` x ``TOP``-th best pair; only phrases that grow from the frontier, or by one word from a phrase at the
   threshold (which tells whether that phrase is dropped), are counted;
3. every phrase at the threshold is then known with its exact counts. If ``TOP`` of them survive, the
   language is settled, ties included; otherwise the threshold falls to a deeper pair and 2. is done again.

A phrase inside a longer candidate is inside one that is one word longer and at least as frequent, so
counts of one-word extensions decide what is dropped.

Counting passes read the texts in slices and count equal phrases of a slice before the shuffle (by 64-bit
hash; over the corpus phrases are grouped by their text). Which words, pairs and parts matter is told to the
tasks by bit maps of fixed size (``FILTER_BITS``): a false hit only counts a phrase that is not needed.

Defined results: a null text counts as empty, a null language as ``und``; rows that repeat count again;
texts of any length are read whole, in windows of words; ties go to the smaller phrase in byte order; languages
without a phrase of 30 occurrences, and empty tables, give no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txgraph.llm import textkernel as K
from txgraph.llm.common import memory_returned, written

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
BATCH = 3             # the first threshold is the score of the BATCH x TOP-th pair
DEEPER = 4            # each further one lies so many times deeper
DROP = (80, 100)      # dropped inside a longer candidate with 80/100 of the occurrences
SCALE = 2_000_000
FILTER_BITS = 1 << 26
SLICE_BYTES = 4 << 20
_WINDOW = 1 << 20     # words counted at once
_BLOCK = 1 << 18      # bytes hashed at once
_OUT_ROWS = 1 << 14   # rows handed to Spark at once
_BREAK = K.byte_class([(ord(c), ord(c)) for c in ".,;:!?"] + [(0x0A, 0x0D)])
_WORD = ~(_BREAK | K.byte_class([(0x20, 0x20), (0x09, 0x09)]))
_INVERSE = np.uint64(pow(int(K._BASE), -1, 1 << 64))


_falling: dict[int, np.ndarray] = {}


def _inverse_powers(n: int) -> np.ndarray:
    """Inverse powers of the hash base."""
    if n not in _falling:
        out = np.full(n, _INVERSE, np.uint64)
        out[:1] = 1
        _falling[n] = np.multiply.accumulate(out)
    return _falling[n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, from one running sum over each block of bytes."""
    n, at = len(starts), 0
    out = np.zeros(n, np.uint64)
    rising, falling = K._power_table(_BLOCK + 1), _inverse_powers(_BLOCK + 1)
    long_ones = np.flatnonzero(ends - starts > _BLOCK)
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, side="right")))
        if end == at + 1 and ends[at] - starts[at] > _BLOCK:
            at = end
            continue
        low = starts[at]
        part = K._BYTE_CODE[data[low : ends[end - 1]]]
        part *= rising[: len(part)]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
        s, e = starts[at:end] - low, ends[at:end] - low
        out[at:end] = K.mix((total[e] - total[s]) * falling[s] + (e - s).astype(np.uint64) * K._BASE)
        at = end
    for i in long_ones:
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Slice:
    """Words of a window of a slice of texts: hashes of its phrases, and which lie in one piece."""

    def __init__(self, data, starts, ends, piece, h, salts, lang, own):
        self.data, self.starts, self.ends, self.piece, self.h, self.salts, self.lang = data, starts, ends, piece, h, salts, lang
        self.own = own  # phrases that start at the first words, the others belong to the next window
        self._grams: dict[int, np.ndarray] = {}

    def starts_of(self, k: int) -> int:
        """How many positions can start a phrase of k words."""
        return max(0, min(self.own, len(self.h) - k + 1))

    def hashes(self, k: int) -> np.ndarray:
        """Hash of the k words from each position on, with the language."""
        if k not in self._grams:
            g = K.gram_hashes(self.h, k)
            self._grams[k] = K.mix(g ^ self.salts[self.lang[: len(g)]])
        return self._grams[k]

    def whole(self, k: int) -> np.ndarray:
        n = self.starts_of(k)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words from the given positions, joined by single spaces."""
        begin, lens = self.starts[at], self.ends[at + k - 1] - self.starts[at]
        odd = np.zeros(len(at), bool)
        for j in range(k - 1):
            gap = self.ends[at + j]
            odd |= (self.starts[at + j + 1] - gap != 1) | (self.data[np.minimum(gap, len(self.data) - 1)] != 0x20)
        if odd.any():
            words = [b" ".join(self.data[self.starts[i + j] : self.ends[i + j]].tobytes() for j in range(k)) for i in at[odd]]
            pool = np.concatenate((self.data, np.frombuffer(b"".join(words), np.uint8)))
            lens[odd] = [len(w) for w in words]
            begin[odd] = len(self.data) + np.cumsum(lens[odd]) - lens[odd]
        else:
            pool = self.data
        offs = np.concatenate(([0], np.cumsum(lens)))
        flat = pool[np.repeat(begin - offs[:-1], lens) + np.arange(offs[-1])]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())


def _windows(batch: pa.RecordBatch) -> Iterator[tuple[Slice, list[str]]]:
    """The texts of an Arrow batch (lang, text), a window of words at a time."""
    langs = batch.column("lang").dictionary_encode()
    names = langs.dictionary.to_pylist()
    code = langs.indices.to_numpy()
    salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
    for a, b, data, offs in K.slices(batch.column("text"), SLICE_BYTES):
        data = K.looked_up(K.LOWER, data)
        starts, ends, bounds = K.words(data, offs, _WORD)
        doc = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(bounds))
        piece = np.searchsorted(np.flatnonzero(K.looked_up(_BREAK, data)), starts).astype(np.int32) + doc
        lang = code[a:b][doc]
        del doc
        for at in range(0, len(starts), _WINDOW):
            end = min(len(starts), at + _WINDOW + MAX_WORDS - 1)
            s, e = starts[at:end], ends[at:end]
            h = word_hashes(data, s, e)
            yield Slice(data, s, e, piece[at:end], h, salts, lang[at:end], min(_WINDOW, len(starts) - at)), names


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _counted(docs: DataFrame, wanted: Callable[[Slice, list[np.ndarray]], list[tuple[int, np.ndarray]]], filters: list, texts: bool) -> DataFrame:
    """Counts of the wanted phrases (lists of (words, flags of the starting positions)), added up over
    the corpus: by hash alone with the word total of each language (h null), or by language and text."""
    fields = [("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("h", pa.int64()), ("n", pa.int64())]
    if not texts:
        fields = [fields[0], *fields[3:]]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [np.frombuffer(f.value, np.uint8) for f in filters]
        for batch in batches:
            for s, names in _windows(batch):
                for k, flags in wanted(s, maps):
                    at = np.flatnonzero(flags)
                    keys = s.hashes(k)[at]
                    order, new = K.dense_order(keys)
                    first = np.flatnonzero(new)
                    n, rep = np.diff(np.append(first, len(at))), at[order[first]]
                    h = keys[order[first]].view(np.int64)
                    for a in range(0, len(rep), _OUT_ROWS):
                        some = slice(a, a + _OUT_ROWS)
                        if texts:
                            lang = pa.DictionaryArray.from_arrays(pa.array(s.lang[rep[some]].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
                            cols = [lang, s.texts(rep[some], k), pa.array(np.full(len(rep[some]), k, np.int32)), pa.array(h[some]), pa.array(n[some])]
                        else:
                            cols = [pa.nulls(len(rep[some]), pa.string()), pa.array(h[some]), pa.array(n[some])]
                        yield pa.RecordBatch.from_arrays(cols, schema=schema)
                if not texts:
                    n = np.bincount(s.lang[: s.own], minlength=len(names))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.nulls(len(names), pa.int64()), pa.array(n)], schema=schema)

    ddl = "lang string, phrase string, k int, h long, n long" if texts else "lang string, h long, n long"
    keys = [x.split()[0] for x in ddl.split(", ")][:-1]
    return docs.mapInArrow(lambda batches: memory_returned(run(batches)), ddl).groupBy(*keys).agg(F.sum("n").alias("n"))


def _bits(df: DataFrame):
    """Broadcast bit map of the hashes ``h``: FILTER_BITS / 8 bytes whatever the number of rows."""
    at = F.col("h").bitwiseAND(FILTER_BITS - 1)
    words = (df.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(h & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return df.sparkSession.sparkContext.broadcast(out.tobytes())


def _destroyed(filters: list) -> None:
    """Bit maps of a written pass are needed by no task any more."""
    for f in filters:
        f.destroy()


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _score(a: str, other: Column) -> Column:
    """floor(SCALE * a / other), exact beyond 64 bits."""
    return F.call_function("div", _wide(a) * F.lit(SCALE).cast("decimal(10,0)"), other)


def _scored(cands: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, k, h, a, l, r, score, first, last): the lowest-scoring cut, and the counts of the first
    and the last word. Phrases with a part that was not counted score below the threshold and go."""
    cut = "transform(sequence(1, k - 1), j -> struct(j, concat_ws(' ', slice(w, 1, j)) AS head, concat_ws(' ', slice(w, j + 1, k)) AS tail))"
    cuts = (cands.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "k", "h", F.col("n").alias("a"), F.explode(F.expr(cut)).alias("c"))
            .select("lang", "phrase", "k", "h", "a", "c.*"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    both = both.withColumn("score", _score("a", _wide("l") + _wide("r")))
    best = F.min(F.struct("score", "j", "l", "r"))
    return (both.groupBy("lang", "phrase", "k", "h", "a").agg(best.alias("m"), F.count("*").alias("n_cuts"), F.max(F.when(F.col("j") == 1, F.col("l"))).alias("first"),
                                                          F.max(F.when(F.expr("j = k - 1"), F.col("r"))).alias("last"))
            .where("n_cuts = k - 1").select("lang", "phrase", "k", "h", "a", "m.l", "m.r", "m.score", "first", "last"))


def _bound(end: str) -> Column:
    return _score("a", _wide("a") + _wide(end))


def _thresholds(pairs: DataFrame, depth: int) -> DataFrame:
    """(lang, least): the score of the depth-th best pair, 0 where there are fewer."""
    best = Window.partitionBy("lang").orderBy(F.col("score").desc())
    cut = pairs.withColumn("i", F.row_number().over(best)).where(F.col("i") <= depth)
    return cut.groupBy("lang").agg(F.when(F.max("i") >= depth, F.min("score")).otherwise(F.lit(0)).cast("long").alias("least"))


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP, min_count: int = MIN_COUNT, batch: int = BATCH) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    often = F.col("n") >= min_count
    words = written(_counted(src, lambda s, m: [(1, s.whole(1))], [], False).where(often | F.col("h").isNull()), "phrase-words")
    total = words.where("h IS NULL").select("lang", F.col("n").alias("n_words"))
    known = [_bits(words.where("h IS NOT NULL"))]

    def two(s: Slice, m: list) -> np.ndarray:
        word = _held(m[0], s.hashes(1))
        n = s.starts_of(2)
        return s.whole(2) & word[:n] & word[1 : 1 + n]

    both = written(_counted(src, lambda s, m: [(2, two(s, m))], known, False).where(often & F.col("h").isNotNull()), "phrase-pairs")
    known.append(_bits(both))

    def texts_of_both(s: Slice, m: list) -> list:
        pair = two(s, m)
        at = np.flatnonzero(pair)
        pair[at] = _held(m[1], s.hashes(2)[at])
        return [(1, _held(m[0], s.hashes(1)[: s.own])), (2, pair)]

    counts = written(_counted(src, texts_of_both, known, True).where(often), "phrase-counts")
    known[0].destroy()
    pairs = written(_scored(counts.where("k = 2"), counts), "phrase-scored")

    def three(s: Slice, m: list) -> list:
        flags = s.whole(3)
        at, h = np.flatnonzero(flags), s.hashes(2)
        a, b = h[at], h[at + 1]
        flags[at] = _held(m[0], a) & _held(m[0], b) & (_held(m[1], a) | _held(m[2], b))
        return [(3, flags)]

    def four(s: Slice, m: list) -> list:
        flags = s.whole(4)
        at, h = np.flatnonzero(flags), s.hashes(3)
        a, b = h[at], h[at + 1]
        flags[at] = (_held(m[0], a) & _held(m[1], b)) | _held(m[2], a) | _held(m[2], b)
        return [(4, flags)]

    done: DataFrame | None = None
    open_langs, depth = pairs.select("lang").distinct(), batch * top
    while True:
        least = written(_thresholds(pairs.join(open_langs, "lang", "left_semi"), depth), "phrase-least")
        reach = lambda df, c: df.join(least, "lang").where(c >= F.col("least")).drop("least")
        grow = [known[1], _bits(reach(pairs, _bound("first"))), _bits(reach(pairs, _bound("last")))]
        triples = written(_counted(src, three, grow, True).where(often), "phrase-triples")
        _destroyed(grow[1:])
        scored = written(_scored(triples, counts), "phrase-scored-3")
        at_least = reach(scored, F.col("score"))
        grow4 = [_bits(reach(scored, _bound("first"))), _bits(reach(scored, _bound("last"))), _bits(at_least)]
        fours = written(_counted(src, four, grow4, True).where(often), "phrase-fours")
        _destroyed(grow4)
        scored4 = _scored(fours, counts.unionByName(triples))
        longer = triples.unionByName(fours).select("lang", "n", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"))
        longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("within"))
        found = reach(pairs, F.col("score")).unionByName(at_least).unionByName(reach(scored4, F.col("score")))
        stay = F.col("within").isNull() | (_wide("within") * DROP[1] < _wide("a") * DROP[0])
        order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        best = (found.join(longer, ["lang", "phrase"], "left").where(stay).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
                .select("lang", "rank", "phrase", "a", "l", "r", "score"))
        best = written(best, "phrase-best")
        full = best.groupBy("lang").agg(F.count("*").alias("n"))
        settled = least.join(full, "lang", "left").where(F.expr(f"least = 0 OR coalesce(n, 0) >= {top}")).select("lang")
        best = best.join(settled, "lang", "left_semi")
        done = best if done is None else done.unionByName(best)
        open_langs = written(least.select("lang").join(settled, "lang", "left_anti"), "phrase-open")
        depth *= DEEPER
        if open_langs.isEmpty():
            break
    known[1].destroy()
    return done.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")
