"""Quality rules (8): suffix-array repetition beside the usual word, symbol and line rules.

For each text, the words inside 8-word windows that occur twice are the only ones that can belong
to a repeat of 8 words or more. Their runs are joined into one integer text (a word of another
document is another symbol, every run ends with a symbol of its own), its suffix array and
longest-common-prefix array are built, and every suffix's longest repeat is the larger of its two
neighbouring common prefixes. The spans of the maximal repeats are united; the verdict limits the
fraction of characters covered and the longest repeat in words.

With ``min_chars`` (the registered query) the array is built over the characters of the text, runs
of white space counting as one space: repeats that start or end inside words, of fewer than 8 words,
or in scripts without spaces count too. Only characters inside a window of ``min_chars`` characters
that occurs twice can belong to such a repeat, so the array over them gives the same repeats as one
over all. Repeats of 8 words that are shorter than that stay in the covered part.

Defined results: null or empty text has zero counts and fails the base rule; repeated rows give
repeated results; a null id is kept; extra columns are ignored; no rows, no result rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from txgraph.llm import textkernel as K
from txgraph.llm.common import id_type, ids_and_texts, map_texts

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_COVERED = 0.30
MAX_LONGEST = 400
MIN_CHARS = 20
MAX_LONGEST_CHARS = 500
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUES = K.byte_class([(0x80, 0xBF)])
_WORD_CHAR = K.SPACE_WORD & ~_CONTINUES


def repeat_spans(h: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of ``window`` or more words (or characters) inside each document.

    h: word hashes, bounds: first word of each document. Returns (covered, at, length): flags of
    the words in windows that repeat, and for each suffix inside them its longest repeat.
    """
    n = len(h)
    covered = np.zeros(n, bool)
    none = np.zeros(0, np.int64)
    begins = K.starts_within(bounds, window)
    if not len(begins):
        return covered, none, none
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    own = K.mix(h + K.mix(doc + np.uint64(1)))
    again = begins[K.repeated(K.gram_hashes(own, window)[begins])]
    if not len(again):
        return covered, none, none
    covered = K.cover(again, window, n)
    at = np.flatnonzero(covered)
    # runs of covered words inside one document, each closed by a symbol of its own
    breaks = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])))
    run = np.cumsum(breaks) - 1
    n_runs = int(run[-1]) + 1
    place = np.arange(len(at)) + run
    text = np.empty(len(at) + n_runs, dtype=np.uint64)
    text[place] = own[at]
    ends = np.append(place[np.flatnonzero(breaks)[1:]] - 1, len(text) - 1)
    text[ends] = K.mix(np.arange(n_runs, dtype=np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    order, levels = K.suffix_array(text)
    lcp = K.adjacent_lcp(order, levels)
    longest = np.zeros(len(text), dtype=np.int64)
    longest[order[:-1]] = lcp
    longest[order[1:]] = np.maximum(longest[order[1:]], lcp)
    length = longest[place]
    long_enough = length >= window
    return covered, at[long_enough], length[long_enough]


def _by_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return K.counts_by(bounds, np.flatnonzero(flags))


def character_repeats(data: np.ndarray, offs: np.ndarray, min_chars: int, also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: characters of words inside maximal repeats of ``min_chars`` or more characters
    or at bytes flagged in ``also``, and the longest such repeat in characters."""
    n = len(offs) - 1
    head = np.flatnonzero(~_CONTINUES[data])
    bounds = np.searchsorted(head, offs)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    space = ~K.SPACE_WORD[data[head]]
    first = np.zeros(len(head) + 1, bool)
    first[bounds] = True
    at = np.flatnonzero(~space | first[:-1] | ~np.concatenate(([False], space[:-1])))  # one of each run of white space
    inner = np.searchsorted(at, bounds)
    symbol = np.where(space, 0x20, code)[at].astype(np.uint64)
    _, start, length = repeat_spans(K.mix(symbol), inner, min_chars)
    inside = also[head]
    inside[at] |= K.cover(start, length, len(at))
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, np.searchsorted(inner, start, side="right") - 1, length)
    return _by_doc(inside & ~space, bounds), longest


def slice_stats(data: np.ndarray, offs: np.ndarray, min_chars: int | None = None) -> dict[str, np.ndarray]:
    """All per-document counts of one slice; repeats in characters if ``min_chars`` is given."""
    n = len(offs) - 1
    starts, ends, bounds = K.words(data, offs, K.SPACE_WORD)
    h = K.hash_spans(data, starts, ends)
    word_chars = _by_doc(K.looked_up(_WORD_CHAR, data), offs)
    # lines: between line ends and document ends
    nl = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate((offs[:-1], nl + 1)))
    line_doc = np.repeat(np.arange(n), 1 + K.counts_by(offs, nl))
    line_end = np.sort(np.concatenate((offs[1:], nl)))
    with_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    ls, le, ld = line_start[with_word], line_end[with_word], line_doc[with_word]
    key = K.mix(K.hash_spans(data, ls, le) + K.mix(ld.astype(np.uint64) + np.uint64(7)))
    _, first = np.unique(key, return_index=True)
    n_lines = np.bincount(ld, minlength=n)
    n_dup = n_lines - np.bincount(ld[first], minlength=n)
    covered, at, length = repeat_spans(h, bounds)
    spans = K.cover(at, length, len(h))
    chars = np.zeros(len(h), dtype=np.int64)
    if len(h):
        head = np.flatnonzero(~K.looked_up(_CONTINUES, data))
        chars = np.searchsorted(head, ends) - np.searchsorted(head, starts)
    total = np.concatenate(([0], np.cumsum(np.where(spans, chars, 0))))
    doc_of = np.repeat(np.arange(n), np.diff(bounds))
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, doc_of[at], length)
    repeat_chars = total[bounds[1:]] - total[bounds[:-1]]
    if min_chars is not None:
        repeat_chars, longest = character_repeats(data, offs, min_chars, K.cover(starts[spans], (ends - starts)[spans], len(data)))
    return {
        "n_words": np.diff(bounds), "word_chars": word_chars, "n_symbols": _by_doc(K.looked_up(_SYMBOL, data), offs), "n_dup_lines": n_dup,
        "n_repeat_words": _by_doc(covered, bounds), "repeat_chars": repeat_chars, "longest_repeat": longest,
    }


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, max_covered: float = MAX_COVERED,
                  max_longest: int = MAX_LONGEST, id_col: str = "doc_id", text_col: str = "text", min_chars: int | None = None) -> DataFrame:
    """One row per document: the counts, base_failed, repeat_chars, longest_repeat and kept.

    Repeats, longest_repeat and max_longest are in words, from 8 on; with ``min_chars`` in characters, from that many on.
    """
    src = ids_and_texts(docs, id_col, text_col)

    def make():
        def f(rows, data, offs):
            s = slice_stats(data, offs, min_chars)
            failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeat_percent * s["n_words"])
            fine = (s["repeat_chars"] <= max_covered * s["word_chars"]) & (s["longest_repeat"] <= max_longest)
            return [rows.column(0), *s.values(), failed, ~failed & fine]

        return f

    names = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_chars, longest_repeat".split(", ")
    return map_texts(src, f"doc_id {id_type(src)}, {', '.join(f'{c} long' for c in names)}, base_failed boolean, kept boolean", make)
