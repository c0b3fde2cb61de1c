"""Language id (5): unigram pieces with all segmentations summed.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a
word is the sum over all its segmentations into pieces, by a forward pass over the piece lattice;
a text's is the product over its words. Training counts words per language over all training rows,
then runs expectation-maximisation rounds with forward-backward passes on the distinct words. What
reaches the driver is bounded by the vocabulary times the number of languages.

Words are whole runs of letters, lower-cased, with the vocabulary's word mark. Runs of more than
``WORD_CHARS`` letters are summed in logarithms, and those of more than ``STRETCH`` in stretches that carry the sums
of their last nodes over to the next, so a run of any length is one word and takes bounded memory. A
character without a piece has the same small probability in every language.

Defined results: null text, or one without a letter: ``und`` with score 0; no training rows: ``und``
with score 0 for all; rows without a language are predicted but not learned from; ties go to the
first language in order; repeated rows give repeated results; a null id is predicted, not learned
from; texts and runs of any length are read whole; more than ``MAX_LANGS`` languages are an error (the
model, pieces x languages, is broadcast); extra columns are ignored; no rows, no result rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.llm import textkernel as K
from txgraph.llm.common import fold, held_out, id_type, map_texts, written

MODEL = "piece_bpe_32k.model"
ROUNDS = 2
WORD_CHARS = 48     # longer words are summed in logarithms
STRETCH = 4096      # characters of a long word whose arcs are held at once
MAX_LANGS = 512
DICTIONARY = 300_000
SMOOTHING = 0.1
LOG_UNKNOWN = -14.0
LIFT = 4.0  # added to every log-probability per character while summing, against underflow
SAFE = 1e-200, 1e200  # sums of words outside are made again in logarithms: the lift of a word stays under 1e84, so what underflows on the way to a sum inside is no part of it
_LETTERS = re.compile(r"[^\W\d_]+")


class Lattice:
    """Arcs of the piece lattice of words: a prefix tree of the pieces, walked from all characters at once."""

    def __init__(self, model_file: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        pieces = sorted({p for p in (p.lower() for p in pieces) if re.fullmatch(r"▁?[^\W\d_]+|▁", p)})
        self.ids = {p: i + 1 for i, p in enumerate(pieces)}  # 0: a character without a piece
        self.size = len(pieces) + 1
        self.lengths = np.array([1] + [len(p) for p in pieces])
        prefixes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        number = {p: k + 1 for k, p in enumerate(sorted(prefixes))} | {"": 0}
        steps = sorted((number[p[:-1]] << 21 | ord(p[-1]), number[p]) for p in prefixes)
        self.keys, self.to = np.array(steps, np.int64).reshape(-1, 2).T.copy()
        self.piece_at = np.zeros(len(number), np.int64)
        for p, k in self.ids.items():
            self.piece_at[number[p]] = k

    def arcs(self, words: list[str], mark: str = "▁") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece) of every arc as nodes of all words together, ordered by the end's
        place in its word; first and last node of each word."""
        chars = np.frombuffer("".join([mark + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) + len(mark) for w in words], np.int64)
        last_char = np.cumsum(sizes)  # past the end of each word
        word = np.repeat(np.arange(len(words)), sizes)
        stop = last_char[word]
        # a word of n characters has n + 1 nodes
        first = last_char - sizes + np.arange(len(words))
        last = first + sizes
        at = np.arange(len(chars))
        state = np.zeros(len(chars), np.int64)
        single = np.zeros(len(chars), bool)
        begin, piece = [], []
        length = 0
        while len(at):
            key = state << 21 | chars[at + length]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[k] == key
            at, state = at[ok], self.to[k[ok]]
            length += 1
            p = self.piece_at[state]
            if length == 1:
                single[at] = p > 0
            begin.append(at[p > 0])
            piece.append(p[p > 0])
            inside = at + length < stop[at]
            at, state = at[inside], state[inside]
        alone = np.flatnonzero(~single)
        begin, piece = np.concatenate([*begin, alone]), np.concatenate([*piece, np.zeros(len(alone), np.int64)])
        node = begin + word[begin]
        end = node + self.lengths[piece]
        place = end - first[word[begin]]
        by = np.argsort(place * (len(chars) + len(words) + 1) + end)
        self.steps = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=1)[1:])))
        return node[by], end[by], piece[by], first, last


def lifted(lattice: Lattice, model: np.ndarray) -> np.ndarray:
    """Arc weights exp(log p + LIFT x length) of every piece, one column per language."""
    return np.exp(model + LIFT * lattice.lengths[:, None])


def forward(weights: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, n_nodes: int, steps: np.ndarray) -> np.ndarray:
    """Sum over all paths from each word's first node to every node."""
    alpha = np.zeros((n_nodes, weights.shape[1]))
    alpha[first] = 1.0
    for a, b in zip(steps[:-1], steps[1:]):
        e = end[a:b]
        new = np.concatenate(([True], e[1:] != e[:-1]))
        at = np.flatnonzero(new)
        alpha[e[at]] += np.add.reduceat(alpha[begin[a:b]] * weights[a:b], at, axis=0)
    return alpha


def forward_logs(weights: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, n_nodes: int, steps: np.ndarray) -> np.ndarray:
    """``forward`` with logarithms of the weights and of the sums."""
    alpha = np.full((n_nodes, weights.shape[1]), -np.inf)
    alpha[first] = 0.0
    for a, b in zip(steps[:-1], steps[1:]):
        e = end[a:b]
        at = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
        if len(at):
            alpha[e[at]] = np.logaddexp.reduceat(alpha[begin[a:b]] + weights[a:b], at, axis=0)
    return alpha


def _unsafe(sums: np.ndarray) -> np.ndarray:
    return ~((sums >= SAFE[0]) & (sums <= SAFE[1]))


def _by_size(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Places of the short words, of those summed in logarithms (in groups of a bounded number of
    characters) and of those walked in stretches."""
    size = np.array([len(w) for w in words], np.int64)
    middle = np.flatnonzero((size > WORD_CHARS) & (size <= STRETCH))
    cuts = np.flatnonzero(np.diff(np.cumsum(size[middle]) // (64 * STRETCH))) + 1
    return np.flatnonzero(size <= WORD_CHARS), [g for g in np.split(middle, cuts) if len(g)], np.flatnonzero(size > STRETCH)


def word_logs(lattice: Lattice, words: list[str], model: np.ndarray) -> np.ndarray:
    """log P(word | language), summed over all segmentations."""
    out = np.zeros((len(words), model.shape[1]))
    short, middle, long = _by_size(words)
    if len(short):
        some = [words[i] for i in short]
        begin, end, piece, first, last = lattice.arcs(some)
        alpha = forward(lifted(lattice, model)[piece], begin, end, first, int(last[-1]) + 1, lattice.steps)[last]
        unsafe = _unsafe(alpha).any(axis=1)
        alpha[unsafe] = 1.0
        out[short] = np.log(alpha) - LIFT * (last - first)[:, None]
        middle = [*middle, short[unsafe]] if unsafe.any() else middle
    for group in middle:
        begin, end, piece, first, last = lattice.arcs([words[i] for i in group])
        out[group] = forward_logs(model[piece], begin, end, first, int(last[-1]) + 1, lattice.steps)[last]
    for i in long:
        out[i] = stretched_logs(lattice, words[i], model)
    return out


def _stretches(lattice: Lattice, word: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first node, nodes of its own, begin, end, piece, ends' steps) of each stretch of a marked word: all arcs that begin
    in it, as nodes counted from its first one."""
    text, reach = "▁" + word, int(lattice.lengths.max())
    for at in range(0, len(text), STRETCH):
        own = min(STRETCH, len(text) - at)
        begin, end, piece, _, _ = lattice.arcs([text[at : at + own + reach]], "")
        mine = begin < own
        begin, end, piece = begin[mine], end[mine], piece[mine]
        yield at, own, begin, end, piece, np.concatenate(([0], np.flatnonzero(np.diff(end)) + 1, [len(end)]))


def stretched_logs(lattice: Lattice, word: str, model: np.ndarray, nodes: np.ndarray | None = None) -> np.ndarray:
    """``forward_logs`` at the last node of one word. ``nodes`` (one language): filled with the sums at all nodes."""
    reach = int(lattice.lengths.max())
    carry = np.full((reach + 1, model.shape[1]), -np.inf)
    carry[0] = 0.0
    for at, own, begin, end, piece, steps in _stretches(lattice, word):
        alpha = np.full((own + reach + 1, model.shape[1]), -np.inf)
        alpha[: reach + 1] = carry
        for a, b in zip(steps[:-1], steps[1:]):  # all arcs to one node
            alpha[end[a]] = np.logaddexp(alpha[end[a]], np.logaddexp.reduce(alpha[begin[a:b]] + model[piece[a:b]], axis=0))
        carry = alpha[own:].copy()
        if nodes is not None:
            nodes[at : at + own + 1] = alpha[: own + 1, 0]
    return carry[0]


def stretched_counts(lattice: Lattice, word: str, n: float, model: np.ndarray) -> np.ndarray:
    """Expected piece counts of n occurrences of one word in one language (model: one column)."""
    alpha = np.zeros(len(word) + 2)
    total = stretched_logs(lattice, word, model, alpha)[0]
    reach = int(lattice.lengths.max())
    out, carry = np.zeros(len(model)), np.full(reach + 1, -np.inf)
    carry[0] = 0.0  # beta from the last node on
    starts = range(0, len(word) + 1, STRETCH)
    text = "▁" + word
    for at in reversed(starts):
        own = min(STRETCH, len(text) - at)
        begin, end, piece, _, _ = lattice.arcs([text[at : at + own + reach]], "")
        mine = np.flatnonzero(begin < own)
        mine = mine[np.argsort(-begin[mine], kind="stable")]
        begin, end, w = begin[mine], end[mine], model[piece[mine], 0]
        piece = piece[mine]
        beta = np.full(own + reach + 1, -np.inf)
        beta[own:] = carry
        steps = np.concatenate(([0], np.flatnonzero(np.diff(begin)) + 1, [len(begin)]))
        for a, b in zip(steps[:-1], steps[1:]):
            beta[begin[a]] = np.logaddexp.reduce(beta[end[a:b]] + w[a:b])
        np.add.at(out, piece, np.exp(alpha[at + begin] + w + beta[end] - total) * n)
        carry = beta[: reach + 1].copy()
    return out


def expected_counts(lattice: Lattice, words: list[str], lang: np.ndarray, n: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces x languages) of n occurrences of each word in its language."""
    short, middle, long = _by_size(words)
    if len(short) < len(words):
        out = np.zeros(model.shape)
        for group in [*middle, *([short] if len(short) else [])]:
            out += (expected_counts if group is short else expected_counts_logs)(lattice, [words[i] for i in group], lang[group], n[group], model)
        for i in long:
            out[:, lang[i]] += stretched_counts(lattice, words[i], float(n[i]), model[:, lang[i] : lang[i] + 1])
        return out
    begin, end, piece, first, last = lattice.arcs(words)
    nodes = int(last[-1]) + 1
    word = np.repeat(np.arange(len(words)), last - first + 1)[begin]
    w = lifted(lattice, model)[piece, lang[word]]
    alpha = forward(w[:, None], begin, end, first, nodes, lattice.steps)[:, 0]
    unsafe = _unsafe(alpha[last])
    beta = np.zeros(nodes)
    beta[last] = 1.0
    for k, at in backward_steps(begin, last[word]):
        beta[begin[k][at]] += np.add.reduceat(beta[end[k]] * w[k], at)
    alpha[last[unsafe]] = 1.0
    share = np.where(unsafe[word], 0.0, alpha[begin] * w * beta[end] / alpha[last][word] * n[word])
    out = np.bincount(piece * model.shape[1] + lang[word], share, model.size).reshape(model.shape)
    if unsafe.any():
        again = np.flatnonzero(unsafe)
        out += expected_counts_logs(lattice, [words[i] for i in again], lang[again], n[again], model)
    return out


def backward_steps(begin: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The arcs with places counted from the word's end, and the first arc of each begin among them."""
    back = stop - begin
    by = np.lexsort((begin, back))
    cuts = np.concatenate(([0], np.cumsum(np.bincount(back, minlength=1)[1:])))
    for a, b in zip(cuts[:-1], cuts[1:]):
        k = by[a:b]
        yield k, np.flatnonzero(np.concatenate(([True], begin[k][1:] != begin[k][:-1])))


def expected_counts_logs(lattice: Lattice, words: list[str], lang: np.ndarray, n: np.ndarray, model: np.ndarray) -> np.ndarray:
    """``expected_counts`` with logarithms of all sums, for words whose sums leave ``SAFE``."""
    begin, end, piece, first, last = lattice.arcs(words)
    nodes = int(last[-1]) + 1
    word = np.repeat(np.arange(len(words)), last - first + 1)[begin]
    w = model[piece, lang[word]]
    alpha = forward_logs(w[:, None], begin, end, first, nodes, lattice.steps)[:, 0]
    beta = np.full(nodes, -np.inf)
    beta[last] = 0.0
    for k, at in backward_steps(begin, last[word]):
        beta[begin[k][at]] = np.logaddexp.reduceat(beta[end[k]] + w[k], at)
    share = np.exp(alpha[begin] + w + beta[end] - alpha[last][word]) * n[word]
    return np.bincount(piece * model.shape[1] + lang[word], share, model.size).reshape(model.shape)


def text_words(text: str) -> list[str]:
    """Runs of letters; number signs that ``str.isalpha`` does not take for letters part them."""
    words = _LETTERS.findall(text.lower())
    if not words or "".join(words).isalpha():
        return words
    out = []
    for w in words:
        out += [w] if w.isalpha() else ["".join(g) for letter, g in groupby(w, str.isalpha) if letter]
    return out


def word_counts(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(lang, word, n) over all rows with a language whose fold is not 0."""
    src = docs.where(fold(id_col) != 0).where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    schema = "lang string, word string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, Counter] = {}

        def flush():
            langs = [x for x, c in have.items() for _ in range(len(c))]
            words, counts = [w for c in have.values() for w in c], [n for c in have.values() for n in c.values()]
            have.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text.is_valid:
                    have.setdefault(lang, Counter()).update(text_words(text.as_py()))
                    if sum(map(len, have.values())) > DICTIONARY:
                        yield flush()
        yield flush()

    return src.mapInArrow(run, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, model_file: str, rounds: int = ROUNDS, lang_col: str = "lang") -> tuple[list[str], np.ndarray | None]:
    """Languages in order, and log-probabilities (pieces x languages)."""
    counts = written(word_counts(docs, lang_col), "language-words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: the model of pieces x languages is broadcast")
    if not langs:
        return [], None
    size = Lattice(model_file).size
    model = np.full((size, len(langs)), -np.log(size))
    model[0] = LOG_UNKNOWN
    index = {x: i for i, x in enumerate(langs)}
    for _ in range(rounds):
        current = counts.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages

        def run(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(model_file), np.zeros((size, len(langs)))
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    lang, words, n = (batch.column(k).slice(a, 4096) for k in range(3))
                    total += expected_counts(lattice, words.to_pylist(), np.array([index[x] for x in lang.to_pylist()]), n.to_numpy(), current.value)
            p, g = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(total[p, g])], names=["piece", "lang", "n"])

        got = counts.select("lang", "word", "n").mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros((size, len(langs)))
        total[got["piece"].to_numpy(), got["lang"].to_numpy()] = got["n"].to_numpy()
        total[0] = 0
        model = np.log(total + SMOOTHING) - np.log((total + SMOOTHING).sum(axis=0))
        model[0] = LOG_UNKNOWN
    return langs, model


def predict_language(docs: DataFrame, model_file: str | None = None, rounds: int = ROUNDS, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (posterior of lang_pred)."""
    path = model_file or public_tokenizers.path(MODEL)
    langs, model = train(docs, path, rounds, lang_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out"))
    schema = f"doc_id {id_type(src)}, held_out boolean, lang_pred string, score double"
    if model is None:
        return src.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = src.sparkSession.sparkContext.broadcast(model)

    def make():
        lattice, model = Lattice(path), shared.value
        row: dict[str, int] = {}
        logs = np.zeros((1024, len(langs)))

        def f(rows, data, offs):
            nonlocal logs
            raw, pred, score = data.tobytes(), [], []
            texts = [text_words(raw[a:b].decode()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            new = list({w: None for words in texts for w in words if w not in row and len(w) <= STRETCH})
            if len(row) + len(new) > DICTIONARY:
                row.clear()
                new = list({w: None for words in texts for w in words if len(w) <= STRETCH})
            if new:  # all new words of the slice at once
                got = np.concatenate([word_logs(lattice, new[i : i + 4096], model) for i in range(0, len(new), 4096)])
                need = len(row) + len(new)
                if need > len(logs):
                    logs = np.concatenate((logs, np.zeros((max(need - len(logs), len(logs)), len(langs)))))
                logs[len(row) : need] = got
                row.update(zip(new, range(len(row), need)))
            for words, size in zip(texts, np.diff(offs).tolist()):
                long = [w for w in words if len(w) > STRETCH] if size > STRETCH else []
                if not words:
                    pred.append("und")
                    score.append(0.0)
                    continue
                known = [w for w in words if len(w) <= STRETCH] if long else words
                total = logs[list(map(row.__getitem__, known))].sum(axis=0)
                for w in long:  # not kept
                    total = total + stretched_logs(lattice, w, model)
                best = int(np.argmax(total))
                pred.append(langs[best])
                score.append(float(1 / np.exp(total - total[best]).sum()))
            return [rows.column(0), rows.column(2), pred, score]

        return f

    return map_texts(src, schema, make)
