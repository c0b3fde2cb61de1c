"""Token counts (1): pieces are counted once per distinct pre-token and joined to each document's
pre-token frequencies; no document's ids are ever built.

A pre-token is cut wherever the vocabulary has no piece that spans the cut, so the pieces of a
text are exactly the pieces of its pre-tokens. Each task keeps a dictionary pre-token -> count
(bounded by ``DICTIONARY`` entries; when full it is emptied and refilled, results do not change)
and joins the documents' frequency tables with it. Joining through a shuffle instead would move
one row per document and rare word, more than the text itself.

Defined results: null text counts as empty; an empty text has 0 bytes and 0 tokens; repeated
rows give repeated results; a null id is kept; extra columns are ignored; no rows, no result rows.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import mul

import public_tokenizers
from pyspark.sql import DataFrame

from txgraph.llm.common import id_type, ids_and_texts, map_texts

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
DICTIONARY = 400_000
_SPACES_APART = r"[ ▁]*[^ ▁]+|[ ▁]+"


def pre_token_pattern(pieces: list[str]) -> re.Pattern:
    """Pattern of pre-tokens no piece of the vocabulary crosses: spaces always start one; letters
    are parted from all other characters unless a piece joins the two (letters that some piece
    joins to a non-letter count as non-letters)."""
    if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
        raise ValueError("the vocabulary joins pieces across spaces or line ends")
    pairs = {pair for p in pieces for pair in zip(p.lstrip("▁"), p.lstrip("▁")[1:])}
    others: set[str] = set()
    while len(others) <= 64:
        letter = rf"[^\W\d_{re.escape(''.join(sorted(others)))}]"
        match = re.compile(letter).match
        mixed = {a if match(a) else b for a, b in pairs if bool(match(a)) != bool(match(b))}
        if not mixed:
            inner = "".join(map(re.escape, sorted(others)))
            return re.compile(rf"[ ▁]*(?:{letter}+|(?:[^\w ▁]|[\d_{inner}])+)|[ ▁]+")
        others |= mixed
    return re.compile(_SPACES_APART)


class PieceCounter:
    """Piece counts of whole texts through a bounded dictionary of pre-tokens."""

    def __init__(self, model_file: str, dictionary: int = DICTIONARY):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.model.get_piece_size()
        plain = [i for i in range(size) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.findall = pre_token_pattern([self.model.id_to_piece(i) for i in plain]).findall
        self.lead = len(self.model.encode("\n"))
        self.counts: dict[str, int] = {}
        self.limit = dictionary

    def frequencies(self, text: str) -> Counter:
        """Pre-token frequencies, with the model's leading space."""
        return Counter(self.findall(" " + text)) if text else Counter()

    def count(self, text: str) -> int:
        freq = self.frequencies(text)
        known = self.counts.get
        counts = list(map(known, freq))
        if None in counts:
            self._learn([t for t, c in zip(freq, counts) if c is None])
            counts = [c if (c := known(t)) is not None else self._count_one(t) for t in freq]
        return sum(map(mul, counts, freq.values()))

    def _learn(self, new: list[str]) -> None:
        if len(self.counts) + len(new) > self.limit:
            self.counts.clear()
        # a line end before the pre-token keeps the model's leading space away from it
        for t, ids in zip(new, self.model.encode(["\n" + t for t in new], num_threads=1)):
            self.counts[t] = len(ids) - self.lead

    def _count_one(self, t: str) -> int:
        """A pre-token that left the dictionary while this text was counted."""
        return len(self.model.encode("\n" + t)) - self.lead


def token_counts(docs: DataFrame, model_file: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    path = model_file or public_tokenizers.path(MODEL)
    src = ids_and_texts(docs, id_col, text_col)

    def make():
        counter = PieceCounter(path)

        def f(rows, data, offs):
            n_bytes = offs[1:] - offs[:-1]
            raw = data.tobytes()
            n = [counter.count(raw[a:b].decode()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            return rows.column(0), n_bytes, n, [x > limit for x in n]

        return f

    return map_texts(src, f"doc_id {id_type(src)}, n_bytes long, n_tokens long, over_limit boolean", make)
