"""BPE encoding and decoding (4): long texts are cut into pieces that are encoded in parallel and
concatenated as a tree; around each join a growing window is encoded anew until it agrees with the
tokens of both sides, identical in id, place and pre-token start.

A token sequence is the encoding of a pre-token exactly if every adjacent pair of its tokens is,
so one agreeing token on each side of the window proves the joined sequence. Texts of one piece
(most) go through a bounded dictionary of chunks between spaces and line ends, and of their words, to (ids, decoded
text); a chunk not yet in it is made of its words. Chunks and words are cut only where the
tokenizer's own pre-tokenizer must cut and no special token can lie: at spaces and line ends,
between Latin letters, ASCII digits and ASCII signs other than ``'<>|``. Texts within Latin-1
without ``<|`` are lower-cased first, which the tokenizer's normaliser would do with equal result.

A window begins and ends where the tokenizer's normaliser cannot look across: before a character that
starts anew (no mark, no later part of a syllable), so marks are never put in order without those they belong to.

Defined results: null text counts as empty; an empty text has no ids and decodes to ''; repeated
rows give repeated results (equal rows with a long text are counted where they are read and encoded once); a
null id is kept; texts of any length are encoded whole; extra columns are ignored; no rows, no result rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.llm.common import id_type, ids_and_texts, map_texts, memory_returned

MODEL = "word_bpe_49k.json"
PIECE_CHARS = 16_384
ROWS = 64  # pieces that a task holds at once beside the batch it reads them from
DICTIONARY = 400_000
MARGIN = 16
_SIGNS = r"!-&(-;=?@\[-`{}~"  # ASCII signs and digits without ' < > |
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORDS = re.compile(rf"[{_LETTERS}]+(?=[ \n'<{_SIGNS}]|\Z)|[0-9](?=[ \n'<{_SIGNS}A-Za-z]|\Z)|(?:(?![0-9])[{_SIGNS}])+(?=[ \n0-9A-Za-z]|\Z)|[^ \n]+")
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_FIRST = 1 << 31  # beside the id of a token that begins a pre-token


def load(model_file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(model_file)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _within_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pre_token_starts(e) -> np.ndarray:
    """Flags of the tokens that begin a pre-token; one outside any is its own."""
    word = np.array([-1 - i if w is None else w for i, w in enumerate(e.word_ids)], dtype=np.int64)
    return np.concatenate((np.ones(min(len(word), 1), bool), word[1:] != word[:-1]))


def plain_letters(tok) -> dict | None:
    """How the pre-tokenizer writes the small Latin letters beyond a-z, if the tokenizer takes every run of small letters
    as one pre-token, letter by letter: such words go to its model as they are. None if it does not."""
    letters = "".join(c for c in map(chr, range(256)) if _PLAIN.fullmatch(c))
    ready = lambda text: [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(text)]
    if tok.pre_tokenizer is None or tok.decoder is not None or getattr(tok.model, "dropout", None):
        return None
    if tok.normalizer is not None and tok.normalizer.normalize_str(letters) != letters:
        return None
    if any(_PLAIN.fullmatch(t.content.lower()) for t in tok.get_added_tokens_decoder().values()):
        return None
    written = {ord(c): "".join(ready(c)) for c in letters}
    if ready(letters) != [letters.translate(written)] or any(written[ord(c)] != c for c in letters if c.isascii()):
        return None
    return written


class WordCodec:
    """Encodes and decodes whole texts through a bounded dictionary of what stands between spaces and line ends, and
    of the words in it; words of small letters only go to the tokenizer's model directly."""

    def __init__(self, model_file: str, dictionary: int = DICTIONARY):
        self.tok = load(model_file)
        self.model = self.tok.model
        self.letters = plain_letters(self.tok)
        self.known: dict[str, tuple[bytes, str]] = {}
        self.placed: dict[str, bytes] = {}  # of each token: id and flag of a pre-token start, begin, end
        self.limit = dictionary

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text)."""
        if "<|" not in text and _within_latin1(text):
            text = text.lower()
        chunks = text.replace("\n", " ").split(" ")
        got = list(map(self.known.get, chunks))
        if None in got:
            self._learn(list(dict.fromkeys(c for c, g in zip(chunks, got) if g is None)), chunks)
            got = list(map(self.known.__getitem__, chunks))
        return b"".join([g[0] for g in got]), "".join([g[1] for g in got])[:-1]

    def _words(self, new: list[str], chunks: list[str], have: dict) -> tuple[dict[str, list[str]], list[str], list[str]]:
        """The words of each new chunk, and those not in the dictionary: of small letters (and such that the model
        takes them), and others. A dictionary that would grow too large begins anew with what ``chunks`` need."""
        parts = {c: _WORDS.findall(c) for c in new}
        words = dict.fromkeys(w for ws in parts.values() for w in ws if w not in have)
        if len(have) + len(words) + len(new) > self.limit:
            kept = {c: g for ws in (chunks, *parts.values()) for c in ws if (g := have.get(c)) is not None}
            have.clear()
            have.update(kept)
        plain = [] if self.letters is None else [w for w in words if _PLAIN.fullmatch(w)]
        return parts, plain, list(words.keys() - set(plain)) if len(plain) < len(words) else []

    def _learn(self, new: list[str], chunks: list[str]) -> None:
        """Decoded texts are held with a space after each token."""
        known = self.known
        parts, plain, others = self._words(new, chunks, known)
        for w in plain:
            got = self.model.tokenize(w if w.isascii() else w.translate(self.letters))
            known[w] = pack(f"<{len(got)}I", *[t.id for t in got]), "".join([t.value + " " for t in got])
        if others:
            lists = [e.ids for e in self.tok.encode_batch_fast(others, add_special_tokens=False)]
            for w, ids, text in zip(others, lists, self.tok.decode_batch(lists, skip_special_tokens=False)):
                known[w] = pack(f"<{len(ids)}I", *ids), text + " " if ids else ""
        for c, ws in parts.items():
            if len(ws) != 1:
                known[c] = b"".join([known[w][0] for w in ws]), "".join([known[w][1] for w in ws])

    def _place(self, new: list[str], chunks: list[str]) -> None:
        placed = self.placed
        parts, plain, others = self._words(new, chunks, placed)
        for w in plain:
            if not w.isascii():  # the model counts bytes
                others.append(w)
                continue
            got = [x for t in self.model.tokenize(w) for x in (t.id, *t.offsets)]
            got[0] |= _FIRST
            placed[w] = pack(f"<{len(got)}I", *got)
        if others:
            self._place_words(others)
        for c, ws in parts.items():
            if len(ws) != 1:
                at = accumulate(map(len, ws), initial=0)
                placed[c] = b"".join([(np.frombuffer(placed[w], "<u4").reshape(-1, 3) + np.array([0, a, a], "<u4")).tobytes() if a else placed[w] for w, a in zip(ws, at)])

    def _place_words(self, new: list[str]) -> None:
        got = self.tok.encode_batch(new, add_special_tokens=False)
        size = [len(e.ids) for e in got]
        cuts = list(accumulate(size, initial=0))
        word = np.array([-1 if x is None else x for e in got for x in e.word_ids], dtype=np.int64)
        first = word < 0  # outside any pre-token: its own
        first[1:] |= word[1:] != word[:-1]
        first[[a for a, n in zip(cuts, size) if n]] = True
        rows = np.empty((len(word), 3), "<u4")
        rows[:, 0] = [x for e in got for x in e.ids]
        rows[:, 0] |= first * np.uint32(_FIRST)
        rows[:, 1:] = np.array([x for e in got for x in e.offsets], dtype="<u4").reshape(-1, 2)
        for w, a, b in zip(new, cuts, cuts[1:]):
            self.placed[w] = rows[a:b].tobytes()

    def tokens(self, text: str) -> Tokens:
        """Tokens of a piece with their places: ``Tokens.of`` through a bounded dictionary."""
        if "<|" not in text and _within_latin1(text):
            text = text.lower()  # of equal length within Latin-1
        chunks = text.replace("\n", " ").split(" ")
        new = list(dict.fromkeys(c for c in chunks if c not in self.placed))
        if new:
            self._place(new, chunks)
        got = list(map(self.placed.__getitem__, chunks))
        rows = np.frombuffer(b"".join(got), "<u4").reshape(-1, 3)
        ends = np.cumsum(np.array(list(map(len, chunks)), dtype=np.int64) + 1)
        at = np.repeat(np.concatenate(([0], ends[:-1])), np.array(list(map(len, got)), dtype=np.int64) // 12)
        return Tokens(rows[:, 0] & np.uint32(_FIRST - 1), rows[:, 1] + at, rows[:, 2] + at, rows[:, 0] >= _FIRST)


def decoder_of(tok):
    """ids -> the library's decoded text: without a decoder of its own a tokenizer joins its tokens by spaces."""
    if tok.decoder is not None:
        return lambda ids: tok.decode(ids, skip_special_tokens=False)
    names = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]
    return lambda ids: " ".join(map(names.__getitem__, ids))


class Tokens:
    """Tokens of one stretch of a text: ids, character spans in the text, pre-token starts."""

    __slots__ = ("ids", "start", "end", "first")

    def __init__(self, ids, start, end, first):
        self.ids, self.start, self.end, self.first = ids, start, end, first

    @staticmethod
    def of(tok, text: str, at: int) -> Tokens:
        return Tokens.made(tok.encode(text, add_special_tokens=False), at)

    @staticmethod
    def made(e, at: int) -> Tokens:
        """From the library's encoding of a text that begins at ``at``."""
        spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at
        return Tokens(np.array(e.ids, dtype="<u4"), spans[:, 0], spans[:, 1], pre_token_starts(e))

    def packed(self) -> list[bytes]:
        """Ids, gaps before and lengths of tokens as byte planes, without high ones that only repeat the sign
        (one byte before them says how many are left), and the starts of pre-tokens as bits."""
        gap = self.start - np.concatenate((np.zeros(min(len(self), 1), np.int64), self.end[:-1]))
        out = []
        for x in (self.ids.astype(np.int64), gap, self.end - self.start):
            width = next(k for k in (1, 2, 4) if not len(x) or -(1 << 8 * k - 1) <= x.min() and x.max() < 1 << 8 * k - 1)
            out.append(bytes([width]) + x.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes())
        return [*out, np.packbits(self.first).tobytes()]

    @staticmethod
    def unpacked(ids: bytes, gap: bytes, length: bytes, first: bytes, at: int) -> Tokens:
        """The tokens of a piece that begins at ``at``."""
        number, gap, length = (np.ascontiguousarray(np.frombuffer(x, np.uint8, offset=1).reshape(x[0], -1).T).view(f"<i{x[0]}").ravel() for x in (ids, gap, length))
        end = at + np.cumsum(gap.astype(np.int64) + length)
        return Tokens(number.astype("<u4"), end - length, end, np.unpackbits(np.frombuffer(first, np.uint8), count=len(number)).astype(bool))

    def part(self, a: int | None, b: int | None) -> Tokens:
        return Tokens(self.ids[a:b], self.start[a:b], self.end[a:b], self.first[a:b])

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate((getattr(self, c), getattr(other, c))) for c in Tokens.__slots__))

    def __len__(self) -> int:
        return len(self.ids)

    def key(self, i: int) -> tuple:
        return int(self.ids[i]), int(self.start[i]), int(self.end[i]), bool(self.first[i])


def starts_anew(c: str) -> bool:
    """True if canonical composition and ordering never reach from this character to those before it: not a
    mark, nor a later letter of a syllable that composes (Hangul vowels and finals, Kirat Rai vowel signs)."""
    if c < "\u0300":
        return True
    return not (unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or "\ud7b0" <= c <= "\ud7ff" or "\U00016d63" <= c <= "\U00016d6a")


def join(tok, text: str, left: Tokens, right: Tokens, begin: int, cut: int, end: int) -> Tokens:
    """Tokens of text[begin:end] from those of text[begin:cut] and text[cut:end]."""
    anew = cut  # from here on the right side is normalised as in the whole text
    while anew < end and not starts_anew(text[anew - begin]):
        anew += 1
    reach = 64
    while True:
        # left edge: a token start at least ``reach`` before the cut where the text starts anew, at a pre-token
        # start if one is near; the tokens before it end there
        i = int(np.searchsorted(left.start, cut - reach, side="right")) - 1 if len(left) else 0
        near = np.flatnonzero(left.first[max(i - 32, 0) : i + 1]) if i > 0 else np.zeros(0, int)
        i = max(i - 32, 0) + int(near[-1]) if len(near) else max(i, 0)
        while i > 0 and not (starts_anew(text[int(left.start[i]) - begin]) and left.end[i - 1] <= left.start[i] < cut):
            i -= 1
        from_start = i == 0 or cut - reach <= begin
        i = 0 if from_start else i
        lo = begin if from_start else int(left.start[i])
        hi = max(cut + 2 * reach, anew)
        while hi < end and not starts_anew(text[hi - begin]):
            hi += 1
        to_end = hi >= end
        hi = min(hi, end)
        window = Tokens.of(tok, text[lo - begin : hi - begin], lo)
        agree_left = from_start or (len(window) > 0 and window.key(0)[:3] == left.key(i)[:3])
        if agree_left and to_end:
            return left.part(0, i) + window
        if agree_left:
            there = {right.key(m): m for m in range(int(np.searchsorted(right.start, hi - MARGIN)))}
            for b in range(len(window) - 1, -1, -1):
                if window.end[b] <= hi - MARGIN and window.start[b] >= max(cut + MARGIN, anew) and (m := there.get(window.key(b))) is not None:
                    return left.part(0, i) + window.part(0, b + 1) + right.part(m + 1, None)
        reach *= 2


def encode_tree(tok, pieces: list[str], tokens: list[Tokens]) -> Tokens:
    """Concatenate the tokens of adjacent pieces pairwise, level by level."""
    nodes, at = [], 0
    for text, t in zip(pieces, tokens, strict=True):
        nodes.append((at, at + len(text), text, t))
        at += len(text)
    while len(nodes) > 1:
        up = []
        for a, b in zip(nodes[::2], nodes[1::2]):
            text = a[2] + b[2]
            up.append((a[0], b[1], text, join(tok, text, a[3], b[3], a[0], a[1], b[1])))
        nodes = up + ([nodes[-1]] if len(nodes) % 2 else [])
    return nodes[0][3]


def _row(ids: bytes, decoded: str, full: bool) -> list:
    out = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
    return out + ([ids, decoded] if full else [])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[dict[int, dict], int]]:
    """Pieces by number, and how many rows have them, of each run of equal keys in sorted batches. Pieces of
    equal rows are held once."""
    now, have, copies = None, {}, 0
    for batch in batches:
        for row in (r for a in range(0, batch.num_rows, ROWS) for r in batch.slice(a, ROWS).to_pylist()):
            if row[key] != now:
                if have:
                    yield have, copies
                now, have, copies = row[key], {}, 0
            have.setdefault(row["n"], row)
            copies += row["copies"] if row["n"] == 0 else 0
    if have:
        yield have, copies


def bpe_round_trip(docs: DataFrame, model_file: str | None = None, piece_chars: int = PIECE_CHARS, full: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``full`` also the
    ids (binary, little-endian 32-bit) and the decoded text."""
    path = model_file or public_tokenizers.path(MODEL)
    src = ids_and_texts(docs, id_col, text_col)
    kind = id_type(src)
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * full

    def one_piece():
        codec = WordCodec(path)

        def f(rows, data, offs):
            raw = data.tobytes()
            got = [_row(*codec.encode(raw[a:b].decode()), full) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            return [rows.column(0), *zip(*got)] if got else [rows.column(0)] + [[]] * (3 + 2 * full)

        return f

    def cut():
        def f(rows, data, offs):
            raw, first, copies = data.tobytes(), {}, {}
            for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                key = f"{rows.column(0)[k].as_py()!r}:{hashlib.sha256(raw[a:b]).hexdigest()}"
                first.setdefault(key, (k, a, b))
                copies[key] = copies.get(key, 0) + 1
            out, take = [], []
            for key, (k, a, b) in first.items():
                text = raw[a:b].decode()
                for n, at in enumerate(range(0, len(text), piece_chars)):
                    out.append((key, n, text[at : at + piece_chars], copies[key]))
                    take.append(k)
            return [rows.column(0).take(pa.array(take, pa.int64())), *(zip(*out) if out else [[], [], [], []])]

        return f

    def encode_pieces(batches):
        codec = WordCodec(path)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                cols = zip(*(codec.tokens(x).packed() for x in part.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, pa.binary()) for c in cols)], names=[*part.schema.names, "ids", "gap", "length", "first"])

    def join_pieces(batches):
        tok = load(path)
        decode = decoder_of(tok)
        types = [doc_type, pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 4 + 2 * full]
        for by_number, copies in _groups(batches, "key"):
            pieces, tokens, at = [], [], 0
            for n in sorted(by_number):
                r = by_number[n]
                pieces.append(r["text"])
                tokens.append(Tokens.unpacked(r["ids"], r["gap"], r["length"], r["first"], at))
                at += len(r["text"])
            ids = encode_tree(tok, pieces, tokens).ids
            row = [by_number[0]["doc_id"], *_row(ids.tobytes(), decode(ids.tolist()), full)]
            for a in range(0, copies, 10_000 if not full else 1):
                k = min(copies - a, 10_000 if not full else 1)
                yield pa.RecordBatch.from_arrays([pa.array([x] * k, t) for x, t in zip(row, types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    doc_type = to_arrow_type(src.schema["doc_id"].dataType)
    is_long = F.coalesce(F.char_length("text") > piece_chars, F.lit(False))
    short = map_texts(src.where(~is_long), schema, one_piece)
    pieces = map_texts(src.where(is_long), f"doc_id {kind}, key string, n int, text string, copies long", cut).repartition("key", "n")
    encoded = pieces.mapInArrow(lambda batches: memory_returned(encode_pieces(batches)), f"doc_id {kind}, key string, n int, text string, copies long, ids binary, gap binary, length binary, first binary")
    long = encoded.repartition("key").sortWithinPartitions("key", "n").mapInArrow(lambda batches: memory_returned(join_pieces(batches)), schema)
    return short.unionByName(long)
