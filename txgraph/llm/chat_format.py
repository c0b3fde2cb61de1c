"""Chat formatting (11): conversations as one text, its token ids and an offset-aligned loss mask.

Rows are sorted by conversation; a task renders each conversation as a whole, with the place of every
turn's text, encodes it once with offsets, and finds the tokens of the trained turns by binary search
of the sorted turn spans among the sorted token spans.

Template: system ``<<SYS>>text<</SYS>>``, user ``[INST]text[/INST]``, assistant ``<s>text</s>``, any other role
``<|role|>role<|text|>text<|end|>``. Control strings are tokens of their own (added behind the vocabulary), so
no token crosses the border of a turn. Inside roles and texts a backslash is doubled and every control
string gets a backslash behind its first character; ``unescape`` undoes both.

Long conversations: parts of whole turns, a new one after ``PART_CHARS`` characters, so a row's size is
bounded by that and one turn; as control strings split the encoding, the parts' ids are those of the whole.

Defined results: null roles and texts count as empty, null turns come first, equal turns in the order of
role and text; repeated rows are turns of their own; rows with a null conv_id are one conversation with
that id; texts of any length are formatted whole; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
TRAINED = ("assistant",)
PART_CHARS = 4_000_000
_BATCH_CHARS = 1_000_000
# fixed control strings of the template
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<|role|>", "<|text|>", "<|end|>")
END_OF_TEXT = "<|endoftext|>"
CONTROLS = [*(m for pair in MARKS.values() for m in pair), *OTHER]
_TO_ESCAPE = re.compile(r"(?=\\|" + "|".join(map(re.escape, [*CONTROLS, END_OF_TEXT])) + r")(.)", re.DOTALL)
_ESCAPED = re.compile(r"\\(\\?)")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    """Text in which no control string is left."""
    return _TO_ESCAPE.sub(lambda m: m[1] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = TRAINED) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns, and the place of each trained text in them, ascending."""
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        begin, close = MARKS.get(role) or (f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2])
        body = escape(text)
        if role in trained:
            spans.append((at + len(begin), at + len(begin) + len(body)))
        out += (begin, body, close)
        at += len(begin) + len(body) + len(close)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; ValueError if it is not one."""
    opened = {begin: (role, close) for role, (begin, close) in MARKS.items()}
    turns, at = [], 0
    marks = _CONTROL.finditer(formatted)
    for m in marks:
        if m.start() != at:
            raise ValueError("text outside the turns")
        if m[0] == OTHER[0]:
            mid = next(marks, None)
            if mid is None or mid[0] != OTHER[1]:
                raise ValueError("role without its mark")
            role, close, start = unescape(formatted[m.end() : mid.start()]), OTHER[2], mid.end()
        elif m[0] in opened:
            (role, close), start = opened[m[0]], m.end()
        else:
            raise ValueError("turn without its mark")
        end = next(marks, None)
        if end is None or end[0] != close:
            raise ValueError("turn without its end")
        turns.append((role, unescape(formatted[start : end.start()])))
        at = end.end()
    if at != len(formatted):
        raise ValueError("text outside the turns")
    return turns


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for the tokens that share a character with a span; token spans and spans ascend."""
    lo, hi = np.array(spans, np.int64).reshape(-1, 2).T
    hi_, lo_ = hi[hi > lo], lo[hi > lo]
    first, last = np.searchsorted(ends, lo_, "right"), np.searchsorted(starts, hi_, "left")
    delta = np.bincount(first, minlength=len(starts) + 1) - np.bincount(last, minlength=len(starts) + 1)
    return (np.cumsum(delta)[: len(starts)] > 0).astype(np.int8)


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> Iterator[str]:
    """Text under each run of masked tokens; tokens that hold parts of one character count it once."""
    on = np.flatnonzero(mask)
    if not len(on):
        return
    s, e = starts[on], np.maximum.accumulate(ends[on])
    cut = np.flatnonzero(s[1:] > e[:-1]) + 1
    for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(on)]))):
        yield formatted[s[a] : e[b - 1]]


def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    t.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
    return t


def _ordered(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select("conv_id", "turn", text("role"), text("text"))
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text")


def format_conversations(conversations: DataFrame, path: str | None = None, trained: tuple[str, ...] = TRAINED, part_chars: int = PART_CHARS) -> DataFrame:
    """A row per conversation (or part of a long one): conv_id, part (from 0), n_turns, text, input_ids,
    token_starts and token_ends (code points of text, end exclusive), loss_mask."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        done: list[tuple] = []  # (id, part, turns) that wait to be encoded together
        waiting = 0

        def encoded() -> pa.RecordBatch:
            texts, spans = zip(*(render(turns, trained) for _, _, turns in done))
            cols: list[list] = [[], [], [], []]
            for e, of in zip(encoder.encode_batch(list(texts), add_special_tokens=False), spans):
                at = np.array(e.offsets, np.int64).reshape(-1, 2)
                starts, ends = at[:, 0], at[:, 1]
                for col, x in zip(cols, (np.array(e.ids, np.int32), starts.astype(np.int32), ends.astype(np.int32), loss_mask(starts, ends, of))):
                    col.append(x)
            got = pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in done], id_kind), pa.array([x[1] for x in done], pa.int32()), pa.array([len(x[2]) for x in done], pa.int64()), pa.array(texts, pa.string()),
                 *(pa.array(c, ints) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int8()))],
                names=["conv_id", "part", "n_turns", "text", "input_ids", "token_starts", "token_ends", "loss_mask"])
            done.clear()
            return got

        conv: object = run  # no id yet
        part = size = 0
        turns: list[tuple[str, str]] = []
        id_kind = None
        for batch in batches:
            id_kind = batch.schema.field("conv_id").type
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if c != conv or size >= part_chars:
                    if turns:
                        done.append((conv, part, turns))
                        waiting += size
                    part, conv, turns, size = (part + 1 if c == conv else 0), c, [], 0
                    if waiting >= _BATCH_CHARS:
                        yield encoded()
                        waiting = 0
                turns.append((role, text))
                size += len(role) + len(text) + 16
        if turns:
            done.append((conv, part, turns))
        if done:
            yield encoded()

    schema = f"conv_id {kind}, part int, n_turns long, text string, input_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<tinyint>"
    return _ordered(conversations).mapInArrow(run, schema)


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """What formatted rows say, from their text, offsets and mask alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. ``in_order``: rows of a conversation stand together in the
    order of their parts, as ``format_conversations`` gives them; otherwise they are sorted first."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    cols = ["conv_id", "text", "token_starts", "token_ends", "loss_mask"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    rows = formatted if in_order else formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = run
        n = chars = loss = 0
        turns_sha = loss_sha = hashlib.sha256()
        out: list[tuple] = []
        for batch in batches:
            id_kind = batch.schema.field("conv_id").type
            ids, texts = batch.column("conv_id").to_pylist(), batch.column("text")
            for i, c in enumerate(ids):
                if c != conv:
                    if conv is not run:
                        out.append((conv, n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars))
                    conv, n, chars, loss, turns_sha, loss_sha = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                text = texts[i].as_py()
                starts, ends, mask = (batch.column(x)[i].values.to_numpy() for x in cols[2:])
                for role, said in parse(text):
                    turns_sha.update(f"{role}\n{said}\n".encode())
                    n += 1
                for piece in masked_texts(text, starts, ends, mask):
                    piece = unescape(piece)
                    loss_sha.update(piece.encode())
                    loss += len(piece)
                chars += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], id_kind if not k else pa.string() if names[k].endswith("sha256") else pa.int64()) for k in range(6)], names=names)
            out.clear()
        if conv is not run:
            out.append((conv, n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], id_kind if not k else pa.string() if names[k].endswith("sha256") else pa.int64()) for k in range(6)], names=names)

    return rows.select(*cols).mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose two texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
