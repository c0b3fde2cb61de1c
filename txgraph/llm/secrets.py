r"""Secret scans (6): pattern candidates, then structural confirmation of encoded candidates.

Base patterns report assignments, access key ids and long hex runs. The method adds spans only
after decoding: base64 and hex runs (also the bodies of armoured blocks) must parse as a nested
length-prefixed structure to the last byte (``der`` private key encodings, ``ssh`` private keys, ``pgp``
secret key packets in an armour), and three dotted base64url parts must begin with a JSON header naming an algorithm (``jwt``).
Public keys are no secrets.
Candidates are normalised first: escaped line ends (``\n``, ``\r``), quotes, string joins and comment
marks between base64 lines go, header lines of an armour are read apart, and wrapped lines of 16 or
more characters are joined without an armour too. An armoured key that its header lines call
encrypted counts as ``der`` if it is whole cipher blocks under a named cipher and a hex vector.

Defined results: null text counts as empty and has no spans; repeated rows give repeated results;
a null id is kept; extra columns are ignored; no rows, no result rows. Very long texts are scanned
whole in time that grows with their length; documents without any byte run a pattern needs are passed over by
exact byte tests.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.llm import textkernel as K
from txgraph.llm.common import id_type, ids_and_texts, map_texts, memory_returned

KINDS = ("assign", "access", "hex", "der", "ssh", "jwt", "pgp")
BASE = 3
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{32,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{32,}={0,2}")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----")
_END = re.compile(r"-----END ([A-Z0-9 ]{1,40})-----")
_ESCAPED = re.compile(r"(?<!\\)\\+([nrt/]|u00[0-9A-Fa-f]{2})")
_FIELD = re.compile(r"([A-Za-z][A-Za-z0-9-]*):")
_BARE = re.compile(r"[A-Za-z0-9+/=\s]*")
_AROUND = " \t\"'`>#*|;,.&()\\"
_CIPHER = re.compile(r"([A-Z0-9-]+),([0-9A-Fa-f]{16,32})")
# between two lines of one candidate: line ends, plain or escaped, string quotes and joins, comment marks
_GAP = re.compile(r"""(?:\\+[nrt/]|[\s"'`]|\\(?=\s)|(?<=["'`\s])[+,.&#*>|](?=[\s"'`]))+""")
_PIECE = re.compile(r"[A-Za-z0-9+/]+={0,2}")
_START = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[nrt]))(?:M[A-P][A-Za-z0-9+/]{14}|b3BlbnNzaC1rZXkt)")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+")  # a match begins where its run does
_RUN = K.byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2F, 0x2F)])
_SIGNED_RUN = K.byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2D, 0x2E), (0x5F, 0x5F)])
_HEX_RUN = K.byte_class([(0x30, 0x39), (0x61, 0x66)])
_HEAD = b"-----BEGIN "
_SSH_MAGIC = b"openssh-key-v1\x00"


def _elements(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the elements that fill b[at:end] exactly, else None."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = b[at], b[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def is_der_key(b: bytes) -> bool:
    """One SEQUENCE to the last byte whose nested lengths all fit and whose members are those of a
    private key: version and integers, version and algorithm and octets, or algorithm and octets."""
    top = _elements(b, 0, len(b)) if len(b) >= 16 and b[0] == 0x30 else None
    if not top or len(top) != 1:
        return False
    members = _elements(b, top[0][1], top[0][2])
    if not members:
        return False
    open_, tags = [m for m in members if m[0] in (0x30, 0x31, 0xA0, 0xA1)], [m[0] for m in members]
    while open_:
        tag, at, end = open_.pop()
        inner = _elements(b, at, end)
        if inner is None:
            return False
        open_ += [m for m in inner if m[0] in (0x30, 0x31, 0xA0, 0xA1)]
    integers = len(tags) >= 6 and all(t == 0x02 for t in tags)
    return integers or tags[:3] in ([0x02, 0x30, 0x04], [0x02, 0x30, 0x30]) or tags[:2] in ([0x02, 0x04], [0x30, 0x04])


def _ssh_fields(read, size: int) -> bool:
    """The container of a private key: magic, three length-prefixed strings, key count, keys. ``read(at, n)``
    gives n of its ``size`` bytes."""
    if size < len(_SSH_MAGIC) or read(0, len(_SSH_MAGIC)) != _SSH_MAGIC:
        return False
    at = len(_SSH_MAGIC)
    for _ in range(3):
        if at + 4 > size or (at := at + 4 + int.from_bytes(read(at, 4), "big")) > size:
            return False
    return at + 4 <= size and 1 <= int.from_bytes(read(at, 4), "big") <= 64


def is_ssh_key(b: bytes) -> bool:
    return _ssh_fields(lambda at, n: b[at : at + n], len(b))


def is_pgp_key(b: bytes) -> bool:
    """OpenPGP packets to the last byte, the first one a secret key."""
    at, first = 0, True
    while at < len(b):
        head, at = b[at], at + 1
        if not head & 0x80 or at >= len(b):
            return False
        if head & 0x40:
            tag, n, at = head & 0x3F, b[at], at + 1
            if 192 <= n < 224 and at < len(b):
                n, at = ((n - 192) << 8) + b[at] + 192, at + 1
            elif n == 255 and at + 4 <= len(b):
                n, at = int.from_bytes(b[at : at + 4], "big"), at + 4
            elif n >= 192:
                return False
        else:
            tag, k = head >> 2 & 0xF, 1 << (head & 3)
            if k == 8 or at + k > len(b):
                return False
            n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if at + n > len(b) or first and (tag != 5 or n < 6 or not 3 <= b[at] <= 6):
            return False
        at, first = at + n, False
    return not first


def _decoded(text: str, url: bool = False) -> bytes | None:
    body = "".join(text.split()).rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """header.payload.signature with JSON objects in the first two, the header naming ``alg``."""
    head, body, _ = text.split(".", 2)
    try:
        header, claims = (json.loads(x) if (x := _decoded(p, url=True)) else None for p in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def _structure(b: bytes | None) -> str | None:
    if not b:
        return None
    return "der" if is_der_key(b) else "ssh" if is_ssh_key(b) else None


def _armoured(body: str, name: str = "") -> str | None:
    """Kind of the key in an armour's body: base64 lines after normalisation, header lines apart. A line that
    begins with ``=`` in a PGP armour is its checksum."""
    plain = _ESCAPED.sub(lambda m: {"n": "\n", "r": "\n", "t": " ", "/": "/"}.get(m[1]) or chr(int(m[1][3:], 16)), body)
    lines, fields, more = [], {}, False
    for line in plain.splitlines():
        bare = line.strip(_AROUND)
        if bare[-2:-1] and bare[-1] == "+" and bare[-2] in _AROUND:  # a string join, not base64
            bare = bare[:-1].rstrip(_AROUND)
        if bare[1:2] and bare[0] == "+" and bare[1] in _AROUND:
            bare = bare[1:].lstrip(_AROUND)
        if m := _FIELD.match(bare):
            fields[m[1].lower()] = bare[m.end() :].strip()
        elif not more:
            if bare != "+" and not _BARE.fullmatch(bare):
                return None
            lines.append("" if bare == "+" and len(line) > 1 else bare)
        more = line.rstrip().endswith("\\") and bool(m or more)
    if name.startswith("PGP "):
        got = _decoded("".join(x for x in lines if not x.startswith("=")))
        return "pgp" if got and "PRIVATE" in name and is_pgp_key(got) else None
    got = _decoded("".join(lines))
    if got and "ENCRYPTED" in fields.get("proc-type", "") and (m := _CIPHER.fullmatch(fields.get("dek-info", ""))):
        return "der" if len(m[2]) in (16, 32) and len(got) % (len(m[2]) // 2) == 0 else None
    return _structure(got)


def _armours(text: str) -> list[tuple[int, str | None, int]]:
    """(start, kind, end) of every armour: a head and the next end of the same name before another head."""
    heads = list(_BEGIN.finditer(text))
    out, ends = [], list(_END.finditer(text)) if heads else []
    at = [e.start() for e in ends]
    for m, after in zip(heads, [*(h.start() for h in heads[1:]), len(text)]):
        for e in ends[bisect_left(at, m.end()) : bisect_left(at, after)]:
            if e[1] == m[1]:
                out.append((m.start(), _armoured(text[m.end() : e.start()], m[1]), e.end()))
                break
    return out


def _der_size(head: str) -> int:
    """Bytes of the SEQUENCE that begins with these base64 characters, 0 if it has no fitting length."""
    b = base64.b64decode(head[:8])
    k = b[1] & 0x7F
    if not b[1] & 0x80:
        return 2 + b[1]
    return 2 + k + int.from_bytes(b[2 : 2 + k], "big") if 1 <= k <= 4 else 0


class _Lines:
    """A run of base64 lines: the pieces, their characters without padding joined, and where each begins there."""

    def __init__(self, text: str, at: int):
        self.pieces = []
        while p := _PIECE.match(text, at):
            self.pieces.append(p)
            gap = _GAP.match(text, p.end())
            if not gap:
                break
            at = gap.end()
        bare = [p[0].rstrip("=") for p in self.pieces]
        self.joined, self.total = "".join(bare), list(accumulate(map(len, bare), initial=0))
        self.padded = list(accumulate((len(p[0]) > len(x) for p, x in zip(self.pieces, bare)), initial=0))
        size = [len(p[0]) for p in self.pieces]
        self.alike = list(range(1, len(size) + 1))  # first line after i of another length
        for i in range(len(size) - 2, -1, -1):
            if size[i] == size[i + 1]:
                self.alike[i] = self.alike[i + 1]

    def whole(self, i: int, j: int) -> int:
        """Bytes that lines i to j hold, -1 if they are not base64 (padding inside, a single character left)."""
        n = self.total[j] - self.total[i]
        return -1 if n % 4 == 1 or self.padded[j - 1] > self.padded[i] else n * 3 // 4

    def read(self, i: int, at: int, n: int) -> bytes:
        """n bytes behind the first ``at`` of line i on."""
        a = self.total[i] + at // 3 * 4
        part = self.joined[a : a + (at % 3 + n + 2) // 3 * 4]
        return base64.b64decode(part + "=" * (-len(part) % 4))[at % 3 : at % 3 + n]


def _wrapped(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of keys in runs of base64 lines without an armour. A DER key ends where its
    outer length says, an SSH container with the first line shorter than the one it begins with. Each run is read
    once; of an SSH container only its length fields are decoded."""
    out, lines, known, free = [], None, {}, 0
    for m in _START.finditer(text):
        if m.start() not in known:  # the run of lines from here
            lines = _Lines(text, m.start())
            known = {p.start(): i for i, p in enumerate(lines.pieces)}
        i, pieces = known[m.start()], lines.pieces
        if m[0][0] == "M":
            if m.start() < free:
                continue  # inside a key
            need = -(-_der_size(m[0]) * 4 // 3)
            j = bisect_left(lines.total, lines.total[i] + need)
            if need >= 32 and j < len(lines.total) and lines.total[j] == lines.total[i] + need and lines.whole(i, j) >= 0:
                if is_der_key(lines.read(i, 0, lines.whole(i, j))):
                    out.append((m.start(), "der", pieces[j - 1].end()))
                    free = pieces[j - 1].end()
            continue
        j = lines.alike[i]
        for j in [j + 1, j] if j < len(pieces) and len(pieces[j][0]) < len(pieces[i][0]) else [j]:
            if _ssh_fields(lambda at, n, i=i: lines.read(i, at, n), lines.whole(i, j)):
                out.append((m.start(), "ssh", pieces[j - 1].end()))
                break
    return out


class _Covered:
    """Whether a place lies inside any of some (start, kind, end) spans."""

    def __init__(self, spans: list[tuple[int, str, int]]):
        spans = sorted((a, b) for a, _, b in spans)
        self.starts, self.ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def __contains__(self, at: int) -> bool:
        k = bisect_right(self.starts, at)
        return k > 0 and self.ends[k - 1] > at


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """All (start, kind index, end), in order of start and then kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    added = [a for a in _armours(text) if a[1]]
    inside = _Covered(added)
    added += [w for w in _wrapped(text) if w[0] not in inside]
    inside = _Covered(added)
    for pattern, decode in ((_BASE64, _decoded), (_ANY_HEX, lambda x: bytes.fromhex(x) if len(x) % 2 == 0 else None)):
        for m in pattern.finditer(text):
            if m.start() not in inside and (kind := _structure(decode(m[0]))):
                added.append((m.start(), kind, m.end()))
    added += [(m.start(), "jwt", m.end()) for m in _SIGNED.finditer(text) if is_signed_token(m[0])]
    return sorted({*out, *((a, KINDS.index(k), b) for a, k, b in added)})


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _suspects(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents with a byte run that some pattern needs: ``:`` or ``=``, AKIA, the head of an armour,
    24 hex digits, 16 base64 characters, or a dotted run; the others cannot hold a span."""
    flag = K.counts_by(offs, np.flatnonzero((data == 0x3A) | (data == 0x3D))) > 0
    four = np.flatnonzero((data[:-3] == 0x41) & (data[1:-2] == 0x4B) & (data[2:-1] == 0x49) & (data[3:] == 0x41)) if len(data) > 3 else np.zeros(0, int)
    flag |= K.counts_by(offs, four) > 0
    dash = np.flatnonzero(data == 0x2D)
    for k, c in enumerate(_HEAD):
        dash = dash[data[np.minimum(dash + k, len(data) - 1)] == c]
    flag |= K.counts_by(offs, dash) > 0
    for table, least in ((_HEX_RUN, 24), (_RUN, 16), (_SIGNED_RUN, 12)):
        starts, ends, _ = K.words(data, offs, table)
        long = starts[ends - starts >= least]
        if table is _SIGNED_RUN and len(long):
            e = ends[ends - starts >= least]
            dots = np.flatnonzero(data == 0x2E)
            long = long[np.searchsorted(dots, e) - np.searchsorted(dots, long) >= 2]
        flag |= K.counts_by(offs, long) > 0
    return flag


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    src = ids_and_texts(docs, id_col, text_col)
    nothing = hashlib.sha256(b"").hexdigest()

    def make():
        def f(rows, data, offs):
            n = len(rows)
            counts, sha, spans = np.zeros((BASE, n), dtype=np.int64), [nothing] * n, [""] * n
            for i in np.flatnonzero(_suspects(data, offs)).tolist():
                found = find_spans(data[offs[i] : offs[i + 1]].tobytes().decode())
                if found:
                    for _, k, _ in found:
                        if k < BASE:
                            counts[k, i] += 1
                    sha[i] = hashlib.sha256(_joined([s for s in found if s[1] < BASE]).encode()).hexdigest()
                    spans[i] = _joined(found)
            return [rows.column(0), *counts, sha, spans]

        return f

    return map_texts(src, f"doc_id {id_type(src)}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)


def _redacted(text: str) -> str:
    out, at = [], 0
    for a, k, b in find_spans(text):
        if b > at:
            out += [text[at:max(a, at)]] + ([f"[{KINDS[k]}]"] if a >= at else [])
            at = b
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; all rows and columns stay,
    ``chars_col`` (if there) is the new length in characters. Null texts stay null."""
    at = docs.columns.index(text_col)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            for a, b, data, offs in K.slices(texts):
                hit = set(np.flatnonzero(_suspects(data, offs)).tolist())
                new = [None if not t.is_valid else (_redacted(t.as_py()) if i in hit else t.as_py()) for i, t in enumerate(texts.slice(a, b - a))]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(new, texts.type) if i == at else c for i, c in enumerate(part.columns)], schema=batch.schema)

    out = docs.mapInArrow(lambda batches: memory_returned(run(batches)), schema)
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.coalesce(F.char_length(text_col), F.lit(0)).cast(schema[chars_col].dataType))
    return out
