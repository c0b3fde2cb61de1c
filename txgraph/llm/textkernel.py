"""Vectorised text helpers shared by the operators (numpy over the UTF-8 bytes of Arrow batches).

Texts are handled as bytes: word classes of all contracts are unions of ASCII ranges with or
without all non-ASCII characters, so byte classes and character classes agree in UTF-8.
Words, lines and n-grams are represented by 64-bit polynomial hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20  # text handled at once by one task; a longer single text is handled alone
_HASH_STEP = 1 << 18   # bytes hashed at once, bounds the temporary arrays
_PACK_BITS = 21

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM_CODE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def byte_class(ranges: list[tuple[int, int]], invert: bool = False) -> np.ndarray:
    """Boolean table over byte values; ``ranges`` are inclusive."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return ~table if invert else table


SPACE_WORD = byte_class([(0x20, 0x20), (0x09, 0x0D)], invert=True)
ALNUM_WORD = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], invert=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``table[data]`` of a table of one-byte values, without the eight bytes a place that an index array takes."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        _powers[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
    return _powers


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into (first row, end row, bytes, offsets); null counts as empty."""
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if texts.null_count and np.diff(offs)[texts.is_null().to_numpy(zero_copy_only=False)].any():  # bytes under a null; else no copy is needed
        yield from slices(texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b""), max_bytes)
        return
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + max_bytes, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of ``table`` bytes inside one document, and the
    first word of each document (n + 1 bounds)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = looked_up(table, data)
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[1:-1][cuts]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    n = len(starts)
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    lens = ends - starts
    pw = _power_table(int(lens.max()) + 1)
    total = np.concatenate(([0], np.cumsum(lens)))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + _HASH_STEP, side="right")) - 1)
        ln = lens[at:end]
        begin = total[at:end] - total[at]
        pos = np.arange(total[end] - total[at]) - np.repeat(begin, ln)
        val = _BYTE_CODE[data[np.repeat(starts[at:end], ln) + pos]] * pw[pos]
        full = ln > 0
        if full.any():
            got = np.zeros(end - at, dtype=np.uint64)
            got[full] = np.add.reduceat(val, begin[full])
            out[at:end] = got
        at = end
    return mix(out + lens.astype(np.uint64) * _BASE)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive hashes starting at each position (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out += h[j : j + m] * _GRAM_CODE[j]
    return mix(out)


def starts_within(bounds: np.ndarray, n: int) -> np.ndarray:
    """Positions from which n consecutive words lie in one document."""
    sizes = np.diff(bounds) - n + 1
    sizes = np.maximum(sizes, 0)
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    return np.arange(total) - np.repeat(begin, sizes) + np.repeat(bounds[:-1], sizes)


def counts_by(bounds_of: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """How many of the ascending ``positions`` lie in each [bounds_of[i], bounds_of[i+1])."""
    return np.diff(np.searchsorted(positions, bounds_of))


def dense_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): an ordering that groups equal 64-bit keys in ascending order, and flags of
    group starts along it."""
    n = len(keys)
    if n < 1 << _PACK_BITS:
        low = np.uint64((1 << _PACK_BITS) - 1)
        packed = keys & ~low
        packed |= np.arange(n, dtype=np.uint64)
        packed.sort()
        packed &= low
        order = packed.view(np.int64)
        got = keys[order]
        if n < 2 or bool((got[1:] >= got[:-1]).all()):
            return order, np.concatenate((np.ones(min(n, 1), bool), got[1:] != got[:-1]))
    order = np.argsort(keys, kind="stable")
    got = keys[order]
    return order, np.concatenate((np.ones(min(n, 1), bool), got[1:] != got[:-1]))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur more than once."""
    n = len(keys)
    flag = np.zeros(n, dtype=bool)
    if n < 2:
        return flag
    order, new = dense_order(keys)
    alone = new & np.concatenate((new[1:], [True]))
    flag[order[~alone]] = True
    return flag


def cover(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Flags of the positions inside any [start, start + length)."""
    delta = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(delta)[:n] > 0


def suffix_array(symbols: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of an integer text by prefix doubling, sorted to ``depth`` symbols (None: in full).

    Returns (order, levels); levels[j][p] ranks the 2^j symbols from p, equal ranks meaning equal
    symbols. The text must end with a symbol that occurs once, so that no suffix prefixes another.
    """
    n = len(symbols)
    order, new = dense_order(symbols.astype(np.uint64))
    where = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(where, np.diff(np.append(where, n)))
    levels, k = [rank], 1
    slot = np.arange(n)[_tied(new)] if n else np.zeros(0, np.int64)
    while len(slot) and (depth is None or k < depth):
        here = order[slot]                     # the suffixes still tied, in groups of equal rank
        head = rank[here]
        nxt = here + k
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        if n < (1 << _PACK_BITS) - 1:
            low = np.uint64((1 << _PACK_BITS) - 1)
            packed = (head.astype(np.uint64) << np.uint64(42)) | (second.astype(np.uint64) << np.uint64(21)) | np.arange(len(here), dtype=np.uint64)
            packed.sort()
            by = (packed & low).astype(np.int64)
        else:
            by = np.lexsort((second, head))
        here, head, second = here[by], head[by], second[by]
        order[slot] = here
        group = np.concatenate(([True], head[1:] != head[:-1]))
        new = group | np.concatenate(([True], second[1:] != second[:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(here)))
        rank = rank.copy()
        rank[here] = np.repeat(slot[at], size)
        levels.append(rank)
        slot = slot[_tied(new)]
        k *= 2
    return order, levels


def _tied(new: np.ndarray) -> np.ndarray:
    return ~(new & np.concatenate((new[1:], [True])))


def adjacent_lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix length of each suffix with the next one in the array."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(max(n - 1, 0), dtype=np.int64)
    for j in range(len(levels) - 1, -1, -1):
        live = (a < n) & (b < n)
        same = live & (levels[j][np.minimum(a, n - 1)] == levels[j][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << j
        lcp += step
        a += step
        b += step
    return lcp
