"""Word and shingle hashes of a column of texts in numpy, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd base of the word polynomial; multiplication modulo 2**64 can be undone.
BASE = 0x9E3779B97F4A7C15
STEP_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
PLAIN = np.where(SPACE, 0, np.arange(256) + 1).astype(U64)
LOWER = PLAIN.copy()
LOWER[65:91] = PLAIN[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=U64)


class _Powers:
    """Powers of the base and of its inverse, as far as the longest chunk so far."""

    up = _powers(BASE, 1)
    down = _powers(pow(BASE, -1, 1 << 64), 1)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, STEP_BYTES + 1)
            cls.up, cls.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each starts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk
        column = pa.array([], pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about STEP_BYTES that end between words."""
    at, end = 0, len(data)
    while at < end:
        to = min(end, at + STEP_BYTES)
        while to < end and not SPACE[data[to]]:
            more = np.flatnonzero(SPACE[data[to : to + 4096]])
            to = to + int(more[0]) if len(more) else min(end, to + 4096)
        yield at, to
        at = to


def words(column: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word of all texts, and the range of words of each text.

    Words are runs without space and without the bytes 9 to 13. fold: A to Z count as a to z.
    Bytes are counted from the start of the first text.
    """
    data, offsets = text_bytes(column)
    hashes, starts, ends = [], [], []
    table = LOWER if fold else PLAIN
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    for at, to in _chunks(data, offsets):
        part = data[at:to]
        space = SPACE[part]
        before = np.empty(len(part), dtype=bool)
        before[0] = True
        before[1:] = space[:-1]
        begin = np.flatnonzero(~space & (before | first[at:to]))
        if not len(begin):
            continue
        after = np.empty(len(part), dtype=bool)
        after[-1] = True
        after[:-1] = space[1:]
        end = np.flatnonzero(~space & (after | first[at + 1 : to + 1])) + 1
        up, down = _Powers.upto(len(part))
        value = table[part]
        value *= up[: len(part)]
        h = np.add.reduceat(value, begin)
        h *= down[begin]
        hashes.append(mix(h + (end - begin).astype(U64) * U64(0xD6E8FEB86659FD93)))
        starts.append(begin + at)
        ends.append(end + at)
    if not hashes:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=U64), none, none, np.zeros(len(offsets), dtype=np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets)


def _multipliers(k: int) -> list[np.uint64]:
    return [U64(pow(BASE, j, 1 << 64)) for j in range(k)]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each position on, for all positions that have them (whatever text they are in)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    if k > 3 and len(h) <= STEP_BYTES:
        # sums over all words so far, weighted by powers of the base: a window is the difference of two of them
        up, down = _Powers.upto(len(h))
        sums = np.zeros(len(h) + 1, dtype=U64)
        np.cumsum(h * up[: len(h)], out=sums[1:])
        return mix((sums[k:] - sums[:n]) * down[:n])
    out = h[:n].copy()
    for j, m in enumerate(_multipliers(k)[1:], 1):
        out += h[j : j + n] * m
    return mix(out)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each k-word shingle of each text; a text with fewer words has its whole sequence as one; repeats stay."""
    count = np.diff(bounds)
    whole = windows(h, k)
    owner = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(whole)) + k <= bounds[1:][owner[: len(whole)]] if len(whole) else np.zeros(0, dtype=bool)
    out, own = [whole[inside]], [owner[: len(whole)][inside]]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        short = np.zeros(len(few), dtype=U64)
        for j in range(k - 1):
            has = count[few] > j
            short[has] += h[bounds[few[has]] + j] * _multipliers(k)[j]
        out.append(mix(short + count[few].astype(U64)))
        own.append(few)
    return np.concatenate(out), np.concatenate(own)


def unique_shingles(h: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """As shingles(), each once for each text, by text and then by hash."""
    value, own = shingles(h, bounds, k)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    return value[new], own[new]


def string_hashes(column: pa.Array) -> np.ndarray:
    """A hash of each string; none may be empty."""
    data, offsets = text_bytes(column)
    if len(offsets) < 2:
        return np.zeros(0, dtype=U64)
    up, down = _Powers.upto(len(data))
    value = data.astype(U64) + U64(1)
    value *= up[: len(data)]
    h = np.add.reduceat(value, offsets[:-1])
    h *= down[offsets[:-1]]
    return mix(h + np.diff(offsets).astype(U64))
