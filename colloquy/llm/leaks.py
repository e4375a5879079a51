"""Benchmark decontamination: SimHash over item-sized windows, found through Hamming blocks, verified exactly.

An item of L words is searched for through windows of w words, w being the largest window size that is not above L; one
window after the other, and one that ends with the item, so they cover it whole. A 64-bit SimHash (its features are word
pairs) is taken of each of them, and of every window of each size in use, at every word of every whole text. The hash is
cut in blocks; two hashes within the radius agree in some block up to a few bits, so a table of each block's values near
an item's gives all windows within the radius. Any window that is found makes its item a candidate, at the place less the
window's offset.

A candidate is kept if one of its windows of L words has a weighted 5-word-shingle similarity of 0.8 or more with the
item: the sum of the smaller counts over the sum of the larger, each shingle weighted by its characters. Windows are
slid over the text word by word. They also reach over its ends and are cut there, so a text that ends within an item, or
begins within one, holds it if what is there is enough; n_words is what the window has.

An item that is 0.8 alike has few changed words, and its windows cover it, so in some window few of the word pairs differ;
README.md has the recall against brute force.

The items are the stated query set. Their table is small next to the corpus; it goes to the tasks in blocks of bounded
bytes, and more blocks mean more passes, each over all documents. The documents are not shuffled.

Words are runs without space and without the bytes 9 to 13, A to Z folded. Null and empty texts, and items without
words, match nothing; an item of fewer than five words is one shingle. Very long texts and items are read whole, a text
larger than a part by itself. Repeated rows and items with equal ids each give their own rows. Of equally similar places
the first is reported. Without documents, or without items, there are no rows. Other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import _words as W
from colloquy.llm._shared import bounded_batches

SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 120)
SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"
LANES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)


def lanes(h: np.ndarray) -> list[np.ndarray]:
    """The 64 bits of each hash as 64 counters of 8 bits, in eight words."""
    return [(h >> np.uint64(j)) & LANES for j in range(8)]


def _doubled(one: list[np.ndarray], top: int) -> list[list[np.ndarray]]:
    """Sums over 1, 2, 4, ... features from each position on, up to top."""
    out, width = [one], 1
    while 2 * width <= top:
        if len(out[-1][0]) > width:
            out.append([a[:-width] + a[width:] for a in out[-1]])
        else:
            break
        width *= 2
    return out


def simhashes(h: np.ndarray, sizes: Iterable[int]) -> dict[int, np.ndarray]:
    """For each size, the SimHash of the window that begins at each word: bits that most of its word pairs have.

    h: hashes of the words. A window of one word has the word as its only feature.
    """
    out = {}
    pairs = W.windows(h, 2)
    sums = _doubled(lanes(pairs), max(sizes) - 1) if len(pairs) else []
    for size in sizes:
        n, features = len(h) - size + 1, size - 1
        if n <= 0:
            out[size] = np.zeros(0, dtype=np.uint64)
            continue
        if size == 1:
            out[size] = W.mix(h)
            continue
        total, at = None, 0
        for power in range(features.bit_length()):
            if features >> power & 1:
                part = [a[at : at + n] for a in sums[power]]
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
                at += 1 << power
        # a counter's high bit is set when more than half of the features have the bit
        lift = np.uint64(127 - features // 2) * LANES
        bits = np.zeros(n, dtype=np.uint64)
        for j, a in enumerate(total):
            bits |= (((a + lift) & HIGH) >> np.uint64(7)) << np.uint64(j)
        out[size] = bits
    return out


class HammingBlocks:
    """All of a few hashes within the radius of a hash: 4 blocks of 16 bits, each with a table of the values near theirs.

    Two hashes at a distance of at most radius differ in some block by at most radius // 4 bits.
    """

    def __init__(self, hashes: np.ndarray, radius: int):
        self.hashes, self.radius = hashes, radius
        near = [0] + [sum(1 << b for b in c) for r in range(1, radius // 4 + 1) for c in combinations(range(16), r)]
        near = np.array(near, dtype=np.uint64)
        self.tables = []
        for block in range(4):
            own = (hashes >> np.uint64(16 * block)) & np.uint64(0xFFFF)
            value = (own[:, None] ^ near).ravel()
            who = np.repeat(np.arange(len(hashes)), len(near))
            order = np.argsort(value, kind="stable")
            count = np.bincount(value.astype(np.int64), minlength=1 << 16)
            self.tables.append((np.cumsum(count) - count, count, who[order]))

    def within(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in found, number of the hash) of all pairs within the radius."""
        at, which = [], []
        for block, (start, count, who) in enumerate(self.tables):
            value = ((found >> np.uint64(16 * block)) & np.uint64(0xFFFF)).astype(np.int64)
            n = count[value]
            hit = np.flatnonzero(n)
            n = n[hit]
            ends = np.cumsum(n)
            pos = np.repeat(hit, n)
            item = who[np.repeat(start[value[hit]] - (ends - n), n) + np.arange(len(pos))]
            close = np.bitwise_count(found[pos] ^ self.hashes[item]) <= self.radius
            at.append(pos[close])
            which.append(item[close])
        both = np.unique(np.concatenate(at) * len(self.hashes) + np.concatenate(which)) if len(self.hashes) else np.zeros(0, np.int64)
        return both // max(1, len(self.hashes)), both % max(1, len(self.hashes))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _grams(words: list[bytes], k: int = 5) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)] if words else []


def _characters(gram: Iterable[bytes]) -> int:
    return sum(len(w.decode(errors="replace")) for w in gram)


def _hashes(words: Iterable[bytes]) -> np.ndarray:
    return W.words(pa.array([b" ".join(words).decode(errors="replace")]), fold=True)[0]


def weighted(words: list[bytes], k: int = 5) -> Counter:
    """Each shingle's count times its characters."""
    return Counter({g: n * _characters(g) for g, n in Counter(_grams(words, k)).items()})


def similarity(a: Counter, b: Counter) -> float:
    low = sum(min(n, b[g]) for g, n in a.items() if g in b)
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


class Item:
    """An item's words, and its shingles' counts and weights."""

    def __init__(self, number: int, words: list[bytes]):
        self.id, self.words = number, words
        self.weights = weighted(words)
        self.total = sum(self.weights.values())
        self.counts = Counter(_grams(words))

    def best(self, words: list[bytes], ranges: list[tuple[int, int]]) -> tuple[float, int, int]:
        """(similarity, first word, words) of the most similar window that begins in the ranges; of equal ones the first.

        A window that reaches over an end of the text is cut there.
        """
        length, n = len(self.words), len(words)
        found = (0.0, 0, 0)
        for lo, hi in _merged((max(a, 1 - length), min(b, n - 1)) for a, b in ranges):
            if length < 5:
                at = next((p for p in range(max(0, lo), hi + 1) if words[p : p + length] == self.words), None)
                if at is not None and found[0] < 1:
                    found = (1.0, at, length)
                continue
            seen, low, weight = Counter(), 0, 0
            a = b = max(0, lo)
            for p in range(lo, hi + 1):
                first, end = max(0, p), min(p + length, n)
                for i in range(b, end - 4):
                    g = tuple(words[i : i + 5])
                    w = _characters(g)
                    weight += w
                    low += w if seen[g] < self.counts.get(g, 0) else 0
                    seen[g] += 1
                for i in range(a, first):
                    g = tuple(words[i : i + 5])
                    w = _characters(g)
                    weight -= w
                    low -= w if seen[g] <= self.counts.get(g, 0) else 0
                    seen[g] -= 1
                a, b = first, max(b, end - 4)
                alike = low / (self.total + weight - low)
                if alike > found[0]:
                    found = (alike, first, end - first)
        return found


def offsets(length: int, size: int) -> list[int]:
    """Where windows of this size begin that cover an item of this length."""
    return sorted({*range(0, length - size + 1, size), length - size})


def _merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (both ends belong to them) in order, without overlap; empty ones go."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(r for r in ranges if r[0] <= r[1]):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


class Items:
    """One block of the query set, with an index for each window size in use."""

    def __init__(self, rows: list[tuple[int, str | None]], radius: int):
        self.rows = [Item(i, w) for i, t in rows if (w := split_words(t))]
        self.index = {}
        groups: dict[int, list[tuple[int, int]]] = {}
        for number, item in enumerate(self.rows):
            size = max(s for s in SIZES if s <= len(item.words))
            groups.setdefault(size, []).extend((number, offset) for offset in offsets(len(item.words), size))
        for size, places in groups.items():
            hashes = np.empty(len(places), dtype=np.uint64)
            for number, some in groupby(enumerate(places), key=lambda x: x[1][0]):
                at = [(i, offset) for i, (_, offset) in some]
                every = simhashes(_hashes(self.rows[number].words), [size])[size]
                hashes[[i for i, _ in at]] = every[[offset for _, offset in at]]
            self.index[size] = (np.array(places, dtype=np.int64), HammingBlocks(hashes, radius))
        self.length = np.array([len(item.words) for item in self.rows])

    def _places(self, h: np.ndarray, bounds: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item number, first start, last start) of windows that can be alike."""
        for size, hashes in simhashes(h, self.index).items():
            places, blocks = self.index[size]
            at, which = blocks.within(hashes)
            inside = at + size <= bounds[1:][owner[at]] if len(at) else np.zeros(0, dtype=bool)
            at, (which, offset) = at[inside], places[which[inside]].T
            start = at - bounds[owner[at]] - offset
            # words that were put in or left out before the window move it
            slack = np.maximum(4, self.length[which] // 8)
            yield from zip(owner[at].tolist(), which.tolist(), (start - slack).tolist(), (start + slack).tolist(), strict=True)

    def find(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(text number, item id, similarity, first word, words) of each item in each text, at its best place."""
        if not self.index:
            return
        h, _, _, bounds = W.words(texts, fold=True)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for text, number, lo, hi in self._places(h, bounds, owner):
            found.setdefault((text, number), []).append((lo, hi))
        split: dict[int, list[bytes]] = {}
        for (text, number), ranges in sorted(found.items()):
            words = split.setdefault(text, split_words(texts[text].as_py()))
            alike, first, length = self.rows[number].best(words, ranges)
            if alike >= 0.8:
                yield text, self.rows[number].id, alike, first, length
            if len(split) > 64:
                split = {text: words}


#: The last indexes that this Python worker built: a worker runs many tasks, and builds each block's index once.
_LAST: dict[str, Items] = {}
MOST_KEPT = 3


def index_of(key: str, rows: list[tuple[int, str | None]], radius: int) -> Items:
    found = _LAST.pop(key, None) or Items(rows, radius)
    _LAST[key] = found
    while len(_LAST) > MOST_KEPT:
        _LAST.pop(next(iter(_LAST)))
    return found


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks of about so many bytes of text; a longer item is a block of its own."""
    rows: list[tuple[int, str | None]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        own = len((row[1] or "").encode()) + 64
        if rows and size + own > block_bytes:
            yield rows
            rows, size = [], 0
        rows.append((row[0], row[1]))
        size += own
    if rows:
        yield rows


#: Bytes of items in a block; its index takes some thirty times as much in a worker.
BLOCK_BYTES = 4 << 20


def find_leaks(docs: DataFrame, items: DataFrame, radius: int = 11, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each item (item_id, text) in each row of docs (doc_id, text) that holds it."""
    bounded_batches(docs.sparkSession)
    out = None

    def searched(block: list[tuple[int, str | None]]) -> DataFrame:
        sent, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(key, sent.value, radius)
            for batch in batches:
                for part in _parts(batch, 300_000):
                    hits = list(index.find(part.column(1)))
                    if hits:
                        n, *rest = (list(c) for c in zip(*hits, strict=True))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(n)), *map(pa.array, rest)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)

    for rows in _blocks(items, block_bytes):
        out = searched(rows) if out is None else out.unionByName(searched(rows))
    return searched([]) if out is None else out


def _parts(batch: pa.RecordBatch, size: int, text: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about so many bytes of text."""
    _, offsets = W.text_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size)) - 1)
        yield batch.slice(at, min(to, batch.num_rows) - at)
        at = to


def without_leaks(docs: DataFrame, items: DataFrame, radius: int = 11, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold an item. Each row is judged by its own text, whatever other rows have its id."""
    bounded_batches(docs.sparkSession)
    text = docs.columns.index("text")

    def kept(rows: DataFrame, block: list[tuple[int, str | None]]) -> DataFrame:
        sent, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(key, sent.value, radius)
            for batch in batches:
                for part in _parts(batch, 300_000, text):
                    stays = np.ones(part.num_rows, dtype=bool)
                    stays[[n for n, *_ in index.find(part.column(text))]] = False
                    yield part.filter(pa.array(stays))

        return rows.mapInArrow(run, docs.schema)

    for block in _blocks(items, block_bytes):
        docs = kept(docs, block)
    return docs
