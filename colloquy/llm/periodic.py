"""Periodic runs: stretches of words that repeat with a short period four times or more, and the text without the repeats.

A run is a stretch of words with smallest period q and length >= max(least_words, 4 * q) that no neighbour extends. Runs
are found with string synchronising sets, at dyadic scales t = 4, 8, 16, ...:

* Windows of t words get names by doubling: the name of a window is the pair of the names of its halves, numbered
  anew, so equal names mean equal words and no hash decides.
* A position is selected if the least hash of the t-word windows that begin within t words of it belongs to its own
  window or to the one t words later. What is selected depends on the next 2 * t words alone, so a repeat of these words
  is selected as well (consistency), and every t positions in a row have a selected one (density), but where
  all windows have a period of t / 4 or less. Those windows are left out of the minima: they lie in runs that smaller
  scales have found.
* Selected positions with equal next 2 * t words, one after the other, d words apart with t <= d < 2 * t, propose the
  period d. A run of period q >= t has a selected position in its first t words, and its copy q words later has the same
  context, as 3 * t + q <= 4 * q; no position between them has it, else two periods would meet and the run's smallest
  period were smaller (Fine and Wilf). So every run is proposed at the scale t <= q < 2 * t.
* Periods of 1 to 3 words, the highly periodic regions of the first scale, are found by comparing shifted words.

Proposals are extended both ways word by word and kept if no divisor of the period is one too. The texts of a batch are
one sequence in which texts share no word, so each scale is a few array operations for many texts; texts too short for
a scale leave. Work is proportional to words times scales, whatever the text's length, and nothing is shuffled.

Null and empty texts have no words, no runs and an empty collapsed text. A very long text is a batch of its own, read
whole. Ties of the longest run are resolved by the query. Repeated rows get equal results. An empty table gives no rows.
Only doc_id and text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm import _words as W
from colloquy.llm._shared import bounded_batches

SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
#: Periods that are compared word by word; the first scale takes the next ones.
SMALL = 3
REPEATS = 4
BATCH_BYTES = 2 << 20
NONE = np.iinfo(np.uint64).max

Edit = Callable[[int | None, int], np.ndarray | None]


def stretch(codes: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch (start, end) around the words at and at + period in which words `period` apart are equal."""
    right, step = at, 64
    while (m := min(step, len(codes) - period - right)) > 0:
        differ = np.flatnonzero(codes[right : right + m] != codes[right + period : right + period + m])
        right, step = right + (int(differ[0]) if len(differ) else m), 2 * step
        if len(differ):
            break
    left, step = at, 64
    while (m := min(step, left)) > 0:
        differ = np.flatnonzero(codes[left - m : left] != codes[left - m + period : left + period])
        left, step = (left - m + int(differ[-1]) + 1 if len(differ) else left - m), 2 * step
        if len(differ):
            break
    return left, right + period


def smallest(codes: np.ndarray, start: int, period: int) -> bool:
    """Is no proper divisor of the period a period of the stretch?"""
    part = codes[start : start + 2 * period]
    return not any(period % d == 0 and np.array_equal(part[:period], part[d : d + period]) for d in range(1, period // 2 + 1))


def small_periods(codes: np.ndarray, period: int) -> list[tuple[int, int, int]]:
    same = codes[:-period] == codes[period:]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2] + period
    long = ends - starts >= REPEATS * period
    return [(int(s), int(e), period) for s, e in zip(starts[long], ends[long], strict=True) if smallest(codes, s, period)]


def selected(names: np.ndarray, periodic: np.ndarray, scale: int) -> np.ndarray:
    """The synchronising set: names are those of the windows of `scale` words, periodic tells which of them are left out."""
    value = W.mix(names.astype(np.uint64) + np.uint64(scale))
    value[periodic] = NONE
    least, width = value, 1
    while width < scale:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:-1], least[1:])  # over scale + 1 windows
    n = len(least)
    return np.flatnonzero((least != NONE) & ((least == value[:n]) | (least == value[scale : scale + n])))


def proposals(names: np.ndarray, periodic: np.ndarray, twice: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of selected positions with equal contexts; twice: names of the windows of 2 * scale words."""
    at = selected(names, periodic, scale)
    at = at[at < len(twice)]
    order = np.argsort(twice[at], kind="stable")
    same = twice[at[order[:-1]]] == twice[at[order[1:]]]
    first = at[order[:-1]][same]
    apart = at[order[1:]][same] - first
    fits = (apart >= scale) & (apart < 2 * scale)
    return first[fits], apart[fits]


def all_runs(codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all stretches with four repeats of a smallest period; bounds: where texts begin, and the end."""
    found: list[tuple[int, int, int]] = []
    for period in range(1, SMALL + 1):
        if len(codes) > period:
            found += small_periods(codes, period)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes))  # of what is left, in codes
    names, width, scale = codes, 1, SMALL + 1
    while scale * REPEATS <= sizes.max(initial=0):
        if len(place) > 2 * (left := int(sizes[sizes >= scale * REPEATS].sum())) or left < len(place) and width == 1:
            stays = sizes[owner[place]] >= scale * REPEATS
            # windows past the end of what is left belong to no text
            names, place = np.append(names, np.full(len(place) - len(names), -1))[stays], place[stays]
        while width <= scale:
            if width == scale:
                before = names
            if len(names) <= width:
                return found
            names = pd.factorize(names[:-width] * np.int64(len(place) + 2) + names[width:])[0].astype(np.int64)
            width *= 2
        periodic = np.zeros(len(place) + 1, dtype=np.int32)
        for start, end, period in found:
            if REPEATS * period <= scale <= end - start:
                k = int(np.searchsorted(place, start))
                if k < len(place) and place[k] == start:
                    periodic[k] += 1
                    periodic[k + end - start - scale + 1] -= 1
        at, apart = proposals(before, np.cumsum(periodic)[: len(before)] > 0, names, scale)
        for period in np.unique(apart):
            mine = np.sort(place[at[apart == period]])
            k = 0
            while k < len(mine):
                start, end = stretch(codes, int(mine[k]), int(period))
                if end - start >= REPEATS * period and smallest(codes, start, int(period)):
                    found.append((start, end, int(period)))
                k = max(k + 1, int(np.searchsorted(mine, end - period)))
        scale *= 2
    return found


def measure(ids: list[int | None], texts: list[bytes], least_words: int, edit: Edit | None) -> Iterator[tuple[list[dict], bytes]]:
    """(runs, collapsed text) of each text."""
    words, bounds = [], [0]
    for doc_id, text in zip(ids, texts, strict=True):
        own = text.split()
        if edit and own and (at := edit(doc_id, len(own))) is not None:
            own = [own[i] for i in at.tolist()]
        words += own
        bounds.append(len(words))
    edges = np.array(bounds)
    owner = np.repeat(np.arange(len(ids)), np.diff(edges))
    kinds, _ = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), None)
    codes = pd.factorize(owner * np.int64(len(words) + 1) + kinds)[0].astype(np.int64)
    found = sorted((s, e - s, q) for s, e, q in all_runs(codes, edges) if e - s >= max(least_words, REPEATS * q))
    drop = np.zeros(len(words) + 1, dtype=np.int32)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    drop = np.cumsum(drop) > 0
    starts = np.array([r[0] for r in found], dtype=np.int64)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        i, j = np.searchsorted(starts, (a, b))
        runs = [{"start": s - a, "length": n, "period": q} for s, n, q in found[i:j]]
        yield runs, b" ".join(words[a:b] if i == j else [words[k] for k in (np.flatnonzero(~drop[a:b]) + a).tolist()])


def batches_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of the texts with about BATCH_BYTES."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > BATCH_BYTES:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def periodic_runs(docs: DataFrame, least_words: int = 6, edit: Edit | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) for each row of docs (doc_id, text): runs by start, then period; words after a run's first period go.

    edit: gives for an id and a number of words the numbers of the words to read in their place, or None to leave them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()}))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for a, b in batches_of(texts):
                rows = list(measure(ids[a:b], texts[a:b], least_words, edit))
                cols = [pa.array(ids[a:b], pa.int64()), pa.array([r for r, _ in rows], kind), pa.array([c for _, c in rows], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "runs", "collapsed"])

    bounded_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").mapInArrow(run, SCHEMA)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The rewriting of the registered query: a tenth of the ids repeat a stretch from some word on. Rows without an id stay."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at
