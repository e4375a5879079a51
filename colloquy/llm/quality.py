"""Quality rules: how much of a text lies in repeated n-grams and lines.

Every text is read whole. Words are runs without space and without the bytes 9 to 13. For each n-gram length a
rolling hash of the words goes over the text in numpy; the characters of all words inside an n-gram found twice or
more are its coverage. A text is rejected if the coverage of one length, or that of repeated lines, is above its limit.

Null and empty texts have no words and are rejected by the base rule. Very long texts are measured whole. An empty table
gives no rows. Repeated rows get equal results. Ties cannot
occur. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm import _words as W
from colloquy.llm._shared import bounded_batches

SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, dup_gram_chars array<long>, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Limits:
    """Largest share of a text's word characters inside repeated n-grams, by n, and inside repeated lines."""

    grams: dict[int, float] = field(default_factory=lambda: {5: 0.45, 7: 0.42, 10: 0.40})
    lines: float = 0.35
    min_words: int = 50
    max_repeat_share: float = 0.50


def in_repeated(ids: np.ndarray, n: int) -> np.ndarray:
    """For each word: does it lie in an n-word window that occurs twice or more, the first occurrence included?"""
    size, count = len(ids), len(ids) - n + 1
    if count < 2:
        return np.zeros(size, dtype=bool)
    _, inverse, times = np.unique(W.windows(ids, n), return_inverse=True, return_counts=True)
    hit = (times[inverse] > 1).astype(np.int32)
    edge = np.zeros(size + 1, dtype=np.int32)
    edge[:count] += hit
    edge[n : n + count] -= hit
    return np.cumsum(edge[:-1]) > 0


def repeated_exactly(codes: np.ndarray, kinds: int, n: int = 3) -> int:
    """Words inside n-word windows found twice or more; windows are compared by numbers, not by hashes."""
    count = len(codes) - n + 1
    if count < 2:
        return 0
    gram, base = codes[:count], max(kinds, 1)
    for j in range(1, n):
        _, gram = np.unique(gram, return_inverse=True)
        gram = gram * base + codes[j : j + count]
    _, inverse, times = np.unique(gram, return_inverse=True, return_counts=True)
    covered = np.zeros(len(codes), dtype=bool)
    start = np.flatnonzero(times[inverse] > 1)
    for j in range(n):
        covered[start + j] = True
    return int(covered.sum())


def measure(text: str | None, limits: Limits) -> tuple:
    """The row of one text, without its id."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, sum(raw.count(c) for c in SYMBOLS), 0, 0, 0, [0] * len(limits.grams), True, False
    codes, kinds = pd.factorize(np.array(words, dtype=object))
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = np.cumsum(size)
    chars = lead[ends] - lead[ends - size]
    total = int(chars.sum())
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    n_dup, dup_chars = 0, 0
    for line in raw.split(b"\n"):
        if line in seen:
            n_dup += 1
            dup_chars += sum(len(w.decode()) for w in line.split())
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    n_repeat = repeated_exactly(codes.astype(np.int64), len(kinds))
    base_failed = n < limits.min_words or n_repeat > limits.max_repeat_share * n
    ids = W.mix(codes.astype(np.uint64) + np.uint64(1))
    grams = [int(chars[in_repeated(ids, k)].sum()) for k in limits.grams]
    kept = not base_failed and dup_chars <= limits.lines * total and all(g <= share * total for g, share in zip(grams, limits.grams.values(), strict=True))
    return n, total, n_symbols, n_dup, n_repeat, dup_chars, grams, base_failed, kept


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts, characters inside repetitions, base_failed and kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x.as_py(), limits) for x in batch.column(1)]
            cols = [batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))]
            if rows:
                cols[7] = cols[7].cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) if pa.types.is_integer(c.type) else c for c in cols], names=[f.split()[0] for f in SCHEMA.split(", ")])

    bounded_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def good_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([measure(x.as_py(), limits)[-1] for x in batch.column(at)], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
