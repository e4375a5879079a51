"""Word counts from tables of any size: an automaton over all words passes over each text once.

Hits follow the rule of the compiled form (functions.expressions.hits): occurrences of each word that do not overlap
with another of the same word, from the left, summed over the words of a category. A word inside another one counts as
well, and a word that stands in several categories counts in each. The work for a text follows its length and its hits,
not the number of words; the compiled form goes over the text once for each word.

Word lists are written by people and read on the driver; `tables.words_of` refuses more than its bound, so what is
broadcast is bounded too. Null texts have no hits. Empty words are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructType

#: For each text column, the columns to add with the words of each.
Wanted = Mapping[str, Mapping[str, Sequence[str]]]


def overlaps_itself(word: str) -> bool:
    """Can two occurrences of the word share characters?"""
    return any(word.endswith(word[:k]) for k in range(1, len(word)))


class WordCounter:
    """Counts the words of categories in texts."""

    def __init__(self, categories: Mapping[str, Sequence[str]]):
        import ahocorasick

        of: dict[str, list[int]] = {}
        for i, words in enumerate(categories.values()):
            for w in dict.fromkeys(words):
                if w:
                    of.setdefault(w, []).append(i)
        self.size = len(categories)
        self.length = np.array([len(w) for w in of], dtype=np.int64)
        self.overlapping = np.array([overlaps_itself(w) for w in of], dtype=bool)
        # the categories of word i are targets[first[i]:first[i + 1]]
        self.targets = np.array([c for cs in of.values() for c in cs], dtype=np.int64)
        self.first = np.cumsum([0, *map(len, of.values())])
        self.automaton = ahocorasick.Automaton()
        for i, w in enumerate(of):
            self.automaton.add_word(w, i)
        if of:
            self.automaton.make_automaton()

    def words(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words found, hits of each)."""
        found = list(self.automaton.iter(text)) if text and len(self.length) else []
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        ends, ids = np.array(found, dtype=np.int64).T
        loose = self.overlapping[ids]
        counted = np.ones(len(ids), dtype=bool)
        free: dict[int, int] = {}  # the end of each word's last hit
        for at in np.flatnonzero(loose).tolist():
            word, end = int(ids[at]), int(ends[at])
            if end - self.length[word] < free.get(word, -1):
                counted[at] = False
            else:
                free[word] = end
        return np.unique(ids[counted], return_counts=True)

    def categories(self, text: str | None) -> np.ndarray:
        """Hits of each category."""
        ids, hits = self.words(text)
        if not len(ids):
            return np.zeros(self.size, dtype=np.int64)
        n = self.first[ids + 1] - self.first[ids]
        at = np.repeat(self.first[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.targets[at], weights=np.repeat(hits, n), minlength=self.size).astype(np.int64)


def with_counts(rows: DataFrame, wanted: Wanted) -> DataFrame:
    """rows with a bigint column of hits for each wanted one; nothing is shuffled."""
    wanted = {c: dict(w) for c, w in wanted.items() if w}
    names = [n for w in wanted.values() for n in w]
    if not names:
        return rows
    schema = StructType(list(rows.schema.fields))
    for n in names:
        schema.add(n, LongType())
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {c: WordCounter(w) for c, w in sent.value.items()}
        for batch in batches:
            made = []
            for column, counter in counters.items():
                hits = [counter.categories(t) for t in batch.column(column).to_pylist()]
                made += [pa.array(c) for c in (np.array(hits).T if hits else np.zeros((counter.size, 0), np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def category_hits(rows: DataFrame, column: str, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """(the other columns of rows, category, words, hits): the categories with a hit in the text, their different words found and all hits.

    For tables with many categories, of which a text has few.
    """
    others = [f for f in rows.schema.fields if f.name != column]
    schema = StructType([*others, *StructType.fromDDL("category string, words bigint, hits bigint").fields])
    sent = rows.sparkSession.sparkContext.broadcast({k: tuple(v) for k, v in categories.items()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, names = WordCounter(sent.value), list(sent.value)
        for batch in batches:
            source, category, words, hits = [], [], [], []
            for i, text in enumerate(batch.column(column).to_pylist()):
                ids, n = counter.words(text)
                size = counter.first[ids + 1] - counter.first[ids]
                own = counter.targets[np.repeat(counter.first[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                kinds, at = np.unique(own, return_inverse=True)
                source += [i] * len(kinds)
                category += [names[k] for k in kinds]
                words += np.bincount(at, minlength=len(kinds)).tolist()
                hits += np.bincount(at, weights=np.repeat(n, size), minlength=len(kinds)).astype(np.int64).tolist()
            kept = [batch.column(f.name).take(pa.array(source, pa.int64())) for f in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(category, pa.string()), pa.array(words, pa.int64()), pa.array(hits, pa.int64())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
