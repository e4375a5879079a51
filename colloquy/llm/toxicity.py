"""Toxicity: severity grades from a cumulative-link ordinal regression over sparse words.

P(grade >= k) = sigmoid(w.x - t_k), with one weight vector w for all thresholds t_1 < t_2 < t_3. x holds log(1 + count)
of the hashed words of the whole text (A to Z folded, punctuation dropped) and of the first four and five bytes of
longer words, so that inflected forms count together. The features that the labels tell apart best (by chi-square) get
weights. The expected severity is the
sum of P(grade >= k); a document is toxic if P(grade >= 1) is 0.3 or more.

The model is trained on labelled documents: at most `sample` of them, those with the smallest hash of their id, so the
fit is small whatever the corpus. Labels say toxic or not; grade 0 is not toxic, and toxic documents are graded 1 to 3
by how often they use words that the labels themselves show as marks of toxic texts (three equal parts). All documents
are scored with the same fixed-size weights, where they are; nothing is shuffled but the sample's ids.

Null and empty texts have no words; their severity follows from the thresholds alone. Labels that are null, or of
unknown documents, are left out; of several labels of one document the largest counts. Without any label all severities
are 0. Of equally likely grades the lowest counts. Very long texts are scored whole. An empty table gives no rows.
Repeated rows get equal results. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import _words as W
from colloquy.llm._shared import bounded_batches

BITS = 18
GRADES = 3
PREFIXES = (4, 5)
LIMIT = 0.3
PUNCTUATION = r"[.,;:!?\"'()\[\]]"


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1 on, a column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -30, 30)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hashed word, log(1 + count)) of all texts."""
    import pyarrow.compute as pc

    plain = pc.replace_substring_regex(pc.fill_null(texts, ""), PUNCTUATION, " ")
    h, start, end, bounds = W.words(plain, fold=True)
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
    data, _ = W.text_bytes(plain)
    owners, hashes = [owner], [h]
    for size in PREFIXES:
        longer = np.flatnonzero(end - start > size)
        value = np.zeros(len(longer), dtype=np.uint64)
        for j in range(size):
            value = value << np.uint64(8) | W.LOWER[data[start[longer] + j]]
        owners.append(owner[longer])
        hashes.append(W.mix(value + np.uint64(size)))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    cell, count = np.unique(owner << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    return cell >> BITS, cell & ((1 << BITS) - 1), np.log1p(count)


def _spread(x: tuple, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(x[0], weights=weights[x[1]] * x[2], minlength=n)


def marks(x: tuple, toxic: np.ndarray, n: int) -> np.ndarray:
    """How much each text uses words that stand in toxic texts at least eight times as often as in others."""
    yes, no = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    in_yes = np.bincount(x[1][toxic[x[0]]], minlength=1 << BITS)
    in_no = np.bincount(x[1][~toxic[x[0]]], minlength=1 << BITS)
    marked = (in_yes >= 5) & (in_yes / yes >= 8 * (in_no + 1) / no)
    return np.bincount(x[0], weights=np.expm1(x[2]) * marked[x[1]], minlength=n)


def grades(x: tuple, toxic: np.ndarray) -> np.ndarray:
    n = len(toxic)
    used = marks(x, toxic, n)
    out = np.zeros(n, dtype=np.int64)
    if toxic.any():
        cuts = np.quantile(used[toxic & (used > 0)] if (toxic & (used > 0)).any() else used[toxic], [1 / 3, 2 / 3])
        out[toxic] = 1 + (used[toxic] > cuts[0]) + (used[toxic] > cuts[1])
    return out


def selected(x: tuple, toxic: np.ndarray, most: int = 4096) -> tuple:
    """x with the features alone that tell toxic from other texts best, of those in five texts or more."""
    yes = np.bincount(x[1][toxic[x[0]]], minlength=1 << BITS).astype(float)
    both = np.bincount(x[1], minlength=1 << BITS).astype(float)
    share = toxic.mean()
    chi = np.where(both >= 5, (yes - share * both) ** 2 / np.maximum(share * both, 1e-9), 0)
    keep = np.zeros(1 << BITS, dtype=bool)
    keep[np.argsort(-chi, kind="stable")[:most]] = True
    keep &= chi > 0
    return tuple(a[keep[x[1]]] for a in x)


def fit(x: tuple, grade: np.ndarray, ridge: float = 1e-4, rounds: int = 150, rate: float = 0.1) -> Model:
    """Maximum likelihood with a ridge penalty, by gradient steps of adapted size over the whole sample."""
    n = len(grade)
    x = selected(x, grade >= 1)
    w, base = np.zeros(1 << BITS), np.array([0.0, 0.5, 0.5])  # first threshold, log gaps
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("w", w), ("b", base))}
    share = np.clip((grade >= 1).mean(), 1e-3, 1 - 1e-3)
    base[0] = np.log((1 - share) / share)
    low, high = grade - 1, grade  # P(grade) = above[low] - above[high]
    for step in range(1, rounds + 1):
        t = base[0] + np.concatenate([[0], np.cumsum(np.exp(base[1:]))])
        above = np.column_stack([np.ones(n), 1 / (1 + np.exp(-np.clip(_spread(x, w, n)[:, None] - t, -30, 30))), np.zeros(n)])
        slope = above * (1 - above)
        p = np.maximum(above[np.arange(n), low + 1] - above[np.arange(n), high + 1], 1e-12)
        d_score = -(slope[np.arange(n), low + 1] - slope[np.arange(n), high + 1]) / p / n
        d_t = np.zeros(GRADES)
        np.add.at(d_t, low[low >= 0], (slope[np.arange(n), low + 1] / p / n)[low >= 0])
        np.add.at(d_t, high[high < GRADES], -(slope[np.arange(n), high + 1] / p / n)[high < GRADES])
        d_base = np.array([d_t.sum(), *(d_t[::-1].cumsum()[::-1][1:] * np.exp(base[1:]))])
        d_w = np.bincount(x[1], weights=d_score[x[0]] * x[2], minlength=1 << BITS) + ridge * w
        for name, value, slope_ in (("w", w, d_w), ("b", base, d_base)):
            m, v = state[name]
            m += 0.1 * (slope_ - m)
            v += 0.01 * (slope_**2 - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(w.astype(np.float32), base[0] + np.concatenate([[0], np.cumsum(np.exp(base[1:]))]))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[tuple, np.ndarray]:
    """Features and labels of at most `sample` labelled documents, those with the smallest hash of their id."""
    ids = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                owner, cell, value = features(part.column(0))
                edges = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(v)) for v in (cell.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column(1), *lists], names=["toxic", "cells", "counts"])

    got = texts.mapInArrow(run, "toxic boolean, cells array<int>, counts array<float>").toArrow().combine_chunks()
    if not got.num_rows:
        return (), np.zeros(0, dtype=bool)
    cells, counts = got.column("cells").combine_chunks(), got.column("counts").combine_chunks()
    owner = np.repeat(np.arange(got.num_rows), cells.value_lengths().to_numpy())
    return (owner, cells.flatten().to_numpy(), counts.flatten().to_numpy()), got.column("toxic").to_numpy()


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> Model | None:
    """sample bounds the labelled rows that the fit sees."""
    x, toxic = labelled_sample(docs, labels, sample)
    return fit(x, grades(x, toxic)) if len(toxic) else None


SCHEMA = "doc_id long, expected_severity double, grade long, toxic boolean"


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row for each row of docs (doc_id, text): expected severity (0 to 3), the most likely grade, and toxic."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                n = part.num_rows
                above = model.above(_spread(features(part.column(1)), model.weights, n)) if model else np.zeros((n, GRADES))
                each = -np.diff(np.column_stack([np.ones(n), above, np.zeros(n)]), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(above.sum(axis=1), 6)), pa.array(each.argmax(axis=1)), pa.array(above[:, 0] >= LIMIT)], names=["doc_id", "expected_severity", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> DataFrame:
    return score(docs, train(docs, labels, sample))
