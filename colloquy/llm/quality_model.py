"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Each text is read once, whole, and becomes the statistics of `NAMES`: shares of kinds of characters, of words and lines
that are repeated, odd or in capitals, and sizes. They are squeezed, and scaled by their mean and deviation over all
documents. cos(W x + b) with Gaussian W approximates a Gaussian kernel (Rahimi and Recht), so a linear model on these
features is a kernel machine of fixed size. The model is the ridge solution of the normal equations, which every
partition sums over its own labelled rows; sums are added by blocks of rows of the matrix, so what is gathered is one
matrix, whatever the number of documents. Isotonic regression (pool adjacent violators) on labelled rows that the fit has
not seen turns its output into a probability; it works on the sums of fixed bins of that output, weighted by their rows.

All labelled documents are used, no sample: the statistics are a few numbers a document, written once as a table.
Neither labels, ids, language nor source are inputs of a score.

Null and empty texts have the statistics of no words and get a score like others. Very long texts are measured whole.
Labels that are null, or of unknown documents, are left out; of several labels of one document the largest counts.
Without labels of both kinds every score is the share of good labels, or 0.5 without any. Ties of the model's output get
equal scores. Repeated rows get equal results; rows without an id are scored and never learned from. An empty table gives
no rows. Only doc_id and text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm import _words as W
from colloquy.llm._shared import bounded_batches, spill

NAMES = (
    "letters capitals digits stops exclaims symbols bars others mean_word long_words one_letter capital_words marked_words shouted_words bar_words "
    "repeated_words following_words top_word repeated_triples repeated_lines marked_lines mean_line log_words log_lines"
).split()
THRESHOLD = 0.7
BATCH_BYTES = 4 << 20
#: Scaled statistics are kept within so many deviations.
MOST_DEVIATIONS = 4.0
#: Bins of the model's output, from which the calibration is made.
BINS, LOWEST, HIGHEST = 2_000, -0.5, 1.5
#: Parts of the matrix that are summed side by side; labelled rows for each matrix that is sent, and most matrices.
BLOCKS = 16
PART_ROWS = 20_000
MOST_PARTS = 256

PLAIN, SPACE, CONTINUED = 0, 8, 9
#: Kinds of bytes: plain are small letters and the first bytes of code points beyond ASCII.
_KIND = np.zeros(256, dtype=np.int8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b"!", b"#*$%&<>@^~=_+\\", b"|", b"()[]{}'\"`/-"), 1):
    _KIND[list(_chars)] = _i
_KIND[[0x20, *range(9, 14)]] = SPACE
_KIND[0x80:0xC0] = CONTINUED


@dataclass(frozen=True)
class Settings:
    """width: of the Gaussian kernel over scaled statistics; ridge: penalty for each labelled row."""

    features: int = 256
    width: float = 6.0
    ridge: float = 1e-4
    seed: int = 11
    #: One labelled row of so many is kept for the calibration.
    calibrate: int = 4


def _repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many keys are equal to an earlier one of it, and the most equal ones."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    codes, kinds = pd.factorize(keys ^ W.mix(owner.astype(np.uint64) + np.uint64(1)))
    times = np.bincount(codes)
    of = np.zeros(len(kinds), dtype=np.int64)
    of[codes] = owner
    most = np.zeros(n)
    np.maximum.at(most, of, times)
    return np.bincount(owner, minlength=n) - np.bincount(of, minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    data, offsets = W.text_bytes(texts)
    n = len(offsets) - 1
    h, start, end, bounds = W.words(texts)
    total = len(h)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    kind = _KIND[data]
    odd = np.flatnonzero((kind != PLAIN) & (kind != SPACE))  # all of them are in words
    cell = (np.searchsorted(start, odd, side="right") - 1) * 10 + kind[odd]
    in_words = np.bincount(cell, minlength=10 * total).reshape(total, 10)  # of each kind, in each word
    size = end - start - in_words[:, CONTINUED]
    ups, digits, stops, shouts, marks, bars, others = in_words[:, 1:8].T
    plain = size - in_words[:, 1:8].sum(axis=1)
    in_text = lambda x: np.bincount(owner, weights=x, minlength=n)
    chars = np.maximum(1, in_text(size))
    words = np.maximum(1, np.diff(bounds))
    again, most = _repeats(h, owner, n)
    following = np.zeros(total)
    following[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    triples = W.windows(h, 3)
    inside = owner[: len(triples)] == owner[2:] if total > 2 else np.zeros(0, bool)
    again3, _ = _repeats(triples[inside], owner[: len(triples)][inside], n)
    # lines with a word; the hash of a line is that of its words and their places
    line = np.searchsorted(np.flatnonzero(data == 10), start) + owner
    first = np.flatnonzero(np.diff(line, prepend=-1))
    in_line = np.diff(np.append(first, total))
    line_owner = owner[first]
    add = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
    line_hash = add(W.mix(h + (np.arange(total) - np.repeat(first, in_line)).astype(np.uint64)))
    marked = 2 * add(((marks > 0) | (shouts > 0) | (bars > 0)).astype(np.int64)) > in_line
    lines = np.bincount(line_owner, minlength=n)
    again_lines, _ = _repeats(line_hash, line_owner, n)
    per_line = np.maximum(1, lines)
    out = [
        *(in_text(x) / chars for x in (plain, ups, digits, stops, shouts, marks, bars, others)), in_text(size) / words,
        *(in_text(x) / words for x in (size > 12, size == 1, (ups > 1) & (plain == 0), marks > 0, shouts > 0, bars > 0)),
        again / words, in_text(following) / words, most / words, again3 / words, again_lines / per_line,
        np.bincount(line_owner, weights=marked, minlength=n) / per_line, words / per_line, np.log1p(np.diff(bounds)), np.log1p(lines),
    ]
    return np.column_stack(out)


@dataclass(frozen=True)
class Model:
    """Statistics are scaled by mean and deviation; steps and levels: the calibrated values at outputs of the linear model."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    settings: Settings
    steps: np.ndarray
    levels: np.ndarray

    def basis(self, x: np.ndarray) -> np.ndarray:
        """The random Fourier features of statistics, and a constant."""
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        directions = rng.standard_normal((len(NAMES), s.features)) / s.width
        phases = rng.uniform(0, 2 * np.pi, s.features)
        scaled = np.clip((x - self.mean) / self.deviation, -MOST_DEVIATIONS, MOST_DEVIATIONS)
        return np.column_stack([np.sqrt(2 / s.features) * np.cos(scaled @ directions + phases), np.ones(len(x))])

    def output(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.output(x), self.steps, self.levels), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(NAMES)).astype(np.float64)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row of docs (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(pc.fill_null(batch.column(1), "")).to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, side="right")))
                part = batch.slice(at, to - at)
                x = statistics(part.column(1)).astype(np.float32)
                edges = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(edges, pa.array(x.ravel()))], names=["doc_id", "x"])
                at = to

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<float>")


def normal_equations(labelled: DataFrame, model: Model, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y of labelled rows (x, y): summed in each partition, then by blocks of rows of the matrix."""
    width = model.settings.features + 1
    block = -(-width // BLOCKS)

    def in_partition(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            z = model.basis(_matrix(batch.column(0)))
            total += z.T @ np.column_stack([z, batch.column(1).to_numpy()])
        parts = [total[i : i + block].ravel() for i in range(0, width, block)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=["block", "sums"])

    def over_partitions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[k] = total.get(k, 0) + sums.values.to_numpy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["block", "sums"])

    # each matrix that is sent should stand for many rows
    few = labelled.select("x", "y").coalesce(min(MOST_PARTS, max(1, -(-rows // PART_ROWS))))
    sums = few.mapInArrow(in_partition, "block int, sums array<double>").repartition(BLOCKS, "block").mapInArrow(over_partitions, "block int, sums array<double>")
    found = np.concatenate([np.array(r.sums) for r in sorted(sums.collect(), key=lambda r: r.block)]).reshape(width, width + 1)
    return found[:, :-1], found[:, -1]


def isotonic(weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool adjacent violators: (first, last, level) of the pooled bins, whose levels rise. total: the sum of the labels of each bin."""
    pools: list[list[float]] = []  # first, last, weight, total
    for i, (w, t) in enumerate(zip(weight.tolist(), total.tolist(), strict=True)):
        pools.append([i, i, w, t])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, last, w, t = pools.pop()
            pools[-1][1] = last
            pools[-1][2] += w
            pools[-1][3] += t
    found = np.array(pools)
    return found[:, 0].astype(int), found[:, 1].astype(int), found[:, 3] / found[:, 2]


def calibration(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(steps, levels) from labelled rows (x, y) that the fit has not seen: level within each pool, lines between pools.

    One row of the other label at either end keeps levels off 0 and 1.
    """

    def bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip((model.output(_matrix(batch.column(0))) - LOWEST) / (HIGHEST - LOWEST) * BINS, 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(1)], names=["bin", "y"])

    got = rows.select("x", F.col("y").cast("double").alias("y")).mapInArrow(bins, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    weight, total = np.zeros(BINS), np.zeros(BINS)
    for r in got:
        weight[r.bin], total[r.bin] = r.n, r.y
    weight[0], total[0], weight[-1] = weight[0] + 1, total[0] + 1, weight[-1] + 1
    used = np.flatnonzero(weight)
    first, last, level = isotonic(weight[used], total[used])
    place = LOWEST + (used + 0.5) * (HIGHEST - LOWEST) / BINS
    return np.column_stack([place[first], place[last]]).ravel(), np.repeat(level, 2)


def train(stats: DataFrame, labels: DataFrame, held_out: Column, settings: Settings = Settings()) -> Model:
    """stats: a written table as of document_statistics. Rows where held_out is true or null are not learned from."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("double").alias("y"))
    rows = spill(stats.where(~held_out).join(known, "doc_id").select("doc_id", "x", "y"), "quality-labelled")
    of = lambda f, i: f(F.get("x", F.lit(i)).cast("double"))
    moments = stats.agg(*(of(f, i) for f in (F.avg, F.stddev_pop) for i in range(len(NAMES)))).first()
    mean, deviation = np.array([m or 0.0 for m in moments]).reshape(2, -1)
    counted = rows.agg(F.count("*").alias("n"), F.sum("y").alias("good")).first()
    share = counted.good / counted.n if counted.n else 0.5
    model = Model(mean, np.maximum(deviation, 1e-6), np.zeros(settings.features + 1), settings, np.array([0.0]), np.array([share]))
    if share in (0, 1) or not counted.n:
        return model
    kept_back = F.pmod(F.xxhash64("doc_id"), F.lit(settings.calibrate)) == 0
    a, b = normal_equations(rows.where(~kept_back), model, counted.n)
    penalty = settings.ridge * max(1.0, a[-1, -1]) * np.eye(len(b))
    penalty[-1, -1] = 1e-9
    model = replace(model, weights=np.linalg.solve(a + penalty, b))
    steps, levels = calibration(rows.where(kept_back), model)
    return replace(model, steps=steps, levels=levels)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of stats (doc_id, x)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(model.score(_matrix(batch.column(1))), 6))], names=["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text). held_out: over doc_id, true for rows not to learn from."""
    stats = spill(document_statistics(docs), "quality-statistics")
    scored = score(stats, train(stats, labels, held_out, settings))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
