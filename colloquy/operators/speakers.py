"""Speaker embeddings: similarity, enrolment, matching, updates. Vectors are arrays of numbers; sums are in double."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators import folds
from colloquy.sources.scratch import scratch


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine01(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2; vectors without length count as of length 1e-8."""
    return (dot(a, b) / (F.greatest(norm(a), F.lit(1e-8)) * F.greatest(norm(b), F.lit(1e-8))) + 1) / 2


def unit(a: Column) -> Column:
    size = F.greatest(norm(a), F.lit(1e-8))
    return F.transform(a, lambda x: x.cast("double") / size)


def embedding_stats(vectors: DataFrame) -> DataFrame:
    n = F.size("embedding")
    mean = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / n
    out = vectors.select("vec_id", n.cast("long").alias("dim"), F.round(norm(F.col("embedding")), 6).alias("l2"), F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), 6).alias("std"), F.array_min("embedding").cast("double").alias("low"), F.array_max("embedding").cast("double").alias("high"))
    return out.withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


def enrol(samples: DataFrame, least: int = 2) -> DataFrame:
    """(speaker_id, n, embedding, quality, status): the unit mean of a speaker's samples, built up position by position.

    The sums of a position are partial before the shuffle, so a speaker with very many samples makes no large group.
    """
    parts = samples.select("speaker_id", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("speaker_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    lists = means.groupBy("speaker_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("mean"), F.max("n").alias("n"))
    ready = F.col("n") >= least
    return lists.select("speaker_id", "n", F.when(ready, unit(F.col("mean"))).alias("embedding"), F.round(norm(F.col("mean")), 6).alias("quality"), F.when(ready, "enrolled").otherwise("too_few").alias("status"))


#: Bytes of profiles that are sent to every task at once; more of them are sent one pack after the other.
MOST_BROADCAST = 64 << 20
#: Similarities that a task holds at once.
PRODUCTS = 4_000_000

#: Profiles of one width: ids, ascending, and a matrix with a row for each.
Pack = dict[int, tuple[np.ndarray, np.ndarray]]


def _pack(profiles: DataFrame) -> Pack:
    table = profiles.select("speaker_id", "profile").toArrow().combine_chunks().sort_by("speaker_id")
    ids, width = table.column("speaker_id").to_numpy(), pc.list_value_length(table.column("profile")).to_numpy()
    lists = table.column("profile").to_pylist()
    out = {}
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        out[int(w)] = ids[rows], np.array([lists[r] for r in rows], dtype=np.float64)
    return out


def _nearest(x: np.ndarray, ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, id) of the nearest profile of each row of x, as matrix products of bounded size; -1 where there is none."""
    size = np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-8)
    near, who = np.empty(len(x)), np.empty(len(x), dtype=np.int64)
    step = max(1, PRODUCTS // len(ids))
    for at in range(0, len(x), step):
        part = slice(at, at + step)
        score = np.nan_to_num((x[part] / size[part, None] @ m.T + 1) / 2, nan=-1)
        best = np.argmax(np.round(score, 6), axis=1)  # the first of equals, which has the smallest id
        near[part], who[part] = score[np.arange(len(best)), best], ids[best]
    return near, who


def _searcher(sent: Broadcast, fields: list[str]):
    """Batches of (vec_id, embedding, speaker_id, similarity) to the same with the pack's profile where it is nearer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            width = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            similarity = pc.fill_null(batch.column("similarity"), -1.0).to_numpy(zero_copy_only=False).copy()
            speaker = pc.fill_null(batch.column("speaker_id").cast(pa.int64()), 0).to_numpy(zero_copy_only=False).copy()
            for w, (ids, m) in sent.value.items():
                rows = np.flatnonzero(width == w)
                if not len(rows):
                    continue
                flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                near, who = _nearest(flat.astype(np.float64).reshape(-1, w), ids, m)
                now, new = np.round(similarity[rows], 6), np.round(near, 6)
                better = (new > now) | ((new == now) & (new >= 0) & (who < speaker[rows]))
                similarity[rows[better]], speaker[rows[better]] = near[better], who[better]
            none = similarity < 0
            made = [pa.array(speaker, mask=none).cast(batch.column("speaker_id").type), pa.array(similarity, mask=none)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vectors, *made], names=fields)

    return run


def match(vectors: DataFrame, profiles: DataFrame, most_bytes: int = MOST_BROADCAST) -> DataFrame:
    """(vec_id, speaker_id, similarity): the nearest profile; of equals, to six digits, the one with the smallest id.

    Profiles are the stated query set, held against all vectors. They are computed once, into a table, and go to the
    tasks as a matrix, in packs below most_bytes by their count and width; vectors stay where they are and keep the
    nearest profile so far. Between two packs they are written, so that only one pack is held. Vectors without numbers,
    or of a width that no profile has, get nulls; without profiles there are no rows.
    """
    spark = vectors.sparkSession
    path = scratch(spark, "profiles")
    profiles.where("embedding is not null").select("speaker_id", unit(F.col("embedding")).alias("profile")).write.parquet(path)
    known = spark.read.parquet(path)
    count, width = known.agg(F.count("*"), F.coalesce(F.max(F.size("profile")), F.lit(0))).first()
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    found = own.withColumns({"speaker_id": F.lit(None).cast(known.schema["speaker_id"].dataType), "similarity": F.lit(None).cast("double")})
    if not count:
        return found.where(F.lit(False)).select("vec_id", "speaker_id", "similarity")
    n = max(1, -(-8 * count * width // most_bytes))
    for pack in range(n):
        if pack:
            path = scratch(spark, "nearest")
            found.write.parquet(path)
            sent.unpersist()
            found = spark.read.schema(found.schema).parquet(path)
        sent = spark.sparkContext.broadcast(_pack(known.where(F.pmod(F.xxhash64("speaker_id"), F.lit(n)) == pack)))
        found = found.mapInArrow(_searcher(sent, found.columns), found.schema)
    return found.select("vec_id", "speaker_id", F.round("similarity", 6).alias("similarity"))


def update_profile(old: Column, samples: Column, weight: float = 0.2) -> Column:
    """The profile after each sample in order: (1 - weight) old + weight sample, of unit length."""
    return F.aggregate(samples, old, lambda p, s: unit(F.zip_with(p, s, lambda a, b: a * (1 - weight) + b.cast("double") * weight)))


def _doubles(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))


def enrolment_steps(vectors: DataFrame, same: float = 0.75, weight: float = 0.2) -> DataFrame:
    """(session_id, vec_id, phase, similarity, interviewer, candidate) at each embedding of a session, in order of vec_id."""
    out = folds.fold(_doubles(vectors), folds.enrol(same, weight), order=("vec_id",))
    return out.select("session_id", "vec_id", "phase", "similarity", "interviewer", "candidate")


def auto_enrol(vectors: DataFrame, same: float = 0.75, weight: float = 0.2) -> DataFrame:
    """(session_id, interviewer, candidate, used) after all embeddings of each session: see folds.enrol."""
    steps = enrolment_steps(vectors, same, weight).where("phase <> 'done'")
    last = F.max(F.struct("vec_id", "interviewer", "candidate")).alias("x")
    return steps.groupBy("session_id").agg(last, F.count("*").alias("used")).select("session_id", "x.interviewer", "x.candidate", "used")


def updated_profiles(vectors: DataFrame, weight: float = 0.2) -> DataFrame:
    """(session_id, vec_id, profile) after each sample of a session, in order of vec_id."""
    return folds.fold(_doubles(vectors), folds.profile(weight), order=("vec_id",)).select("session_id", "vec_id", "profile")


def retro_roles(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """(session_id, vec_id, role): roles after the fact; the candidate's only if strictly more alike, else the interviewer's."""
    both = vectors.join(profiles, "session_id", "left")
    nearer = F.coalesce(cosine01(F.col("embedding"), F.col("candidate")) > cosine01(F.col("embedding"), F.col("interviewer")), F.lit(False))
    return both.select("session_id", "vec_id", F.when(nearer, "candidate").otherwise("interviewer").alias("role"))


def frame_energy(samples: Column, whole_numbers: bool = False) -> Column:
    """Mean square of a frame's samples; samples in 16-bit whole numbers count as parts of 32768."""
    by = float(32768**2) if whole_numbers else 1.0
    return F.when(F.size(samples) > 0, dot(samples, samples) / (F.size(samples) * by)).otherwise(0.0)
