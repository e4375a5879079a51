"""Rolling analysis: features and scores of an interview as far as each candidate segment.

Hits cannot reach over the newline between two segments, so counts add up: each segment is counted once and running sums
take the place of the transcript so far.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators import folds
from colloquy.operators import turns as T
from colloquy.plans.layers import all_layers, apply, counted, counts, scored

SUMMED = ("sent", "sent_chars", "cand_chars", "n_turns", "n_segments")


def own_counts(segments: DataFrame, told: Column, words: Mapping[str, Sequence[str]]) -> DataFrame:
    """segments with the columns of `counts` for each alone, and chars: answers count for t, every line for w."""
    said = T.utrim(F.coalesce("text", F.lit("")))
    rows = segments.withColumns({
        "chars": F.length(F.coalesce("text", F.lit(""))).cast("long"),
        "t": F.when(told, said).otherwise(""),
        "w": T.display_line(F.col("speaker"), F.coalesce("text", F.lit(""))),
        "n_turns": told.cast("long"),
        "n_segments": F.lit(1).cast("long"),
    })
    parts = T.sentences(F.col("t"))
    rows = rows.withColumns({"sent": F.size(parts).cast("long"), "sent_chars": F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x)).cast("long"), "cand_chars": F.length("t").cast("long")})
    # sizes of parts add up; the least size of 1 is that of the whole
    return counted(rows, words, least=0)


def segment_counts(segments: DataFrame, words: Mapping[str, Sequence[str]]) -> DataFrame:
    """The counts of each segment, and kind: that of the question which an answer takes."""
    told = (F.col("speaker") == "candidate") & (T.utrim(F.coalesce("text", F.lit(""))) != "")
    rows = segments.select("interview_id", "seg_id", "speaker", "text", F.when(told, T.question_type(F.coalesce(T.asked(), F.lit("")))).alias("kind"))
    return own_counts(rows, told, words)


def rolling(segments: DataFrame, words: Mapping[str, Sequence[str]]) -> DataFrame:
    """(interview_id, seg_id, speaker, chars, all features and scores) as far as each segment; chars are those of the segment."""
    rows = segment_counts(segments, words)
    sofar = Window.partitionBy("interview_id").orderBy("seg_id").rowsBetween(Window.unboundedPreceding, 0)
    names = [*SUMMED, *counts(words)]
    least = {"text_length": 1, "word_count": 1}
    sums = [F.greatest(F.lit(least.get(c, 0)), F.sum(c).over(sofar)).cast("long").alias(c) for c in names]
    out = rows.select("interview_id", "seg_id", "speaker", "chars", F.size(F.collect_set("kind").over(sofar)).cast("long").alias("n_types"), *sums)
    return apply(out, all_layers(words)[1:])


def refreshed(rolled: DataFrame, segments: int = 2, chars: int = 80) -> DataFrame:
    """The rows of rolling() at which an analysis is due: enough new segments or candidate characters since the last one."""
    return folds.fold(rolled, folds.refresh(segments, chars), key="interview_id", order=("seg_id",)).where("fired").drop("fired")


def live_disc(rolled: DataFrame, roles: Mapping[str, Sequence[str]], least_chars: int = 20) -> DataFrame:
    """(interview_id, seg_id, disc_confidence, status, dominant, secondary, live scores, deltas, roles) at each candidate segment: see folds.live."""
    scores = [f"disc_{d}" for d in "cdis"]
    rows = rolled.where("speaker = 'candidate'").select("interview_id", "seg_id", "cand_chars", "disc_confidence", *scores)
    return folds.fold(rows, folds.live(dict(roles), least_chars), key="interview_id", order=("seg_id",)).drop("cand_chars", *scores)


def until_end(segments: DataFrame) -> DataFrame:
    """The segments (interview_id, seg_id, ..., ended) of sessions that have ended, as far as their first end event."""
    ends = F.min(F.when(F.col("ended"), F.col("seg_id"))).over(Window.partitionBy("interview_id"))
    return segments.withColumn("__ends", ends).where("seg_id <= __ends").drop("__ends", "ended")


def final_reports(segments: DataFrame, words: Mapping[str, Sequence[str]]) -> DataFrame:
    """(interview_id, all features and scores) of each session that has ended; what comes after its end is left out."""
    return scored(T.interviews(until_end(segments)), words)
