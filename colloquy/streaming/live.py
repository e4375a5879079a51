"""The live path as streams: rolling analysis at its trigger, live scores, and reports of sessions that have ended.

Each is a chain: segments are counted where they are, a session's sums follow in the state store, features and scores
are projections over the sums, and a second stateful step smooths the scores. The watermark goes on from step to step.
The batch twins are in operators.rolling.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import folds
from colloquy.operators import turns as T
from colloquy.operators.folds import Fold
from colloquy.operators.rolling import SUMMED, own_counts
from colloquy.plans.layers import all_layers, apply, counts
from colloquy.streaming.sessions import DAY, followed, running

LEAST = {"text_length": 1, "word_count": 1}


def _sums(segments: DataFrame, words: Mapping[str, Sequence[str]], more: Fold, carried: Sequence[str], delay: str, ttl_ms: int) -> DataFrame:
    """What `more` says at each segment, with the sums so far under the names of the counts."""
    said = T.utrim(F.coalesce("text", F.lit("")))
    told = (F.col("speaker") == "candidate") & (said != "")
    rows = segments.withColumns({"told": told, "kind": T.question_type(F.coalesce("text", F.lit("")))})
    rows = own_counts(rows, told, words)
    names = [*SUMMED, *counts(words)]
    rule = folds.both(running(names, LEAST), more)
    out = followed(rows, rule, ("session_id", "event_id", "ms", "ts", *carried), delay, ttl_ms)
    return out.withColumnsRenamed({f"sofar_{c}": c for c in names})


def rolling_analysis(segments: DataFrame, words: Mapping[str, Sequence[str]], due: Fold | None = None, delay: str = "1 hour", ttl_ms: int = DAY) -> DataFrame:
    """(session_id, event_id, ms, speaker, chars, all features and scores) at the segments at which an analysis is due.

    segments: session_id, event_id, ms, speaker, text. due: the rule that fires, folds.refresh() if not given.
    """
    sums = _sums(segments, words, due or folds.refresh(), ("speaker", "chars"), delay, ttl_ms)
    return apply(sums.where("fired").drop("fired"), all_layers(words)[1:])


def live_scores(segments: DataFrame, words: Mapping[str, Sequence[str]], roles: Mapping[str, Sequence[str]], least_chars: int = 20, delay: str = "1 hour", ttl_ms: int = DAY) -> DataFrame:
    """(session_id, event_id, disc_confidence, status, dominant, secondary, live scores, deltas, roles) at each candidate segment."""
    rows = segments if "ended" in segments.columns else segments.withColumn("ended", F.lit(False))
    sums = _sums(rows, words, folds.until_end(), ("speaker",), delay, ttl_ms)
    scored = apply(sums.where("speaker = 'candidate' and status <> 'not_active'").drop("status"), all_layers(words)[1:])
    rows = scored.select("session_id", "event_id", "ms", "ts", "cand_chars", "disc_confidence", *(f"disc_{d}" for d in "cdis"))
    return followed(rows, folds.live({k: tuple(v) for k, v in roles.items()}, least_chars), ("session_id", "event_id", "disc_confidence"), delay, ttl_ms)


def final_reports(segments: DataFrame, words: Mapping[str, Sequence[str]], delay: str = "1 hour", ttl_ms: int = DAY) -> DataFrame:
    """(session_id, event_id, ms, all features and scores) of each session, once, at its end event; what comes after it is left out.

    segments: session_id, event_id, ms, speaker, text, ended.
    """
    sums = _sums(segments, words, folds.until_end(), (), delay, ttl_ms)
    return apply(sums.where("status = 'completed'").drop("status"), all_layers(words)[1:])


def analyses_of_completed(read_segments: Callable[[SparkSession], DataFrame], analyse: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A hook for streams of ended sessions (session_id, event_id, ms): the full batch analysis of these sessions alone.

    read_segments: the table of all segments (session_id, event_id, ms, ...), which is read anew for each micro-batch and
    joined with the ended ids by key. What a micro-batch gives is written under its number, so a repeated one adds nothing.
    """

    def hook(ended: DataFrame, number: int) -> None:
        ids = ended.groupBy("session_id").agg(F.min(F.struct("ms", "event_id")).alias("__last"))
        rows = read_segments(ended.sparkSession).join(ids, "session_id").where(F.struct("ms", "event_id") <= F.col("__last")).drop("__last")
        analyse(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return hook
