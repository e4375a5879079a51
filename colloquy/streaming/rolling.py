"""Rolling analysis of live segments as a stream: sums in state, features and scores as projections over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import turns as T
from colloquy.operators.rolling import SUMMED, own_counts
from colloquy.plans.layers import all_layers, apply, counts
from colloquy.streaming.sessions import DAY, followed, running


def rolling(segments: DataFrame, words: Mapping[str, Sequence[str]], delay: str = "1 hour", ttl_ms: int = DAY) -> DataFrame:
    """(session_id, event_id, speaker, chars, all features and scores) at each segment of a stream (session_id, event_id, ms, speaker, text).

    The batch twin is operators.rolling.rolling.
    """
    said = T.utrim(F.coalesce("text", F.lit("")))
    told = (F.col("speaker") == "candidate") & (said != "")
    rows = segments.withColumns({"told": told, "kind": T.question_type(F.coalesce("text", F.lit("")))})
    rows = own_counts(rows, told, words)
    names = [*SUMMED, *counts(words)]
    sums = followed(rows, running(names, {"text_length": 1, "word_count": 1}), ("session_id", "event_id", "speaker", "chars"), delay, ttl_ms)
    return apply(sums.withColumnsRenamed({f"sofar_{c}": c for c in names}), all_layers(words)[1:])
