"""Live segment events as rows: what a session's events are, and the rules over them as batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators import folds

SPEAKER = {"click": "interviewer", "view": "interviewer", "purchase": "candidate", "signup": "candidate", "error": "candidate"}


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, session_id, ms, event_type, speaker, kind, chars, ended, energy, prob) from the table of events.

    An error stands for a partial text of the candidate, every fourth signup for the end of its session.
    """
    return shaped(spark.read.parquet(f"{sf_dir}/events.parquet"))


def shaped(rows: DataFrame) -> DataFrame:
    speaker = F.element_at(F.create_map(*(F.lit(x) for kv in SPEAKER.items() for x in kv)), F.col("event_type"))
    value = F.coalesce("value", F.lit(0.0))
    return rows.select(
        "event_id",
        F.col("user_id").alias("session_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        "event_type",
        F.coalesce(speaker, F.lit("unknown")).alias("speaker"),
        F.when(F.col("event_type") == "error", "partial").otherwise("final").alias("kind"),
        F.floor(value).alias("chars"),
        ((F.col("event_type") == "signup") & (F.col("event_id") % 4 == 0)).alias("ended"),
        (value / 1000).alias("energy"),
        ((F.col("event_id") % 10) / 10).alias("prob"),
    )


def scaled(events: DataFrame, by: int) -> DataFrame:
    """The same events in a quicker time: their distances, which are hours, become seconds or less."""
    return events.withColumn("ms", F.floor(F.col("ms") / by))


def refresh_triggers(events: DataFrame, segments: int = 2, chars: int = 80) -> DataFrame:
    return folds.fold(events.where("kind = 'final'"), folds.refresh(segments, chars)).select("session_id", "event_id", "fired")


def fast_triggers(events: DataFrame, wait_ms: int = 1000, chars: int = 20) -> DataFrame:
    return folds.fold(events, folds.fast(wait_ms, chars)).select("session_id", "event_id", "fired")


def call_throttle(events: DataFrame, wait_ms: int = 10_000) -> DataFrame:
    """The kind of event stands for the signature."""
    return folds.fold(events.withColumn("signature", F.col("event_type")), folds.throttle(wait_ms)).select("session_id", "event_id", "emitted")


def single_flight(events: DataFrame, wait_ms: int = 8000, ttl_ms: int | None = None) -> DataFrame:
    """The kind of event and its characters, in tens, stand for the request."""
    request = F.concat_ws(":", "event_type", F.floor(F.col("chars") / 10).cast("string"))
    return folds.fold(events.withColumn("request", request), folds.single_flight(wait_ms, ttl_ms)).select("session_id", "event_id", "outcome")


def ema_scores(events: DataFrame) -> DataFrame:
    return folds.fold(events.withColumn("value", F.col("chars") % 101), folds.ema()).select("session_id", "event_id", "score")


def appended(events: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(session_id, event_id, seg_id, status) of the segments: ok ones are numbered, others are unknown, not_active or blank.

    registry: (session_id) of the sessions that were opened; without it all are known. What a session's segment becomes
    follows from those before it by windows; the stream's twin is folds.append.
    """
    order = Window.partitionBy("session_id").orderBy("ms", "event_id")
    before, sofar = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.where("kind = 'final'")
    if registry is None:
        rows = rows.withColumn("known", F.lit(True))
    else:
        rows = rows.join(registry.select("session_id").distinct().withColumn("known", F.lit(True)), "session_id", "left")
    over = F.coalesce(F.max("ended").over(before), F.lit(False))
    status = F.when(F.col("known").isNull(), "unknown").when(over, "not_active").when(F.coalesce("chars", F.lit(0)) == 0, "blank").otherwise("ok")
    rows = rows.withColumn("status", status)
    number = F.when(F.col("status") == "ok", F.count(F.when(F.col("status") == "ok", 1)).over(sofar))
    return rows.select("session_id", "event_id", number.alias("seg_id"), "status")


def registrations(registry: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions of a registry (session_id, ms) as events of kind open, in the columns of events: for a stream of both."""
    own = {"session_id": F.col("session_id"), "ms": F.col("ms"), "kind": F.lit("open"), "event_id": F.lit(-1), "chars": F.lit(0), "ended": F.lit(False)}
    return registry.select(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields))


def speaker_partials(events: DataFrame) -> DataFrame:
    """(session_id, event_id, partial, n_open) at each event (kind, speaker, text): see folds.speaker_partials."""
    return folds.fold(events, folds.speaker_partials()).select("session_id", "event_id", "partial", "n_open")


def evictions(events: DataFrame, ttl: str) -> DataFrame:
    """(session_id, first_ms, evicted_ms, n_events): a session's state goes when nothing came for the ttl; a later event begins anew."""
    timed = events.withColumn("ts", F.timestamp_millis("ms"))
    runs = timed.groupBy("session_id", F.session_window("ts", ttl).alias("w")).agg(F.count("*").alias("n_events"))
    return runs.select("session_id", F.unix_millis("w.start").alias("first_ms"), F.unix_millis("w.end").alias("evicted_ms"), "n_events")


def late_events(events: DataFrame, delay_ms: int) -> DataFrame:
    """(session_id, event_id, watermark, late): events that come, in order of their id, behind their session's latest time less the delay."""
    seen = Window.partitionBy("session_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    watermark = F.max("ms").over(seen) - delay_ms
    return events.select("session_id", "event_id", watermark.alias("watermark"), F.coalesce(F.col("ms") < watermark, F.lit(False)).alias("late"))
