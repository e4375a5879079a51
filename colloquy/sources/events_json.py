"""JSON from speech services: diarised transcripts, typed provider events, labelled lines with times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SEGMENT = "struct<speaker: string, speaker_label: string, speaker_id: string, text: string, start: double, end: double, start_ms: double, end_ms: double>"
DIARISED = f"segments array<{_SEGMENT}>, speaker_segments array<{_SEGMENT}>, text string"


def diarised_segments(raw: DataFrame) -> DataFrame:
    """(id, at, speaker, text, start_ms, end_ms) from (id, value): the first speaker is speaker_a, all others speaker_b.

    Either array key and any speaker key may be used; times are seconds or milliseconds. A text alone becomes one segment
    of 120 ms for each character, one second at least. Blank segments are dropped.
    """
    rows = raw.select("id", F.from_json("value", DIARISED).alias("j"))
    length = F.length("j.text")
    alone = F.array(
        F.struct(
            F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("speaker_label"),
            F.lit(None).cast("string").alias("speaker_id"), F.col("j.text").alias("text"), F.lit(None).cast("double").alias("start"),
            F.lit(None).cast("double").alias("end"), F.lit(0.0).alias("start_ms"),
            F.greatest(F.lit(1000), 120 * length).cast("double").alias("end_ms"),
        ),
    )
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    rows = rows.select(
        "id", F.posexplode(F.coalesce(filled("j.segments"), filled("j.speaker_segments"), F.when(length > 0, alone))).alias("at", "s"),
    )
    rows = rows.select(
        "id", "at", F.coalesce("s.speaker", "s.speaker_label", "s.speaker_id", F.lit("speaker_a")).alias("name"),
        F.trim("s.text").alias("text"),
        F.round(F.coalesce("s.start_ms", F.col("s.start") * 1000, F.lit(0.0))).cast("long").alias("start_ms"),
        F.round(F.coalesce("s.end_ms", F.col("s.end") * 1000, F.lit(0.0))).cast("long").alias("end_ms"),
    ).where(
        "text <> ''",
    )
    first = F.first("name").over(Window.partitionBy("id").orderBy("at"))
    return rows.select(
        "id", F.col("at").cast("long").alias("at"), F.when(F.col("name") == first, "speaker_a").otherwise("speaker_b").alias("speaker"),
        "text", "start_ms", "end_ms",
    )


PROVIDER = "type string, text string, delta string, transcript string, item struct<text: string>, start_ms bigint, end_ms bigint, start double, end double"


def provider_events(raw: DataFrame) -> DataFrame:
    """(id, kind, text, start_ms, end_ms) from (id, value): typed events of a speech provider; unknown types are `other`."""
    e = raw.select("id", F.from_json("value", PROVIDER).alias("e")).select("id", "e.*")
    low = F.lower(F.coalesce("type", F.lit("")))
    kind = F.when(low.contains("error"), "error").when(low.contains("delta"), "delta").when(low.contains("completed"), "completed").when(
        low.contains("started"), "speech_start",
    ).when(
        low.contains("stopped"), "speech_stop",
    ).otherwise(
        "other",
    )
    return e.select(
        "id", kind.alias("kind"),
        F.coalesce(F.nullif("text", F.lit("")), F.nullif("delta", F.lit("")), F.nullif("transcript", F.lit("")), F.col("item.text")).alias(
            "text",
        ),
        F.coalesce("start_ms", F.round(F.col("start") * 1000).cast("long")).alias("start_ms"),
        F.coalesce("end_ms", F.round(F.col("end") * 1000).cast("long")).alias("end_ms"),
    )


def timed_segments(segments: DataFrame) -> DataFrame:
    """(interview_id, seg_id, speaker, start_ms, end_ms): 120 ms for each character, from 1200 to 4800; each begins where the last ended."""
    size = F.least(F.lit(4800), F.greatest(F.lit(1200), 120 * F.length("text"))).cast("long")
    before = F.sum("size").over(
        Window.partitionBy("interview_id").orderBy("seg_id").rowsBetween(Window.unboundedPreceding, 0),
    ) - F.col("size")
    return segments.withColumn("size", size).withColumn("start_ms", before).select(
        "interview_id", "seg_id", "speaker", "start_ms", (F.col("start_ms") + F.col("size")).alias("end_ms"),
    )


def case_violations(cases: DataFrame) -> DataFrame:
    """(case_id, rule) of labelled cases that break the schema: enums, ten outline turns, a ranking of all four letters."""
    rules = {
        "case_id": F.coalesce(F.col("case_id"), F.lit("")) == "",
        "job_type": ~F.coalesce(F.col("job_type"), F.lit("")).isin("product", "sales", "engineering", "operations"),
        "level": ~F.coalesce(F.col("level"), F.lit("")).isin("junior", "mid", "senior"),
        "case_quality": ~F.coalesce(F.col("case_quality"), F.lit("")).isin("strong", "medium", "weak", "disguised"),
        "outline": F.coalesce(F.size("outline"), F.lit(0)) < 10,
        "ranking": F.coalesce(F.array_join(F.array_sort("ranking"), ""), F.lit("")) != "CDIS",
    }
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    return cases.select("case_id", F.explode(broken).alias("rule"))


FOLLOWUP = "question string, purpose string, target_dimension string, dimension string, defect_id string, label string, priority string"


def followups(raw: DataFrame, priority: str = "medium", purpose: str = "verify") -> DataFrame:
    """raw with (question, dimension, priority, purpose) in place of `value`, a follow-up as a JSON string or object.

    The dimension is the first of four keys that is not blank; an unknown priority becomes the given one. Blank questions,
    and values that are neither, are dropped.
    """
    o = F.from_json("value", FOLLOWUP)
    text = F.when(F.ltrim("value").startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), F.col("value"), F.lit("}")), "$.x"))
    said = lambda *keys: F.coalesce(*(F.nullif(F.trim(o[k]), F.lit("")) for k in keys))
    level = F.lower(said("priority"))
    rows = raw.select(
        *(c for c in raw.columns if c != "value"),
        F.trim(F.coalesce(text, o["question"], F.lit(""))).alias("question"),
        F.coalesce(said("target_dimension", "dimension", "defect_id", "label"), F.lit("")).alias("dimension"),
        F.when(level.isin("high", "medium", "low"), level).otherwise(priority).alias("priority"),
        F.coalesce(said("purpose"), F.lit(purpose)).alias("purpose"),
    )
    return rows.where("question <> ''")


def ranking_match(predicted: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, predicted, expected, top_match, exact, in_place): rankings, as arrays, against those that labelled cases expect."""
    both = predicted.select(key, F.col("ranking").alias("predicted")).join(cases.select(key, F.col("ranking").alias("expected")), key)
    same = F.aggregate(
        F.zip_with("predicted", "expected", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)),
    )
    return both.select(
        key, "predicted", "expected", (F.get("predicted", F.lit(0)) == F.get("expected", F.lit(0))).alias("top_match"),
        (F.col("predicted") == F.col("expected")).alias("exact"), same.cast("long").alias("in_place"),
    )
