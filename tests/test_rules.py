"""Rules of the live path against rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import events, folds, frames, turns

EVENT = "event_id long, session_id long, ms long, event_type string, speaker string, kind string, chars long, ended boolean"


def said(spark, *rows):
    """(ms, speaker, kind, chars) of one session in order."""
    return spark.createDataFrame([(i, 1, ms, "x", who, kind, n, False) for i, (ms, who, kind, n) in enumerate(rows)], EVENT)


def listed(df, name):
    return [r[name] for r in df.orderBy("event_id").collect()]


@pytest.mark.parametrize("label", ["面试官", "Interviewer", "面试老师", "HR", "hrbp", "chris", "﻿面试官"])
def test_interviewer_labels(spark, label):
    rows = spark.createDataFrame([(1, f"{label}：你好")], "interview_id long, text string")
    assert [r.role for r in turns.speaker_lines(rows).collect()] == ["interviewer"]


@pytest.mark.parametrize(("label", "role"), [("候选人", "candidate"), ("应聘者", "candidate"), ("求职者", "candidate"), ("面试者", "candidate"), ("Candidate", "candidate"), ("Summary", None), ("Q", None), ("答", None)])
def test_other_labels(spark, label, role):
    rows = spark.createDataFrame([(1, f"{label}: done")], "interview_id long, text string")
    assert [(r.role, r.text) for r in turns.speaker_lines(rows).collect()] == [(role, "done" if role else f"{label}: done")]


def test_a_label_without_words_is_text(spark):
    rows = spark.createDataFrame([(1, "候选人：好\n面试官：\n候选人：行。面试老师 : 继续？")], "interview_id long, text string")
    got = [(r.speaker, r.text) for r in turns.merge_segments(turns.speaker_lines(rows)).orderBy("seg_id").collect()]
    assert got == [("candidate", "好\n面试官：\n行。"), ("interviewer", "继续？")]


def test_a_question_waits_for_its_answer(spark):
    rows = [(1, "interviewer", "a？"), (2, "interviewer", "b？"), (3, "unknown", "(laughs)"), (4, "candidate", "x"), (5, "candidate", "y")]
    df = spark.createDataFrame([(1, *r) for r in rows], "interview_id long, seg_id long, speaker string, text string")
    assert [(r.turn_id, r.question) for r in turns.qa_pairs(df).orderBy("turn_id").collect()] == [(1, "b？"), (2, "")]


def test_refresh(spark):
    rows = said(spark, (0, "candidate", "final", 79), (1, "interviewer", "final", 500), (2, "candidate", "final", 80), (3, "interviewer", "final", 0), (4, "candidate", "final", 1))
    assert listed(events.refresh_triggers(rows), "fired") == [False, True, True, False, True]


def test_fast_trigger(spark):
    rows = said(
        spark,
        (0, "interviewer", "final", 3),  # a segment of anyone
        (500, "candidate", "partial", 30),  # too near
        (1000, "candidate", "partial", 31),  # grew since the last fire
        (2500, "candidate", "partial", 31),  # did not grow
        (2600, "candidate", "partial", 32),
        (9000, "candidate", "partial", 0),  # blank: gone
        (9900, "candidate", "partial", 5),  # less than at the last fire
        (12000, "candidate", "final", 1),
    )
    assert listed(events.fast_triggers(rows), "fired") == [True, False, True, False, True, False, False, True]


def test_single_flight(spark):
    df = spark.createDataFrame([(i, 1, ms, k) for i, (ms, k) in enumerate([(0, "a"), (7999, "b"), (8000, "b"), (8001, "a"), (15999, "c"), (16000, "c")])], "event_id long, session_id long, ms long, request string")
    assert listed(folds.fold(df, folds.single_flight()), "outcome") == ["run", "throttled", "run", "cached", "throttled", "run"]


def test_append(spark):
    df = spark.createDataFrame([(1, 1, 1, 5, False), (2, 1, 2, 0, False), (3, 1, 3, 5, True), (4, 1, 4, 5, False), (5, 2, 1, 1, False)], "event_id long, session_id long, ms long, chars long, ended boolean").withColumn("kind", F.lit("final"))
    got = {(r.event_id, r.seg_id, r.status) for r in folds.fold(df, folds.append()).collect()}
    assert got == {(1, 1, "ok"), (2, None, "blank"), (3, 2, "ok"), (4, None, "not_active"), (5, 1, "ok")}


def test_a_long_session_passes_in_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select(F.col("id").alias("event_id"), F.lit(1).alias("session_id"), F.col("id").alias("ms"), F.lit(100).cast("long").alias("value"))
        assert {r.score for r in folds.fold(df, folds.ema()).collect()} == {100}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_live_scores(spark):
    roles = {"D": ("a", "b"), "I": ("b", "c", "d", "e"), "S": ("f",), "C": ("g",)}
    rows = [(1, 10, 90, 90, 90, 90), (2, 30, 25, 75, 25, 25), (3, 40, 25, 60, 60, 25), (4, 50, 0, 0, 100, 0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "interview_id long, seg_id long, cand_chars long, disc_c long, disc_d long, disc_i long, disc_s long")
    got = folds.fold(df, folds.live(roles), key="interview_id", order=("seg_id",)).orderBy("seg_id").collect()
    assert [(r.status, r.dominant, r.secondary) for r in got] == [("collecting", "", ""), ("ready", "D", "C"), ("ready", "D", "I"), ("ready", "I", "D")]
    # 0.42 * 75 = 31.5 is rounded to even; then 0.58 * 32 + 0.42 * 60 = 43.76
    assert [(r.live_d, r.delta_d) for r in got] == [(0, 0), (32, 32), (44, 12), (26, -18)]
    assert got[1].roles == "a,b,g" and got[2].roles == "a,b,c,d"


FRAME = "stream_id long, frame_id long, ms long, energy double, prob double"


def test_activity(spark):
    on, off, faint = (0.005, 0.61), (0.5, 0.6), (0.0049, 0.9)
    rows = [(0, on), (300, on), (700, on), (701, off), (1101, off), (5000, on), (5100, on), (5600, faint), (9000, on), (9400, on), (9900, on), (10_250, on)]
    df = spark.createDataFrame([(1, i, ms, *v) for i, (ms, v) in enumerate(rows)], FRAME)
    got = [(r.seg, r.start_ms, r.end_ms, r.active, r.reason) for r in frames.activity(df).orderBy("seg").collect()]
    # 5000 to 5100 is 500 ms with its silence; between 9400 and 9900 are more than 400
    assert got == [(1, 0, 1100, 3, "silence_timeout")]
    assert [r.start_ms for r in frames.activity(df, least_ms=500).orderBy("seg").collect()] == [0, 5000, 9000, 9900]


def test_activity_with_one_more_inactive_frame(spark):
    on, off = (0.1, 0.9), (0.1, 0.1)
    rows = [(0, on), (100, on), (200, off), (400, off), (450, on), (500, off), (760, off), (800, off), (1000, off), (2000, on), (2100, off), (2320, off), (2340, off), (3000, on)]
    df = spark.createDataFrame([(1, i, ms, *v) for i, (ms, v) in enumerate(rows)], FRAME)
    got = [(r.start_ms, r.end_ms, r.active) for r in frames.activity_hysteresis(df).orderBy("seg").collect()]
    # at 400 it is quiet for 300 ms, but the next frame is active; 760 is quiet, 800 closes; 2000 is one frame and 320 ms
    assert got == [(0, 760, 3), (2000, 2320, 1)]
    assert [r.start_ms for r in frames.activity_hysteresis(df, least_ms=330).collect()] == [0]


def test_change_points(spark):
    rows = [(0.0, 0.5), (0.31, 0.5), (0.31, 0.5), (0.0, 0.9), (0.05, 0.9), (0.05, 0.9), (0.09, 0.9), (0.4, 0.9)]
    df = spark.createDataFrame([(1, i, i * 32, *v) for i, v in enumerate(rows)], FRAME)
    got = [r.changed for r in frames.change_points(df).orderBy("frame_id").collect()]
    # after energy 0 no change of energy counts; a change has to hold against the frame before the last as well
    assert got == [False, True, False, True, False, False, False, True]
