"""Unit rows: thresholds from both sides, ties, empty inputs, odd labels."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import expressions as X
from colloquy.operators import events, reports, scoring, speakers, turns
from colloquy.plans import lexicon as L
from colloquy.plans import rows as R
from colloquy.plans.layers import all_layers, apply
from colloquy.sources import events_json, tables


def transcripts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "interview_id long, text string")


def segments_of(spark, *texts):
    return [tuple(r) for r in turns.merge_segments(turns.speaker_lines(transcripts(spark, *texts))).orderBy("interview_id", "seg_id").collect()]


def test_both_forms_of_a_transcript(spark):
    many = "﻿面试官：介绍一下项目背景？\r\n候选人：当时时间紧。\n我负责数据。\n面试官：结果？\n候选人：提升了30%。"
    one = "面试官：介绍一下项目背景？候选人：当时时间紧。候选人：我负责数据。面试官：结果？候选人：提升了30%。"
    want = [(1, "interviewer", "介绍一下项目背景？"), (2, "candidate", "当时时间紧。\n我负责数据。"), (3, "interviewer", "结果？"), (4, "candidate", "提升了30%。")]
    got = segments_of(spark, many, one)
    assert [r[1:] for r in got if r[0] == 1] == want and [r[1:] for r in got if r[0] == 2] == want


def test_labels(spark):
    got = segments_of(spark, "no label\nchris：hello\nCandidate: hi\n\n  \nmore", "", None)
    assert got == [(1, 1, "unknown", "no label"), (1, 2, "interviewer", "hello"), (1, 3, "candidate", "hi\nmore")]


def test_pairs_keep_their_ids(spark):
    rows = [(1, 1, "interviewer", "任务？"), (1, 2, "candidate", " "), (1, 3, "interviewer", "结果？"), (1, 4, "candidate", "好"), (1, 5, "candidate", "又"), (2, 1, "candidate", "x" * 90)]
    got = turns.qa_pairs(spark.createDataFrame(rows, "interview_id long, seg_id long, speaker string, text string")).orderBy("interview_id", "turn_id").collect()
    assert [(r.interview_id, r.turn_id, r.question, r.question_type) for r in got] == [(1, 2, "结果？", "result"), (1, 3, "", "unlabelled"), (2, 1, "", "unlabelled")]
    assert got[2].answer_summary == "x" * 80 + "..." and got[2].answer_length == 90


def scored(spark, rows, words=None):
    return apply(turns.interviews(spark.createDataFrame(rows, "interview_id long, seg_id long, speaker string, text string")), all_layers(words))


def test_an_interview_without_answers_has_a_row(spark):
    row = scored(spark, [(1, 1, "interviewer", "问题？"), (2, 1, "candidate", "我拍板了。我拍板了。")]).orderBy("interview_id").collect()
    assert (row[0].text_length, row[0].n_turns, row[0].n_action, row[0].sent, row[0].avg_sentence) == (1, 0, 0, 0, 0.0)
    assert (row[1].n_action, row[1].sent, row[1].avg_sentence, row[1].n_singular) == (2, 2, 4.0, 2)
    assert row[0].sample_quality == "low"


@pytest.mark.parametrize(("text", "word", "n"), [("aaaa", "aa", 2), ("提升了提升", "提升", 2), ("", "x", 0), ("it''s", "'", 2)])
def test_hits_do_not_overlap(spark, text, word, n):
    assert spark.createDataFrame([(text,)], "t string").selectExpr(f"{X.hits('t', [word])} as n").first().n == n == text.count(word)


def test_ratio_and_clamp(spark):
    got = spark.sql(f"select {X.ratio('1', '3')} a, {X.ratio('1', '0')} b, {X.ratio('1', '20000')} c, {X.clamp('130')} d, {X.clamp('-4')} e").first()
    assert tuple(got) == (0.3333, 0.0, 0.0001, 100, 0)


@pytest.mark.parametrize("condition", ["a >= 0.02", "a < 0.005", "b = 'x'"])
def test_tolerance(condition):
    assert X.tolerant(condition) == {"a >= 0.02": "a >= 0.019", "a < 0.005": "a < 0.00525", "b = 'x'": "b = 'x'"}[condition]


@pytest.mark.parametrize(("rule", "at", "holds"), [("action_ratio >= 0.02", "0.0199", False), ("action_ratio >= 0.02", "0.02", True), ("hedge_ratio <= 0.006", "0.006", True), ("hedge_ratio <= 0.006", "0.0061", False)])
def test_thresholds(spark, rule, at, holds):
    name = rule.split()[0]
    assert spark.sql(f"select cast({at} as double) as {name}").where(rule).count() == holds


def test_tables_are_complete():
    assert sum(map(len, L.ENNEAGRAM.values())) == 71 and len(L.BIGFIVE_TO_TYPE) == 12 and len(L.PATTERNS) == 8
    assert set(R.PROBES) == {c for c, _, _ in R.STAR_DEFECTS}


def test_ranking_ties_keep_the_declared_order(spark):
    df = spark.createDataFrame([(1, 50, 70, 70, 50)], "interview_id long, a long, b long, c long, d long")
    got = scoring.ranked(df, "m", list("DISC"), list("abcd")).orderBy("rank").collect()
    assert [r.dim for r in got] == ["I", "S", "D", "C"]


def test_a_question_is_asked_once(spark):
    df = spark.createDataFrame([(1, "medium", "high", None, "low", None, None)], "interview_id long, " + ", ".join(f"defect_{k} string" for k in R.PROBES))
    got = [(r.defect, r.question) for r in scoring.probes(df).orderBy("place").collect()]
    assert got[:2] == [("team_substitution", "ask_own_part"), ("team_substitution", "ask_decision")] and len({q for _, q in got}) == len(got) == 5


def test_rows_where_caps_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, 5, None)], "interview_id long, x long, y long")
    rules = [("a", "'1'", "x > 1"), ("b", "'2'", "y > 1"), ("c", "'3'", "x > 2"), ("d", "'4'", "x > 3")]
    assert [r.code for r in scoring.rows_where(df, rules, 2).collect()] == ["a", "c"]


def test_diarised_json(spark):
    raw = spark.createDataFrame(
        [(1, '{"segments":[{"speaker":"S1","text":"你好","start":0.5,"end":2.0},{"speaker":"S2","text":"我好","start":2.1,"end":4.1},{"speaker":"S3","text":" "}]}'), (2, '{"text":"只有文字"}'), (3, '{"speaker_segments":[{"speaker_label":"x","text":"a","start_ms":5,"end_ms":7}]}'), (4, "broken")],
        "id long, value string",
    )
    got = [tuple(r) for r in events_json.diarised_segments(raw).orderBy("id", "at").collect()]
    assert got == [(1, 0, "speaker_a", "你好", 500, 2000), (1, 1, "speaker_b", "我好", 2100, 4100), (2, 0, "speaker_a", "只有文字", 0, 1000), (3, 0, "speaker_a", "a", 5, 7)]


def test_segment_events_fill_and_reject(spark):
    raw = spark.createDataFrame([('{"session_id":"a","text":"hi"}',), ('{"session_id":"a","text":"  "}',), ("no json",)], "value string")
    good, bad = tables.segment_events(raw)
    row = good.first()
    assert (row.speaker_id, row.start_ms, row.final, row.interviewer_sim) == ("speaker_a", 0, True, 0.0) and bad.count() == 2


def test_files_and_manifests(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("﻿面试官：好？\n候选人：好。", encoding="utf-8")
    (tmp_path / "m.json").write_text('[{"id":"1","title":"A","job_hint":"sales","filename":"a.txt","description":""}]')
    got = tables.with_job_hints(tables.transcript_files(spark, str(tmp_path / "t")), tables.manifests(spark, str(tmp_path / "m.json"))).first()
    assert got.job_hint == "sales" and got.text.startswith("面试官")


def test_speakers(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 2, [0.0, 1.0])], "vec_id long, speaker_id int, embedding array<double>")
    profiles = speakers.enrol(df)
    assert {(r.speaker_id, r.status) for r in profiles.collect()} == {(1, "enrolled"), (2, "too_few")}
    got = {r.vec_id: (r.speaker_id, r.similarity) for r in speakers.match(df, profiles).collect()}
    assert got == {1: (1, 1.0), 2: (1, 1.0), 3: (1, 0.5)}
    new = df.where("vec_id = 1").select(speakers.update_profile(F.col("embedding"), F.array(F.array(F.lit(0.0), F.lit(1.0)))).alias("p")).first().p
    assert [round(x, 4) for x in new] == [0.9701, 0.2425]


def test_the_nearest_profile_is_the_same_for_any_number_of_packs(spark):
    rng = np.random.default_rng(3)
    known = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(40)]
    known += [(40, known[7][1]), (41, [2 * x for x in known[7][1]]), (42, None), (43, [1.0, 2.0])]
    asked = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(50)] + [(50, known[7][1]), (51, [0.0] * 6), (52, None), (53, []), (54, [1.0, 2.0, 3.0]), (55, [2.0, 4.0])]
    profiles = spark.createDataFrame(known, "speaker_id int, embedding array<double>")
    vectors = spark.createDataFrame(asked, "vec_id long, embedding array<double>").repartition(3)
    want = {}
    for i, v in asked:
        near = []
        for j, p in known:
            if v and p and len(p) == len(v):
                size = max(math.hypot(*v), 1e-8) * max(math.hypot(*p), 1e-8)
                near.append((-round((sum(x * y for x, y in zip(v, p, strict=True)) / size + 1) / 2, 6), j))
        least = min(near, default=(None, None))
        want[i] = (least[1], None if least[0] is None else -least[0])
    assert want[50] == (7, 1.0) and want[55] == (43, 1.0) and want[51] == (0, 0.5) and want[52] == want[53] == want[54] == (None, None)
    for most in (1 << 20, 700):
        got = speakers.match(vectors, profiles, most)
        assert got.dtypes == [("vec_id", "bigint"), ("speaker_id", "int"), ("similarity", "double")]
        assert {r.vec_id: (r.speaker_id, r.similarity) for r in got.collect()} == want
    assert speakers.match(vectors, profiles.where("false")).collect() == []


def test_merged_results_keep_local_values(spark):
    local = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, x string")
    remote = spark.createDataFrame([(1, "z"), (2, " ")], "id long, x string")
    assert {tuple(r) for r in reports.merge_results(local, remote, "id", ["x"]).collect()} == {(1, "z"), (2, "b"), (3, "c")}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=12))
def test_smoothing_rounds_half_to_even(spark, values):
    df = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(values)], "session_id long, ms long, event_id long, chars long")
    got = [r.score for r in events.ema_scores(df).orderBy("event_id").collect()]
    want = []
    for v in values:
        want.append(v % 101 if not want else round((58 * want[-1] + 42 * (v % 101)) / 100))
    assert got == want


def test_counts_add_up_over_segments(spark):
    words = L.WORDS["action"]
    parts = ["推进落地", "我拍板", "完成"]
    whole = "\n".join(parts)
    assert sum(sum(p.count(w) for w in words) for p in parts) == sum(whole.count(w) for w in words)


def test_rolling_ends_where_the_whole_is(spark):
    from colloquy.operators import rolling

    rows = [(1, 1, "interviewer", "任务是什么？"), (1, 2, "candidate", "当时我负责数据，提升了30%。"), (1, 3, "interviewer", "结果？"), (1, 4, "candidate", "首先推进。大家满意！"), (2, 1, "candidate", "我拍板。")]
    df = spark.createDataFrame(rows, "interview_id long, seg_id long, speaker string, text string")
    whole = {r.interview_id: r.asDict() for r in apply(turns.interviews(df), all_layers(L.WORDS)).collect()}
    last = {r.interview_id: r.asDict() for r in rolling.rolling(df, L.WORDS).orderBy("seg_id").collect()}
    for i, row in last.items():
        same = set(row) & set(whole[i]) - {"seg_id"}
        assert len(same) > 200 and {c: row[c] for c in same} == {c: whole[i][c] for c in same}


def test_auto_enrolment(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 2, [0.8, 0.6]), (1, 3, [-1.0, 0.0]), (1, 4, [0.0, 1.0]), (2, 1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "session_id long, vec_id long, embedding array<double>")
    got = {r.session_id: r for r in speakers.auto_enrol(df).collect()}
    assert [round(x, 4) for x in got[1].interviewer] == [0.9923, 0.124] and got[1].candidate == [-1.0, 0.0] and got[1].used == 3
    assert got[2].candidate is None
    roles = {(r.session_id, r.vec_id): r.role for r in speakers.retro_roles(df, speakers.auto_enrol(df)).collect()}
    assert roles == {(1, 1): "interviewer", (1, 2): "interviewer", (1, 3): "candidate", (1, 4): "interviewer", (2, 1): "interviewer"}
