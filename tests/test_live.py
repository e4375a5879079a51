"""The live path: streams against their batch twins and against rules worked out in plain Python, for several cuts of the stream."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_streaming import LONG, few, run, streamed

from colloquy.operators import events as E
from colloquy.operators import folds, frames
from colloquy.operators import rolling as R
from colloquy.operators import turns as T
from colloquy.plans import lexicon as L
from colloquy.plans import rows as rules
from colloquy.plans.layers import analyse
from colloquy.plans.views import zh_turns
from colloquy.streaming import live
from colloquy.streaming import sessions as S
from colloquy.streaming import sinks


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    for k, v in S.CONF.items():
        spark.conf.set(k, v)
    yield


def talks(spark, n=5):
    """Segments of n conversations as events, shuffled against each other by time; some end before their last segment."""
    rows = zh_turns(spark, "/root/testdata/sf0.001").where(f"interview_id < {n}")
    return rows.selectExpr("interview_id as session_id", "seg_id as event_id", "seg_id * 1000 + interview_id * 137 + 1000 as ms", "speaker", "text", "interview_id % 3 > 0 and seg_id = 1 + interview_id % 2 as ended")


def as_interviews(rows):
    return rows.selectExpr("session_id as interview_id", "event_id as seg_id", "speaker", "text", "ended")


def same(got, want):
    """Rows of the stream, by session and event, against rows of the twin, in the columns of both."""
    assert got and set(got) == set(want)
    for k, row in want.items():
        both = set(row) & set(got[k]) - {"interview_id", "seg_id", "session_id", "event_id", "ms"}
        assert len(both) > 5 and {c: got[k][c] for c in both} == {c: row[c] for c in both}


@pytest.mark.parametrize("parts", [1, 4])
def test_rolling_analysis_at_its_trigger(spark, tmp_path, parts):
    rows = talks(spark).drop("ended")
    out = run(live.rolling_analysis(streamed(spark, rows, str(tmp_path / "in"), ["ms"], parts), L.WORDS, **LONG), f"due_{parts}")
    twin = R.refreshed(R.rolling(as_interviews(rows.withColumn("ended", F.lit(False))).drop("ended"), L.WORDS))
    same({(r.session_id, r.event_id): r.asDict() for r in out.collect()}, {(r.interview_id, r.seg_id): r.asDict() for r in twin.collect()})


@pytest.mark.parametrize("parts", [1, 5])
def test_live_scores(spark, tmp_path, parts):
    rows = talks(spark).drop("ended")
    out = run(live.live_scores(streamed(spark, rows, str(tmp_path / "in"), ["ms"], parts), L.WORDS, rules.STYLE_ROLES, **LONG), f"live_{parts}")
    twin = R.live_disc(R.rolling(as_interviews(rows.withColumn("ended", F.lit(False))).drop("ended"), L.WORDS), rules.STYLE_ROLES)
    same({(r.session_id, r.event_id): r.asDict() for r in out.collect()}, {(r.interview_id, r.seg_id): r.asDict() for r in twin.collect()})


@pytest.mark.parametrize("parts", [1, 4])
def test_one_report_for_each_ended_session(spark, tmp_path, parts):
    rows = talks(spark, 7)
    twin = {r.interview_id: r.asDict() for r in R.final_reports(as_interviews(rows), L.WORDS).collect()}
    ended = live.final_reports(streamed(spark, rows, str(tmp_path / "in"), ["ms"], parts), L.WORDS, **LONG)
    got = run(ended, f"final_{parts}").collect()
    assert len(got) == len(twin) > 1
    same({r.session_id: r.asDict() for r in got}, twin)


def test_the_analysis_of_completed_sessions_is_written_once(spark, tmp_path):
    rows = talks(spark, 7).cache()
    rows.write.parquet(str(tmp_path / "all"))
    final = lambda df: analyse(T.interviews(df.selectExpr("session_id as interview_id", "event_id as seg_id", "speaker", "text")), L.WORDS).select("interview_id", "disc_d", "n_turns", "star_overall")
    hook = live.analyses_of_completed(lambda s: s.read.parquet(str(tmp_path / "all")), final, str(tmp_path / "out"))
    ended = live.final_reports(streamed(spark, rows, str(tmp_path / "in"), ["ms"], 3), L.WORDS, **LONG).select("session_id", "event_id", "ms")

    def twice(batch, number):  # as after a failure
        hook(batch, number)
        hook(batch, number)

    sinks.hooked(ended, twice, str(tmp_path / "ckpt")).awaitTermination()
    got = {(r.interview_id, r.disc_d, r.n_turns, r.star_overall) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.interview_id, r.disc_d, r.n_turns, r.star_overall) for r in R.final_reports(as_interviews(rows), L.WORDS).collect()}
    assert got == want and spark.read.parquet(str(tmp_path / "out")).count() == len(want)


def test_many_keys_of_one_session(spark):
    def seconds(n):
        rule = folds.single_flight(0)
        state, table = rule.start, {}
        began = time.perf_counter()
        for i in range(n):
            state, (said,) = rule.step(state, table, i, f"request {i}\nmore")
            assert said == "run"
        assert rule.step(state, table, n, "request 5\nmore")[1] == ("cached",)
        return time.perf_counter() - began

    assert seconds(100_000) < 40 * seconds(10_000) + 0.5


def test_old_keys_are_forgotten():
    rule = folds.single_flight(0, 1000)
    state, table = rule.start, {}
    for i in range(50_000):
        state, (said,) = rule.step(state, table, 100 * i, f"k{i}")
        assert said == "run" and len(table) <= 64
    assert rule.step(state, table, 50_000 * 100, "k49995")[1] == ("cached",) and rule.step(state, table, 50_000 * 100, "k100")[1] == ("run",)


def test_unknown_sessions_on_stream_and_batch(spark, sf_dir, tmp_path):
    rows = few(spark, sf_dir)
    registry = rows.where("session_id % 3 > 0").groupBy("session_id").agg((F.min("ms") - 1).alias("ms"))
    want = {tuple(r) for r in E.appended(rows, registry).collect()}
    opened = E.registrations(registry, rows)
    stream = streamed(spark, opened.unionByName(rows.where("kind = 'final'")), str(tmp_path / "in"), ["ms", "event_id"])
    got = {tuple(r) for r in run(S.followed(stream, folds.append(registered=True), **LONG), "unknown").where("status <> 'open'").collect()}
    assert got == want and {s for *_, s in want} == {"unknown", "ok", "not_active"} | ({"blank"} if any(s == "blank" for *_, s in want) else set())


def test_append_by_windows_is_the_fold(spark, sf_dir):
    rows = E.session_events(spark, sf_dir).withColumn("chars", F.when(F.col("event_id") % 4 > 0, F.col("chars")).otherwise(0))
    want = folds.fold(rows.where("kind = 'final'"), folds.append()).select("session_id", "event_id", "seg_id", "status")
    assert sorted(map(tuple, E.appended(rows).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_partial_texts_of_all_speakers():
    rnd = random.Random(4)
    rule, state, table, parts = folds.speaker_partials(), (0,), {}, {}
    for _ in range(3000):
        kind, speaker, text = rnd.choice(["partial", "final"]), rnd.choice("abcd"), rnd.choice([None, "", "  ", "x", "yes", "no"])
        state, said = rule.step(state, table, kind, speaker, text)
        if kind == "partial" and text and text.strip():
            parts[speaker] = text
        else:
            parts.pop(speaker, None)
        assert said == (parts.get(speaker), len(parts)) and table == parts


def noise(spark, n=400):
    rnd = random.Random(8)
    rows, at = [], [0, 0, 0]
    for i in range(n):
        s = rnd.randrange(3)
        at[s] += rnd.choice([20, 40, 200, 400])
        rows.append((s, i, 1000 + at[s], rnd.random() / 50, rnd.choice([0.1, 0.2, 0.9, 0.9]), rnd.random()))
    return spark.createDataFrame(rows, "stream_id long, frame_id long, ms long, energy double, prob double, pitch double")


@pytest.mark.parametrize("parts", [1, 6])
def test_change_points_on_a_stream(spark, tmp_path, parts):
    rows = noise(spark)
    want = {(r.stream_id, r.frame_id): r.changed for r in frames.change_points(rows, ("energy", "prob", "pitch")).collect()}
    events = rows.selectExpr("stream_id as session_id", "frame_id as event_id", "ms", "array(energy, prob, pitch) as features")
    got = run(S.followed(streamed(spark, events, str(tmp_path / "in"), ["ms", "event_id"], parts), folds.change(), **LONG), f"change_{parts}").collect()
    assert {(r.session_id, r.event_id): r.changed for r in got} == want and len(set(want.values())) == 2


@pytest.mark.parametrize("parts", [1, 6])
def test_hysteresis_on_a_stream(spark, tmp_path, parts):
    rows = noise(spark)
    want = {tuple(r) for r in frames.activity_hysteresis(rows).select("stream_id", "seg", "start_ms", "end_ms", "active").collect()}
    events = rows.selectExpr("stream_id as session_id", "frame_id as event_id", "ms", "prob")
    got = run(S.followed(streamed(spark, events, str(tmp_path / "in"), ["ms", "event_id"], parts), folds.hysteresis(), ("session_id",), **LONG), f"hyst_{parts}")
    assert {tuple(r) for r in got.where("seg is not null").collect()} == want and len(want) > 5


def test_a_table_of_the_latest_rows(spark, tmp_path):
    rnd = random.Random(2)
    hook, want = sinks.keep_latest(str(tmp_path / "t"), "k", ["at"], buckets=8), {}
    for number in range(6):
        rows = [(f"k{rnd.randrange(30)}", rnd.randrange(1000), number) for _ in range(25)] if number != 3 else []
        batch = spark.createDataFrame(rows, "k string, at long, v int")
        hook(batch, number)
        if number % 2:
            hook(batch, number)  # comes again
        for k, at, v in sorted(rows):
            if k not in want or at >= want[k][0]:
                want[k] = (at, v)
    got = sinks.latest_of(spark, str(tmp_path / "t")).collect()
    assert len(got) == len(want) and {r.k: r.at for r in got} == {k: at for k, (at, _) in want.items()}
    files = list((tmp_path / "t" / "rows").glob("bucket=*/*.parquet"))
    assert len(files) == len({f.parent for f in files}) <= 8  # history is not kept


def test_a_batch_that_failed_between_its_steps(spark, tmp_path):
    path = str(tmp_path / "t")
    hook = sinks.keep_latest(path, "k", ["at"], buckets=2)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, at long")
    hook(rows(("a", 1), ("b", 1), ("c", 1)), 0)
    hook(rows(("a", 2)), 1)
    for f in (tmp_path / "t" / "rows").glob("bucket=*"):  # as if the second step had deleted, and not yet moved
        if f.name in {d.name for d in (tmp_path / "t" / "rows").glob("bucket=*")} and spark.read.parquet(str(f)).where("k = 'a'").count():
            f.rename(tmp_path / f"lost-{f.name}")
    hook(rows(("a", 2)), 1)
    assert {(r.k, r.at) for r in sinks.latest_of(spark, path).collect()} == {("a", 2), ("b", 1), ("c", 1)}


def test_latest_rows_of_an_aggregate_in_update_mode(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, 1000 + i, i) for i in range(30)], "event_id long, session_id long, ms long, value long")
    sums = streamed(spark, rows, str(tmp_path / "in"), ["ms"], 5).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    sinks.hooked(sums, sinks.keep_latest(str(tmp_path / "out"), "session_id", ["n"], 4), str(tmp_path / "ckpt"), mode="update").awaitTermination()
    assert {(r.session_id, r.n, r.v) for r in sinks.latest_of(spark, str(tmp_path / "out")).collect()} == {(k, 10, sum(range(k, 30, 3))) for k in range(3)}


def test_rejected_events_keep_their_text_and_reason_over_a_restart(spark, tmp_path):
    good = [f'{{"session_id": "s{i}", "text": "hello {i}"}}' for i in range(6)]
    bad = {'{"session_id": "s1", "te': "malformed", "not json": "malformed", '{"text": "x"}': "no_session", '{"session_id": " ", "text": ""}': "no_session", '{"session_id": "s1", "text": "  "}': "blank", '{"session_id": "s1"}': "blank"}
    lines = [*good, *bad]
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines[i * 3 : i * 3 + 3]) + "\n")
    out, ckpt, seen = str(tmp_path / "out"), str(tmp_path / "ckpt"), []

    def failing(rows, number):
        seen.append(number)
        sinks.segments_and_rejects(out)(rows, number)
        if number == 2:
            raise RuntimeError("lost")

    stream = lambda: sinks.raw_events(spark, str(tmp_path / "in"), 1)
    with pytest.raises(Exception, match="lost"):
        sinks.hooked(stream(), failing, ckpt).awaitTermination()
    sinks.hooked(stream(), sinks.segments_and_rejects(out), ckpt).awaitTermination()
    assert max(seen) == 2
    accepted = spark.read.parquet(f"{out}/accepted").collect()
    assert sorted(r.text for r in accepted) == [f"hello {i}" for i in range(6)] and {r.speaker_id for r in accepted} == {"speaker_a"}
    assert sorted((r.value, r.reason) for r in spark.read.parquet(f"{out}/rejected").collect()) == sorted(bad.items())
