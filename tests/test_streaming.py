"""Each stream gives what its batch twin gives, over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import events as E
from colloquy.operators import folds, speakers
from colloquy.operators import rolling as R
from colloquy.plans import lexicon as L
from colloquy.plans.views import zh_turns
from colloquy.streaming import rolling as live
from colloquy.streaming import sessions as S
from colloquy.streaming import sinks

LONG = {"delay": "400 days", "ttl_ms": 10**12}


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    for k, v in S.CONF.items():
        spark.conf.set(k, v)
    yield


def streamed(spark, df, folder, order, parts=3):
    """df as a stream of some files in the given order."""
    rows = df.toPandas().sort_values(order)
    size = max(1, -(-len(rows) // parts))
    for i in range(parts):
        part = rows.iloc[i * size : (i + 1) * size]
        if len(part):
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def few(spark, sf_dir):
    return E.scaled(E.session_events(spark, sf_dir).where("session_id < 8"), 3600)


RULES = {
    "refresh": (folds.refresh(), "kind = 'final'", {}),
    "fast": (folds.fast(), "true", {}),
    "throttle": (folds.throttle(), "true", {"signature": "event_type"}),
    "single": (folds.single_flight(), "true", {"request": "event_type"}),
    "ema": (folds.ema(), "true", {"value": "chars % 101"}),
    "append": (folds.append(), "kind = 'final'", {}),
    "partials": (folds.partials(), "true", {}),
    "registered": (folds.append(registered=True), "kind = 'final'", {"kind": "case when event_id % 9 = 0 and session_id % 3 > 0 then 'open' else 'final' end"}),
    "single_ttl": (folds.single_flight(1000, 20_000), "true", {"request": "concat(event_type, '\n', chars div 50)"}),
    "speakers": (folds.speaker_partials(), "true", {"kind": "case when event_id % 3 > 0 then 'partial' else 'final' end", "speaker": "event_type", "text": "case when chars % 5 = 0 then ' ' when chars % 7 > 0 then concat('t', chars) end"}),
    "both": (folds.both(folds.refresh(), folds.until_end()), "true", {}),
}


@pytest.mark.parametrize("name", RULES)
def test_rules_on_a_stream(spark, sf_dir, tmp_path, name):
    rule, where, more = RULES[name]
    rows = few(spark, sf_dir).where(where).withColumns({k: F.expr(v) for k, v in more.items()}) if more else few(spark, sf_dir).where(where)
    got = {tuple(r) for r in run(S.followed(streamed(spark, rows, str(tmp_path / "in"), ["ms", "event_id"]), rule, **LONG), f"rule_{name}").collect()}
    want = {tuple(r) for r in folds.fold(rows, rule).select("session_id", "event_id", *rule.names()).collect()}
    assert got == want and len(got) == rows.count()


def test_enrolment_and_corrections(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id % 25 as session_id", "vec_id as event_id", "vec_id + 1000 as ms", "embedding").where("session_id < 6 and event_id < 200")
    got = run(S.enrolled_roles(streamed(spark, rows, str(tmp_path / "in"), ["ms"]), **LONG), "enrolled").collect()
    vectors = rows.withColumnRenamed("event_id", "vec_id")
    want = {(r.session_id, r.vec_id): r.role for r in speakers.retro_roles(vectors, speakers.auto_enrol(vectors)).collect()}
    assert {(r.session_id, r.event_id): r.role for r in got} == want and any(r.corrected for r in got)


def test_silent_sessions_lose_their_state(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 1000, 50), (2, 1, 5_000, 50), (3, 2, 10**9, 1), (4, 2, 10**9 + 10**8, 1), (5, 1, 2 * 10**9, 50)], "event_id long, session_id long, ms long, value long")
    got = {r.event_id: r.score for r in run(S.followed(streamed(spark, rows, str(tmp_path / "in"), ["ms"], 5), folds.ema(), delay="1 second", ttl_ms=1000_000), "ttl").collect()}
    assert got == {1: 50, 2: 50, 3: 1, 4: 1, 5: 50}


def test_rolling_stream(spark, sf_dir, tmp_path):
    rows = zh_turns(spark, sf_dir).where("interview_id < 4").selectExpr("interview_id as session_id", "seg_id as event_id", "seg_id * 1000 + 1000 as ms", "speaker", "text")
    got = {(r.session_id, r.event_id): r.asDict() for r in run(live.rolling(streamed(spark, rows, str(tmp_path / "in"), ["ms"], 2), L.WORDS, **LONG), "rolling").collect()}
    twin = R.rolling(rows.selectExpr("session_id as interview_id", "event_id as seg_id", "speaker", "text"), L.WORDS)
    want = {(r.interview_id, r.seg_id): r.asDict() for r in twin.collect()}
    assert set(got) == set(want)
    for k, row in want.items():
        same = set(row) - {"interview_id", "seg_id"}
        assert {c: got[k][c] for c in same} == {c: row[c] for c in same}


def test_hooks_and_latest_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, i * 1000, i * 10) for i in range(12)], "event_id long, session_id long, ms long, value long")
    stream = S.followed(streamed(spark, rows, str(tmp_path / "in"), ["ms"]), folds.ema(), ("session_id", "event_id"), **LONG)
    sinks.hooked(stream, sinks.upserts(str(tmp_path / "out")), str(tmp_path / "ckpt")).awaitTermination()
    got = {r.session_id: r.event_id for r in sinks.latest(spark, str(tmp_path / "out"), "session_id", ["event_id"]).collect()}
    assert got == {0: 9, 1: 10, 2: 11}


def test_repeats_and_late_rows(spark, sf_dir, tmp_path):
    rows = few(spark, sf_dir).withColumn("ts", F.timestamp_millis("ms"))
    stream = streamed(spark, rows, str(tmp_path / "in"), ["ms"], 1)
    assert run(S.once(stream.unionByName(stream)), "once").count() == rows.count()
    rows = spark.createDataFrame([(1, 1000), (2, 9000)], "id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    fresh, late = S.late_rows(rows, 5000)
    assert [r.id for r in fresh.collect()] == [2] and [r.id for r in late.collect()] == [1]


def test_activity_windows(spark, tmp_path):
    start = 1_700_000_000_000
    ms = [start + m for m in (0, 300, 600, 900, 1200, 5000, 5100)]
    rows = spark.createDataFrame([(1, m) for m in ms] + [(1, start + 10**7)], "stream_id long, ms long").select("stream_id", F.timestamp_millis("ms").alias("ts"), F.lit(0.1).alias("energy"), F.lit(0.9).alias("prob"))
    got = run(S.activity(streamed(spark, rows, str(tmp_path / "f"), ["ts"], 2)), "activity").collect()
    assert [(r.frames, round((r.end - r.start).total_seconds(), 1)) for r in got] == [(5, 1.6)]
