"""Registered queries over events and embeddings.

Windows are one SQL text for both engines, as they are plain SQL; rules that follow a session event by event run as
folds here and as recursive walks in the other SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from colloquy.functions.expressions import ansi
from colloquy.operators import events as E
from colloquy.operators import frames
from colloquy.operators import speakers as V
from colloquy.plans.catalog import add

EV = """ev as (
    select event_id, user_id as session_id, epoch_us(ts) // 1000 as ms, event_type,
           case when event_type in ('click', 'view') then 'interviewer' when event_type in ('purchase', 'signup', 'error') then 'candidate' else 'unknown' end as speaker,
           case when event_type = 'error' then 'partial' else 'final' end as kind,
           floor(coalesce(value, 0))::bigint as chars, event_type = 'signup' and event_id % 4 = 0 as ended,
           coalesce(value, 0) / 1000 as energy, (event_id % 10) / 10 as prob
    from events
)"""


def both(name: str, sql: str) -> None:
    """sql reads the view ev."""
    other = f"with {EV}, {ansi(sql.strip())[5:]}" if sql.strip().startswith("with ") else f"with {EV}\n{ansi(sql)}"
    add(name, lambda spark, d: spark.sql(re.sub(r"\b(from|join) ev\b", r"\1 {ev}", sql.strip()), ev=E.session_events(spark, d)), other)


BY = "partition by session_id order by ms, event_id"
SOFAR = f"({BY} rows between unbounded preceding and current row)"
both("score_deltas", f"""
    select session_id, event_id, chars % 101 as score, coalesce(chars % 101 - lag(chars % 101) over ({BY}), 0) as delta
    from ev where kind = 'final'""")
both("partial_upsert", """
    with last as (select *, row_number() over (partition by session_id, speaker order by ms desc, event_id desc) as back from ev )
    select session_id, speaker, event_id, chars from last where back = 1 and kind = 'partial' and chars > 0""")
both("session_finalize", f"""
    with o as (select *, min(case when ended then struct(ms, event_id) end) over (partition by session_id) as closed from ev ),
    inside as (select * from o where closed is null or struct(ms, event_id) <= closed)
    select session_id, count(*) as n_events, cast(sum(case when speaker = 'candidate' and kind = 'final' then chars else 0 end) as bigint) as chars,
           case when max(closed) is null then 'active' else 'completed' end as status,
           cast(max(case when ended then chars % 101 end) as bigint) as final_score
    from inside group by session_id""")
both("speaker_first_seen", """
    with f as (select session_id, speaker, min(struct(ms, event_id)) as seen from ev group by session_id, speaker),
    g as (select *, min(seen) over (partition by session_id) as lead from f)
    select session_id, speaker, case when seen = lead then 'speaker_a' else 'speaker_b' end as label from g""")
#: Voices of a session: the speakers by first appearance are its interviewer and candidate, but for sessions with an odd id.
both("role_lookup", """
    with f as (select session_id, event_type, min(struct(ms, event_id)) as seen from ev group by session_id, event_type),
    g as (select *, row_number() over (partition by session_id order by seen) as place from f),
    voices as (select session_id, event_type, case when (place + session_id) % 2 = 1 then 'interviewer' else 'candidate' end as voice from g where place <= 2),
    said as (select session_id, event_id, event_type, case when event_id % 3 = 0 then speaker end as recognized from ev )
    select s.session_id, s.event_id, coalesce(s.recognized, v.voice, s.event_type) as role
    from said s left join voices v on v.session_id = s.session_id and v.event_type = s.event_type""")
both("new_segments", """
    with shown as (select event_id from ev where event_id % 3 = 0), e as (select * from ev )
    select e.session_id, e.event_id, e.speaker from e left join shown s on e.event_id = s.event_id where s.event_id is null""")
both("alternating_roles", f"""
    with a as (select *, case event_type when 'view' then 1 when 'purchase' then -1 end as known, row_number() over ({BY}) as rn from ev ),
    b as (select *, max(case when known is not null then rn end) over {SOFAR} as last from a),
    c as (select b.session_id, b.event_id, coalesce(k.known, -1) as base, b.rn - coalesce(b.last, 0) as past from b left join a k on k.session_id = b.session_id and k.rn = b.last)
    select session_id, event_id, case when base * (case when past % 2 = 0 then 1 else -1 end) = 1 then 'interviewer' else 'candidate' end as role from c""")
both("role_mean_similarity", """
    with s as (select session_id, speaker, case when energy > 0 then cast(chars as double) / 1000 end as similarity from ev )
    select session_id, round(avg(case when speaker = 'candidate' then similarity end), 6) as candidate_mean, round(avg(case when speaker = 'interviewer' then similarity end), 6) as interviewer_mean,
           count(case when speaker = 'candidate' then similarity end) as candidate_n, count(case when speaker = 'interviewer' then similarity end) as interviewer_n
    from s group by session_id""")
both("role_by_similarity", "select session_id, event_id, case when prob > energy then 'candidate' else 'interviewer' end as role from ev")
both("session_counts", """
    select session_id, count(*) as n_segments, count(distinct speaker) as n_speakers, cast(sum(case when speaker = 'candidate' then chars else 0 end) as bigint) as candidate_chars, max(ms) as last_ms
    from ev where kind = 'final' group by session_id""")

#: Distances between a session's events are hours; as frames they are some hundred milliseconds.
FRAME = 60_000
_FRAMES = f"with frames as (select session_id as stream_id, event_id as frame_id, ms div {FRAME} as ms, energy, prob, (event_id % 7) / 7 as pitch from ev ), "
for _name, _sql in (
    ("activity_segments", frames.activity_sql()), ("activity_segments_hysteresis", frames.hysteresis_sql()),
    ("change_points", frames.change_sql(("energy", "prob", "pitch"))),
):
    both(_name, _FRAMES + _sql.strip().removeprefix("with "))


def walk(start: str, step: str, columns: str, source: str = "ev", at: str = "session_id, event_id", by: str = BY) -> str:
    """A recursive walk over each session's rows e; w is the state before. start and step give the state's columns."""
    key, row = at.split(", ")
    return f"""with recursive {EV}, rows_ as (select *, row_number() over ({by}) as rn from {source}),
    walk as (
        select {key}, {row}, rn, {start} from rows_ e where rn = 1
        union all
        select e.{key}, e.{row}, e.rn, {step} from walk w join rows_ e on e.{key} = w.{key} and e.rn = w.rn + 1
    ) select {key}, {row}, {columns} from walk"""


SCALE = 3_600  # distances of hours become seconds
_FINAL = "(select * from ev where kind = 'final')"
_QUICK = f"(select * replace (ms // {SCALE} as ms) from ev)"
_C = "case when e.speaker = 'candidate' then e.chars else 0 end"
_F = f"(case when w.fired then 0 else w.n end + 1 >= 2 or case when w.fired then 0 else w.c end + {_C} >= 80)"
add(
    "refresh_trigger",
    lambda s, d: E.refresh_triggers(E.session_events(s, d)),
    walk(
        f"1 as n, {_C} as c, {_C} >= 80 as fired",
        f"case when w.fired then 0 else w.n end + 1, case when w.fired then 0 else w.c end + {_C}, {_F}", "fired", _FINAL,
    ),
)
# n, told and part as they are after the row; last_ as they were at the last fire
_N = "{w}n + (e.kind = 'final')::bigint"
_TOLD = "{w}told + case when e.kind = 'final' and e.speaker = 'candidate' then e.chars else 0 end"
_PART = "case when e.speaker <> 'candidate' then {w}part when e.kind = 'partial' then e.chars else 0 end"


def _fast(w: str, last_at: str, last_n: str, last_c: str) -> str:
    n, told, part = (x.format(w=w) for x in (_N, _TOLD, _PART))
    if not w:
        n, told, part = (x.replace("n + (", "0 + (", 1) if i == 0 else x.replace("told", "0", 1) if i == 1 else x.replace("then part", "then 0", 1) for i, x in enumerate((n, told, part)))
    now = f"({told} + {part})"
    fire = f"(({n} > 0 or {part} > 0) and ({last_at} is null or e.ms - {last_at} >= 1000) and ({n} - {last_n} >= 1 or {now} - {last_c} >= 20 or ({part} > 0 and {now} > {last_c})))"
    return f"{n} as n, {told} as told, {part} as part, {fire} as fired, case when {fire} then e.ms else {last_at} end as at, case when {fire} then {n} else {last_n} end as last_n, case when {fire} then {now} else {last_c} end as last_c"


add(
    "fast_trigger",
    lambda s, d: E.fast_triggers(E.scaled(E.session_events(s, d), SCALE)),
    walk(_fast("", "null::bigint", "0", "0"), _fast("w.", "w.at", "w.last_n", "w.last_c"), "fired", _QUICK),
)
_EMIT = "(w.sig <> e.event_type or e.ms - w.at >= 10000)"
add(
    "call_throttle",
    lambda s, d: E.call_throttle(E.scaled(E.session_events(s, d), SCALE)),
    walk(
        "e.event_type as sig, e.ms as at, true as emitted",
        f"case when {_EMIT} then e.event_type else w.sig end, case when {_EMIT} then e.ms else w.at end, {_EMIT}", "emitted", _QUICK,
    ),
)
_REQUEST = "e.event_type || ':' || (e.chars // 10)::varchar"
_OUTCOME = f"case when list_contains(w.keys, {_REQUEST}) then 'cached' when e.ms - w.at < 8000 then 'throttled' else 'run' end"
_WITHIN = f"case when e.ms - w.keys[{_REQUEST}] <= 120000 then 'cached' when e.ms - w.at < 8000 then 'throttled' else 'run' end"
add(
    "single_flight_cache",
    lambda s, d: E.single_flight(E.scaled(E.session_events(s, d), SCALE)),
    walk(
        f"[{_REQUEST}] as keys, e.ms as at, 'run' as outcome",
        f"case when {_OUTCOME} = 'run' then list_append(w.keys, {_REQUEST}) else w.keys end, case when {_OUTCOME} = 'run' then e.ms else w.at end, {_OUTCOME}",
        "outcome", _QUICK,
    ),
)
add(
    "ema_scores",
    lambda s, d: E.ema_scores(E.session_events(s, d)),
    walk("e.chars % 101 as score", "round_even((58 * w.score + 42 * (e.chars % 101))::double / 100, 0)::bigint", "score"),
)
#: Sessions are those of customers that owe nothing; others were never opened.
_REGISTRY = "select c_custkey as session_id from customer where c_acctbal >= 0"


def session_append(spark, sf_dir):
    registry = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal >= 0").selectExpr("c_custkey as session_id")
    return E.appended(E.session_events(spark, sf_dir), registry)


add("session_append", session_append, f"""with {EV},
    o as (select *, min(case when ended then row(ms, event_id) end) over (partition by session_id) as closed, session_id in ({_REGISTRY}) as known from ev where kind = 'final'),
    s as (select *, case when not known then 'unknown' when row(ms, event_id) > closed then 'not_active' when chars = 0 then 'blank' else 'ok' end as status from o)
    select session_id, event_id, case when status = 'ok' then sum(case when status = 'ok' then 1 else 0 end) over ({BY})::bigint end as seg_id, status from s""")

# partial texts of all speakers: an event of an even id is a partial text of its kind of event as a speaker
_PARTIALS = ["session_id", "event_id", "ms", "case when event_id % 2 = 0 then 'partial' else 'final' end as kind", "event_type as speaker",
             "case when chars % 4 = 0 then ' ' else concat(event_type, '-', chars) end as text"]
_KINDS = ("click", "view", "purchase", "signup", "error")
add(
    "speaker_partials",
    lambda s, d: E.speaker_partials(E.session_events(s, d).selectExpr(*_PARTIALS)),
    f"""with {EV}, p as (select {', '.join(_PARTIALS)} from ev), f as (select *, case when kind = 'partial' and trim(text) <> '' then text end as now from p)
    select session_id, event_id, now as partial,
           ({' + '.join(f"coalesce(last_value(case when speaker = '{k}' then (now is not null)::bigint end ignore nulls) over {SOFAR}, 0)" for k in _KINDS)})::bigint as n_open
    from f""",
)
# keys of requests that are forgotten after two minutes of the events' quick time
add(
    "single_flight_ttl",
    lambda s, d: E.single_flight(E.scaled(E.session_events(s, d), SCALE), ttl_ms=120_000),
    walk(
        f"map([{_REQUEST}], [e.ms]) as keys, e.ms as at, 'run' as outcome",
        f"case when {_WITHIN} = 'run' then map_concat(w.keys, map([{_REQUEST}], [e.ms])) else w.keys end, case when {_WITHIN} = 'run' then e.ms else w.at end, {_WITHIN}",
        "outcome", _QUICK,
    ),
)


def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def samples(spark, sf_dir):
    return vectors(spark, sf_dir).selectExpr("label as speaker_id", "embedding")


def sessions(spark, sf_dir):
    return vectors(spark, sf_dir).selectExpr("vec_id % 25 as session_id", "vec_id", "embedding")


_D = "list_transform(embedding, lambda x: x::double)"


def _norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda y: y * y)))"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def _cos(a: str, b: str) -> str:
    return f"({_dot(a, b)} / (greatest({_norm(a)}, 1e-8) * greatest({_norm(b)}, 1e-8)) + 1) / 2"


_PROFILE = f"""means as (
    select label as speaker_id, pos, avg(x) as m, count(*) as n from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings) group by all
), lists as (select speaker_id, list(m order by pos) as mean, max(n) as n from means group by 1
), profiles as (select speaker_id, n, list_transform(mean, lambda x: x / {_norm('mean')}) as embedding, {_norm('mean')} as quality from lists)"""
add("embedding_stats", lambda s, d: V.embedding_stats(vectors(s, d)), f"""
    select vec_id, len(v) as dim, round({_norm('v')}, 6) as l2, round(list_avg(v), 6) as mean,
           round(sqrt(greatest(list_sum(list_transform(v, lambda x: x * x)) / len(v) - list_avg(v) * list_avg(v), 0)), 6) as std, round(list_min(v), 6) as low, round(list_max(v), 6) as high
    from (select vec_id, {_D} as v from embeddings)""")
add(
    "enrol_profiles",
    lambda s, d: V.enrol(samples(s, d)).selectExpr(
        "speaker_id", "n", "quality", "status", "round(embedding[0], 6) as first", "cast(size(embedding) as bigint) as dim",
    ),
    f"with {_PROFILE} select speaker_id, n, round(quality, 6) as quality, case when n >= 2 then 'enrolled' else 'too_few' end as "
    f"status, round(embedding[1], 6) as first, len(embedding) as dim from profiles",
)
#: Labels 0 to 4 stand for voices of interviewers, the others for candidates.
add(
    "enrolment_status",
    lambda s, d: samples(s, d).groupBy(
        F.when(F.col("speaker_id") < 5, "interviewer").otherwise("candidate").alias("role"), "speaker_id",
    ).count().selectExpr(
        "role", "speaker_id", "count as n", "greatest(0, 2 - count) as needed", "count >= 2 as can_complete",
    ),
    "select case when label < 5 then 'interviewer' else 'candidate' end as role, label as speaker_id, count(*) as n, greatest(0, 2 - "
    "count(*)) as needed, count(*) >= 2 as can_complete from embeddings group by all",
)
add("speaker_match", lambda s, d: V.match(vectors(s, d), V.enrol(samples(s, d))), f"""with {_PROFILE}, v as (select vec_id, {_D} as e from embeddings),
    met as (select vec_id, speaker_id, round({_cos('e', 'embedding')}, 6) as similarity from v, profiles)
    select vec_id, speaker_id, similarity from met qualify row_number() over (partition by vec_id order by similarity desc, speaker_id) = 1""")
add(
    "cosine01",
    lambda s, d: vectors(s, d).join(V.enrol(samples(s, d)).selectExpr("speaker_id as label", "embedding as p"), "label").select(
        "vec_id", F.round(V.cosine01(F.col("embedding"), F.col("p")), 6).alias("similarity"),
    ),
    f"with {_PROFILE} select vec_id, round({_cos(_D.replace('embedding', 'v.embedding'), 'p.embedding')}, 6) as similarity from "
    f"embeddings v join profiles p on p.speaker_id = v.label",
)
add(
    "frame_energy",
    lambda s, d: vectors(s, d).select(
        "vec_id", F.round(V.frame_energy(F.col("embedding")), 6).alias("energy"),
        F.round(V.frame_energy(F.expr("transform(embedding, x -> cast(x * 1000 as smallint))"), True), 12).alias("energy_16"),
    ),
    f"""select vec_id, round(list_sum(list_transform({_D}, lambda x: x * x)) / len(embedding), 6) as energy,
        round(list_sum(list_transform(embedding, lambda x: trunc(x * 1000)::double * trunc(x * 1000)::double)) / (len(embedding) * 1073741824.0), 12) as energy_16 from embeddings""",
)

# enrolment: the state is walked through in SQL as well
_V = f"(select vec_id % 25 as session_id, vec_id as event_id, {_D} as e_ from embeddings)"
_BY_VEC = "partition by session_id order by event_id"


def _mix(p: str, q: str) -> str:
    mixed = f"list_transform(list_zip({p}, {q}), lambda z: z[1] * (1 - 0.2) + z[2] * 0.2)"
    return f"list_transform({mixed}, lambda x: x / greatest({_norm(mixed)}, 1e-8))"


_NEAR = _cos("w.a", "e.e_")
_ENROL = walk(
    "e.e_ as a, null::double[] as b, 'interviewer' as phase, 1.0::double as similarity",
    f"""case when w.b is null and {_NEAR} >= 0.75 then {_mix('w.a', 'e.e_')} else w.a end,
        case when w.b is not null then w.b when {_NEAR} < 0.75 then e.e_ end,
        case when w.b is not null then 'done' when {_NEAR} >= 0.75 then 'update' else 'candidate' end,
        case when w.b is null then {_NEAR} end""",
    "phase, similarity, a, b", _V, by=_BY_VEC,
)
add(
    "auto_enrolment",
    lambda s, d: V.enrolment_steps(sessions(s, d)).selectExpr(
        "session_id", "vec_id", "phase", "round(similarity, 6) as similarity", "round(interviewer[0], 6) as first",
    ),
    f"select session_id, event_id as vec_id, phase, round(similarity, 6) as similarity, round(a[1], 6) as first from ({_ENROL})",
)
add(
    "retro_correction",
    lambda s, d: V.retro_roles(sessions(s, d), V.auto_enrol(sessions(s, d))),
    f"""with steps as ({_ENROL}), ends as (select session_id, arg_max(a, event_id) as a, arg_max(b, event_id) as b from steps where phase <> 'done' group by session_id),
    v as (select vec_id % 25 as session_id, vec_id, {_D} as e from embeddings)
    select session_id, vec_id, case when b is not null and {_cos('e', 'b')} > {_cos('e', 'a')} then 'candidate' else 'interviewer' end as role from v join ends using (session_id)""",
)
add(
    "profile_update",
    lambda s, d: V.updated_profiles(sessions(s, d)).selectExpr(
        "session_id", "vec_id", "round(profile[0], 6) as first", "cast(size(profile) as bigint) as dim",
    ),
    f"select session_id, event_id as vec_id, round(p[1], 6) as first, len(p) as dim from ({walk('e.e_ as p', _mix('w.p', 'e.e_'), 'p', _V, by=_BY_VEC)})",
)
