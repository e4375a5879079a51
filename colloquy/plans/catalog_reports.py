"""Registered queries: reports and requests, rolling and live analysis, files and streams as sources, jobs, cues and cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.expressions import ansi, hits, quoted
from colloquy.operators import events as E
from colloquy.operators import reports, rolling
from colloquy.operators import turns as T
from colloquy.plans import lexicon as L
from colloquy.plans import oracle as O
from colloquy.plans import rows as R
from colloquy.plans.catalog import _ROLES, DISC, MODELS, WORDS, add, flat_transcripts, interviews, listed, ranked, scored
from colloquy.plans.catalog_events import EV, walk
from colloquy.plans.layers import all_layers, counts
from colloquy.plans.views import LABELS, zh_turns
from colloquy.sources import events_json as J
from colloquy.sources import tables
from colloquy.sources.scratch import scratch

BASE = f"with {O.SEGMENTS}, {O.TURNS}, {O.INTERVIEWS}"

# jobs: the most hits win; the words that were found are the evidence
_HITS = {j: hits("w", words) for j, words in L.JOBS.items()}
_MOST = "greatest(" + ", ".join(f"j_{j}" for j in L.JOBS) + ")"
_JOB = f"case when {_MOST} = 0 then 'unknown' " + " ".join(f"when j_{j} = {_MOST} then '{j}'" for j in L.JOBS) + " end"
_SURE = f"case when {_MOST} = 0 then 20 else least(90, 35 + 10 * {_MOST}) end"
_HINT = "case when interview_id % 4 = 0 then 'sales' else '' end"
_COUNTED = ["interview_id", "w", *(f"cast({h} as bigint) as j_{j}" for j, h in _HITS.items())]
_JOBS_SQL = f"{BASE}, jobs as (select {', '.join(map(ansi, _COUNTED))} from base)"


def job_rows(spark, sf_dir):
    words = {j: F.array_join(
        F.slice(F.filter(F.array(*map(F.lit, x)), lambda k: F.contains(F.col("w"), k)), 1, 4), ",",
    ) for j, x in L.JOBS.items()}
    rows = interviews(spark, sf_dir).selectExpr(*_COUNTED).withColumn("job", F.expr(_JOB))
    return rows.withColumn("evidence", F.coalesce(*(F.when(F.col("job") == j, e) for j, e in words.items()), F.lit("")))


_EVIDENCE = f"case {_JOB} " + " ".join(f"when '{j}' then array_to_string(list_filter({list(x)}, lambda k: contains(w, k))[1:4], ',')" for j, x in L.JOBS.items()) + " else '' end"
add(
    "job_inference",
    lambda s, d: job_rows(s, d).selectExpr("interview_id", "job", f"cast({_SURE} as bigint) as confidence_percent", "evidence"),
    f"{_JOBS_SQL} select interview_id, {_JOB} as job, ({_SURE})::bigint as confidence_percent, {_EVIDENCE} as evidence from jobs",
)
_OVERRIDE = [
    "interview_id", f"case when {_HINT} <> '' then {_HINT} else {_JOB} end as job",
    f"cast(case when {_HINT} <> '' then 95 else {_SURE} end as bigint) as confidence_percent",
]
add("job_hint_override", lambda s, d: job_rows(s, d).selectExpr(*_OVERRIDE), f"{_JOBS_SQL} select {', '.join(_OVERRIDE)} from jobs")

# cues of questions and answers in a single line
_CUES = f"case when text = '' then false when text like '%？' or text like '%?' then true else {' or '.join(f'text like {quoted(f'%{c}%')}' for c in T.QUESTION_CUES)} end"
_TOLD = f"case when text = '' then false else length(text) >= 18 or {' or '.join(f'text like {quoted(f'%{c}%')}' for c in T.ANSWER_CUES)} end"
#: Each segment, and its first six characters as a short one.
_SHORT = "select interview_id, seg_id, 'whole' as part, trim({t}) as text from {s} union all select interview_id, seg_id, 'start', trim(left({t}, 6)) from {s}"


def short_texts(spark, sf_dir):
    return spark.sql(_SHORT.format(t="text", s="{rows}"), rows=zh_turns(spark, sf_dir))


add(
    "looks_like_question",
    lambda s, d: short_texts(s, d).select("interview_id", "seg_id", "part", T.looks_like_question(F.col("text")).alias("question")),
    f"with {O.SEGMENTS}, t as ({_SHORT.format(t='text', s='segments')}) select interview_id, seg_id, part, {_CUES} as question from t",
)
add(
    "looks_like_answer",
    lambda s, d: short_texts(s, d).select("interview_id", "seg_id", "part", T.looks_like_answer(F.col("text")).alias("answer")),
    f"with {O.SEGMENTS}, t as ({_SHORT.format(t='text', s='segments')}) select interview_id, seg_id, part, {_TOLD} as answer from t",
)

# fast scores from one expression for each side, and the words of each dimension that are there
_low = "translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SIDES = {x: "|".join(sorted(WORDS[f"side_{x}"], key=len, reverse=True)) for x in "eintfjps"}
_FAST = [
    "interview_id", *(f"cast(case when m_{x} >= 2 then least(70 + 5 * m_{x}, 95) end as bigint) as fast_{x}" for x in _SIDES),
    *(f"case when m_{x} >= 3 then 'moderate' when m_{x} >= 2 then 'slight' end as level_{x}" for x in _SIDES),
]
add(
    "fast_mbti",
    lambda s, d: interviews(s, d).selectExpr(
        "interview_id", *(f"regexp_count({_low}, '{p}') as m_{k}" for k, p in _SIDES.items()),
    ).selectExpr(
        *_FAST,
    ),
    f"{BASE}, f as (select interview_id, "
    f"{', '.join(f'len(regexp_extract_all({_low}, {quoted(p)})) as m_{k}' for k, p in _SIDES.items())} from base) select "
    f"{', '.join(_FAST)} from f",
)


def star_behaviours(spark, sf_dir):
    """The strong words of each dimension that a transcript holds, more of them first."""
    low = F.lower("w")
    found = lambda d: F.filter(F.array(*map(F.lit, WORDS[f"star_{d}"])), lambda k: F.contains(low, F.lower(k)))
    made = F.array(
        *(F.struct(
            (-F.size(found(d))).cast("long").alias("neg"), F.lit(i).alias("ord"), F.lit(d.upper()).alias("dim"),
            F.array_join(found(d), ",").alias("words"),
        ) for i, d in enumerate("star")),
    )
    rows = interviews(spark, sf_dir).select(
        "interview_id", F.posexplode(F.array_sort(F.filter(made, lambda x: x["neg"] < 0))).alias("at", "r"),
    )
    return rows.select("interview_id", "r.dim", (-F.col("r.neg")).alias("n"), "r.words", (F.col("at") + 1).cast("long").alias("place"))


_KEPT = O.union(
    [f"select interview_id, {i} as ord, '{d.upper()}' as dim, list_filter({list(WORDS[f'star_{d}'])}, lambda k: contains(lower(w), "
    f"lower(k))) as k from base" for i, d in enumerate("star")],
)
add(
    "star_behaviours", star_behaviours,
    f"{BASE}, k as ({_KEPT}) select interview_id, dim, len(k) as n, array_to_string(k, ',') as words, row_number() over (partition by "
    f"interview_id order by len(k) desc, ord) as place from k where len(k) > 0",
)

# reports, requests and what comes back
_DIGEST = {
    "top": ("report.disc.top", "disc_top"), "confidence": ("report.disc.confidence", "disc_confidence"), "mbti": ("report.mbti.type", "mbti_type"), "overall": ("report.star.overall", "star_overall"),
    "segments": ("report.overview.segments", "n_segments"), "quality": ("report.overview.sample_quality", "sample_quality"), "style": ("report.mapping.style", "style_label"), "richness": ("report.features.richness", "richness"),
    "turns": (
        "cast(size(report.interview_map.turns) as bigint)", "n_turns",
    ), "kinds": ("array_join(transform(report.interview_map.turns, x -> x.question_type), ',')", "kinds"),
    "findings": ("array_join(report.findings, ',')", listed(R.FINDINGS, 4)), "gaps": ("array_join(report.gaps, ',')", listed(R.GAPS, 5)),
    "stages": (
        "array_join(transform(report.stages, x -> x.stage), ',')", quoted(",".join(reports.STAGES)),
    ), "parsed": ("report.stages[0].n", "n_turns"),
}


def report_sink(spark, sf_dir):
    """Reports are written, then read back."""
    path = scratch(spark, "reports")
    reports.write_reports(reports.report(scored(spark, sf_dir), T.qa_pairs(zh_turns(spark, sf_dir))), path)
    return spark.read.parquet(path).selectExpr("interview_id", *(f"{e} as {n}" for n, (e, _) in _DIGEST.items()))


add(
    "report_sink", report_sink,
    f"{O.prelude(WORDS)}, kinds as (select interview_id, string_agg(question_type, ',' order by turn_id) as kinds from turns group by "
    f"1) select scored.interview_id, {', '.join(f'{e} as {n}' for n, (_, e) in _DIGEST.items() if n != 'kinds')}, coalesce(kinds, '') "
    f"as kinds from scored left join kinds using (interview_id)",
)
_IN = "get_json_object(get_json_object(request, '$.messages[1].content'), '$.{}') as {}"
_LISTS = ("gaps", "open_axes", "defects", "questions")
_GRAVE = ", ".join(f"case when {d} = 'high' then '{c}' end" for c, d, _ in R.STAR_DEFECTS)
_ASKED = " || ".join(f"case when {w} then {list(R.PROBES[c])} else [] end" for c, _, w in R.STAR_DEFECTS)
_OPEN = ", ".join(f"case when pref_{a} in ('neutral', 'unclear') then '{a.upper()}' end" for a in ("ei", "ns", "tf", "jp"))
_RANK4 = "(select string_agg(dim, ' / ' order by score desc, o) from (values ('D', disc_d, 0), ('I', disc_i, 1), ('S', disc_s, 2), ('C', disc_c, 3)) v(dim, score, o))"
_JSON = "case when len({0}) = 0 then '[]' else '[\"' || array_to_string({0}, '\",\"') || '\"]' end"
_NONNULL = "list_filter([{}], lambda x: x is not null)"
_DISTINCT = f"(list_filter({_ASKED}, lambda x, i: list_position({_ASKED}, x) = i))[1:4]"
add(
    "inference_requests",
    lambda s, d: reports.inference_requests(scored(s, d)).selectExpr(
        "interview_id", "get_json_object(request, '$.messages[0].role') as role",
        *(_IN.format(k, k) for k in ("transcript", "ranking", "mbti", "risk", *_LISTS)),
    ),
    f"""{O.prelude(WORDS)} select interview_id, 'system' as role, right(w, 4000) as transcript, {_RANK4} as ranking, mbti_type as mbti, impression_risk as risk,
        {_JSON.format(f"string_split(nullif({listed(R.GAPS, 4)}, ''), ',')")} as gaps,
        {_JSON.format(_NONNULL.format(_OPEN))} as open_axes, {_JSON.format(_NONNULL.format(_GRAVE))} as defects, {_JSON.format(_DISTINCT)} as questions from scored""".replace("case when len(string_split(nullif(", "case when coalesce(len(string_split(nullif(", 1).replace(", ''), ',')) = 0 then", ", ''), ',')), 0) = 0 then", 1),
)


def inference_merge(spark, sf_dir):
    """Every third interview has a result with a style, a blank type, and six lists of turns; every sixth an empty list."""
    row = scored(spark, sf_dir, "disc_top mbti_type n_turns").selectExpr(
        "interview_id", "disc_top", "mbti_type", "transform(sequence(1, 7), x -> concat('local', x)) as strengths",
    )
    far = row.where("interview_id % 3 = 0").selectExpr(
        "interview_id", "'X' as disc_top", "' ' as mbti_type",
        "case when interview_id % 6 = 0 then array() else transform(sequence(1, 6), x -> concat('far', x)) end as strengths",
    )
    return reports.merge_results(row, far, "interview_id", ["disc_top", "mbti_type"], {"strengths": 4}).withColumn(
        "strengths", F.array_join("strengths", ","),
    )


add(
    "inference_merge", inference_merge,
    f"{O.prelude(WORDS)} select interview_id, case when interview_id % 3 = 0 then 'X' else disc_top end as disc_top, mbti_type, case "
    f"when interview_id % 3 = 0 and interview_id % 6 <> 0 then 'far1,far2,far3,far4' else 'local1,local2,local3,local4' end as "
    f"strengths from scored",
)

# rolling analysis: counts of each segment, then running sums, then the same layers
_COUNTS = dict(counts(WORDS))
_COUNTS["text_length"], _COUNTS["word_count"] = (_COUNTS[c].replace("greatest(1, ", "greatest(0, ") for c in ("text_length", "word_count"))
_NAMES = [*rolling.SUMMED, *_COUNTS]
_SOFAR = "over (partition by interview_id order by seg_id rows between unbounded preceding and current row)"
_STEPS, _LAST = [], "summed"
for _i, _layer in enumerate(all_layers(WORDS)[1:]):
    _STEPS.append(f"roll{_i} as materialized (select *, {', '.join(f'{ansi(e)} as {n}' for n, e in _layer.items())} from {_LAST})")
    _LAST = f"roll{_i}"
_SAID = O._TRIM.format("text")
_ROLL = f"""{O.SEGMENTS}, {O.TURNS}, told as (
    select interview_id, seg_id, speaker, length(text) as chars, case when speaker = 'candidate' then {_SAID} else '' end as t,
           case speaker when 'interviewer' then '面试官' when 'candidate' then '候选人' else '发言人' end || '：' || text as w, case when speaker = 'candidate' and {_SAID} <> '' then {O._KIND} end as kind
    from asked
), parted as (select *, list_filter(list_transform(string_split_regex(t, '[。！？!?；;\\n]+'), lambda s: {O._TRIM.format('s')}), lambda s: s <> '') as parts from told
), counted as (
    select *, len(parts) as sent, coalesce(list_sum(list_transform(parts, lambda x: length(x))), 0)::bigint as sent_chars, length(t) as cand_chars, (kind is not null)::bigint as n_turns, 1::bigint as n_segments,
           {', '.join(f'{ansi(e)} as {n}' for n, e in _COUNTS.items())}
    from parted
), summed as materialized (
    select interview_id, seg_id, speaker, chars, len(list_distinct(list_filter(list(kind) {_SOFAR}, lambda k: k is not null))) as n_types,
           {', '.join(f"greatest({1 if c in ('text_length', 'word_count') else 0}, sum({c}) {_SOFAR})::bigint as {c}" for c in _NAMES)}
    from counted
), {', '.join(_STEPS)}"""


def rolled(spark, sf_dir):
    return rolling.rolling(zh_turns(spark, sf_dir), WORDS)


_ROLL_OUT = [
    "interview_id", "seg_id", "n_turns", "cand_chars", "disc_d", "disc_i", "disc_s", "disc_c", "big_top", "mbti_type", "star_overall",
    "sample_quality",
]
_C = "case when e.speaker = 'candidate' then e.chars else 0 end"
_NEW = f"(case when w.fired then 0 else w.n end + 1 >= 2 or case when w.fired then 0 else w.c end + {_C} >= 80)"
_DUE = walk(
    f"1 as n, {_C} as c, {_C} >= 80 as fired", f"case when w.fired then 0 else w.n end + 1, case when w.fired then 0 else w.c end + {_C}, {_NEW}",
    "fired", "told", at="interview_id, seg_id", by="partition by interview_id order by seg_id",
).replace(EV, _ROLL)
_DUE = _DUE[: _DUE.rindex(") select")] + f") select {', '.join('r.' + c for c in _ROLL_OUT)} from walk join {_LAST} r on r.interview_id = walk.interview_id and r.seg_id = walk.seg_id where fired"
add("rolling_analysis", lambda s, d: rolling.refreshed(rolled(s, d)).selectExpr(*_ROLL_OUT), _DUE)

_FIRST = "case " + " ".join(f"when {x} = greatest(c, d, i, s) then '{x.upper()}'" for x in "cdis") + " end"
_SECOND = "case " + " ".join(f"when first <> '{x.upper()}' and {x} = greatest({', '.join(f'''case when first = '{y.upper()}' then -1 else {y} end''' for y in 'cdis')}) then '{x.upper()}'" for x in "cdis") + " end"
_BOTH = f"{_ROLES.format('first')} || {_ROLES.format('second')}"
_PICKED = f"array_to_string((list_filter({_BOTH}, lambda x, i: list_position({_BOTH}, x) = i))[1:4], ',')"
_SMOOTH = ", ".join(f"case when low then 0 when p{x} is null then raw_{x} else round_even((58 * p{x} + 42 * raw_{x})::double / 100, 0)::bigint end as {x}" for x in "cdis")


def _step(source: str) -> str:
    """From rows with raw scores, the scores before (p), the styles and roles before, to the state after."""
    return f"""select interview_id, seg_id, rn, c, d, i, s, case when low then '' else first || second end as sig, case when low then coalesce(was, '') when first || second <> psig or was = '' then {_PICKED} else was end as roles,
        disc_confidence, low, {', '.join(f'pc{x}' for x in 'cdis')}
    from (select *, {_SECOND} as second from (select *, {_FIRST} as first from (select *, {_SMOOTH}, {', '.join(f'p{x} as pc{x}' for x in 'cdis')} from ({source}))))"""


_RAW = ", ".join(f"e.disc_{x} as raw_{x}" for x in "cdis")
_LIVE = f"""with recursive {_ROLL}, rows_ as materialized (select *, row_number() over (partition by interview_id order by seg_id) as rn from {_LAST} where speaker = 'candidate'),
walk as (
    {_step(f"select interview_id, seg_id, rn, disc_confidence, cand_chars < 20 as low, {_RAW}, {', '.join(f'null::bigint as p{x}' for x in 'cdis')}, '' as psig, '' as was from rows_ e where rn = 1")}
    union all
    {_step(f"select e.interview_id, e.seg_id, e.rn, e.disc_confidence, e.cand_chars < 20 as low, {_RAW}, {', '.join(f'w.{x} as p{x}' for x in 'cdis')}, w.sig as psig, w.roles as was from walk w join rows_ e on e.interview_id = w.interview_id and e.rn = w.rn + 1")}
), live as (
    select interview_id, seg_id, disc_confidence, case when low then 'collecting' else 'ready' end as status, left(sig, 1) as dominant, right(sig, 1) as secondary,
           {', '.join(f'c.{x}::bigint as live_{x}'.replace('c.', '') for x in 'cdis')}, {', '.join(f'(case when low then 0 else coalesce({x} - pc{x}, 0) end)::bigint as delta_{x}' for x in 'cdis')}, roles
    from walk
)"""


def live(spark, sf_dir):
    return rolling.live_disc(rolled(spark, sf_dir), R.STYLE_ROLES)


add("live_disc", live, f"{_LIVE} select * from live")
_EVENT = f"""'{{"type":"disc.update","dominant":"' || dominant || '","secondary":"' || secondary || '","scores":{{' || {" || ',' || ".join(f"'{chr(34)}{x.upper()}{chr(34)}:' || live_{x}" for x in "disc")} || '}},"deltas":{{' || {" || ',' || ".join(f"'{chr(34)}{x.upper()}{chr(34)}:' || delta_{x}" for x in "disc")} || '}},"confidence":"' || disc_confidence || '","is_partial":' || case when seg_id % 5 = 0 then 'true' else 'false' end || '}}'"""
add(
    "score_update_event", lambda s, d: reports.score_update(live(s, d).withColumn("partial", F.col("seg_id") % 5 == 0)),
    f"{_LIVE} select interview_id, seg_id, {_EVENT} as event from live",
)
# sessions of some conversations end before their last segment: each that has ended gets its report, of what came until then
_ENDED = "interview_id % 4 > 0 and seg_id = 1 + interview_id % 3"
_REPORT = ["interview_id", "n_segments", "n_turns", "cand_chars", "disc_top", "disc_d", "big_top", "type_top", "mbti_type", "star_overall", "n_high", "sample_quality", "disc_confidence", "star_confidence"]
_UNTIL = f"""{O.SEGMENTS.replace("segments as", "all_segments as", 1)}, segments as (
    select * exclude (ends) from (select *, min(case when {_ENDED} then seg_id end) over (partition by interview_id) as ends from all_segments) where seg_id <= ends
)"""
add(
    "session_report",
    lambda s, d: rolling.final_reports(zh_turns(s, d).withColumn("ended", F.expr(_ENDED)), WORDS).selectExpr(*_REPORT),
    O.select(", ".join(_REPORT), words=WORDS).replace(O.SEGMENTS, _UNTIL, 1),
)
add(
    "session_snapshot",
    lambda s, d: reports.snapshots(interviews(s, d), live(s, d), rolling.refreshed(rolled(s, d)), T.speakers_of(zh_turns(s, d))),
    f"""{_LIVE}, {O.INTERVIEWS.replace('told as (', 'told_ as (', 1).replace('left join told ', 'left join told_ ').replace('from whole left join told using', 'from whole left join told_ using')},
    last as (select * from live qualify row_number() over (partition by interview_id order by seg_id desc) = 1),
    due_rows as (select *, row_number() over (partition by interview_id order by seg_id) as rn from told),
    due_walk as (
        select interview_id, seg_id, rn, 1 as n, {_C} as c, {_C} >= 80 as fired from due_rows e where rn = 1
        union all
        select e.interview_id, e.seg_id, e.rn, case when w.fired then 0 else w.n end + 1, case when w.fired then 0 else w.c end + {_C}, {_NEW} from due_walk w join due_rows e on e.interview_id = w.interview_id and e.rn = w.rn + 1
    ), due as (select interview_id, max(seg_id) as seg_id from due_walk where fired group by interview_id), result as (select r.* from {_LAST} r join due using (interview_id, seg_id)),
    said as (select interview_id, string_agg(seg_id || ':' || speaker || ':' || length(text), ',' order by seg_id) as segments from segments group by interview_id)
    select b.interview_id, b.n_segments, said.segments, b.w as transcript, l.seg_id as analysed_to, coalesce(l.status, 'waiting') as status, l.dominant, l.secondary, l.roles,
           {', '.join(f'l.live_{x}, l.delta_{x}' for x in 'cdis')}, r.seg_id as rolled_to, r.mbti_type, r.big_top, r.star_overall, r.sample_quality
    from base b left join last l using (interview_id) left join result r on r.interview_id = b.interview_id join said on said.interview_id = b.interview_id""",
)

# files and streams of events as sources: written by Spark from the tables, then read back
_LABEL = " ".join(f"when '{who}' then ({list(names)})[seg_id % {len(names)} + 1]" for who, names in LABELS.items())
_FLAT = f"""said as (
    select interview_id, seg_id, case speaker {_LABEL} end || '：' || regexp_replace(text, '\\s+', ' ', 'g') || '。' as line from segments where speaker <> 'unknown'
), flat as (select interview_id, case when interview_id % 2 = 0 then string_agg(line, chr(10) order by seg_id) else string_agg(line, '' order by seg_id) end as text from said group by interview_id)"""


def transcript_scan(spark, sf_dir):
    """A text file for each interview, each with a byte order mark, written and read back."""
    path = scratch(spark, "transcripts")
    rows = flat_transcripts(spark, sf_dir).withColumn("interview_id", F.coalesce(F.col("interview_id").cast("string"), F.lit("null")))
    try:
        back = tables.transcript_files(spark, tables.write_transcripts(rows, path))
    except tables.NotReached:  # a folder for each interview, by Spark's own writer
        named = rows.select("interview_id", F.concat(F.lit("\uFEFF"), "text").alias("value"))
        named.repartition("interview_id").write.partitionBy("interview_id").text(f"{path}/by-interview")
        back = tables.transcript_folders(spark, f"{path}/by-interview")
    return back.selectExpr("try_cast(interview_id as bigint) as interview_id", "text")


add(
    "transcript_scan", transcript_scan,
    f"with {O.SEGMENTS}, {_FLAT} select * from flat",
)
_MANIFEST = [
    "cast(interview_id as string) as id", "concat('case ', interview_id) as title",
    "case interview_id % 3 when 0 then 'sales' when 1 then 'product' else '' end as job_hint", "concat(interview_id, '.txt') as filename",
    "'' as description",
]


def manifest_scan(spark, sf_dir):
    """A manifest of the interviews with an even id, joined with all transcripts."""
    path = scratch(spark, "manifest")
    rows = flat_transcripts(spark, sf_dir)
    rows.where("interview_id % 2 = 0").selectExpr(*_MANIFEST).write.json(path)
    return tables.with_job_hints(
        rows.withColumn("interview_id", F.col("interview_id").cast("string")), tables.manifests(spark, path),
    ).select(
        "interview_id", "job_hint", "title",
    )


add(
    "manifest_scan", manifest_scan,
    f"with {O.SEGMENTS}, {_FLAT} select interview_id::varchar as interview_id, case when interview_id % 2 = 0 then case interview_id % "
    f"3 when 0 then 'sales' when 1 then 'product' else '' end end as job_hint, case when interview_id % 2 = 0 then 'case ' || "
    f"interview_id end as title from flat",
)
_WORD_VALUES = ", ".join(f"('{k}', '{w}')" for k in ("action", "hedge", "detail", "plural") for w in WORDS[k])
add(
    "rule_tables",
    lambda s, d: s.sql(
        f"select t.category, t.word, count(i.interview_id) as interviews, sum(case when i.interview_id is null then 0 else (length(i.w) "
        f"- length(replace(i.w, t.word, ''))) div length(t.word) end) as hits from (select /*+ broadcast(v) */ * from values "
        f"{_WORD_VALUES} as v(category, word)) t left join {{rows}} i on contains(i.w, t.word) group by t.category, t.word",
        rows=interviews(s, d),
    ),
    f"{BASE} select t.category, t.word, count(i.interview_id) as interviews, sum(coalesce((length(i.w) - length(replace(i.w, t.word, "
    f"''))) // length(t.word), 0))::bigint as hits from (values {_WORD_VALUES}) t(category, word) left join base i on contains(i.w, "
    f"t.word) group by all",
)
_RAW_EVENT = (
    "case when event_id % 10 = 1 then concat('{\"session_id\": \"', user_id) when event_id % 70 = 9 then null else to_json(named_struct('session_id', case when event_id % 15 <> 7 then cast(user_id as string) end, "
    "'text', case when event_id % 6 = 0 then '  ' else concat(event_type, ' ', event_id) end, 'speaker_id', case when event_id % 2 = 0 then event_type end, 'start_ms', case when event_id % 3 = 0 then event_id end)) end as value"
)


def segment_stream(spark, sf_dir):
    """Events as JSON, some of them cut, without a session or blank: accepted ones filled with defaults, others with their reason."""
    good, bad = tables.segment_events(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", _RAW_EVENT))
    good = good.selectExpr("event_id", "session_id", "speaker_id", "text", "cast(start_ms as bigint) as start_ms", "final", "interviewer_sim", "cast(null as string) as value", "cast(null as string) as reason")
    return good.unionByName(bad.selectExpr("event_id", "value", "reason"), allowMissingColumns=True)


_JSON = """'{' || case when event_id % 15 <> 7 then '"session_id":"' || user_id || '",' else '' end || '"text":"' || case when event_id % 6 = 0 then '  ' else event_type || ' ' || event_id end || '"'
    || case when event_id % 2 = 0 then ',"speaker_id":"' || event_type || '"' else '' end || case when event_id % 3 = 0 then ',"start_ms":' || event_id else '' end || '}'"""
add(
    "segment_stream", segment_stream,
    f"""with e as (select *, case when event_id % 10 = 1 or event_id % 70 = 9 then 'malformed' when event_id % 15 = 7 then 'no_session' when event_id % 6 = 0 then 'blank' end as reason from events)
    select event_id, case when reason is null then user_id::varchar end as session_id, case when reason is null then case when event_id % 2 = 0 then event_type else 'speaker_a' end end as speaker_id,
           case when reason is null then event_type || ' ' || event_id end as text, case when reason is null then case when event_id % 3 = 0 then event_id else 0 end end as start_ms,
           case when reason is null then true end as final, case when reason is null then 0.0::double end as interviewer_sim, reason,
           case when reason is not null and event_id % 70 <> 9 then case when event_id % 10 = 1 then '{{"session_id": "' || user_id else {_JSON} end when reason is not null and event_id % 10 = 1 then '{{"session_id": "' || user_id end as value
    from e""",
)

# what becomes of silent sessions and of late events, in order of arrival
DAY = 86_400_000
add(
    "state_ttl",
    lambda s, d: E.evictions(E.session_events(s, d), "1 day"),
    f"""with {EV}, a as (select *, case when ms - lag(ms) over (partition by session_id order by ms, event_id) < {DAY} then 0 else 1 end as new from ev),
    b as (select *, sum(new) over (partition by session_id order by ms, event_id rows between unbounded preceding and current row) as run from a)
    select session_id, min(ms) as first_ms, max(ms) + {DAY} as evicted_ms, count(*) as n_events from b group by session_id, run""",
)
add(
    "late_segments",
    lambda s, d: E.late_events(E.session_events(s, d), DAY),
    f"""with {EV}, a as (select *, max(ms) over (partition by session_id order by event_id rows between unbounded preceding and 1 preceding) - {DAY} as watermark from ev)
    select session_id, event_id, watermark, coalesce(ms < watermark, false) as late from a""",
)

# follow-ups in several shapes, and rankings against what labelled cases expect
_FOLLOW_TEXT = "trim(text)"


def followup_normalise(spark, sf_dir):
    """Interviewer segments as follow-ups: strings, and objects with any of the four keys, some with odd priorities or blank."""
    rows = zh_turns(spark, sf_dir).where("speaker = 'interviewer'").withColumn("q", F.expr(_FOLLOW_TEXT))
    quotes = "substring(to_json(named_struct('x', q)), 6, length(to_json(named_struct('x', q))) - 6)"
    kind = "(interview_id + seg_id) % 7"
    value = f"""case {kind} when 0 then {quotes} when 1 then to_json(named_struct('question', q, 'target_dimension', 'D', 'priority', 'HIGH'))
        when 2 then to_json(named_struct('question', q, 'dimension', 'I', 'priority', 'urgent')) when 3 then to_json(named_struct('question', q, 'target_dimension', ' ', 'defect_id', 'fake_star', 'priority', 'low'))
        when 4 then to_json(named_struct('question', q, 'label', 'x', 'purpose', 'p')) when 5 then '{{"question":"  "}}' else '17' end"""
    return J.followups(rows.selectExpr("interview_id", "seg_id", f"{value} as value"))


add("followup_normalise", followup_normalise, f"""with {O.SEGMENTS}, k as (select interview_id, seg_id, (interview_id + seg_id) % 7 as k, trim(text, ' ') as question from segments where speaker = 'interviewer')
    select interview_id, seg_id, question, case k when 1 then 'D' when 2 then 'I' when 3 then 'fake_star' when 4 then 'x' else '' end as dimension, case k when 1 then 'high' when 3 then 'low' else 'medium' end as priority, case k when 4 then 'p' else 'verify' end as purpose
    from k where k < 5 and question <> ''""")
_EXPECTED = ["D,I,S,C", "C,S,I,D", "I,S,D,C", "S,C,D,I", "I,S,C,D"]


def prediction_vs_label(spark, sf_dir):
    """Ranked styles of each interview against the ranking of its case; cases are given by the interview's id."""
    order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "dim"))), lambda x: x["dim"])
    predicted = ranked("disc")(spark, sf_dir).groupBy(F.col("interview_id").alias("case_id")).agg(order.alias("ranking"))
    cases = tables.conversation_segments(spark, sf_dir).select(F.col("interview_id").alias("case_id")).distinct()
    expected = F.split(F.get(F.array(*map(F.lit, _EXPECTED)), F.pmod("case_id", F.lit(len(_EXPECTED))).cast("int")), ",")
    out = J.ranking_match(predicted, cases.select("case_id", expected.alias("ranking")))
    return out.withColumns({c: F.array_join(c, ",") for c in ("predicted", "expected")})


_ORDERED = "list_transform(list_sort([(-disc_d, 0, 'D'), (-disc_i, 1, 'I'), (-disc_s, 2, 'S'), (-disc_c, 3, 'C')]), lambda x: x[3])"
add("prediction_vs_label", prediction_vs_label, f"""{O.prelude(WORDS)}, p as (select interview_id as case_id, {_ORDERED} as p, string_split(({_EXPECTED})[interview_id % {len(_EXPECTED)} + 1], ',') as e from scored)
    select case_id, array_to_string(p, ',') as predicted, array_to_string(e, ',') as expected, p[1] = e[1] as top_match, p = e as exact, len(list_filter(list_zip(p, e), lambda z: z[1] = z[2])) as in_place from p""")
assert DISC == list(MODELS["disc"][0])
