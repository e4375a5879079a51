"""Registered queries: rule tables joined, jobs, fast scores, reports, JSON sources, label joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions.expressions import ansi, hits, quoted
from colloquy.plans.layers import all_layers, counts
from colloquy.operators import reports, rolling
from colloquy.operators import turns as T
from colloquy.plans import lexicon as L
from colloquy.plans import oracle as O
from colloquy.plans import oracle_scores as OS
from colloquy.plans import rows as R
from colloquy.plans.catalog import WORDS, add, flat_transcripts, interviews, scored
from colloquy.sources import events_json as J
from colloquy.plans.views import LABELS, zh_turns

# rules as rows: the plain form that the compiled sums are held against
_RULES = [(str(k), f, op, t, n) for k, rules in L.ENNEAGRAM.items() for f, op, t, n in rules]
_FEATURES = sorted({f for _, f, *_ in _RULES})


def rule_match(spark, sf_dir):
    """(interview_id, type, points, matched): features as rows joined with the rule table, of fixed size."""
    table = spark.sql(
        "select * from values " + ", ".join(f"('{k}', '{f}', '{op}', cast({t} as double), {n})" for k, f, op, t, n in _RULES) + " as r(type, feature, op, threshold, points)",
    )
    stack = f"stack({len(_FEATURES)}, " + ", ".join(f"'{f}', {f}" for f in _FEATURES) + ") as (feature, value)"
    rows = scored(spark, sf_dir).selectExpr("interview_id", stack).join(F.broadcast(table), "feature")
    held = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return rows.groupBy("interview_id", "type").agg(
        F.sum(F.when(held, F.col("points")).otherwise(0)).alias("points"), F.count(F.when(held, 1)).alias("matched"),
    )


add("rule_match", rule_match, f"with {OS.scores(WORDS)} select interview_id, dim as type, points, matched from points where model = 'type'")


_BASE = f"with {O.SEGMENTS}, {O.TURNS}, {O.INTERVIEWS}"
# one regular expression for each dimension: its words do not overlap each other
_FAST = {d: "|".join(sorted(WORDS[f"disc_{d}"], key=len, reverse=True)) for d in "disc"}
_FAST_MAX = "greatest(f_d, f_i, f_s, f_c)"
_FAST_OUT = [
    "interview_id",
    *(f"cast(case when {_FAST_MAX} < 3 then 0 else least(100, (80 * f_{d}) div {_FAST_MAX} + case when f_{d} = {_FAST_MAX} then 20 else 0 "
    f"end) end as bigint) as fast_{d}" for d in "disc"),
]
_lower = "translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
add(
    "fast_disc",
    lambda s, d: interviews(s, d).selectExpr(
        "interview_id", *(f"regexp_count({_lower}, '{p}') as f_{k}" for k, p in _FAST.items()),
    ).selectExpr(
        *_FAST_OUT,
    ),
    f"{_BASE}, f as (select interview_id, "
    f"{', '.join(f'len(regexp_extract_all({_lower}, {quoted(p)})) as f_{k}' for k, p in _FAST.items())} from base) select "
    f"{', '.join(ansi(c) if c.startswith('cast') else c for c in _FAST_OUT).replace('(80 * f_d) // ' + _FAST_MAX, '(80 * f_d) // greatest(1, ' + _FAST_MAX + ')')} "
    f"from f",
)

_FAMILIES = {"defects": R.STAR_DEFECTS, "findings": R.FINDINGS, "conflicts": R.CONFLICTS, "patterns": R.TRAIT_PATTERNS}
add(
    "rule_hit_rate", lambda s, d: reports.rule_hit_rates(scored(s, d), _FAMILIES),
    f"{O.prelude(WORDS)} "
    f"{O.union([f'''select '{f}' as family, count(*) * {len(rules)} as checks, sum({' + '.join(f'case when {w} then 1 else 0 end' for _, _, w in rules)})::bigint as hits from scored''' for f, rules in _FAMILIES.items()])}",
)
_LETTERS = {d: [x for x in letters] for d, letters in L.UNLIKELY.items()}
add(
    "letter_intersection",
    lambda s, d: scored(s, d).select(
        "interview_id", "disc_top",
        F.array_join(
            F.array_intersect(
                F.split("mbti_type", ""),
                F.element_at(
                    F.create_map(*(x for k, v in _LETTERS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("disc_top"),
                ),
            ),
            "",
        ).alias(
            "letters",
        ),
    ),
    f"{O.prelude(WORDS)} select interview_id, disc_top, "
    f"concat({', '.join(f'''case when contains(case disc_top {' '.join(f"when '{k}' then '{''.join(v)}'" for k, v in _LETTERS.items())} end, mbti_type[{i}]) then mbti_type[{i}] else '' end''' for i in range(1, 5))}) "
    f"as letters from scored",
)


add(
    "timed_segments", lambda s, d: J.timed_segments(zh_turns(s, d)),
    f"with {O.SEGMENTS}, sized as (select *, least(4800, greatest(1200, 120 * length(text)))::bigint as size from segments) select "
    f"interview_id, seg_id, speaker, (sum(size) over (partition by interview_id order by seg_id) - size)::bigint as start_ms, "
    f"(sum(size) over (partition by interview_id order by seg_id))::bigint as end_ms from sized",
)


def diarised(spark, sf_dir):
    """Conversations as the JSON of a diarising service, read back: a round trip over the whole table."""
    rows = T.F.struct(
        "seg_id", T.F.col("speaker").alias("speaker_label"), T.F.trim("text").alias("text"), (T.F.col("seg_id") * 1.5).alias("start"),
        (T.F.col("seg_id") * 1.5 + 1).alias("end"),
    )
    made = zh_turns(spark, sf_dir).groupBy("interview_id").agg(
        F.to_json(F.struct(F.sort_array(F.collect_list(rows)).alias("segments"))).alias("value"),
    ).withColumnRenamed(
        "interview_id", "id",
    )
    return J.diarised_segments(made)


add(
    "diarised_json", diarised,
    f"with {O.SEGMENTS}, s as (select interview_id as id, row_number() over (partition by interview_id order by seg_id) - 1 as at, case "
    f"when speaker = first_value(speaker) over (partition by interview_id order by seg_id) then 'speaker_a' else 'speaker_b' end as "
    f"speaker, trim(text, ' ') as text, round(seg_id * 1500)::bigint as start_ms, round(seg_id * 1500 + 1000)::bigint as end_ms from "
    f"segments) select * from s",
)
add(
    "provider_events",
    lambda s, d: J.provider_events(
        s.read.parquet(f"{d}/events.parquet").select(
            F.col("event_id").alias("id"),
            F.to_json(
                F.struct(
                    F.concat(
                        F.lit("speech."),
                        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "delta").when(
                            F.col("event_type") == "view", "started",
                        ).otherwise(
                            "completed",
                        ),
                    ).alias(
                        "type",
                    ),
                    F.col("event_type").alias("delta"), (F.col("event_id") * 0.5).alias("start"),
                ),
            ).alias(
                "value",
            ),
        ),
    ).select(
        "id", "kind", "text", "start_ms",
    ),
    "select event_id as id, case event_type when 'error' then 'error' when 'click' then 'delta' when 'view' then 'speech_start' else "
    "'completed' end as kind, event_type as text, (event_id * 500)::bigint as start_ms from events",
)
add(
    "case_schema_check",
    lambda s, d: J.case_violations(
        s.read.parquet(f"{d}/labels.parquet").selectExpr(
            "*", "cast(doc_id as varchar(20)) as case_id",
            "case doc_id % 5 when 0 then 'product' when 1 then 'sales' when 2 then 'engineering' when 3 then 'operations' else 'other' end as job_type",
            "case quality when 1 then 'senior' else 'junior' end as level",
            "case when toxic = 1 then 'weak' when quality = 1 then 'strong' else 'medium' end as case_quality",
            "sequence(1, cast(8 + doc_id % 5 as int)) as outline",
            "split(case when doc_id % 7 = 0 then 'D,I,S' else 'S,C,I,D' end, ',') as ranking",
        ),
    ),
    "select doc_id::varchar as case_id, 'job_type' as rule from labels where doc_id % 5 = 4 union all select doc_id::varchar, "
    "'outline' from labels where 8 + doc_id % 5 < 10 union all select doc_id::varchar, 'ranking' from labels where doc_id % 7 = 0",
)
add(
    "library_matrix",
    lambda s, d: s.read.parquet(f"{d}/labels.parquet").selectExpr(
        "case doc_id % 4 when 0 then 'product' when 1 then 'sales' when 2 then 'engineering' else 'operations' end as job",
        "quality + 2 * toxic as q",
    ).groupBy(
        "job",
    ).pivot(
        "q", [0, 1, 2, 3],
    ).count().na.fill(
        0,
    ).withColumnsRenamed(
        {str(i): f"q{i}" for i in range(4)},
    ),
    "select case doc_id % 4 when 0 then 'product' when 1 then 'sales' when 2 then 'engineering' else 'operations' end as job, count(*) "
    "filter (quality + 2 * toxic = 0) as q0, count(*) filter (quality + 2 * toxic = 1) as q1, count(*) filter (quality + 2 * toxic = "
    "2) as q2, count(*) filter (quality + 2 * toxic = 3) as q3 from labels group by 1",
)

add(
    "normalize_text", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", T.normalize_text(F.col("html")).alias("text")),
    "select page_id, regexp_replace(replace(replace(replace(html, chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), "
    "'^[\\s\\x{3000}]+|[\\s\\x{3000}]+$', '', 'g') as text from pages",
)

# one line for each segment again, whichever form the transcript had
_LABEL = " ".join(f"when '{who}' then ({list(names)})[seg_id % {len(names)} + 1]" for who, names in LABELS.items())
add(
    "turn_breaks",
    lambda s, d: flat_transcripts(s, d).select("interview_id", T.turn_breaks(F.col("text")).alias("text")),
    f"""with {O.SEGMENTS}, said as (
        select interview_id, seg_id, case speaker {_LABEL} end || '：' || regexp_replace(text, '\\s+', ' ', 'g') || '。' as line from segments where speaker <> 'unknown'
    ) select interview_id, string_agg(line, chr(10) order by seg_id) as text from said group by interview_id""",
)
