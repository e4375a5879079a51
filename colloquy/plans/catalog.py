"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.expressions import ansi, quoted
from colloquy.operators import scoring as S
from colloquy.operators import turns as T
from colloquy.plans import layers
from colloquy.plans import lexicon as L
from colloquy.plans import oracle as O
from colloquy.plans import oracle_scores as OS
from colloquy.plans import rows as R
from colloquy.plans.layers import ON_ANSWERS, RATIOS
from colloquy.plans.views import flat_transcripts, zh_turns
from colloquy.sources.tables import conversation_segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = L.with_stems()
DISC, OCEAN, TYPES = list("DISC"), list("OCEAN"), [str(k) for k in range(1, 10)]
MODELS = {"disc": (DISC, [f"disc_{d.lower()}" for d in DISC]), "bigfive": (OCEAN, [f"big_{d.lower()}" for d in OCEAN]), "enneagram": (TYPES, [f"type_{k}" for k in TYPES]), "star": (list("STAR"), [f"dim_{d}" for d in "star"])}


def interviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.interviews(zh_turns(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, text: str | None = None) -> DataFrame:
    """Interviews with all features and scores, or with those alone that the text's names lead to."""
    return layers.scored(interviews(spark, sf_dir), WORDS, text)


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def wide(name: str, *columns: str) -> None:
    cols = ["interview_id", *columns]
    add(name, lambda spark, d: scored(spark, d, " ".join(cols)).selectExpr(*cols), O.select(", ".join(ansi(c) for c in cols), words=WORDS))


def ruled(name: str, rules: Sequence[R.Rule], code: str = "code", detail: str = "detail", most: int | None = None) -> None:
    """Rows of the rules that hold."""
    parts = [f"select interview_id, {i}::bigint as ord, {quoted(c)} as {code}, {ansi(d)} as {detail} from scored where {ansi(w)}" for i, (c, d, w) in enumerate(rules)]
    sql = f"{O.prelude(WORDS)}, found as ({O.union(parts)}) select * from found"
    if most is not None:
        sql += f" qualify row_number() over (partition by interview_id order by ord) <= {most}"
    add(
        name, lambda spark, d: S.rows_where(scored(spark, d, str(rules)), rules, most).withColumnsRenamed({"code": code, "detail": detail}),
        sql,
    )


def scores_sql(model: str) -> str:
    dims, columns = MODELS[model]
    return O.union(
        [f"select interview_id, '{model}' as model, '{d}' as dim, {i}::bigint as dim_ord, {c} as score from scored" for i, (d, c) in enumerate(zip(dims, columns, strict=True))],
    )


RANKED = "row_number() over (partition by interview_id order by score desc, dim_ord)"


def ranked_sql(model: str, columns: str = "*", where: str = "true") -> str:
    return f"{O.prelude(WORDS)}, long as ({scores_sql(model)}), ranked as (select *, {RANKED} as rank from long) select {columns} from ranked where {where}"


def ranked(model: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: S.ranked(scored(spark, d, " ".join(MODELS[model][1])), model, *MODELS[model])


# sources and texts
add("conversation_scan", conversation_segments, """
    select conv_id as interview_id, turn as seg_id, case role when 'user' then 'interviewer' when 'assistant' then 'candidate' else 'unknown' end as speaker, text
    from conversations""")
add(
    "qa_pairing", lambda s, d: T.qa_pairs(zh_turns(s, d)).select("interview_id", "turn_id", "question", "answer"),
    f"with {O.SEGMENTS}, {O.TURNS} select interview_id, turn_id, question, answer from turns",
)
add(
    "question_type", lambda s, d: T.qa_pairs(zh_turns(s, d)).select("interview_id", "turn_id", "question_type"),
    f"with {O.SEGMENTS}, {O.TURNS} select interview_id, turn_id, question_type from turns",
)
add(
    "answer_summary", lambda s, d: T.qa_pairs(zh_turns(s, d)).select("interview_id", "turn_id", "answer_summary", "answer_length"),
    f"with {O.SEGMENTS}, {O.TURNS} select interview_id, turn_id, case when length(flat) > 80 then left(flat, 80) || '...' else flat end "
    f"as answer_summary, length(answer) as answer_length from turns",
)
add(
    "normalize_turns", lambda s, d: T.qa_pairs(zh_turns(s, d)),
    f"with {O.SEGMENTS}, {O.TURNS} select interview_id, turn_id, question, question_type, answer, case when length(flat) > 80 then "
    f"left(flat, 80) || '...' else flat end as answer_summary, length(answer) as answer_length from turns",
)


FLAT_SQL = f"""with {O.SEGMENTS}, said as (
    select interview_id, speaker, trim(regexp_replace(text, '\\s+', ' ', 'g') || '。', ' ') as text, row_number() over (partition by interview_id order by seg_id) as seg_id
    from segments where speaker <> 'unknown'
) select interview_id, seg_id, speaker, text from said"""
add("segments", lambda s, d: T.merge_segments(T.speaker_lines(flat_transcripts(s, d))), FLAT_SQL)
add(
    "speaker_lines",
    lambda s, d: T.speaker_lines(flat_transcripts(s, d)).select("interview_id", F.col("line").cast("long").alias("line"), "role", "text"),
    FLAT_SQL.replace(
        "select interview_id, seg_id, speaker, text from said", "select interview_id, seg_id - 1 as line, speaker as role, text from said",
    ),
)
add(
    "display_transcript", lambda s, d: interviews(s, d).select("interview_id", F.col("w").alias("transcript")),
    f"with {O.SEGMENTS}, {O.TURNS}, {O.INTERVIEWS} select interview_id, w as transcript from base",
)
add(
    "candidate_text", lambda s, d: interviews(s, d).select("interview_id", F.col("t").alias("answers")),
    f"with {O.SEGMENTS}, {O.TURNS}, {O.INTERVIEWS} select interview_id, t as answers from base",
)
add(
    "segment_counts", lambda s, d: interviews(s, d).select("interview_id", "n_segments", "n_turns", "cand_chars"),
    f"with {O.SEGMENTS}, {O.TURNS}, {O.INTERVIEWS} select interview_id, n_segments, n_turns, cand_chars from base",
)
add(
    "sentences",
    lambda s, d: interviews(s, d).select("interview_id", F.posexplode(T.sentences(F.col("t"))).alias("at", "sentence")).withColumn(
        "at", F.col("at").cast("long"),
    ),
    f"with {O.SEGMENTS}, {O.TURNS}, {O.INTERVIEWS} select interview_id, unnest(parts) as sentence, generate_subscripts(parts, 1) - 1 as "
    f"at from (select interview_id, list_filter(list_transform(string_split_regex(t, '[。！？!?；;\\n]+'), lambda s: "
    f"{O._TRIM.format('s')}), lambda s: s <> '') as parts from base)",
)

# features
wide("text_stats", "text_length", "word_count", "sent", "avg_sentence")
wide("keyword_counts", *(f"n_{k}" for k in ON_ANSWERS), "n_team", "n_asked", "n_numbers")
wide("lexicon_hits", *(f"h_{k}" for k in WORDS if k.startswith(("disc_", "pos_", "neg_", "type_", "side_"))))
wide("density_ratios", *(f"{k}_ratio" for k in RATIOS), "question_ratio", "team_result_ratio")
wide("star_structure", "structure")
wide("topic_stability", "n_types", "n_turns", "stability")
wide("story_richness", "n_detail", "n_numbers", "richness")
wide("self_team_balance", "n_singular", "team_count", "self_team_ratio", "orientation", "focus", "balance", "abstraction")
wide(
    "star_subscores", *(f"cast(sub_{d} as double) / 10000 as star_{d}_score" for d in "star"),
    *(f"n_star_{d} as strong_{d}" for d in "star"), *(f"n_weak_{d} as weak_{d}" for d in "star"),
)
wide(
    "feature_highlights",
    *(f"cast(floor({c} * 100) as bigint) as {c}_percent" for c in (
        "action_ratio", "emotional_ratio", "social_ratio", "logical_ratio", "hedge_ratio", "structure", "stability", "richness",
        "buzzword_ratio", "detail_ratio",
    )),
)

# scores
wide(
    "score_table", "sample_quality", *(c for _, cols in MODELS.values() for c in cols), "mbti_type", "star_overall", "disc_confidence",
    "mbti_confidence", "big_confidence", "type_confidence", "star_confidence",
)
wide(
    "mbti_axes", *(f"{p}_{(a + b).lower()}" for a, b in L.AXES for p in ("pref", "strength")), *(f"side_{x}" for x in "eintfjps"),
    "sample_quality", "mbti_confidence",
)
wide("mbti_type", "mbti_type", "sample_quality", "mbti_confidence")
wide("star_dimensions", *(f"dim_{d}" for d in "star"), "star_confidence")
wide("star_overall", "star_overall", "star_confidence")
wide("sample_quality", "word_count", "n_turns", "sample_quality")
wide("impression_risk", "buzzword_ratio", "richness", "impression_risk")
wide("mbti_confidence", "n_clear", "n_neutral", "mbti_confidence")
wide("bigfive_confidence", "big_confidence")
wide("enneagram_confidence", "type_max", "type_second_score", "type_confidence")
wide("n_artifact", "big_n", "big_e", "n_artifact")
wide("enneagram_wing", "type_top", "type_second", "wing")
wide("primary_style_label", "disc_top", "big_top", "style_label")
wide(
    "integrated_profile", "disc_top", "disc_second", "big_top", "type_top", "type_second", "mbti_type", "style_label", "wing",
    "sample_quality", "disc_confidence", "big_confidence", "type_confidence", "mbti_confidence",
)
_REASONS = {"short_sample": "cand_chars < 300", "few_turns": "n_turns < 3", "no_clear_style": "disc_max < 60", "open_axes": "n_open >= 2", "high_conflict": "(disc_d >= 70 or disc_c >= 70) and mbti_type like '%P%'", "star_defect": "n_high > 0", "impression": "impression_risk = 'high'"}
_FIRST_HIGH = "case " + " ".join(f"when ({w}) and ({d}) = 'high' then '{c}'" for c, d, w in R.FINDINGS) + " end"
_FIRST_GAP = "case " + " ".join(f"when {w} then '{c}'" for c, _, w in R.GAPS) + " end"
_ANY_MEDIUM = " or ".join(f"(({w}) and ({d}) = 'medium')" for c, d, w in R.FINDINGS)
wide(
    "decision_outputs", f"coalesce({_FIRST_HIGH}, {_FIRST_GAP}, 'stable') as blocker",
    f"case when {_FIRST_HIGH} is not null then 'verify_first' when impression_risk = 'high' then 'authenticity' when {_ANY_MEDIUM} or "
    f"impression_risk = 'medium' then 'medium' else 'none' end as risk",
    f"case when {_FIRST_HIGH} is not null then 'challenge' when disc_confidence = 'low' then 'collect_more' else 'verify' end as action",
)

# the scores once more, against words and rules as rows: (prefix of the columns, dimensions)
STATED = {"disc": "disc", "big": "ocean", "type": "123456789"}
for _prefix, _dims in STATED.items():
    _cols = [f"{_prefix}_{d}" for d in _dims]
    _name = {"disc": "disc", "big": "bigfive", "type": "enneagram"}[_prefix]
    wide(f"{_name}_scores", *_cols, "sample_quality", f"{_prefix}_confidence")
    ORACLES[f"{_name}_scores"] = f"{O.prelude(WORDS)}, stated as materialized ({OS.wide_scores(WORDS, {_prefix: _dims})} select * from result) select interview_id, {', '.join('stated.' + c for c in _cols)}, sample_quality, {_prefix}_confidence from scored join stated using (interview_id)"
_SIDE = "eintfjps"


def _axis(a: str, b: str) -> str:
    """Preference and strength of an axis from its sides."""
    share = f"side_{a}::double / (side_{a} + side_{b}) * 100"
    few = f"side_{a} + side_{b} < 5"
    return f"""case when {few} then 'unclear' when {share} > 55 then '{a.upper()}' when {share} < 45 then '{b.upper()}' else 'neutral' end as pref_{a}{b},
        (case when {few} then 50 when {share} > 55 then floor({share}) when {share} < 45 then floor(100 - {share}) else 50 end)::bigint as strength_{a}{b}"""


ORACLES["mbti_axes"] = f"""{O.prelude(WORDS)}, stated as materialized ({OS.wide_scores(WORDS, {'side': _SIDE})} select * from result)
select interview_id, {', '.join('stated.side_' + x for x in _SIDE)}, {', '.join(_axis(a, b) for a, b in ('ei', 'ns', 'tf', 'jp'))}, sample_quality, mbti_confidence from (select interview_id, sample_quality, mbti_confidence from scored) join stated using (interview_id)"""
ORACLES["keyword_counts"] = f"""with {OS.features(WORDS)}
select interview_id, {', '.join(f"coalesce(max(n) filter (category = '{k}'), 0) as n_{k}" for k in ON_ANSWERS)}, coalesce(max(n) filter (category = 'team'), 0) as n_team, max(asked) as n_asked, max(numbers) as n_numbers
from counted join sizes using (interview_id) group by interview_id"""
ORACLES["lexicon_hits"] = f"""with {OS.features(WORDS)}
select interview_id, {', '.join(f"coalesce(max(n) filter (category = '{k}'), 0) as h_{k}" for k in WORDS if k.startswith(("disc_", "pos_", "neg_", "type_", "side_")))} from held group by interview_id"""
ORACLES["star_structure"] = f"with {OS.features(WORDS)} select interview_id, max(num) filter (name = 'structure') as structure from feature group by interview_id"

# confidence with its reasons
wide("disc_confidence", "sample_quality", "contradictions", "disc_confidence")
wide("star_confidence", "n_high", "star_confidence", "star_notes")
for _a, _b in [("line", "concat('{0}: ', pref_{1}, ' ', cast(strength_{1} as varchar(9)), '% ', conf_{1})")]:
    wide("axis_highlights", *(f"{_b.format(a + b, (a + b).lower())} as {_a}_{(a + b).lower()}" for a, b in L.AXES))
_REASONS = {
    "short_sample": "cand_chars < 300",
    "few_turns": "n_turns < 3",
    "no_clear_style": "disc_max < 60",
    "malformed_scores": "disc_d is null or disc_i is null or disc_s is null or disc_c is null",
    "open_axes": "n_open >= 2",
    "high_conflict": "(disc_d >= 70 or disc_c >= 70) and mbti_type like '%P%'",
    "star_defect": "n_high > 0",
    "impression": "impression_risk = 'high'",
}
_WHY = ", ".join(f"case when {c} then '{k}' end" for k, c in _REASONS.items())
_ANY = " or ".join(f"({c})" for c in _REASONS.values())
wide("escalation_filter", f"concat_ws(' | ', {_WHY}) as reasons", f"case when {_ANY} then true else false end as escalate")

# detections
ruled("star_defects", R.STAR_DEFECTS, "defect", "severity")
ruled("star_risk_signals", R.RISK_SIGNALS, "signal", "severity")
ruled("star_disc_signals", R.DISC_SIGNALS, "signal", "hint")
ruled("critical_findings", R.FINDINGS, "finding", "severity", most=4)
ruled("capped_lists", R.GAPS, "gap", "kind", most=5)
ruled("hire_risks", R.HIRE_RISKS, "risk", "kind", most=4)
ruled("bigfive_patterns", R.TRAIT_PATTERNS, "pattern", "kind")
ruled("enneagram_risks", R.TYPE_RISKS, "risk", "severity")
ruled("defect_interactions", R.INTERACTIONS, "interaction", "kind")
ruled("disc_mbti_conflicts", R.CONFLICTS, "conflict", "severity")
ruled("graph_conflicts", R.GRAPH_CONFLICTS, "conflict", "severity", most=5)
ruled("confidence_adjustments", R.ADJUSTMENTS, "adjustment", "reason")
ruled("style_hypotheses", R.HYPOTHESES, "place", "style")
ruled("axis_questions", R.AXIS_QUESTIONS, "axis", "priority", most=4)

# rankings
for _model in MODELS:
    add(f"{_model}_ranking", ranked(_model), ranked_sql(_model))
add("score_ranking", ranked("disc"), ranked_sql("disc"))
add(
    "score_band", lambda s, d: ranked("bigfive")(s, d).select("interview_id", "dim", "score", S.band(F.col("score")).alias("band")),
    ranked_sql(
        "bigfive",
        "interview_id, dim, score, case when score <= 24 then 'low' when score <= 49 then 'guarded' when score <= 74 then 'clear' else 'strong' end as band",
    ),
)
_TOP = "max(score) over (partition by interview_id)"
_RULES_AT = "case dim " + " ".join(f"when '{k}' then rules_{k}" for k in range(1, 10)) + " end"
_HITS_AT = "case dim " + " ".join(f"when '{k}' then h_type_{k}" for k in range(1, 10)) + " end"

_TOP = "max(score) over (partition by interview_id)"
add(
    "secondary_traits",
    lambda s, d: S.ranked(scored(s, d, " ".join(MODELS["bigfive"][1]) + " big_max"), "bigfive", *MODELS["bigfive"], ["big_max"]).where(
        "rank in (2, 3) and 10 * score >= 7 * big_max",
    ).select(
        "interview_id", "dim", "score", "rank",
    ),
    f"{O.prelude(WORDS)}, long as ({scores_sql('bigfive')}), ranked as (select *, {RANKED} as rank, {_TOP} as top from long) select "
    f"interview_id, dim, score, rank from ranked where rank in (2, 3) and 10 * score >= 7 * top",
)
_LEVEL = "case when score >= 65 then 'high' when score >= 50 then 'medium' else 'low' end"
_AT = lambda prefix: "case dim " + " ".join(f"when '{k}' then {prefix}_{k}" for k in TYPES) + " end"
_SIGNS = "case when hits >= 5 and rules >= 3 then 'words,rules' when hits >= 5 then 'words' when rules >= 3 then 'rules' else 'weak' end"
_TYPE_ROWS = ["*", f"{_AT('h_type')} as hits", f"{_AT('rules')} as rules"]
_TYPE_CARRY = [f"{p}_{k}" for p in ("h_type", "rules") for k in TYPES]


def type_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked types with their keyword hits and the rules that hold."""
    row = scored(spark, sf_dir, " ".join(MODELS["enneagram"][1] + _TYPE_CARRY))
    return S.ranked(row, "enneagram", *MODELS["enneagram"], _TYPE_CARRY).selectExpr(*_TYPE_ROWS)


_TYPES_SQL = f"{O.prelude(WORDS)}, long as ({scores_sql('enneagram')}), ranked as (select *, {RANKED} as rank from long), with_ as (select r.*, {_AT('h_type')} as hits, {_AT('rules')} as rules from ranked r join scored using (interview_id))"
_TWO = ["interview_id", "dim as type", "score", "rank", f"{_LEVEL} as level", f"{_SIGNS} as evidence"]
add(
    "top_two_types", lambda s, d: type_rows(s, d).where("rank <= 2").selectExpr(*_TWO),
    f"{_TYPES_SQL} select {', '.join(_TWO)} from with_ where rank <= 2",
)
_FOUR = ["interview_id", "dim as type", "rank", "score", f"{_LEVEL} as band", "hits", "rules"]
add(
    "enneagram_evidence", lambda s, d: type_rows(s, d).where("rank <= 4").selectExpr(*_FOUR),
    f"{_TYPES_SQL} select {', '.join(_FOUR)} from with_ where rank <= 4",
)
_PROBE_VALUES = ", ".join(f"('{d}', '{c}', '{x}')" for d, (c, x) in R.STYLE_PROBES.items())


def probe_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each style with the question of its place: confirm the first two, challenge the last two. The table of probes has four rows."""
    table = spark.sql(f"select * from values {_PROBE_VALUES} as p(dim, confirm, challenge)")
    rows = ranked("disc")(spark, sf_dir).join(F.broadcast(table), "dim")
    return rows.selectExpr(
        "interview_id", "dim", "rank", "case when rank <= 2 then 'confirm' else 'challenge' end as probe",
        "case when rank <= 2 then confirm else challenge end as question",
    )


add(
    "probe_plan", probe_plan,
    f"{O.prelude(WORDS)}, long as ({scores_sql('disc')}), ranked as (select *, {RANKED} as rank from long) select interview_id, r.dim, "
    f"rank, case when rank <= 2 then 'confirm' else 'challenge' end as probe, case when rank <= 2 then confirm else challenge end as "
    f"question from ranked r join (values {_PROBE_VALUES}) p(dim, confirm, challenge) on p.dim = r.dim",
)
_SHARE = "case when total = 0 then cast(0 as double) else cast((20000 * score + total) div (2 * total) as double) / 10000 end"
_OFFSET = "case when total = 0 then cast(0 as double) else cast((20000 * before + total) div (2 * total) as double) / 10000 end"


def score_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each style's share of the sum of the four, and where it begins if they are put one after the other."""
    row = scored(spark, sf_dir, " ".join(MODELS["disc"][1]))
    rows = S.ranked(
        row, "disc", *MODELS["disc"],
        ["disc_d + disc_i + disc_s + disc_c as total", "array(0, disc_d, disc_d + disc_i, disc_d + disc_i + disc_s) as sums"],
    )
    return rows.selectExpr("interview_id", "dim", f"{_SHARE} as share", "sums[cast(dim_ord as int)] as before", "total").selectExpr(
        "interview_id", "dim", "share", f"{_OFFSET} as offset",
    )


add(
    "score_share", score_share,
    f"{O.prelude(WORDS)}, long as ({scores_sql('disc')}), sums as (select *, sum(score) over (partition by interview_id)::bigint as "
    f"total, (sum(score) over (partition by interview_id order by dim_ord) - score)::bigint as before from long) select interview_id, "
    f"dim, {ansi(_SHARE)} as share, {ansi(_OFFSET)} as offset from sums",
)
_UNION_SQL = O.union(
    [f"select interview_id, {i}::bigint as ord, {quoted(k)} as type, {sev} as severity, {quoted(text)} as description from scored where "
    f"{ansi(w)}" for i, (k, sev, w, text) in enumerate(R.UNION)],
)
add(
    "conflict_union",
    lambda s, d: S.conflict_union(scored(s, d, str(R.UNION)), R.UNION),
    f"{O.prelude(WORDS)}, found as ({_UNION_SQL}), once as (select * from found qualify row_number() over (partition by interview_id, "
    f"type, left(description, 40) order by ord) = 1) select * from once qualify row_number() over (partition by interview_id order by "
    f"ord) <= 8",
)

# mappings and probes
_PROBE_ROWS = O.union(
    [f"select interview_id, defect_{k} as severity, {i} as ord, '{k}' as defect, {j} as n, '{q}' as question from scored where "
    f"defect_{k} is not null" for i, (k, qs) in enumerate(R.PROBES.items()) for j, q in enumerate(qs)],
)
add(
    "probe_lookup", lambda s, d: S.probes(scored(s, d, " ".join(f"defect_{k}" for k in R.PROBES))),
    f"{O.prelude(WORDS)}, asked2 as ({_PROBE_ROWS}), placed as (select *, row_number() over (partition by interview_id order by case "
    f"severity when 'high' then 0 when 'medium' then 1 else 2 end, ord, n) as place from asked2) select interview_id, defect, severity, "
    f"question, place from placed qualify row_number() over (partition by interview_id, question order by place) = 1",
)
add(
    "severity_order",
    lambda s, d: S.rows_where(scored(s, d, str(R.STAR_DEFECTS)), R.STAR_DEFECTS).selectExpr(
        "interview_id", "code as defect", "detail as severity",
        "row_number() over (partition by interview_id order by case detail when 'high' then 0 when 'medium' then 1 else 2 end, ord) as place",
    ).withColumn(
        "place", F.col("place").cast("long"),
    ),
    f"{O.prelude(WORDS)}, found as "
    f"({O.union([f'select interview_id, {quoted(c)} as defect, {d} as severity, {i} as ord from scored where {w}' for i, (c, d, w) in enumerate(R.STAR_DEFECTS)])}) "
    f"select interview_id, defect, severity, row_number() over (partition by interview_id order by case severity when 'high' then 0 "
    f"when 'medium' then 1 else 2 end, ord) as place from found",
)
_DISC_TYPES = ", ".join(f"('{d}', '{t}', {w}::double)" for d, types in L.DISC_TO_TYPE.items() for t, w in types)
add(
    "disc_to_enneagram", lambda s, d: S.disc_to_types(scored(s, d, "disc_top")),
    f"{O.prelude(WORDS)} select interview_id, disc_top, v.type, v.weight from scored join (values {_DISC_TYPES}) v(disc, type, weight) on v.disc = disc_top",
)
_DISC_BIG = ", ".join(f"('{d}', '{b}', {w}::double)" for d, dims in L.DISC_TO_BIGFIVE.items() for b, w in dims.items() if abs(w) >= 0.3)
add(
    "dim_adjustments", lambda s, d: S.dim_adjustments(scored(s, d, "disc_top")),
    f"{O.prelude(WORDS)} select interview_id, disc_top, v.dim, v.adjustment from scored join (values {_DISC_BIG}) v(disc, dim, "
    f"adjustment) on v.disc = disc_top",
)
_BIG_TYPES = O.union(
    [f"select interview_id, {i} as ord, '{c}' as type, {d} as weight from scored where {w}" for i, (c, d, w) in enumerate(S.BIGFIVE_TYPES)],
)
add(
    "bigfive_to_enneagram", lambda s, d: S.bigfive_to_types(scored(s, d, str(S.BIGFIVE_TYPES))),
    f"{O.prelude(WORDS)}, found as ({_BIG_TYPES}) select interview_id, type, weight, row_number() over (partition by interview_id order "
    f"by weight desc, ord) as rank from found qualify rank <= 3",
)
_ROLES = "case {} " + " ".join(f"when '{k}' then ['" + "','".join(v) + "']" for k, v in R.STYLE_ROLES.items()) + " end"
add(
    "role_recommendation", lambda s, d: S.style_roles(scored(s, d, "disc_top disc_second")),
    f"{O.prelude(WORDS)}, both_ as (select interview_id, {_ROLES.format('disc_top')} || {_ROLES.format('disc_second')} as r from "
    f"scored) select interview_id, array_to_string((list_filter(r, lambda x, i: list_position(r, x) = i))[1:4], ',') as roles from both_",
)
_MOTIVE = ", ".join(f"('{k}', '{m}', '{f}', '{w}')" for k, (m, f, w) in R.MOTIVES.items())
add(
    "motivation_lookup", lambda s, d: S.motives(scored(s, d, "type_top type_max")),
    f"{O.prelude(WORDS)} select interview_id, type_top, v.motive, v.fear, v.desire, case when type_max >= 70 then 'marked' when "
    f"type_max >= 50 then 'present' else 'faint' end as level from scored join (values {_MOTIVE}) v(k, motive, fear, desire) on v.k = "
    f"type_top",
)

_PARTS = f"""big as ({_BIG_TYPES}), long as ({scores_sql('enneagram')}), parts as (
    select interview_id, type, weight as p, 'bigfive' as source from big
    union all select interview_id, v.type, round(v.weight * 100)::bigint, 'disc' from scored join (values {_DISC_TYPES}) v(disc, type, weight) on v.disc = disc_top
    union all select interview_id, dim, score, 'direct' from long
), total as (select interview_id, type, sum(p)::bigint as points, string_agg(distinct source, ',' order by source) as sources from parts group by all)"""
add(
    "enneagram_fusion",
    lambda s, d: S.type_fusion(scored(s, d, str(S.BIGFIVE_TYPES) + " disc_top " + " ".join(MODELS["enneagram"][1]))),
    f"{O.prelude(WORDS)}, {_PARTS} select *, row_number() over (partition by interview_id order by points desc, type) as rank from total qualify rank <= 3",
)


def listed(rules: Sequence[R.Rule], most: int) -> str:
    """SQL of the codes of the first rules that hold, joined."""
    return f"array_to_string(list_filter([{', '.join(f'case when {ansi(w)} then {quoted(c)} end' for c, _, w in rules)}], lambda x: x is not null)[1:{most}], ',')"


def masking_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = scored(spark, sf_dir, "disc_confidence sample_quality impression_risk " + str((R.FINDINGS, R.HIRE_RISKS, R.GAPS)))
    lists = ((R.FINDINGS, 4, "findings"), (R.HIRE_RISKS, 4, "risks"), (R.GAPS, 5, "gaps"))
    return row.select(
        "interview_id", "disc_confidence", "sample_quality", "impression_risk",
        *(F.array_join(S.codes(rules, most), ",").alias(name) for rules, most, name in lists),
    )


add(
    "masking_view", masking_view,
    f"{O.prelude(WORDS)} select interview_id, disc_confidence, sample_quality, impression_risk, {listed(R.FINDINGS, 4)} as findings, "
    f"{listed(R.HIRE_RISKS, 4)} as risks, {listed(R.GAPS, 5)} as gaps from scored",
)
_LABELS = ", ".join(f"('{k}', '{v}')" for k, v in R.DEFECT_LABELS.items())


def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects with their labels, and the code where there is none. The table of labels has a fixed size."""
    table = spark.sql(f"select * from values {_LABELS} as l(defect, label)")
    rows = S.rows_where(scored(spark, sf_dir, str(R.STAR_DEFECTS)), R.STAR_DEFECTS).selectExpr(
        "interview_id", "code as defect", "detail as severity",
    )
    return rows.join(F.broadcast(table), "defect", "left").selectExpr(
        "interview_id", "defect", "severity", "coalesce(label, defect) as label",
    )


_FOUND = O.union([f"select interview_id, {quoted(c)} as defect, {d} as severity from scored where {w}" for c, d, w in R.STAR_DEFECTS])
add(
    "label_lookup", label_lookup,
    f"{O.prelude(WORDS)}, found as ({_FOUND}) select interview_id, f.defect, severity, coalesce(label, f.defect) as label from found f "
    f"left join (values {_LABELS}) l(defect, label) on l.defect = f.defect",
)
