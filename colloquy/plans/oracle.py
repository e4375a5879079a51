"""The same interviews, features and scores as one ANSI SQL statement over the conversation table."""

from __future__ import annotations

from collections.abc import Sequence

from colloquy.functions.expressions import ansi, quoted
from colloquy.plans import lexicon as L
from colloquy.plans.layers import all_layers
from colloquy.plans.views import SAMPLE_SENTENCES

_LIST = "[" + ", ".join(map(quoted, SAMPLE_SENTENCES)) + "]"
_KIND = "case when coalesce(question, '') = '' then 'unlabelled' " + " ".join("when " + " or ".join(f"contains(question, {quoted(w)})" for w in words) + f" then '{kind}'" for kind, words in L.QUESTIONS) + " else 'general' end"
_TRIM = r"regexp_replace({}, '^[\s\x{{3000}}]+|[\s\x{{3000}}]+$', '', 'g')"
_FLAT = r"regexp_replace({}, '[\s\x{{3000}}]+', '', 'g')"

SEGMENTS = f"""segments as (
    select conv_id as interview_id, turn as seg_id, case role when 'user' then 'interviewer' when 'assistant' then 'candidate' else 'unknown' end as speaker,
           {_LIST}[((conv_id * 7 + turn * 5) % 12) + 1] || {_LIST}[((conv_id * 3 + turn * 11 + 4) % 12) + 1] || coalesce(text, '') as text
    from conversations
)"""
_PAST = "over (partition by interview_id order by seg_id rows between unbounded preceding and 1 preceding)"
TURNS = f"""past as (
    select *, max(case when speaker = 'interviewer' then seg_id end) {_PAST} as q_id, max(case when speaker = 'candidate' then seg_id end) {_PAST} as c_id,
           last_value(case when speaker = 'interviewer' then text end ignore nulls) {_PAST} as q
    from segments
), asked as (
    select interview_id, seg_id, speaker, text, coalesce({_TRIM.format("case when c_id is null or q_id > c_id then q end")}, '') as question from past
), turns as (
    select interview_id, row_number() over (partition by interview_id order by seg_id) as turn_id, question, {_KIND} as question_type, {_TRIM.format('text')} as answer, {_FLAT.format('text')} as flat
    from asked where speaker = 'candidate' qualify answer <> ''
)"""
INTERVIEWS = f"""told as (
    select interview_id, string_agg(answer, chr(10) order by turn_id) as t, count(*) as n_turns, count(distinct question_type) as n_types, sum(length(answer)) as cand_chars from turns group by interview_id
), whole as (
    select interview_id, string_agg(case speaker when 'interviewer' then '面试官' when 'candidate' then '候选人' else '发言人' end || '：' || text, chr(10) order by seg_id) as w, count(*) as n_segments from segments group by interview_id
), base0 as (
    select interview_id, coalesce(t, '') as t, w, n_segments, coalesce(n_turns, 0) as n_turns, coalesce(n_types, 0) as n_types, coalesce(cand_chars, 0)::bigint as cand_chars from whole left join told using (interview_id)
), base as (
    select *, len(parts) as sent, coalesce(list_sum(list_transform(parts, lambda x: length(x))), 0)::bigint as sent_chars
    from (select *, list_filter(list_transform(string_split_regex(t, '[。！？!?；;\\n]+'), lambda s: {_TRIM.format('s')}), lambda s: s <> '') as parts from base0)
)"""


def prelude(words=None) -> str:
    """WITH clause that ends with the table `scored`: every layer."""
    steps, last = [], "base"
    layers = all_layers(words)
    for i, layer in enumerate(layers):
        name = "scored" if i == len(layers) - 1 else f"layer{i}"
        steps.append(f"{name} as materialized (select *, {', '.join(f'{ansi(e)} as {n}' for n, e in layer.items())} from {last})")
        last = name
    return "with " + ",\n".join([SEGMENTS, TURNS, INTERVIEWS, *steps])


def select(columns: str, source: str = "scored", words=None) -> str:
    return f"{prelude(words)}\nselect {columns} from {source}"


def union(cases: Sequence[str]) -> str:
    return "\nunion all\n".join(cases)
