"""SQL for features and scores that shares nothing with the compiled columns but the word lists.

Words and rules are rows here: words are counted by splitting each text at them, features are unpivoted, and a rule holds
where all its conditions join. The rules are stated once more, in a notation of their own (fixed values), so a slip in
the compiled tables shows as a difference.
"""

from __future__ import annotations

import re

from colloquy.functions.expressions import quoted
from colloquy.plans import oracle as O
from colloquy.plans.layers import TEAM

#: Points by dimension; conditions joined by & hold together.
DISC = """
D: action>=.02 +18; achievement>=.015 +15; hedge<=.006 +8; focus=problem +8; qualifier>=.015 -10
I: social>=.018 +18; emotional>=.008 +15; plural>=.01 +10; richness>=.65 +6; abstraction=grounded & social<.01 -8
S: stability>=.72 +15; orientation=team +18; balance=balanced +8; hedge>=.004 & hedge<=.015 +6; imperative>=.012 -10
C: logical>=.015 +18; detail>=.015 +15; structure>=.75 +12; qualifier>=.008 +8; stability<.55 -10
"""
BIGFIVE = """
O: abstraction=abstract +15; hedge>=.005 +10; qualifier>=.006 +8; process>=.006 +6; abstraction=grounded & detail>=.010 -8
C: process>=.008 +15; detail>=.008 +12; structure>=.60 +10; logical>=.008 +8; qualifier>=.006 +5; hedge>=.010 -6
E: emotional>=.005 +15; social>=.006 +12; plural>=.006 +10; richness>=.55 +7; avg_sentence>=15 +5; social<.005 & process>=.008 -10
A: plural>=.008 +15; social>=.006 +12; hedge>=.004 +8; contrast>=.006 -10; imperative>=.008 -8
N: emotional>=.007 +18; risk>=.006 +12; hedge>=.008 +8; certainty>=.006 -10; hedge<.003 -6
"""
ENNEAGRAM = """
1: certainty>=.006 +16; process>=.012 +14; imperative>=.010 +12; qualifier>=.008 +10; logical>=.010 +10; hedge<=.006 -12; buzzword>=.010 -8
2: social>=.012 +18; emotional>=.007 +14; plural>=.010 +14; singular>=.020 -8; imperative>=.015 -10; achievement>=.015 -6
3: achievement>=.015 +20; action>=.020 +16; structure>=.70 +14; singular>=.018 +12; buzzword>=.008 +10; hedge<=.004 -12; question<=.06 -8; plural>=.015 -6
4: singular>=.025 +20; emotional>=.010 +16; avg_sentence>=20 +12; plural<=.006 -14; social<=.008 -8; process<=.008 -8
5: detail>=.015 +18; logical>=.012 +16; process>=.012 +14; qualifier>=.010 +12; risk>=.012 +12; avg_sentence>=20 +10; social<=.008 -14; emotional<=.005 -10; plural<=.006 -10; imperative<=.006 -8
6: risk>=.012 +20; hedge>=.008 +16; qualifier>=.012 +14; logical>=.010 +12; plural>=.010 +12; certainty>=.010 -8; imperative>=.015 -8; hedge<=.003 -6
7: emotional>=.010 +18; hedge>=.008 +16; avg_sentence>=20 +14; richness>=.65 +12; singular>=.018 +10; stability<=.65 -8; detail<=.010 -8; logical<=.008 -8; risk<=.006 -8
8: imperative>=.015 +20; certainty>=.007 +16; singular>=.022 +18; contrast>=.008 +14; action>=.020 +12; hedge<=.004 -16; plural>=.015 -8; social<=.008 -8; qualifier<=.005 -6
9: plural>=.014 +20; social>=.014 +16; hedge>=.010 +14; contrast<=.004 -14; imperative<=.005 -14; certainty<=.005 -12; singular>=.025 -8; action>=.025 -6
"""
#: Strong, soft and opposing rules of each side, split by bars; numbers get a tolerance of 5 %.
MBTI = """
E: social>=.015; plural>=.012; orientation=team | richness>=.65; question>=.08 | singular>.025; social<.005
I: singular>=.018; social<.008; orientation=self | avg_sentence>=25; stability>=.70 | plural>.015; emotional>.012
N: abstraction=abstract; abstract>=.008; hedge>=.008 | qualifier>=.010; detail<.012 | detail>.020; structure>.85
S: detail>=.015; abstraction=grounded; structure>=.75 | richness>=.70; certainty>=.005 | abstract>.012; hedge>.015
T: logical>=.015; focus=problem; emotional<.006 | certainty>=.006; detail>=.012 | emotional>.012; focus=people
F: emotional>=.010; focus=people; social>=.012 | plural>=.010; hedge>=.008 | logical>.020; emotional<.004
J: structure>=.75; action>=.018; certainty>=.005 | stability>=.70; qualifier<.008 | hedge>.012; qualifier>.015
P: hedge>=.010; qualifier>=.012; action<.015 | question>=.08; stability<.65 | certainty>.008; structure>.80
"""


def _stated() -> tuple[list[str], list[str]]:
    """Rows of the rules (model, dim, rule, points, conditions) and of their conditions (rule, name, op, number, label)."""
    rules, conditions = [], []

    def add(model: str, dim: str, text: str, points: int, tolerance: bool) -> None:
        rule = len(rules)
        parts = [re.fullmatch(r"\s*(\w+)(>=|<=|=|>|<)([\w.]+)\s*", p).groups() for p in text.split("&")]
        rules.append(f"('{model}', '{dim}', {rule}, {points}, {len(parts)})")
        for name, op, value in parts:
            number = re.fullmatch(r"[\d.]+", value)
            limit = round(float(value) * ((0.95 if ">" in op else 1.05) if tolerance else 1), 6) if number else None
            conditions.append(f"({rule}, '{name}', '{op}', {limit if number else 'null'}::double, {'null' if number else quoted(value)})")

    for model, text in (("disc", DISC), ("big", BIGFIVE), ("type", ENNEAGRAM)):
        for line in text.strip().splitlines():
            dim, said = line.split(": ", 1)
            for rule in said.split("; "):
                condition, points = rule.rsplit(" ", 1)
                add(model, dim.lower(), condition, int(points), False)
    for line in MBTI.strip().splitlines():
        dim, said = line.split(": ", 1)
        for points, group in zip((25, 12, -15), said.split(" | "), strict=True):
            for condition in group.split("; "):
                add("side", dim.lower(), condition, points, True)
    return rules, conditions


RATIOS = "action emotional social certainty hedge achievement process detail risk imperative qualifier logical contrast abstract buzzword singular plural".split()


def features(words: dict[str, tuple[str, ...]]) -> str:
    """CTEs that end with feature (interview_id, name, num, txt) and held (interview_id, category, n), hits in the whole transcript."""
    pairs = ", ".join(f"({quoted(k)}, {quoted(w)})" for k, ws in words.items() for w in ws)
    team = ", ".join(f"('team', {quoted(w)})" for w in TEAM)
    n = lambda k: f"coalesce(max(n) filter (category = '{k}'), 0)"
    return f"""{O.SEGMENTS}, {O.TURNS}, {O.INTERVIEWS}, lexicon(category, word) as (values {pairs}, {team}),
counted as (select interview_id, category, sum(len(string_split(t, word)) - 1)::bigint as n from base, lexicon group by all),
held as (select interview_id, category, sum(len(string_split(w, word)) - 1)::bigint as n from base, lexicon group by all),
sizes as (
    select interview_id, greatest(1, length(regexp_replace(t, '[\\s\\x{{3000}}]+', '', 'g')))::bigint as chars, sent, sent_chars, n_turns, n_types,
           len(regexp_extract_all(t, '[0-9]+[%个天周月年人]')) as numbers, (length(t) - length(replace(replace(t, '？', ''), '?', '')))::bigint as asked
    from base
),
wide as (select interview_id, {', '.join(f"{n(k)} as {k}" for k in ('singular', 'plural', 'team', 'process', 'detail', 'risk', 'social', 'action', 'reflection', 'abstract'))},
           count(*) filter (category in ('star_s', 'star_t', 'star_a', 'star_r') and n > 0) as parts from counted group by interview_id),
feature(interview_id, name, num, txt) as (
    select interview_id, category, ((20000 * n + chars) // (2 * chars))::double / 10000, null from counted join sizes using (interview_id)
    union all select interview_id, 'question', ((20000 * asked + greatest(sent, 1)) // (2 * greatest(sent, 1)))::double / 10000, null from sizes
    union all select interview_id, 'avg_sentence', case when sent = 0 then 0 else ((200 * sent_chars + sent) // (2 * sent))::double / 100 end, null from sizes
    union all select interview_id, 'stability', case when n_turns <= 1 then 0.6 else least(1, (45 + (40 * n_types)::double / n_turns) / 100) end, null from sizes
    union all select interview_id, 'richness', least(1, (5 + detail + numbers)::double / 25), null from wide join sizes using (interview_id)
    union all select interview_id, 'structure', parts::double / 4, null from wide
    union all select interview_id, 'orientation', null, case when plural + team > singular then 'team' else 'self' end from wide
    union all select interview_id, 'focus', null, case when process + detail + risk >= social then 'problem' else 'people' end from wide
    union all select interview_id, 'balance', null, case when action - reflection > 1 then 'action' when action - reflection < -1 then 'reflection' else 'balanced' end from wide
    union all select interview_id, 'abstraction', null, case when abstract > detail then 'abstract' else 'grounded' end from wide
)"""


def scores(words: dict[str, tuple[str, ...]]) -> str:
    """features, then points (interview_id, model, dim, points, matched) and score (interview_id, model, dim, score)."""
    rules, conditions = _stated()
    bonus = {"disc": ("25", "least(22, 4 * {hit})"), "big": ("40", "least(22, 3 * {pos}) - least(10, 4 * {neg})"), "type": ("15", "least(28, 3 * {hit})")}
    hit = lambda prefix: f"coalesce((select n from held h where h.interview_id = p.interview_id and h.category = '{prefix}_' || p.dim), 0)"
    cases = " ".join(
        f"when '{m}' then greatest(0, least(100, greatest(0, least(100, {base} + points)) + {more.format(hit=hit(m), pos=hit('pos'), neg=hit('neg'))}))" for m, (base, more) in bonus.items()
    )
    return f"""{features(words)},
rule(model, dim, rule, points, n) as (values {', '.join(rules)}), condition(rule, name, op, num, txt) as (values {', '.join(conditions)}),
met as (
    select f.interview_id, c.rule, count(*) as n from condition c join feature f on f.name = c.name
    where case c.op when '>=' then f.num >= c.num when '<=' then f.num <= c.num when '>' then f.num > c.num when '<' then f.num < c.num else f.txt = c.txt end
    group by all
),
points as (
    select i.interview_id, r.model, r.dim, sum(case when m.n = r.n then r.points else 0 end)::bigint as points, count(case when m.n = r.n then 1 end) as matched
    from (select distinct interview_id from base) i cross join rule r left join met m on m.interview_id = i.interview_id and m.rule = r.rule group by all
),
score as (select interview_id, model, dim, matched, (case model {cases} else greatest(0, points) + least(30, 5 * {hit('side')}) end)::bigint as score from points p)"""


def wide_scores(words: dict[str, tuple[str, ...]], models: dict[str, str]) -> str:
    """WITH clause that ends with result: interview_id and a column for each dimension of the models (prefix: letters)."""
    columns = ", ".join(f"max(score) filter (model = '{m}' and dim = '{d}') as {m}_{d}" for m, dims in models.items() for d in dims)
    return f"with {scores(words)}, result as (select interview_id, {columns} from score group by interview_id)"
