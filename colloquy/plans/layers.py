"""Features and scores of an interview, in layers: each adds columns that follow from those below.

An interview row has interview_id, t (candidate answers, a line each), w (the whole transcript with labels), sent and
sent_chars (sentences of t and their characters), n_segments, n_turns, n_types (kinds of questions) and cand_chars.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame

from colloquy.functions.expressions import clamp, hits, points, ratio, tolerant
from colloquy.operators.words import with_counts
from colloquy.plans import lexicon as L
from colloquy.plans.tables import Rules

Layer = Mapping[str, str]

ON_ANSWERS = ("action emotional social certainty hedge achievement process detail risk imperative qualifier modal logical contrast abstract buzzword quantitative temporal constraint vague_result tool_method step_connector context_marker self_result team_result reflection singular plural second third adjective star_s star_t star_a star_r weak_s weak_t weak_a weak_r").split()
RATIOS = ("action emotional social certainty hedge achievement process detail risk imperative qualifier modal logical contrast abstract buzzword quantitative temporal constraint vague_result tool_method step_connector context_marker self_result singular plural second third adjective").split()
TEAM = ("团队", "大家")
#: Rules against a style that make a high score of it a contradiction.
MIN_AGAINST = 2
SYNTAX = {"s": "当时|背景", "t": "", "a": "首先|第一步", "r": "[0-9]+|%|提升了|降低了"}


def bare(column: str) -> str:
    """The text without white space."""
    for code in (9, 10, 13, 32, 0x3000):
        column = f"replace({column}, chr({code}), '')" if code < 256 else f"replace({column}, '{chr(code)}', '')"
    return column


def word_columns(words: Mapping[str, Sequence[str]]) -> dict[str, dict[str, Sequence[str]]]:
    """The words of each column of hits: in the answers t (n_), and in the whole transcript w (h_)."""
    on_answers = {f"n_{k}": words[k] for k in ON_ANSWERS} | {"n_team": TEAM, "n_asked": ("？", "?")}
    on_whole = {f"h_{k}": v for k, v in words.items() if k.startswith(("disc_", "pos_", "neg_", "type_", "side_", "star_", "counter_"))}
    return {"t": on_answers, "w": on_whole}


def counts(words: Mapping[str, Sequence[str]], least: int = 1) -> Layer:
    """Hits in the answers and in the whole transcript, and sizes of both, which are `least` at least."""
    out = {n: f"cast({hits(text, own)} as bigint)" for text, columns in word_columns(words).items() for n, own in columns.items()}
    out["n_numbers"] = "cast(regexp_count(t, '[0-9]+[%个天周月年人]') as bigint)"
    out |= {f"syn_{d}": f"cast(case when t rlike '{p}' then 1 else 0 end as bigint)" for d, p in SYNTAX.items() if p}
    out["text_length"] = f"cast(greatest({least}, length({bare('t')})) as bigint)"
    out["word_count"] = f"cast(greatest({least}, length(replace(w, chr(10), ''))) as bigint)"
    return out


def features() -> Layer:
    out = {f"{k}_ratio": ratio(f"n_{k}", "text_length") for k in RATIOS}
    out |= {
        "question_ratio": ratio("n_asked", "greatest(sent, 1)"),
        "team_result_ratio": ratio("n_team_result", "greatest(n_team_result + n_self_result, 1)"),
        "self_team_ratio": ratio("n_singular", "greatest(n_plural + n_team, 1)"),
        "team_count": "n_plural + n_team",
        "avg_sentence": "(case when sent = 0 then cast(0 as double) else cast((200 * sent_chars + sent) div (2 * sent) as double) / 100 end)",
        "orientation": "case when n_plural + n_team > n_singular then 'team' else 'self' end",
        "focus": "case when n_process + n_detail + n_risk >= n_social then 'problem' else 'people' end",
        "balance": "case when n_action - n_reflection > 1 then 'action' when n_action - n_reflection < -1 then 'reflection' else 'balanced' end",
        "abstraction": "case when n_abstract > n_detail then 'abstract' else 'grounded' end",
        "richness": "least(cast(1 as double), cast(5 + n_detail + n_numbers as double) / 25)",
        "stability": "(case when n_turns <= 1 then cast(6 as double) / 10 else least(cast(1 as double), (45 + cast(40 * n_types as double) / "
        "n_turns) / 100) end)",
        "structure": "cast((case when n_star_s > 0 then 25 else 0 end + case when n_star_t > 0 then 25 else 0 end + case when n_star_a > 0 then 25 "
        "else 0 end + case when n_star_r > 0 then 25 else 0 end) as double) / 100",
    }
    for d in "star":
        syntax = f"case when syn_{d} > 0 then 1000 else 0 end" if SYNTAX[d] else "0"
        strong, weak = f"n_star_{d}", f"n_weak_{d}"
        out[f"sub_{d}"] = f"least(10000, {syntax} + case when {strong} > 0 and {weak} = 0 then least(10000, 3000 + 1500 * {strong}) when {strong} > 0 then least(10000, 2000 + 1500 * {strong} - 750 * {weak}) else 1000 end)"
    return out


def scores(rules: Rules) -> Layer:
    out = {f"disc_{d.lower()}": f"cast({clamp(clamp('25 + ' + points(rules_)) + f' + least(22, 4 * h_disc_{d.lower()})')} as bigint)" for d, rules_ in rules.disc.items()}
    out |= {f"big_{d.lower()}": f"cast({clamp(clamp('40 + ' + points(rules_)) + f' + least(22, 3 * h_pos_{d.lower()}) - least(10, 4 * h_neg_{d.lower()})')} as bigint)" for d, rules_ in rules.bigfive.items()}
    for k, rules_ in rules.enneagram.items():
        compiled = [(f"{f} {op} {t}", n) for f, op, t, n in rules_]
        out[f"type_{k}"] = f"cast({clamp(clamp('15 + ' + points(compiled)) + f' + least(28, 3 * h_type_{k})')} as bigint)"
        out[f"rules_{k}"] = f"cast({points([(c, 1) for c, _ in compiled])} as bigint)"
    for side, (strong, soft, against) in rules.mbti.items():
        total = points([(tolerant(c), n) for group, n in ((strong, 25), (soft, 12), (against, -15)) for c in group])
        out[f"side_{side.lower()}"] = f"cast(greatest(0, {total}) + least(30, 5 * h_side_{side.lower()}) as bigint)"
    bonus = {
        "s": "case when n_temporal > 0 then 5 else 0 end + case when n_constraint > 0 then 5 else 0 end",
        "t": "case when self_team_ratio >= 0.8 then 8 when orientation = 'self' then 4 else 0 end",
        "a": "case when step_connector_ratio > 0.005 then 5 else 0 end + case when tool_method_ratio > 0 then 5 else 0 end",
        "r": "case when quantitative_ratio > 0 then 8 else 0 end + case when self_result_ratio > 0 then 4 else 0 end - case when "
        "vague_result_ratio > quantitative_ratio then 10 else 0 end",
    }
    for d in "star":
        tenths = f"sub_{d} div 10 + 10 * (least(20, 4 * h_star_{d}) + {bonus[d]} - least(15, 5 * h_counter_{d}))"
        out[f"dim_{d}"] = f"cast(bround(cast({clamp(tenths, 0, 1000)} as double) / 10, 0) as bigint)"
    return out


def _top(names: Sequence[str], values: Sequence[str], best: bool = True) -> str:
    """The first of the names with the largest value."""
    most = f"greatest({', '.join(values)})"
    return "case " + " ".join(f"when {v} = {most} then '{n}'" for n, v in zip(names[:-1], values[:-1], strict=True)) + f" else '{names[-1]}' end"


def _second(names: Sequence[str], values: Sequence[str], top: str) -> str:
    left = [f"case when {top} = '{n}' then -1 else {v} end" for n, v in zip(names, values, strict=True)]
    return _top(names, left)


def tops(rules: Rules) -> Layer:
    disc, big, types = [f"disc_{d}" for d in "disc"], [f"big_{d}" for d in "ocean"], [f"type_{k}" for k in range(1, 10)]
    out = {"disc_top": _top("DISC", disc), "big_top": _top("OCEAN", big), "type_top": _top([str(k) for k in range(1, 10)], types), "disc_max": f"greatest({', '.join(disc)})", "big_max": f"greatest({', '.join(big)})", "type_max": f"greatest({', '.join(types)})"}
    for a, b in L.AXES:
        x, y, axis = f"side_{a.lower()}", f"side_{b.lower()}", (a + b).lower()
        share = f"cast({x} as double) / ({x} + {y}) * 100"
        out[f"pref_{axis}"] = f"case when {x} + {y} < 5 then 'unclear' when {share} > 55 then '{a}' when {share} < 45 then '{b}' else 'neutral' end"
        out[f"strength_{axis}"] = f"cast(case when {x} + {y} < 5 then 50 when {share} > 55 then floor({share}) when {share} < 45 then floor(100 - {share}) else 50 end as bigint)"
        strength = f"(case when {x} + {y} < 5 then 50 when {share} > 55 then floor({share}) when {share} < 45 then floor(100 - {share}) else 50 end)"
        out[f"conf_{axis}"] = f"case when {x} + {y} < 5 then 'low' when {strength} >= 70 then 'clear' when {strength} >= 60 then 'moderate' when {strength} >= 55 then 'slight' else 'neutral' end"
    # styles with a high score against which so many rules speak as well
    against = {d: [c for c, n in rules_ if n < 0] for d, rules_ in rules.disc.items()}
    out["contradictions"] = " + ".join(f"case when disc_{d.lower()} >= 60 and {points([(c, 1) for c in cs]) if cs else 0} >= {MIN_AGAINST} then 1 else 0 end" for d, cs in against.items())
    out["star_overall"] = "cast(15 * dim_s + 15 * dim_t + 35 * dim_a + 35 * dim_r as double) / 100"
    out["n_low_dims"] = "case when dim_s < 35 then 1 else 0 end + case when dim_t < 35 then 1 else 0 end + case when dim_a < 35 then 1 else 0 end + case when dim_r < 35 then 1 else 0 end"
    out["dim_mean"] = "cast(dim_s + dim_t + dim_a + dim_r as double) / 4"
    return out


def _defect(*cases: tuple[str, str]) -> str:
    return "case " + " ".join(f"when {c} then '{s}'" for s, c in cases) + " end"


DEFECTS = {
    "fake_star": _defect(
        ("high", "n_low_dims >= 2 and n_quantitative = 0 and word_count > 100 and dim_mean < 45"),
        ("medium", "n_low_dims >= 2 or dim_mean < 50"),
    ),
    "team_substitution": _defect(
        ("high", "team_count >= 5 and n_singular <= 2"), ("medium", "team_count >= 3 and self_team_ratio < 0.5"),
        ("low", "orientation = 'team' and self_team_ratio < 0.7"),
    ),
    "situation_missing": _defect(
        ("high", "n_temporal = 0 and word_count < 80"), ("medium", "n_temporal = 0 and n_context_marker = 0"),
        ("low", "n_temporal > 0 and n_constraint = 0 and dim_s < 50"),
    ),
    "action_vague": _defect(
        ("high", "n_star_a = 0 and n_step_connector = 0 and n_tool_method = 0"), ("medium", "n_star_a = 0"),
        ("low", "n_step_connector = 0 and dim_a < 50"),
    ),
    "result_abstract": _defect(
        ("high", "n_quantitative = 0 and n_vague_result > 0 and word_count > 80"), ("medium", "n_star_r = 0 and n_vague_result > 0"),
    ),
}
DEFECTS["result_attribution_error"] = _defect(
    ("medium", "self_result_ratio > 0.5 and team_result_ratio > 0.5"), ("high", "self_result_ratio > 0.4 and dim_r < 40"),
    ("medium", "team_result_ratio > 0.6 and dim_r < 40"),
)


def defects(cases: Mapping[str, str]) -> Layer:
    disc, types = [f"disc_{d}" for d in "disc"], [f"type_{k}" for k in range(1, 10)]
    out = {f"defect_{k}": v for k, v in cases.items()}
    out["disc_second"] = _second("DISC", disc, "disc_top")
    out["type_second"] = _second([str(k) for k in range(1, 10)], types, "type_top")
    out["mbti_type"] = "concat(" + ", ".join(f"case when pref_{(a + b).lower()} in ('neutral', 'unclear') then 'X' else pref_{(a + b).lower()} end" for a, b in L.AXES) + ")"
    axes = [f"strength_{(a + b).lower()}" for a, b in L.AXES]
    prefs = [f"pref_{(a + b).lower()}" for a, b in L.AXES]
    out["n_clear"] = " + ".join(f"case when {x} >= 70 then 1 else 0 end" for x in axes)
    out["n_neutral"] = " + ".join(f"case when {x} < 55 then 1 else 0 end" for x in axes)
    out["n_open"] = " + ".join(f"case when {x} in ('neutral', 'unclear') then 1 else 0 end" for x in prefs)
    out["sample_quality"] = "case when word_count < 120 or n_turns <= 1 then 'low' when word_count < 300 or n_turns <= 2 then 'medium' else 'high' end"
    out["impression_risk"] = "case when buzzword_ratio >= 0.015 and richness < 0.4 then 'high' when buzzword_ratio >= 0.01 then 'medium' when richness < 0.45 and word_count >= 120 then 'medium' else 'low' end"
    return out


def seconds() -> Layer:
    return {"type_second_score": "case type_second " + " ".join(f"when '{k}' then type_{k}" for k in range(1, 10)) + " end"}


def summary(cases: Mapping[str, str]) -> Layer:
    count = lambda level: "(" + (" + ".join(f"case when defect_{k} = '{level}' then 1 else 0 end" for k in cases) or "0") + ")"
    high, medium = count("high"), count("medium")
    odd = " + ".join(f"case when big_{d} > 90 or big_{d} < 12 then 1 else 0 end" for d in "ocean")
    return {
        "n_high": high,
        "star_confidence": f"case when cand_chars >= 200 and dim_s >= 50 and dim_t >= 50 and dim_a >= 60 and dim_r >= 60 and {high} = 0 and star_overall "
        f">= 55 then 'high' when cand_chars < 60 or star_overall < 30 or {high} >= 2 then 'low' else 'medium' end",
        "disc_confidence": "case when sample_quality = 'high' and contradictions = 0 and richness >= 0.7 then 'high' when sample_quality = 'low' or "
        "contradictions > 2 then 'low' else 'medium' end",
        "star_notes": f"case when cand_chars >= 200 and dim_s >= 50 and dim_t >= 50 and dim_a >= 60 and dim_r >= 60 and {high} = 0 and star_overall "
        f">= 55 then 'distinct_and_rich' when cand_chars < 60 or star_overall < 30 or {high} >= 2 then concat_ws(',', case when "
        f"cand_chars < 60 then 'too_short' end, case when star_overall < 30 then 'very_low_overall' end, case when {high} >= 2 then "
        f"'grave_defects' end) when {high} = 1 or {medium} > 0 then 'defects_beside_signals' else 'structure_without_substance' end",
        "mbti_confidence": "case when sample_quality = 'low' then 'low' when n_clear >= 3 and sample_quality = 'high' then 'high' when n_neutral >= 2 "
        "then 'low' else 'medium' end",
        "big_confidence": f"case when word_count < 60 or n_turns <= 1 then 'low' when {odd} >= 3 then 'low' when word_count >= 300 and n_turns >= 3 then "
        f"'high' else 'medium' end",
        "type_confidence": "case when type_max >= 68 and type_max - type_second_score >= 20 then 'high' when word_count < 150 or n_turns <= 1 then 'low' "
        "when type_max - type_second_score <= 8 then 'low' else 'medium' end",
        "n_artifact": "case when big_n >= 65 and big_e >= 70 then true when big_n >= 60 and n_turns >= 2 then false when big_n >= 60 then true else false end",
        "wing": "case when (cast(type_second as int) - cast(type_top as int) + 9) % 9 in (1, 8) then concat(type_top, 'w', type_second) else 'uncertain' end",
        "style_label": "case when concat(disc_top, big_top) in ('DC', 'DE', 'IA', 'IE', 'SA', 'CC', 'CO', 'DN') then concat('pair_', disc_top, '_', "
        "big_top) else concat('mixed_', disc_top, '_', big_top) end",
    }


def all_layers(words: Mapping[str, Sequence[str]] | None = None, rules: Rules | None = None) -> list[Layer]:
    rules = rules or Rules()
    cases = DEFECTS if rules.defects is None else {k: _defect(*cs) for k, cs in rules.defects.items()}
    return [counts(words or L.WORDS), features(), scores(rules), tops(rules), defects(cases), seconds(), summary(cases)]


def analyse(interviews: DataFrame, words: Mapping[str, Sequence[str]] | None = None, rules: Rules | None = None, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Interviews with all features and scores, from the caller's word lists, rules and further features.

    extra: columns over an interview's row and its features, Pandas UDFs among them; rules can ask for them by name.
    """
    _, low, *high = all_layers(words, rules)
    rows = apply(counted(interviews, words or L.WORDS), [low])
    return apply(rows.withColumns(dict(extra)) if extra else rows, high)


def counted(interviews: DataFrame, words: Mapping[str, Sequence[str]], names: Collection[str] | None = None, least: int = 1) -> DataFrame:
    """Interviews with the columns of `counts`, or those named: all words in one pass over each text, the rest as SQL."""
    wanted = {text: {n: own for n, own in columns.items() if names is None or n in names} for text, columns in word_columns(words).items()}
    hit = {n for columns in wanted.values() for n in columns}
    rest = {n: e for n, e in counts({k: () for k in words}, least).items() if n not in hit and (names is None or n in names)}
    return apply(with_counts(interviews, wanted), [rest] if rest else [])


def scored(interviews: DataFrame, words: Mapping[str, Sequence[str]], text: str | None = None) -> DataFrame:
    """Interviews with all features and scores, or with those alone that the names in the text lead to."""
    first, *rest = all_layers(words)
    layers = [first, *rest] if text is None else needed([first, *rest], text)
    here = layers[0] if layers and set(layers[0]) <= set(first) else {}
    return apply(counted(interviews, words, set(here)), layers[1:] if here else layers)


def needed(layers: Sequence[Layer], text: str) -> list[Layer]:
    """The layers with the columns alone that the names in the text lead to."""
    names = set(re.findall(r"[A-Za-z_]\w*", text))
    out: list[Layer] = []
    for layer in reversed(layers):
        kept = {n: e for n, e in layer.items() if n in names}
        for e in kept.values():
            names |= set(re.findall(r"[A-Za-z_]\w*", e))
        if kept:
            out.insert(0, kept)
    return out


def apply(df: DataFrame, layers: Sequence[Layer]) -> DataFrame:
    """df with the columns of all layers."""
    for layer in layers:
        df = df.selectExpr("*", *(f"{e} as {n}" for n, e in layer.items()))
    return df
