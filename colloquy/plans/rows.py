"""Rule tables that give rows: detectors, mappings, probes. (code, detail, condition) in order; the first ones come first."""

from __future__ import annotations

from colloquy.plans import lexicon as L
from colloquy.plans.layers import DEFECTS

Rule = tuple[str, str, str]  # code, SQL of the detail, SQL of the condition


def _lit(text: str) -> str:
    return f"'{text}'"


STAR_DEFECTS: list[Rule] = [(k, f"defect_{k}", f"defect_{k} is not null") for k in DEFECTS]
SIGNAL = {"fake_star": ("authenticity", "high"), "team_substitution": ("ownership", "medium"), "situation_missing": ("context", "low"), "result_attribution_error": ("attribution", "medium"), "action_vague": ("execution", "medium"), "result_abstract": ("outcome", "medium")}
RISK_SIGNALS: list[Rule] = [(v[0], _lit(v[1]), f"defect_{k} is not null") for k, v in SIGNAL.items()] + [
    ("impression", _lit("high"), "buzzword_ratio >= 0.015 and richness < 0.45"),
]
DISC_SIGNALS: list[Rule] = [
    ("complete_star", _lit("confirm_high_c"), "dim_s + dim_t + dim_a + dim_r >= 280 and dim_r >= 65"),
    ("action_without_situation", _lit("check_d"), "dim_a >= 70 and dim_s < 40"),
    ("result_behind_team", _lit("check_s"), "dim_r < 40 and orientation = 'team'"),
    ("situation_only", _lit("check_i"), "dim_s >= 70 and dim_a < 50 and dim_r < 50"),
]
FINDINGS: list[Rule] = [
    ("low_density", _lit("high"), "word_count >= 120 and richness < 0.45"),
    ("incomplete_chain", _lit("medium"), "structure < 0.55"),
    ("weak_outcome", _lit("medium"), "achievement_ratio < 0.006"),
    ("thin_action", _lit("medium"), "action_ratio < 0.015"),
    ("polished", "case when buzzword_ratio >= 0.018 then 'high' else 'medium' end", "buzzword_ratio >= 0.012 and richness < 0.5"),
    ("star_unsure", _lit("medium"), "star_confidence = 'low'"),
    ("no_situation", _lit("medium"), "dim_s < 40"),
    ("no_result", _lit("high"), "dim_r < 40"),
]
HIRE_RISKS: list[Rule] = [(c, _lit("risk"), cond) for c, _, cond in FINDINGS if c not in ("incomplete_chain", "no_situation")]
GAPS: list[Rule] = [(c, _lit("gap"), cond) for c, _, cond in FINDINGS[:4]] + [
    ("thin_detail_for_c", _lit("gap"), "disc_c >= 70 and detail_ratio < 0.012"), ("star_unsure", _lit("gap"), "star_confidence = 'low'"),
] + [(c, _lit("gap"), cond) for c, _, cond in DISC_SIGNALS] + [(c, _lit("gap"), cond) for c, _, cond in FINDINGS[6:]]
TRAIT_PATTERNS: list[Rule] = [(
    code, _lit("pattern"),
    " and ".join(f"big_{p.split()[0].lower()} {p.split(' ', 1)[1]}" if p.split()[0] in "OCEAN" else p for p in cond.split(" and ")),
) for code, cond in L.PATTERNS]
TYPE_RISKS: list[Rule] = [
    ("polished_achiever", _lit("high"), "type_3 >= 72 and structure >= 0.75 and richness < 0.50"),
    ("anxious_loyalist", _lit("medium"), "type_6 >= 65 and hedge_ratio >= 0.010"),
    ("hidden_self", _lit("medium"), "type_9 >= 65 and singular_ratio < 0.010"),
]
INTERACTIONS: list[Rule] = [
    ("no_scene_no_action", _lit("pair"), "defect_situation_missing is not null and defect_action_vague is not null"),
    ("borrowed_story", _lit("pair"), "defect_fake_star is not null and defect_result_attribution_error is not null"),
    ("team_cover", _lit("pair"), "defect_team_substitution is not null and defect_result_abstract is not null"),
    (
        "empty_frame", _lit("triple"),
        "defect_fake_star is not null and defect_situation_missing is not null and defect_result_abstract is not null",
    ),
]
CONFLICTS: list[Rule] = [(
    f"{d}_unlikely_{x}", _lit("medium"), f"disc_{d.lower()} >= 70 and mbti_type like '%{x}%'",
) for d, letters in L.UNLIKELY.items() for x in letters] + [(
    f"high_{d}_with_P", _lit("high"), f"disc_{d.lower()} >= 70 and mbti_type like '%P%'",
) for d in "DC"]
GRAPH_CONFLICTS: list[Rule] = [(
    f"{d}_unlikely_{x}", _lit("medium"), f"disc_{d.lower()} >= 50 and mbti_type like '%{x}%'",
) for d, letters in L.UNLIKELY.items() for x in letters] + [(
    f"high_{d}_with_P", _lit("high"), f"disc_{d.lower()} >= 75 and mbti_type like '%P%'",
) for d in "DC"] + [(
    f"{a}_plus_{b}", _lit("combination"),
    f"disc_{a.lower()} >= 65 and disc_{b.lower()} >= 65 and concat(disc_top, disc_second) in ('{a}{b}', '{b}{a}')",
) for a, b in ("DI", "IS")]
ADJUSTMENTS: list[Rule] = [
    ("star_down", _lit("tense_and_quiet"), "big_n >= 70 and big_e <= 45"),
    ("star_up", _lit("tense_and_orderly"), "big_n >= 65 and big_c >= 65"),
    ("disc_c_up", _lit("orderly"), "big_c >= 70 and big_confidence = 'high'"),
    ("disc_d_check", _lit("achiever"), "(type_top = '3' or type_second = '3') and achievement_ratio >= 0.015"),
]
def _score_of(style: str) -> str:
    return f"case {style} when 'D' then disc_d when 'I' then disc_i when 'S' then disc_s else disc_c end"


def _strength(style: str) -> str:
    score = _score_of(style)
    return f"concat({style}, ':', case when {score} >= 75 then 'strong' when {score} >= 50 then 'medium' else 'weak' end)"


HYPOTHESES: list[Rule] = [
    ("top", _strength("disc_top"), "true"), ("second", _strength("disc_second"), "true"),
    ("composite", "'DC:medium'", "concat(disc_top, disc_second) in ('DC', 'CD')"),
]
#: Rules of several models under one scheme: (type, severity, condition, description). Equal types with equal first 40 characters count once.
UNION: list[tuple[str, str, str, str]] = [
    *((
        "disc_mbti", "'medium'", f"disc_{d.lower()} >= 70 and mbti_type like '%{x}%'", f"style {d} seldom goes with {x}",
    ) for d, letters in L.UNLIKELY.items() for x in letters),
    *(("disc_mbti_pattern", "'high'", f"disc_{d.lower()} >= 70 and mbti_type like '%P%'", f"high {d} beside P") for d in "DC"),
    *((
        "trait_risk", "'medium'", f"big_{d} >= {n} and big_{e} <= {m}",
        f"{d.upper()} is high while {e.upper()} is low, so one of the two may be dressed up for the talk",
    ) for d, n, e, m in (("n", 70, "e", 45), ("o", 65, "c", 45), ("e", 65, "a", 45))),
    *((
        "trait_risk", "'low'", f"big_{d} >= {n} and big_{e} <= {m}",
        f"{d.upper()} is high while {e.upper()} is low, so one of the two may be dressed up (weak)",
    ) for d, n, e, m in (("n", 60, "e", 50), ("o", 60, "c", 50))),
    *((code, severity, condition, f"type risk {code}") for code, severity, condition in TYPE_RISKS),
]
#: What confirms or challenges a style, by code.
STYLE_PROBES = {"D": ("hard_call", "listened"), "I": ("won_over", "worked_alone"), "S": ("kept_team", "forced_change"), "C": ("found_error", "fast_guess")}
#: Labels of defects and of score levels; those without one are shown by their code.
DEFECT_LABELS = {"fake_star": "staged story", "team_substitution": "team instead of self", "situation_missing": "no situation", "action_vague": "vague action"}
AXIS_QUESTIONS: list[Rule] = [((a + b), "'high'", f"strength_{(a + b).lower()} < 60") for a, b in L.AXES] + [((a + b), "'medium'", f"strength_{(a + b).lower()} >= 70") for a, b in L.AXES]
#: Two questions for each defect, by code; one code is shared, so that it is asked once.
PROBES = {"fake_star": ("ask_replay", "ask_numbers"), "team_substitution": ("ask_own_part", "ask_decision"), "situation_missing": ("ask_scene", "ask_limits"), "result_attribution_error": ("ask_own_part", "ask_credit"), "action_vague": ("ask_steps", "ask_decision"), "result_abstract": ("ask_numbers", "ask_check")}
#: Roles by style.
STYLE_ROLES = {"D": ("lead", "sales", "founder"), "I": ("sales", "marketing", "community"), "S": ("support", "operations", "community"), "C": ("analyst", "quality", "operations")}
#: Motive, fear and desire of each type, by code.
MOTIVES = {1: ("integrity", "error", "goodness"), 2: ("care", "rejection", "love"), 3: ("success", "failure", "worth"), 4: ("identity", "plainness", "self"), 5: ("knowledge", "helplessness", "mastery"), 6: ("safety", "abandonment", "support"), 7: ("freedom", "pain", "joy"), 8: ("control", "weakness", "strength"), 9: ("peace", "conflict", "harmony")}
