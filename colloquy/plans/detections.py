"""The library's detections as a rule table, in the form in which a caller writes one: (scheme, code, detail, rule), in order.

A rule is a conjunction; alternatives of a code are rules of their own, of which the first that holds gives the detail.
Numbers are fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Of these schemes only so many codes are kept, in order.
CAPS = {"finding": 4, "risk": 4, "gap": 5, "graph": 5, "type": 3}

_DEFECTS = (
    ("fake_star", "high", "n_low_dims >= 2 and n_quantitative == 0 and word_count > 100 and dim_mean < 45"),
    ("fake_star", "medium", "n_low_dims >= 2"),
    ("fake_star", "medium", "dim_mean < 50"),
    ("team_substitution", "high", "team_count >= 5 and n_singular <= 2"),
    ("team_substitution", "medium", "team_count >= 3 and self_team_ratio < 0.5"),
    ("team_substitution", "low", "orientation == team and self_team_ratio < 0.7"),
    ("situation_missing", "high", "n_temporal == 0 and word_count < 80"),
    ("situation_missing", "medium", "n_temporal == 0 and n_context_marker == 0"),
    ("situation_missing", "low", "n_temporal > 0 and n_constraint == 0 and dim_s < 50"),
    ("action_vague", "high", "n_star_a == 0 and n_step_connector == 0 and n_tool_method == 0"),
    ("action_vague", "medium", "n_star_a == 0"),
    ("action_vague", "low", "n_step_connector == 0 and dim_a < 50"),
    ("result_abstract", "high", "n_quantitative == 0 and n_vague_result > 0 and word_count > 80"),
    ("result_abstract", "medium", "n_star_r == 0 and n_vague_result > 0"),
    ("result_attribution_error", "medium", "self_result_ratio > 0.5 and team_result_ratio > 0.5"),
    ("result_attribution_error", "high", "self_result_ratio > 0.4 and dim_r < 40"),
    ("result_attribution_error", "medium", "team_result_ratio > 0.6 and dim_r < 40"),
)
_INTERACTIONS = (
    ("no_scene_no_action", "pair", "defect_situation_missing is present and defect_action_vague is present"),
    ("borrowed_story", "pair", "defect_fake_star is present and defect_result_attribution_error is present"),
    ("team_cover", "pair", "defect_team_substitution is present and defect_result_abstract is present"),
    ("empty_frame", "triple", "defect_fake_star is present and defect_situation_missing is present and defect_result_abstract is present"),
)
_THIN = (
    ("low_density", "high", "word_count >= 120 and richness < 0.45"),
    ("incomplete_chain", "medium", "structure < 0.55"),
    ("weak_outcome", "medium", "achievement_ratio < 0.006"),
    ("thin_action", "medium", "action_ratio < 0.015"),
)
_POLISHED = (
    ("polished", "high", "buzzword_ratio >= 0.012 and richness < 0.5 and buzzword_ratio >= 0.018"),
    ("polished", "medium", "buzzword_ratio >= 0.012 and richness < 0.5"),
)
_UNSURE = ("star_unsure", "medium", "star_confidence == low")
_WEAK = (("no_situation", "medium", "dim_s < 40"), ("no_result", "high", "dim_r < 40"))
_SIGNALS = (
    ("complete_star", "dim_sum >= 280 and dim_r >= 65"),
    ("action_without_situation", "dim_a >= 70 and dim_s < 40"),
    ("result_behind_team", "dim_r < 40 and orientation == team"),
    ("situation_only", "dim_s >= 70 and dim_a < 50 and dim_r < 50"),
)
_PATTERNS = (
    ("curious_and_orderly", "big_o >= 65 and big_c >= 65"),
    ("warm_and_outgoing", "big_e >= 65 and big_a >= 65"),
    ("orderly_and_tense", "big_c >= 65 and big_n >= 60"),
    ("orderly_and_calm", "big_c >= 65 and big_n <= 40"),
    ("curious_and_loose", "big_o >= 65 and big_c <= 45"),
    ("outgoing_and_firm", "big_e >= 65 and big_a <= 45"),
    ("warm_and_calm", "big_a >= 65 and big_n <= 40"),
    ("rich_story", "richness >= 0.7 and big_o >= 55 and big_c >= 55"),
)
_UNLIKELY = (("D", "I"), ("D", "F"), ("D", "P"), ("I", "I"), ("I", "T"), ("S", "E"), ("S", "T"), ("S", "J"), ("C", "E"), ("C", "F"), ("C", "P"))
_TYPES = (
    ("2@4", "80", "big_a >= 60 and big_e >= 65"), ("7@5", "80", "big_o >= 65 and big_e >= 65"), ("4@6", "80", "big_o >= 65 and big_e <= 45"),
    ("5@7", "75", "big_o >= 60 and big_c >= 60"), ("4@8", "70", "big_n >= 65 and big_e <= 50 and big_o >= 55"), ("6@9", "75", "big_n >= 60 and big_c >= 60"),
    ("3@10", "70", "big_e >= 65 and big_c >= 60 and big_n >= 50"), ("7@11", "70", "big_o >= 65 and big_c <= 45"), ("1@0", "85", "big_c >= 65 and big_n >= 55"),
    ("3@1", "80", "big_c >= 65 and big_n <= 45"), ("2@2", "75", "big_a >= 65 and big_n >= 55"), ("9@3", "80", "big_a >= 65 and big_n <= 45 and big_e <= 50"),
)


def _conflicts(least: int, pattern: int) -> list[tuple[str, str, str]]:
    out = [(f"{d}_unlikely_{x}", "medium", f"disc_{d.lower()} >= {least} and mbti_type has {x}") for d, x in _UNLIKELY]
    return out + [(f"high_{d}_with_P", "high", f"disc_{d.lower()} >= {pattern} and mbti_type has P") for d in "DC"]


def _as(detail: str, rules) -> list[tuple[str, str, str]]:
    return [(r[0], detail, r[-1]) for r in rules]


def _pairs() -> list[tuple[str, str, str]]:
    both = [("DI", "D_plus_I"), ("ID", "D_plus_I"), ("IS", "I_plus_S"), ("SI", "I_plus_S")]
    return [(code, "combination", f"disc_{p[0].lower()} >= 65 and disc_{p[1].lower()} >= 65 and disc_pair == {p}") for p, code in both]


RULES: dict[str, list[tuple[str, str, str]]] = {
    "defect": [*_DEFECTS],
    "interaction": [*_INTERACTIONS],
    "finding": [*_THIN, *_POLISHED, _UNSURE, *_WEAK],
    "risk": _as("risk", [_THIN[0], *_THIN[2:], _POLISHED[1], _UNSURE, _WEAK[1]]),
    "gap": _as("gap", [*_THIN, ("thin_detail_for_c", "disc_c >= 70 and detail_ratio < 0.012"), _UNSURE, *_SIGNALS, *_WEAK]),
    "pattern": _as("pattern", _PATTERNS),
    "conflict": _conflicts(70, 70),
    "graph": _conflicts(50, 75) + _pairs(),
    # larger weights first, then the rule's number
    "type": sorted(_TYPES, key=lambda r: (-int(r[1]), int(r[0].split("@")[1]))),
}


def rule_table(spark: SparkSession) -> DataFrame:
    """(scheme, place, code, detail, rule): to read, change and pass to tables.detections_of."""
    rows = [(scheme, i, *r) for scheme, rules in RULES.items() for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "scheme string, place int, code string, detail string, rule string")
