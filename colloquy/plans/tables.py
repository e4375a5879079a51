"""The caller's own word lists, rules, probes and mappings as tables, in place of those of the library.

Tables are small by nature (words and rules that people write); they are read once on the driver and compiled to columns.
A table with more rows than `MOST_ROWS` is refused.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame

from colloquy.plans import lexicon as L

MOST_ROWS = 100_000
_NUMERIC = re.compile(r"\s*([A-Za-z_]\w*)\s*(>=|<=|==|=|>|<)\s*(-?\d+(?:\.\d+)?)\s*")
_LABEL = re.compile(r"\s*([A-Za-z_]\w*)\s*(?:==|=)\s*'?([A-Za-z_]+)'?\s*")
_HAS = re.compile(r"\s*([A-Za-z_]\w*)\s+has\s+([A-Za-z_]+)\s*", re.IGNORECASE)
_PRESENT = re.compile(r"\s*([A-Za-z_]\w*)\s+is\s+present\s*", re.IGNORECASE)
#: What holds for every interview, as a rule and as a feature.
ALWAYS = "always"


@dataclass(frozen=True)
class Condition:
    """feature op value: a number (>=, <=, >, <, =), a label (=), letters of a label (has), or any value (present)."""

    feature: str
    op: str
    value: str = ""

    @property
    def number(self) -> float | None:
        return float(self.value) if re.fullmatch(r"-?\d+(\.\d+)?", self.value) else None

    @property
    def label(self) -> str | None:
        return self.value if self.value and self.number is None else None

    def sql(self) -> str:
        if self.feature == ALWAYS:
            return "true"
        if self.op == "present":
            return f"{self.feature} is not null"
        if self.op == "has":
            return f"{self.feature} like '%{self.value}%'"
        return f"{self.feature} {self.op} {self.value}" if self.number is not None else f"{self.feature} = '{self.value}'"


def parse_conditions(text: str, features: Collection[str] | None = None) -> list[Condition]:
    """The conditions of a rule string, which are joined with `and`.

    == counts as =. Anything else, and a feature that is not among the given ones, is an error. `always` is a rule that holds.
    """
    if text.strip().lower() == ALWAYS:
        return [Condition(ALWAYS, "present")]
    out = []
    for part in re.split(r"\s+and\s+", text.strip(), flags=re.IGNORECASE):
        if m := _NUMERIC.fullmatch(part):
            found = Condition(m[1], "=" if m[2] == "==" else m[2], m[3])
        elif m := _LABEL.fullmatch(part):
            found = Condition(m[1], "=", m[2])
        elif m := _HAS.fullmatch(part):
            found = Condition(m[1], "has", m[2])
        elif m := _PRESENT.fullmatch(part):
            found = Condition(m[1], "present")
        else:
            raise ValueError(f"not a rule: {part!r}")
        if features is not None and found.feature not in features:
            raise ValueError(f"unknown feature {found.feature!r} in {text!r}")
        out.append(found)
    return out


def parse_rule(text: str, features: Collection[str] | None = None) -> str:
    """A rule string as an SQL condition."""
    return " and ".join(c.sql() for c in parse_conditions(text, features))


def _rows(table: DataFrame, *columns: str) -> list[tuple]:
    rows = table.select(*columns).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a table of words or rules has more than {MOST_ROWS} rows")
    return [tuple(r) for r in rows]


@dataclass(frozen=True)
class Rules:
    """The rules of each scheme, as in the lexicon: conditions with points, in order."""

    disc: Mapping[str, Sequence[tuple[str, int]]] = field(default_factory=lambda: L.DISC)
    bigfive: Mapping[str, Sequence[tuple[str, int]]] = field(default_factory=lambda: L.BIGFIVE)
    enneagram: Mapping[int, Sequence[tuple[str, str, float, int]]] = field(default_factory=lambda: L.ENNEAGRAM)
    mbti: Mapping[str, tuple[Sequence[str], Sequence[str], Sequence[str]]] = field(default_factory=lambda: L.MBTI)
    #: The cases (severity, condition) of each defect, the first that holds first; None for the library's.
    defects: Mapping[str, Sequence[tuple[str, str]]] | None = None


@dataclass(frozen=True)
class Detection:
    """A rule of a scheme (defect, finding, gap, conflict, ...): its code and detail, and the conditions that all have to hold."""

    scheme: str
    place: int
    code: str
    detail: str
    conditions: tuple[Condition, ...]


def detections_of(table: DataFrame, features: Collection[str] | None = None) -> dict[str, list[Detection]]:
    """Detections from (scheme, place, code, detail, rule), in order of place; rule is a string as of parse_conditions."""
    out: dict[str, list[Detection]] = {}
    for scheme, place, code, detail, rule in sorted(_rows(table, "scheme", "place", "code", "detail", "rule")):
        out.setdefault(scheme, []).append(Detection(scheme, int(place), code, detail, tuple(parse_conditions(rule, features))))
    return out


def compiled(detections: Sequence[Detection]) -> list[tuple[str, str, str]]:
    """(code, SQL of the detail, SQL of the condition), for operators.scoring.rows_where."""
    return [(r.code, "'" + r.detail.replace("'", "''") + "'", " and ".join(c.sql() for c in r.conditions)) for r in detections]


def with_defects(rules: Rules, defects: Sequence[Detection]) -> Rules:
    """rules whose scores, confidences and further detections follow from the caller's defects."""
    cases: dict[str, list[tuple[str, str]]] = {}
    for r in defects:
        cases.setdefault(r.code, []).append((r.detail, " and ".join(c.sql() for c in r.conditions)))
    return replace(rules, defects=cases)


def words_of(table: DataFrame) -> dict[str, tuple[str, ...]]:
    """Word lists from (category, word); categories that the table lacks keep the library's lists. Blank words are left out."""
    out: dict[str, list[str]] = {}
    for category, word in sorted(r for r in _rows(table, "category", "word") if r[0] and r[1]):
        out.setdefault(category, []).append(word)
    return L.WORDS | {k: tuple(dict.fromkeys(v)) for k, v in out.items()}


def categories_of(table: DataFrame) -> dict[str, tuple[str, ...]]:
    """All word lists of a table (category, word), whatever their names: for operators.words.category_hits."""
    out: dict[str, list[str]] = {}
    for category, word in sorted(r for r in _rows(table, "category", "word") if r[0] and r[1]):
        out.setdefault(category, []).append(word)
    return {k: tuple(dict.fromkeys(v)) for k, v in out.items()}


def rules_of(table: DataFrame, features: Sequence[str] | None = None) -> Rules:
    """Rules from (model, dim, rule, points); schemes that the table lacks keep the library's rules.

    model is disc, bigfive, enneagram or mbti; rule is a string as of parse_rule. Of mbti, points of 25, 12 and -15 tell
    strong, soft and opposing rules apart; an enneagram rule is a single comparison with a number.
    """
    found: dict[str, dict] = {}
    for model, dim, rule, points in sorted(_rows(table, "model", "dim", "rule", "points")):
        condition = parse_rule(rule, features)
        if model == "enneagram":
            name, op, value = condition.split(" ", 2)
            found.setdefault(model, {}).setdefault(int(dim), []).append((name, op, float(value), int(points)))
        elif model == "mbti":
            found.setdefault(model, {}).setdefault(dim, ([], [], []))[{25: 0, 12: 1, -15: 2}[int(points)]].append(condition)
        elif model in ("disc", "bigfive"):
            found.setdefault(model, {}).setdefault(dim, []).append((condition, int(points)))
        else:
            raise ValueError(f"unknown model {model!r}")
    # a scheme's dimensions stay complete: those without a rule have none
    none = {"disc": {d: () for d in L.DISC}, "bigfive": {d: () for d in L.BIGFIVE}, "enneagram": {k: () for k in L.ENNEAGRAM}, "mbti": {k: ((), (), ()) for k in L.MBTI}}
    return Rules(**{model: none[model] | rules for model, rules in found.items()})


def bands_of(table: DataFrame) -> dict[str, tuple[np.ndarray, tuple[str, ...]]]:
    """Bands from (scheme, upto, band): each reaches up to its end, itself included; an end that is null is open. Two equal ends are an error."""
    out: dict[str, list[tuple[float, str]]] = {}
    for scheme, upto, band in _rows(table, "scheme", "upto", "band"):
        out.setdefault(scheme, []).append((float("inf") if upto is None else float(upto), band))
    for scheme, cuts in out.items():
        cuts.sort()
        if len({c for c, _ in cuts}) < len(cuts):
            raise ValueError(f"two bands of {scheme!r} have the same end")
    return {k: (np.array([c for c, _ in v]), tuple(b for _, b in v)) for k, v in out.items()}


def probes_of(table: DataFrame) -> dict[str, tuple[str, ...]]:
    """Questions from (defect, place, question), in order of place."""
    out: dict[str, list[str]] = {}
    for defect, _, question in sorted(r for r in _rows(table, "defect", "place", "question") if r[2]):
        out.setdefault(defect, []).append(question)
    return {k: tuple(v) for k, v in out.items()}


def mapping_of(table: DataFrame) -> dict[str, tuple[tuple[str, float], ...]]:
    """Weighted mappings from (source, target, weight), larger weights first."""
    out: dict[str, list[tuple[str, float]]] = {}
    for source, target, weight in sorted(_rows(table, "source", "target", "weight"), key=lambda r: (r[0], -abs(r[2]), r[1])):
        out.setdefault(source, []).append((target, float(weight)))
    return {k: tuple(v) for k, v in out.items()}
