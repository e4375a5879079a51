"""Expressions as SQL text, so that rule tables compile to plain columns: no join, no row for each rule.

The text keeps to what Spark SQL and ANSI engines share, but for the words that `ansi` replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterable


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def hits(column: str, words: Iterable[str]) -> str:
    """Non-overlapping occurrences of each word, summed over the words.

    What a text loses without the word is measured in bytes, which are known without looking at the text.
    """
    parts = [f"(octet_length({column}) - octet_length(replace({column}, {quoted(w)}, ''))) div {len(w.encode())}" for w in words]
    return "(" + " + ".join(parts or ["0"]) + ")"


def ratio(n: str, d: str) -> str:
    """n / d to four places, halves up, in whole numbers; 0 without d."""
    return f"(case when {d} <= 0 then cast(0 as double) else cast((20000 * ({n}) + ({d})) div (2 * ({d})) as double) / 10000 end)"


def clamp(x: str, low: int = 0, high: int = 100) -> str:
    return f"greatest({low}, least({high}, {x}))"


def points(rules: Iterable[tuple[str, int]]) -> str:
    """The sum of the points of the rules that hold."""
    return "(" + (" + ".join(f"case when {condition} then {n} else 0 end" for condition, n in rules) or "0") + ")"


def tolerant(condition: str) -> str:
    """A numeric comparison with 5 % of tolerance; other conditions stay."""
    m = re.fullmatch(r"(\w+) (>=|<=|>|<) ([0-9.]+)", condition)
    if not m:
        return condition
    return f"{m[1]} {m[2]} {round(float(m[3]) * (0.95 if '>' in m[2] else 1.05), 6)}"


def ansi(text: str) -> str:
    """The same expression for an engine with // for whole division, round_even and regexp_extract_all."""
    text = re.sub(r"\bdiv\b", "//", text)
    text = text.replace("bround(", "round_even(").replace("octet_length(", "strlen(").replace(" struct(", " row(").replace("(struct(", "(row(")
    text = re.sub(r"regexp_count\((\w+), ", r"regexp_count_(\1, ", text)
    text = re.sub(r"regexp_count_\((\w+), ('(?:[^']|'')*')\)", r"len(regexp_extract_all(\1, \2))", text)
    return re.sub(r"(\w+) rlike ('(?:[^']|'')*')", r"regexp_matches(\1, \2)", text)
