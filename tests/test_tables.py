"""The caller's own words, rules, probes and features."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.operators import scoring, turns
from colloquy.plans import lexicon as L
from colloquy.plans import tables
from colloquy.plans.layers import analyse


def interviews(spark):
    rows = [(1, 1, "interviewer", "why?"), (1, 2, "candidate", "we shipped it, we shipped it again"), (2, 1, "candidate", "nothing")]
    return turns.interviews(spark.createDataFrame(rows, "interview_id long, seg_id long, speaker string, text string"))


@pytest.mark.parametrize(("text", "want"), [("a >= 0.5", "a >= 0.5"), ("a==2", "a = 2"), ("b == team", "b = 'team'"), ("a >= 1 and b = 'x' AND c<-2", "a >= 1 and b = 'x' and c < -2")])
def test_rule_strings(text, want):
    assert tables.parse_rule(text) == want


@pytest.mark.parametrize("text", ["a", "a >= x y", "a >= 1; drop table x", "1 >= 2", "a like 'b%'", ""])
def test_other_strings_are_refused(text):
    with pytest.raises(ValueError):
        tables.parse_rule(text)
    with pytest.raises(ValueError):
        tables.parse_rule("a >= 1", ["b"])


def test_own_words_and_rules(spark):
    words = tables.words_of(spark.createDataFrame([("action", "shipped"), ("action", "shipped"), ("plural", "we"), ("none", None)], "category string, word string"))
    rules = tables.rules_of(spark.createDataFrame([("disc", "D", "n_action >= 2", 40), ("disc", "D", "loud == yes", 5), ("enneagram", "3", "length_ratio >= 0.5", 30), ("mbti", "E", "n_plural > 1", 25)], "model string, dim string, rule string, points int"))

    @F.pandas_udf("double")
    def half(s: pd.Series) -> pd.Series:
        return s / 2.0

    extra = {"loud": F.when(F.col("n_action") > 0, "yes").otherwise("no"), "length_ratio": half(F.col("n_action"))}
    got = {r.interview_id: r for r in analyse(interviews(spark), words, rules, extra).collect()}
    assert (got[1].n_action, got[1].disc_d, got[1].type_3, got[1].side_e) == (2, 70, 45, 25)
    assert (got[2].n_action, got[2].disc_d, got[2].type_3, got[2].side_e) == (0, 25, 15, 0)
    assert rules.bigfive is L.BIGFIVE and rules.disc["S"] == ()


def test_too_large_a_table_is_refused(spark, monkeypatch):
    monkeypatch.setattr(tables, "MOST_ROWS", 2)
    with pytest.raises(ValueError):
        tables.words_of(spark.createDataFrame([("a", str(i)) for i in range(3)], "category string, word string"))


def test_own_probes_and_mappings(spark):
    df = spark.createDataFrame([(1, "high", "D")], "interview_id long, defect_x string, disc_top string")
    asked = tables.probes_of(spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("x", 3, None)], "defect string, place int, question string"))
    assert [r.question for r in scoring.probes(df, asked).orderBy("place").collect()] == ["a", "b"]
    to = tables.mapping_of(spark.createDataFrame([("D", "9", 0.5), ("D", "8", 0.7)], "source string, target string, weight double"))
    assert [(r.type, r.weight) for r in scoring.disc_to_types(df, to).collect()] == [("8", 0.7), ("9", 0.5)]
