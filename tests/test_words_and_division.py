"""Large word tables against the compiled form, and detections by division against compiled rules."""

import random
import time

import pytest
from pyspark.sql import functions as F

from colloquy.functions.expressions import hits
from colloquy.operators import bands as B
from colloquy.operators import division, scoring, turns
from colloquy.operators import words as W
from colloquy.plans import detections as D
from colloquy.plans import dimensions
from colloquy.plans import lexicon as L
from colloquy.plans import tables
from colloquy.plans.layers import all_layers, analyse, apply, counted, counts
from colloquy.plans.views import zh_turns


def plain(text, words):
    return sum((text or "").count(w) for w in dict.fromkeys(words) if w)


def made(seed, n, letters="abc"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("text", ["", None, "aaaaaaa", "abababab", "aabaabaab", "我们我们我们", "x😀😀😀y", "nothing"])
def test_words_that_overlap_themselves_and_each_other(text):
    lists = {"a": ("a", "aa", "aaa", "aba", "abab", "aab"), "b": ("aa", "我们", "我", "们我们", ""), "c": (), "d": ("😀😀", "😀", "aa", "aa")}
    counter = W.WordCounter(lists)
    assert counter.categories(text).tolist() == [plain(text, v) for v in lists.values()]


def test_no_words_at_all():
    assert W.WordCounter({"a": ()}).categories("text").tolist() == [0] and W.WordCounter({}).categories("text").tolist() == []


def test_fifty_thousand_words_are_the_compiled_counts(spark):
    words = sorted(set(made(1, 70_000, "abcdef")))[:50_000]
    lists = {f"k{i}": words[i::25] for i in range(25)}
    texts = [(i, " ".join(made(i + 2, 60, "abcdef"))) for i in range(6)] + [(6, None), (7, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    got = {r.id: r for r in W.with_counts(df, {"text": lists}).collect()}
    for i, text in texts:
        assert [got[i][k] for k in lists] == [plain(text, v) for v in lists.values()]
    long = {(r.id, r.category): (r.words, r.hits) for r in W.category_hits(df, "text", lists).collect()}
    for i, text in texts:
        for k, v in lists.items():
            assert long.get((i, k), (0, 0)) == (sum(w in (text or "") for w in v), plain(text, v))
    some = {k: v[:40] for k, v in list(lists.items())[:3]}  # as many as can be compiled
    compiled = df.selectExpr("id", *(f"{hits('text', v)} as {k}" for k, v in some.items())).where("text is not null").collect()
    assert all([r[k] for k in some] == [plain(dict(texts)[r.id], v) for k, v in some.items()] for r in compiled)


def test_the_time_of_a_text_does_not_follow_the_number_of_words():
    text = " ".join(made(9, 20_000, "mnop"))
    few, many = (W.WordCounter({"a": [f"mn{w}" for w in set(made(3, 60, "mnop"))] + [f"z{i}" for i in range(n)]}) for n in (500, 50_000))

    def best(counter):
        times = []
        for _ in range(5):
            began = time.perf_counter()
            counter.categories(text)
            times.append(time.perf_counter() - began)
        return min(times)

    assert few.categories(text)[0] == many.categories(text)[0] > 0
    assert best(many) < 4 * best(few) + 0.02


def test_counts_of_interviews_are_the_compiled_ones(spark, sf_dir):
    rows = turns.interviews(zh_turns(spark, sf_dir))
    one, other = (sorted(map(repr, (r.asDict() for r in df.select("interview_id", *counts(L.WORDS)).collect()))) for df in (apply(rows, [counts(L.WORDS)]), counted(rows, L.WORDS)))
    assert one == other
    assert counted(rows, L.WORDS, {"n_action", "text_length"}).columns[-2:] == ["n_action", "text_length"]


def test_scores_from_a_large_word_table(spark):
    rows = [(1, 1, "candidate", "qa qb qc and more"), (2, 1, "candidate", "none of them")]
    interviews = turns.interviews(spark.createDataFrame(rows, "interview_id long, seg_id long, speaker string, text string"))
    table = spark.createDataFrame([("action", f"q{x}") for x in "abc"] + [("action", f"never{i}") for i in range(3000)] + [("type_3", f"q{x}") for x in "ab"], "category string, word string")
    got = {r.interview_id: r for r in analyse(interviews, tables.words_of(table)).collect()}
    assert (got[1].n_action, got[1].h_type_3, got[2].n_action) == (3, 2, 0)


# division


def compiled(scored, detections, caps):
    """What the CASE of each rule gives."""
    out = set()
    for scheme, rules in detections.items():
        for r in scoring.rows_where(scored, tables.compiled(rules), caps.get(scheme)).orderBy("interview_id", "ord").collect():
            out.add((r.interview_id, scheme, r.code, r.detail))
    return out


@pytest.fixture(scope="module")
def interviews(spark):
    rows = turns.interviews(zh_turns(spark, "/root/testdata/sf0.001")).cache()
    yield rows
    rows.unpersist()


def divided(scored, detections, caps):
    rows = division.detect(scored, detections, caps).collect()
    places = {}
    for r in rows:
        places.setdefault((r.interview_id, r.scheme), []).append(r.place)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    return {(r.interview_id, r.scheme, r.code, r.detail) for r in rows}


def test_the_library_rules(spark, interviews):
    scored = analyse(interviews, L.with_stems()).withColumns({k: F.expr(v) for k, v in division.DERIVED.items()})
    detections = tables.detections_of(D.rule_table(spark), set(scored.columns))
    got = divided(scored, detections, D.CAPS)
    assert got == compiled(scored, detections, D.CAPS) and {s for _, s, _, _ in got} >= {"defect", "finding", "gap", "interaction", "graph"}


@pytest.mark.parametrize("seed", range(4))
def test_random_rules(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, *(rnd.choice([None, 0.0, 0.5, 1.0, 2.0]) for _ in "xy"), rnd.choice([None, "AB", "BC", "C"])) for i in range(40)]
    scored = spark.createDataFrame(rows, "interview_id long, x double, y double, kind string")
    parts = lambda: rnd.choice([f"{rnd.choice('xy')} {rnd.choice(['>=', '<=', '>', '<', '=='])} {rnd.choice(['0', '0.5', '1', '-1'])}", f"kind has {rnd.choice('ABC')}", "kind is present", f"kind == {rnd.choice(['AB', 'C'])}", "x is present"])
    table = [(rnd.choice("mn"), i, f"c{rnd.randrange(9)}", rnd.choice(["low", "high"]), rnd.choice([" and ".join(parts() for _ in range(rnd.randint(1, 4))), "always"])) for i in range(25)]
    detections = tables.detections_of(spark.createDataFrame(table, "scheme string, place int, code string, detail string, rule string"))
    caps = {"m": 3}
    assert divided(scored, detections, caps) == compiled(scored, detections, caps)


def test_a_table_changes_what_is_found_and_what_follows(spark, interviews):
    own = [("defect", 0, "quiet", "high", "word_count > 0"), ("defect", 1, "never", "high", "word_count < 0"), ("interaction", 0, "only_quiet", "pair", "defect_quiet is present"), ("interaction", 1, "both", "pair", "defect_quiet is present and defect_never is present"), ("finding", 0, "unsure", "low", "star_confidence == low")]
    detections = tables.detections_of(spark.createDataFrame(own, "scheme string, place int, code string, detail string, rule string"))
    rules = tables.with_defects(tables.Rules(), detections["defect"])
    scored = analyse(interviews, rules=rules).cache()
    n = interviews.count()
    got = divided(scored, detections, {})
    count = lambda code: sum(c == code for _, _, c, _ in got)
    assert count("quiet") == count("only_quiet") == n and count("both") == count("never") == 0
    assert scored.where("n_high = 1 and defect_quiet = 'high' and defect_never is null").count() == n and "defect_fake_star" not in scored.columns
    assert got == compiled(scored, detections, {})
    assert scored.where("star_confidence = 'high'").count() == 0


def test_odd_rules(spark):
    scored = spark.createDataFrame([(1, 2, True, None)], "interview_id long, x int, b boolean, label string")
    rule = lambda text: tables.detections_of(spark.createDataFrame([("s", 0, "c", "d", text)], "scheme string, place int, code string, detail string, rule string"))
    assert divided(scored, rule("b == 1 and x == 2"), {}) == {(1, "s", "c", "d")}
    assert divided(scored, rule("label is present"), {}) == set() == divided(scored, rule("label has x"), {})
    with pytest.raises(ValueError):
        division.detect(scored, rule("missing > 1"), {})
    assert divided(scored.where("false"), rule("x > 0"), {}) == set()
    with pytest.raises(ValueError):
        rule("x has 1 2")


def test_the_plan_does_not_grow_with_the_rules(spark):
    scored = spark.createDataFrame([(1, 2.0)], "interview_id long, x double")
    table = [("s", i, f"c{i}", "d", f"x >= {i}") for i in range(2000)]
    detections = tables.detections_of(spark.createDataFrame(table, "scheme string, place int, code string, detail string, rule string"))
    found = division.detect(scored, detections, {})
    assert found.count() == 3 and len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_all_layers_keep_their_names():
    assert [len(x) for x in all_layers()] == [len(x) for x in all_layers(L.WORDS, tables.Rules())]


# bands and dimension tables


def test_bands_by_binary_search(spark):
    rnd = random.Random(6)
    cuts = sorted(rnd.sample(range(100_000), 10_000))
    table = [("many", float(c), f"b{c}") for c in cuts] + [("few", 10.0, "low"), ("few", None, "high")]
    bands = tables.bands_of(spark.createDataFrame(table, "scheme string, upto double, band string"))
    scores = [("many", x) for x in (*rnd.sample(range(100_000), 300), *cuts[:50], cuts[-1] + 1, -1)] + [("few", 10), ("few", 11), ("few", None), ("none", 3), (None, 3)]
    rows = spark.createDataFrame(scores, "scheme string, score long")
    want = []
    for s, x in scores:
        own = [] if x is None else [(c or float("inf"), b) for t, c, b in table if t == s and (c is None or c >= x)]
        want.append((s, x, min(own)[1] if own else None))
    assert sorted(map(tuple, B.banded(rows, bands).collect()), key=str) == sorted(want, key=str)
    assert B.banded(rows.where("false"), bands).count() == 0


def test_bands_with_equal_ends_are_refused(spark):
    with pytest.raises(ValueError):
        tables.bands_of(spark.createDataFrame([("s", 1.0, "a"), ("s", 1.0, "b")], "scheme string, upto double, band string"))


def test_tables_that_a_user_edits(spark, interviews, tmp_path):
    path = str(tmp_path / "d")
    dimensions.save(dimensions.own_tables(spark), path)
    found = dimensions.load(spark, path)
    assert {k: v.count() for k, v in found.items()} == {k: v.count() for k, v in dimensions.own_tables(spark).items()}
    found["probes"] = spark.createDataFrame([("situation_missing", 0, "where?")], found["probes"].schema)
    found["bands"] = spark.createDataFrame([("bigfive", None, "any")], found["bands"].schema)
    scored = analyse(interviews)
    got = {(r.kind, r.scheme, r.code): r.interviews for r in dimensions.used(interviews, scored, found).collect()}
    assert got["bands", "bigfive", "any"] == interviews.count() and [k for k in got if k[0] == "probes"] == [("probes", "situation_missing", "where?")]
    assert {k for k, *_ in got} == {"lexicon", "rules", "bands", "probes", "mappings"}
