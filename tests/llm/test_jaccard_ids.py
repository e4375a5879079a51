"""Rows without an id take no links from equal texts that have one."""

from collections import Counter
from itertools import permutations

import corpus
import numpy as np
import pyarrow as pa

from colloquy.llm import _words as W
from colloquy.llm import jaccard

TEXT = corpus.prose(95, 90)
ROWS = [(None, TEXT), (7, TEXT), (9, TEXT + " end")]


def test_a_copy_without_an_id_is_no_entry():
    for rows in permutations(ROWS):
        texts = pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([1] * 3, pa.int64()), pa.array([0] * 3, pa.int64())], names=["doc_id", "text", "copies", "block"])
        sent = jaccard._sender(1, 5)(texts)
        got = jaccard._keeper(5)(texts, jaccard._count(sent)).to_pylist()
        assert {r["doc_id"] for r in got if r["is_entry"]} == {7, 9}
        assert all(len(r["tokens"]) == (r["n_shingles"] if r["is_entry"] else 0) for r in got)


def test_links_hold_beside_copies_without_an_id(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = [(None, TEXT)] * 20 + [(7, TEXT), (9, TEXT + " end")]
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {None: None, 7: 7, 9: 7}


def test_rows_that_repeat_are_counted_and_given_back(spark):
    rows = [(7, TEXT)] * 9 + [(9, TEXT + " end")] * 2 + [(None, TEXT)] * 5 + [(3, None)] * 6 + [(7, TEXT + " more")] * 4 + [(8, "")] + [(6, corpus.prose(96, 60))] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter(map(tuple, jaccard.jaccard_components(docs).collect()))
    assert sum(want.values()) == len(rows) and want[(7, 86, 7)] == 9 and want[(6, 56, 6)] == 7
    for repeats in (0, 1, 4):
        assert Counter(map(tuple, jaccard.jaccard_components(docs, repeats=repeats).collect())) == want
    given = jaccard._given_back(spark.createDataFrame([("a", 7), ("b", 1), ("c", 6), ("d", 3)], "x string, copies long"), step=3)
    assert Counter(r.x for r in given.collect()) == {"a": 7, "b": 1, "c": 6, "d": 3}


def test_sets_with_one_half_of_the_hash_in_common_stay_apart(spark, monkeypatch):
    """Sets whose set_key is forged to be equal differ by set_check, within a block and between blocks."""
    mix = W.mix
    texts = [corpus.prose(200 + i, 60) for i in range(6)]
    table = lambda part: pa.table([pa.array(range(len(part)), pa.int64()), pa.array(part), pa.array([1] * len(part), pa.int64()), pa.array([0] * len(part), pa.int64())], names=["doc_id", "text", "copies", "block"])
    doubled = texts + [t + " end" for t in texts]
    levels = jaccard._count(jaccard._sender(1, 5)(table(doubled)))
    sums = []

    def forged(x):
        sums.append(len(x))
        return np.zeros_like(x) if len(sums) == SET_KEY else mix(x)

    plain = jaccard._keeper(5)(table(doubled), levels)
    calls = []
    monkeypatch.setattr(W, "mix", lambda x: calls.append(1) or mix(x))
    jaccard._keeper(5)(table(doubled), levels)
    SET_KEY = len(calls) - 1
    monkeypatch.setattr(W, "mix", forged)
    got = jaccard._keeper(5)(table(doubled), levels)
    assert set(got.column("set_key").to_pylist()) == {0} and got.column("is_entry").to_pylist() == plain.column("is_entry").to_pylist()
    assert got.column("set_check").to_pylist() == plain.column("set_check").to_pylist()
