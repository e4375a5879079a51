"""Stages decide by row: ids can be null or repeated."""

from collections import Counter

import corpus

import corpus_pipeline as P
from colloquy.llm import leaks

LEAK = f"{corpus.prose(13, 70)} {corpus.ITEM} {corpus.prose(14, 70)}"
CLEAN = corpus.prose(90, 80)
COPY = corpus.prose(91, 80)
NEAR = COPY + " end"


def test_leaks_go_by_row(spark):
    rows = [(None, LEAK), (None, CLEAN), (1, LEAK), (1, CLEAN), (1, LEAK), (2, CLEAN), (2, CLEAN), (3, None), (None, None)]
    items = [(1, corpus.ITEM), (2, corpus.prose(92, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1 << 20, 1):
        got = leaks.without_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
        assert got.schema == docs.schema
        assert Counter(map(tuple, got.collect())) == Counter(r for r in rows if r[1] != LEAK)


def test_one_row_of_each_group_stays(spark, tmp_path):
    rows = [(5, COPY), (5, COPY), (7, NEAR), (7, CLEAN), (None, NEAR), (None, LEAK), (None, LEAK), (8, None), (8, None), (None, None), (9, ""), (4, COPY)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, __row long").repartition(3)
    got = P.near_duplicates(spark, docs, str(tmp_path))
    assert got.dtypes == docs.dtypes
    assert all(rows[r["__row"]] == (r.doc_id, r.text) for r in got.collect())
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(4, COPY), (7, CLEAN), (None, LEAK), (8, None), (8, None), (None, None), (9, "")])
