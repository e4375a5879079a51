"""Pages of equal rows keep the byte limit, from however many partitions the rows come."""

from collections import Counter, defaultdict

import pytest

from colloquy.llm import sharding


@pytest.mark.parametrize(("size", "copies", "pages"), [(700, 24, 24), (300, 50, 17), (100, 95, 10)])
def test_pages_fit(spark, size, copies, pages):
    rows = [(1, "x" * size, i) for i in range(copies)] + [(2, "y" * size, 0), (2, "y" * size, 1), (2, "y" * size, 2), (3, "z" * 5000, 0), (4, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other long").repartition(7)
    got = sharding.shard(docs, 1000).collect()
    assert Counter((r.doc_id, r.text, r.other) for r in got) == Counter(rows)
    held, stated = defaultdict(int), {}
    for r in got:
        held[r.shard] += len(r.text or "")
        assert stated.setdefault(r.shard, r.shard_bytes) == r.shard_bytes
    assert held == stated
    assert all(n <= 1000 for n in held.values() if n != 5000)
    assert len({r.shard for r in got if r.doc_id == 1}) == pages


def test_both_ways_to_look_up_give_the_same(spark):
    rows = [(i, "t%d " % i * (i % 40), i) for i in range(400)] + [(7, "x" * 900, 1)] * 5 + [(None, None, 2), (None, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, depth long").repartition(5)
    pick = lambda most: Counter((r.doc_id, r.text, r.shard.split("-")[0], r.depth, r.shard_bytes) for r in sharding.shard(docs, 1000, most).collect())
    broadcast, joined = pick(sharding.MOST_ENTRIES), pick(0)
    assert broadcast == joined and sum(joined.values()) == len(rows) and len({s for _, _, s, _, _ in joined}) > 20
    assert sharding.shard(docs, 10**9, 0).select("shard").distinct().count() == 1
    assert sharding.shard(docs, 1000).columns == ["doc_id", "text", "shard", "depth", "shard_bytes"]


def test_names_of_the_operator_stay_the_users(spark):
    rows = [(i, "t%d " % i * (i % 40), f"mine{i}", i) for i in range(60)] + [(7, "x" * 900, "same", 1)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, __shard_h string, __shard_leaf long").repartition(3)
    got = sharding.shard(docs, 1000)
    assert got.columns == [*docs.columns, "shard", "depth", "shard_bytes"] and got.dtypes[:4] == docs.dtypes
    assert Counter(tuple(r)[:4] for r in got.collect()) == Counter(rows)
    plain = sharding.shard(docs.select("doc_id", "text"), 1000).collect()
    assert Counter((r.doc_id, r.shard.split("-")[0], r.shard_bytes) for r in got.collect()) == Counter((r.doc_id, r.shard.split("-")[0], r.shard_bytes) for r in plain)
