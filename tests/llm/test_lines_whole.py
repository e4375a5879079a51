"""Line dedup against brute force: what must go, and what may."""

import time

import corpus
import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import lines

NOISE, GUARANTEE = 25, 50


def words(line):
    return len(line.encode().split())


def bounds(rows):
    """For each row, the lines that have to go and those that may: of runs of 50 and of 25 words that stand earlier."""
    order = sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len({r[0] for r in order}) == len(order)
    texts = {r: [(i, x) for i, x in enumerate(r[1].split("\n")) if words(x)] for r in order}
    out = {}
    seen = set()
    for r in order:
        own = texts[r]
        must, may = set(), set()
        for a in range(len(own)):
            total, here = 0, []
            for b in range(a, len(own)):
                total += words(own[b][1])
                here.append(own[b][1])
                if total >= NOISE and tuple(here) in seen:
                    may |= {i for i, _ in own[a : b + 1]}
                    if total >= GUARANTEE:
                        must |= {i for i, _ in own[a : b + 1]}
                if total >= NOISE:
                    seen.add(tuple(here))
        out[r] = must, may
    return out


def check(spark, rows):
    want = bounds(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.doc_id, r.text): r for r in docs.join(lines.repeated_runs(docs).withColumnRenamed("runs", "r"), lines._key() == lines.F.col("key"), "left").collect()}
    total = 0
    for r, (must, may) in want.items():
        gone = {i for run in found[r].r or () for i in range(run["first"], run["last"] + 1)}
        gone = {i for i in gone if words(r[1].split("\n")[i])}
        assert must <= gone, (r[0], must - gone)
        assert gone <= may, (r[0], gone - may)
        total += len(gone)
    return total


def test_edges_go_whatever_stands_around_the_first_place(spark):
    line = {c: corpus.prose(200 + i, 12) for i, c in enumerate("abcdefghij")}
    join = lambda s: "\n".join(line[c] for c in s)
    # the fingerprint of cdef is first in document 1, with other edges; the edges of 4 stand in 2 and 3
    rows = [(1, join("cdef")), (2, join("abcdefg")), (3, join("jcdefghi")), (4, join("abcdefghi")), (None, join("ij")), (5, None), (6, "")]
    assert check(spark, rows) > 9


def test_random_shared_runs(spark):
    rng = np.random.default_rng(5)
    pool = [corpus.prose(300 + i, int(rng.choice([2, 6, 14, 40, 90]))) for i in range(40)]
    runs = [pool[a : a + int(rng.integers(2, 9))] for a in range(0, 32, 4)]
    rows = []
    for d in range(30):
        own = []
        for k in range(4):
            run = runs[rng.integers(len(runs))]
            a = int(rng.integers(0, len(run)))
            own += [corpus.prose(1000 + 10 * d + k, int(rng.integers(3, 30))), *run[a:], "", *run[: int(rng.integers(0, len(run)))]]
        rows.append((d, "\n".join(own)))
    assert check(spark, rows) > 50


def test_a_line_repeated_in_one_text(spark):
    rows = [(1, "\n".join(["ten words are in this line of a short list"] * 30)), (2, "\n".join(["ten words are in this line of a short list"] * 8))]
    check(spark, rows)


def test_texts_that_share_64_bits_of_hash_are_different(spark, monkeypatch):
    rows = [(d, "\n".join(corpus.prose(700 + 40 * d + i, 13) for i in range(20))) for d in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = F.xxhash64
    # every shingle and every extended match has the same first hash
    monkeypatch.setattr(lines.F, "xxhash64", lambda *cols: real(*cols) * 0 if len(cols) == 1 else real(*cols))
    assert lines.repeated_runs(docs).count() == 0
    assert lines.repeated_runs(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10))).count() == 4


def test_columns_of_any_name_stay(spark):
    docs = corpus.table(spark).withColumns({"__line_key": F.lit("mine"), "__line_total": F.lit(-1), "key": F.lit(2), "runs": F.lit(3), "___line_kept": F.lit(4)})
    out = lines.dedup_lines(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and len(set(out.columns)) == len(docs.columns) + 2
    got = out.collect()
    assert len(got) == docs.count() and all((r["__line_key"], r["__line_total"], r["key"], r["runs"], r["___line_kept"]) == ("mine", -1, 2, 3, 4) for r in got)
    assert lines.dedup_lines(corpus.empty(spark)).count() == 0


def test_long_texts_take_time_in_proportion(spark):
    def seconds(n):
        text = "\n".join(f"line {i} of a long log file with ten words {i % 7} each" for i in range(n))
        docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
        began = time.perf_counter()
        got = {r.doc_id: r[-1] for r in lines.dedup_lines(docs).collect()}
        assert got == {1: 0, 2: n}
        return time.perf_counter() - began

    seconds(1000)
    few, many = seconds(12_000), seconds(24_000)
    assert many < 2.5 * few + 2


def test_a_text_of_many_megabytes(spark):
    text = "\n".join(f"{i} here is a line of some ten words or so" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "a line of its own\n" + text)], "doc_id long, text string")
    got = {r.doc_id: (r[-1], len(r.text)) for r in lines.dedup_lines(docs).collect()}
    assert len(text) > 8_000_000 and got == {1: (0, len(text)), 2: (200_000, 17)}
