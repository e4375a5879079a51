"""Transcripts as files: as many folders as tasks, every text as it was."""

import glob
import os

import pytest

import __spark_entry__ as entry
from colloquy.plans import catalog_reports
from colloquy.sources import tables


def conversations(spark, folder, n):
    rows = spark.range(2 * n).selectExpr("id div 2 as conv_id", "id % 2 as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('said ', id) as text")
    rows.write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def scanned(spark, folder):
    return sorted(map(tuple, entry.queries()["transcript_scan"](spark, folder).collect()))


def test_no_folder_for_each_interview(spark, tmp_path):
    at = f"{spark.conf.get('spark.checkpoint.dir')}/transcripts-*"
    before = set(glob.glob(at))
    got = scanned(spark, conversations(spark, tmp_path, 200))
    (made,) = set(glob.glob(at)) - before
    walked = list(os.walk(made))
    assert [i for i, _ in got] == list(range(200)) and "said 399" in got[-1][1]
    assert len(walked) <= 20 and sum(f.endswith(".txt") for d, _, names in walked if "_made" not in d for f in names) == 200


def test_no_conversations(spark, tmp_path):
    assert scanned(spark, conversations(spark, tmp_path, 0)) == []


def test_folder_that_only_spark_reaches(spark, tmp_path, monkeypatch):
    folder = conversations(spark, tmp_path / "in", 20)
    want = scanned(spark, folder)
    (tmp_path / "out").mkdir()
    spark.conf.set("fs.viewfs.mounttable.transcripts.link./out", f"file://{tmp_path}/out")
    monkeypatch.setattr(catalog_reports, "scratch", lambda _, name: f"viewfs://transcripts/out/{name}")
    assert len(want) == 20 and scanned(spark, folder) == want and os.listdir(tmp_path / "out") == ["transcripts"]


def test_texts_as_they_were(spark, tmp_path):
    texts = {"a": "x\n", "b": "\n\ny\r\n\n", "c": "﻿two marks", "d": "", "e.1": "面试官：好？", "-7": "z" * 100_000, "f 1%20é": "odd name", "g+h#?&": "odder"}
    rows = spark.createDataFrame(list(texts.items()), "interview_id string, text string").repartition(3)
    folders = tables.write_transcripts(rows, f"{tmp_path}/t")
    os.makedirs(f"{tmp_path}/t/lost")
    with open(f"{tmp_path}/t/lost/a.txt", "w") as file:  # what an attempt that did not end well may leave
        file.write("half")
    assert {r.interview_id: r.text for r in tables.transcript_files(spark, folders).collect()} == texts
    assert tables.transcript_files(spark, folders).count() == len(texts)


@pytest.mark.parametrize("names", [["a/b"], ["_a"], [".a"], [""], [None], ["a", "a"]])
def test_names_that_would_lose_a_text(spark, tmp_path, names):
    rows = spark.createDataFrame([(n, "x") for n in names], "interview_id string, text string").coalesce(1)
    with pytest.raises(Exception, match="no file of one interview alone"):
        tables.write_transcripts(rows, f"{tmp_path}/t")
