"""The pipeline's stages, each on what the one before it kept."""

import corpus
import pytest

import corpus_pipeline as P
from colloquy.llm._shared import spill


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    corpus.table(spark).drop("key", "runs").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, corpus.ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = []
    for name, stage in P.STAGES[:-1]:
        out = spill(stage(spark, docs, folder), "stage")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        ids.append({r.doc_id for r in out.collect()})
        docs = out
    assert 12 not in ids[0] and {6, 8, 13, 10} <= ids[0]
    assert ids[1] == ids[0]
    assert 6 in ids[2] and 8 not in ids[2] and {10, 13, 15} <= ids[2]
    assert ids[3] == ids[2] - {13}
    last = P.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in last} == ids[3] and all(r.n_tokens * 4 == len(r.token_ids) for r in last)
    assert {r.doc_id for r in P.run(spark, folder).collect()} == ids[3]
