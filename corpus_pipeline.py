"""A corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, BPE encoding.

Null and empty texts are rejected by the quality rules, so later stages meet them only where line dedup empties a text: such
a text is linked with nothing, holds no item and has no tokens. Rows that repeat an id are judged one by one. An empty
table goes through all stages. Further columns stay as they are until the last stage, whatever their names.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. Between stages the rows are written as a table in the shared folder, so a lost executor costs no
more than its own stage. Very long texts go through every stage whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, jaccard, leaks, lines, quality
from colloquy.llm._shared import documents, free_prefix, spill


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; a text of which all is repeated becomes empty. n_chars follows."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: that with the smallest id, rows without an id last, then by a hash of all columns."""
    row = free_prefix(docs, "__row")
    rows = spill(docs.withColumn(row, F.monotonically_increasing_id()), "near-duplicates-rows")
    found = jaccard.jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), repeats=None)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64(*columns).alias("hash"), F.col(row).alias("row"))
    linked = rows.select(row, order.alias("order")).join(found.select(F.col("doc_id").alias(row), "component_id"), row)
    stays = linked.groupBy("component_id").agg(F.min("order").alias("least")).select(F.col("least.row").alias(row))
    return rows.join(stays, row, "left_semi").select(*columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text that is left, and whether they decode to it."""
    coded = bpe.encode_decode(docs.select("doc_id", "text"), bpe.default_tokenizer())
    return coded.select("doc_id", bpe.token_count(F.col("ids")).alias("n_tokens"), F.col("ids").alias("token_ids"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Rolling hashes, winnowing and BPE are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
