"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, jaccard, leaks, licenses, lines, periodic, quality, quality_model, secrets, sharding, token_counts, toxicity, variants
from colloquy.llm._shared import documents


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    total, removed = out.columns[-2:]
    return out.select("doc_id", F.col(total).cast("long").alias("n_lines"), F.col(removed).cast("long").alias("n_removed"), "text")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(documents(spark, sf_dir))
    base = tuple(r.kind for r in secrets.BASE)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in base), F.sha2(secrets.spans_text(F.col("spans"), base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir).select("doc_id", "text"), SHARD_BYTES).select("doc_id", "shard", "depth", "shard_bytes")


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir), bpe.default_tokenizer())
    return coded.select("doc_id", bpe.token_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = token_counts.edited_counts(documents(spark, sf_dir), bpe.default_tokenizer())
    return edited.select("doc_id", F.col("n_before").alias("n_tokens"), "n_edits", token_counts.total().alias("n_tokens_edited"), "n_reencoded")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return quality_model.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(documents(spark, sf_dir), edit=periodic.planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    told = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.before")).alias("start"), "longest.length", (-F.col("longest.less")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.less")).alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir), edit=variants.thinned)


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_bpe_encode_decode": op7_bpe_encode_decode,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_token_counts": op10_token_counts,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}

OP9_SQL = r"""
with recursive words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
    from documents
), shingles as (
    select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
    from words
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), common as (
    select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all
), links as (
    select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)
), reach(doc_id, other) as (
    select doc_id, doc_id from documents
    union
    select r.doc_id, l.b from reach r join links l on r.other = l.a
)
select r.doc_id, coalesce(any_value(n), 0) as n_shingles, min(other) as component_id
from reach r left join sizes using (doc_id) group by r.doc_id
"""

OP6_SQL = f"""
with rows as (
    select doc_id, coalesce(strlen(text), 0) as size, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 15))::bigint as h
    from documents
), buckets as (
    select depth, h >> (60 - depth)::int as prefix, sum(size) as bytes, min(h) as lo, max(h) as hi
    from rows, (select unnest(range(0, 61)) as depth) group by all
), placed as (
    select r.doc_id, r.h, min(b.depth) as depth
    from rows r join buckets b on b.prefix = r.h >> (60 - b.depth)::int where b.bytes <= {SHARD_BYTES} or b.lo = b.hi group by all
)
select p.doc_id, case when p.depth = 0 then '' else lpad(bin(b.prefix), p.depth::int, '0') end as shard, p.depth, b.bytes::bigint as shard_bytes
from placed p join buckets b on b.depth = p.depth and b.prefix = p.h >> (60 - p.depth)::int
"""

ORACLES: dict[str, str] = {"op6_sharding": OP6_SQL, "op9_ngram_jaccard_join": OP9_SQL}
