"""Sharding by extendible hashing.

Each row has a hash of 60 bits (from the MD5 of its doc_id and text). The directory is indexed by the hash's first bits:
it begins with one bucket, and only buckets above the byte limit split, on the next bit, until every shard fits. To
find it, the bytes are first summed over a fixed number of leading bits, then rolled up to shorter prefixes; buckets that
are still too large are counted over more bits, on their own rows alone.

A bucket whose rows all have one hash (rows that repeat doc_id and text, or one row above the limit) cannot split on any
bit. It is kept whole if it is a single row, however large, and else its equal rows are numbered (in each partition of a
written table, and then on from the partitions before) and fill one page after the other. shard_bytes is what the rows of
a shard or page really have. Null texts have no bytes, null ids hash as empty; such rows have a shard as any other. An empty
table has no shards. Very long texts are only measured and hashed. Ties cannot occur. All columns are kept but those that are
named shard, depth or shard_bytes, which the result's own replace; other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from colloquy.llm._shared import bounded_batches, free_prefix, spill

#: Columns of the result; columns of docs with these names give way to them.
ADDED = ("shard", "depth", "shard_bytes")
BITS = 60
#: Bits that one pass counts over.
STEP = 12


def row_hash() -> Column:
    text = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: str, depth: int | Column) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", F.col(h), (F.lit(BITS) - depth).cast("int"))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, bytes, n_rows, single) of each shard, from (h, bytes) of each row."""
    leaves, rest, base = None, sizes, 0
    while True:
        top = min(base + STEP, BITS)
        # bytes over `top` bits, below the buckets that are still too large; then each shorter prefix
        fine = spill(rest.groupBy(_prefix("h", top).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_rows"), F.min("h").alias("lo"), F.max("h").alias("hi")), "shard-counts")
        levels = fine.select("*", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
        levels = levels.groupBy("depth", F.call_function("shiftright", F.col("p"), (F.lit(top) - F.col("depth")).cast("int")).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))
        parents = levels.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        reached = levels.withColumn("up", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
        inner = reached.where(F.col("depth") > base).join(parents, ["depth", "up"], "left_semi").select(levels.columns)
        candidates = inner.unionByName(levels.where(F.col("depth") == base))
        done = spill(candidates.where(fits).select("depth", "prefix", "bytes", "n_rows", (F.col("lo") == F.col("hi")).alias("single")), "shard-directory")
        leaves = done if leaves is None else leaves.unionByName(done)
        large = candidates.where(~fits & (F.col("depth") == top)).select(F.col("prefix").alias("p"))
        if top == BITS or large.isEmpty():
            return leaves
        large = spill(large, "shard-large")
        rest = rest.withColumn("p", _prefix("h", top)).join(large, "p", "left_semi").select("h", "bytes")
        base = top


#: A larger directory is joined; a smaller one (40 bytes an entry) goes to every task.
MOST_ENTRIES = 2_000_000


def _first(prefix: Column, depth: Column) -> Column:
    return F.call_function("shiftleft", prefix, (F.lit(BITS) - depth).cast("int"))


def _joined(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows with __shard_leaf by a join: on the bits that all entries have, then by the range of hashes of each entry.

    Hashes are even but for equal rows, so few entries share those bits, and each row has one of them.
    """
    bits = leaves.agg(F.min("depth")).first()[0] or 0
    leaf = leaves.select(
        F.call_function("shiftright", F.col("prefix"), (F.col("depth") - bits).cast("int")).alias("__shard_top"),
        _first(F.col("prefix"), F.col("depth")).alias("__shard_lo"),
        (_first(F.col("prefix") + 1, F.col("depth")) - 1).alias("__shard_hi"),
        F.struct(F.col("depth").cast("int").alias("depth"), "bytes", "n_rows", F.col("single").cast("long").alias("single")).alias("__shard_leaf"),
    )
    inside = (F.col("__shard_h") >= F.col("__shard_lo")) & (F.col("__shard_h") <= F.col("__shard_hi"))
    keyed = rows.withColumn("__shard_key", _prefix("__shard_h", bits))
    return keyed.join(leaf, (F.col("__shard_key") == F.col("__shard_top")) & inside).drop("__shard_key", "__shard_top", "__shard_lo", "__shard_hi")


def _looked_up(h: Column, leaves: DataFrame) -> Column:
    """depth and bytes of the shard of a hash: the last entry, by its first hash, that is not above it."""
    table = leaves.select(_first(F.col("prefix"), F.col("depth")).alias("first"), F.col("depth").cast("long").alias("depth"), "bytes", "n_rows", F.col("single").cast("long").alias("single")).toArrow().sort_by("first")
    sent = leaves.sparkSession.sparkContext.broadcast([c.to_numpy() for c in table.columns])

    @F.pandas_udf("depth int, bytes long, n_rows long, single long")
    def find(values: pd.Series) -> pd.DataFrame:
        start, *rest = sent.value
        at = np.searchsorted(start, values.to_numpy(), side="right") - 1
        return pd.DataFrame({name: column[at] for name, column in zip(("depth", "bytes", "n_rows", "single"), rest, strict=True)})

    return find(h)


def shard(docs: DataFrame, limit: int, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """docs with shard (hash prefix in bits, and a page where one hash is above the limit), depth and shard_bytes."""
    names = [c for c in docs.columns if c not in ADDED]
    taken = [c for c in names if c.startswith("__shard_")]
    if taken:
        aside = {c: f"{free_prefix(docs, 'kept_')}{i}" for i, c in enumerate(taken)}
        moved = docs.select(*(F.col(f"`{c}`").alias(aside.get(c, c)) for c in names))
        return shard(moved, limit, most_entries).select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in names), *ADDED)
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    own = docs.withColumns({"__shard_h": row_hash(), "__shard_size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")})
    leaves = spill(directory(own.select(F.col("__shard_h").alias("h"), F.col("__shard_size").alias("bytes")), limit), "shards")
    if leaves.count() <= most_entries:
        own = own.withColumn("__shard_leaf", _looked_up(F.col("__shard_h"), leaves))
    else:
        own = _joined(own, leaves)
    leaf = F.col("__shard_leaf")
    depth = leaf["depth"]
    bits = F.lpad(F.conv(F.call_function("shiftright", F.col("__shard_h"), (F.lit(BITS) - depth).cast("int")).cast("string"), 10, 2), depth, F.lit("0"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    result = lambda name, size: [*columns, name.alias("shard"), depth.cast("long").alias("depth"), size.cast("long").alias("shard_bytes")]
    if leaves.where(_paged(limit, F.col("bytes"), F.col("n_rows"), F.col("single").cast("long"))).isEmpty():
        return own.select(*result(bits, leaf["bytes"]))
    paged = _paged(limit, leaf["bytes"], leaf["n_rows"], leaf["single"])
    numbered, page = _pages(own.where(paged).withColumn("__shard_bits", bits), limit)
    return own.where(~paged).select(*result(bits, leaf["bytes"])).unionByName(numbered.select(*result(F.concat_ws("-", "__shard_bits", page.cast("string")), F.col("__shard_sum"))))


def _paged(limit: int, size: Column, n_rows: Column, single: Column) -> Column:
    """Is a shard one of several equal rows above the limit?"""
    return (size > limit) & (n_rows > 1) & (single == 1)


def _pages(rows: DataFrame, limit: int) -> tuple[DataFrame, Column]:
    """rows with __shard_sum, the bytes of each row's page, and the page's number within its hash."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            number = []
            for h in batch.column("__shard_h").to_pylist():
                number.append(seen.get(h, 0))
                seen[h] = number[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64())], names=[*batch.schema.names, "__shard_local"])

    bounded_batches(rows.sparkSession)
    rows = rows.withColumn("__shard_part", F.spark_partition_id())
    rows = spill(rows.mapInArrow(count, StructType([*rows.schema.fields, StructField("__shard_local", LongType())])), "shard-numbered")
    # a hash has a row for each partition here
    counts = rows.groupBy("__shard_h", "__shard_part").agg(F.count("*").alias("n"), F.max("__shard_size").alias("most"))
    of_hash = Window.partitionBy("__shard_h")
    before = F.coalesce(F.sum("n").over(of_hash.orderBy("__shard_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__shard_h", "__shard_part", before.alias("__shard_before"), F.greatest(F.lit(1), F.floor(limit / F.greatest(F.lit(1), F.max("most").over(of_hash)))).alias("__shard_each"))
    rows = rows.join(counts, ["__shard_h", "__shard_part"]).withColumn("__shard_page", F.floor((F.col("__shard_before") + F.col("__shard_local")) / F.col("__shard_each")))
    sums = rows.groupBy("__shard_h", "__shard_page").agg(F.sum("__shard_size").alias("__shard_sum"))
    return rows.join(sums, ["__shard_h", "__shard_page"]), F.col("__shard_page")


def write_shards(docs: DataFrame, path: str, limit: int) -> None:
    """Writes a folder of Parquet files for each shard."""
    shard(docs, limit).repartition("shard").write.partitionBy("shard").parquet(path)
