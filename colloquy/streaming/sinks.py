"""Where streams end: hooks for each micro-batch, and tables of the latest row of each key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.sources.tables import segment_events


def hooked(stream: DataFrame, hook: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Calls hook(rows, number) for each micro-batch: a transcript callback, a status callback, a sink of one's own.

    A batch can come again after a failure, with the same number; a hook that writes has to use it. mode: append, or
    update for aggregates of which each batch gives the changed rows.
    """
    return stream.writeStream.outputMode(mode).foreachBatch(hook).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def upserts(path: str, late: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> Callable[[DataFrame, int], None]:
    """A hook that keeps each micro-batch under its number, so that a repeated batch replaces itself; late: what splits off late rows."""

    def hook(rows: DataFrame, number: int) -> None:
        if late is not None:
            rows, behind = late(rows)
            behind.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return hook


def latest(spark: SparkSession, path: str, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key of what `upserts` kept: a log of all rows, read whole. For a table of the last rows see `keep_latest`."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    back = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__back", F.row_number().over(back)).where("__back = 1").drop("__back", "batch")


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path; None if nothing has been written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def keep_latest(path: str, key: str, order: Sequence[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A hook that keeps a table with the latest row of each key, for streams in append or update mode.

    The table is partitioned into buckets of keys. A micro-batch reads the buckets that its keys fall into, and writes
    them anew with one file each, so neither its cost nor that of reading follows the history. It goes in two steps: the
    new contents of the buckets are written aside with the batch's number, then they take the buckets' place (dynamic
    partition overwrite). A batch that comes again after a failure between the two goes on from what lies aside; after
    both, merging its rows once more changes nothing. Of equal orders the row that came later stays.
    """

    def hook(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        aside = f"{path}/aside"
        done = _there(spark, aside)
        if done is None or done.where(F.col("__batch") != number).limit(1).count() or not done.limit(1).count():
            new = rows.withColumns({"bucket": F.pmod(F.hash(F.col(key)), F.lit(buckets)), "__batch": F.lit(number).cast("long")})
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # as many as there are buckets
            if not touched:
                return
            old = _there(spark, f"{path}/rows")
            if old is not None:
                new = new.unionByName(old.where(F.col("bucket").isin(touched)), allowMissingColumns=True)
            best = F.max_by(F.struct(*new.columns), F.struct(*order, "__batch"))
            kept = new.groupBy("bucket", F.col(key).alias("__key")).agg(best.alias("row")).select("row.*")
            kept.withColumn("__batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(aside)
        spark.read.parquet(aside).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")

    return hook


def latest_of(spark: SparkSession, path: str) -> DataFrame:
    """The table that `keep_latest` keeps."""
    return spark.read.parquet(f"{path}/rows").drop("bucket", "__batch")


def segments_and_rejects(path: str) -> Callable[[DataFrame, int], None]:
    """A hook for streams of raw events (value): accepted segments and rejected events with their reasons, in tables beside each other.

    A repeated batch replaces itself, so a restart neither loses nor doubles an event.
    """

    def hook(raw: DataFrame, number: int) -> None:
        raw = raw.persist()
        for rows, name in zip(segment_events(raw), ("accepted", "rejected"), strict=True):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        raw.unpersist()

    return hook


def raw_events(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Events as lines of JSON (value) from the files that come into a folder, so many for each micro-batch at most."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(folder)
