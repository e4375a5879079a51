"""Readers: conversation tables, transcript files, manifests, live events."""

from __future__ import annotations

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = {"user": "interviewer", "assistant": "candidate"}

def role_to_speaker(role: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), role), F.lit("unknown"))


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(interview_id, seg_id, speaker, text) from a conversation table: user asks, assistant answers, others are unknown."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.col("conv_id").alias("interview_id"), F.col("turn").alias("seg_id"), role_to_speaker(F.col("role")).alias("speaker"), "text")


def transcript_files(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """(interview_id, text): one interview for each file, named by it without its ending; a byte order mark is dropped."""
    file = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # Spark gives the name as URIs have it, but "+" as it is
    name = F.regexp_replace(file, r"\.[A-Za-z0-9]+$", "")
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(name.alias("interview_id"), "value")
    return files.select("interview_id", F.regexp_replace("value", "^\uFEFF", "").alias("text"))


def transcript_folders(spark: SparkSession, folder: str) -> DataFrame:
    """(interview_id, text): one interview for each folder interview_id=..., as Spark writes them; an interview's file may not be split."""
    return spark.read.text(folder, wholetext=True).select("interview_id", F.regexp_replace("value", "^\uFEFF|\n$", "").alias("text"))


class NotReached(ValueError):
    """Arrow does not see the folder that Spark writes to."""


def write_transcripts(transcripts: DataFrame, folder: str) -> list[str]:
    """Writes each (interview_id, text) to a file <interview_id>.txt with a byte order mark; gives the folders that now hold them.

    Tasks write the files themselves, through Arrow: Spark's writer would make, list and move a folder for each interview,
    and Hadoop's local files start a process for each mode that they set. Each attempt of a task has a folder of its own, and
    only attempts that came to their end are named here, so what a lost one left is not read. A null text is an empty one.
    """
    # Spark makes the folder: a path without a scheme, say, may be a local one to Arrow and one of HDFS to Spark
    transcripts.sparkSession.range(0).selectExpr("cast(id as string)").write.text(f"{folder}/_made")
    try:
        store, path = FileSystem.from_uri(folder)
        seen = store.get_file_info(f"{path}/_made").type == FileType.Directory
    except (OSError, ValueError, NotImplementedError) as e:
        raise NotReached(folder) from e
    if not seen:
        raise NotReached(folder)

    def run(batches):
        own = f"{folder}/{TaskContext.get().taskAttemptId()}"
        store, path = FileSystem.from_uri(own)
        names = set()
        for batch in batches:
            store.create_dir(path)
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not name or "/" in name or name[0] in "._" or name in names:
                    raise ValueError(f"no file of one interview alone can have the name {name!r}")
                names.add(name)
                with store.open_output_stream(f"{path}/{name}.txt", compression=None) as file:
                    file.write(b"\xef\xbb\xbf" + (text or b""))
        if names:
            yield pa.RecordBatch.from_pydict({"folder": [own]})

    rows = transcripts.select(F.col("interview_id").cast("string"), F.col("text").cast("binary"))
    return [r.folder for r in rows.mapInArrow(run, "folder string").collect()] or [folder]


MANIFEST = "id string, title string, job_hint string, filename string, description string"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """A manifest as one JSON array, or a folder of files with an object in each line."""
    return spark.read.schema(MANIFEST).json(path, multiLine=path.endswith(".json"))


def with_job_hints(transcripts: DataFrame, manifest: DataFrame) -> DataFrame:
    hints = manifest.select(F.regexp_replace("filename", r"\.[A-Za-z0-9]+$", "").alias("interview_id"), "job_hint", "title")
    return transcripts.join(hints, "interview_id", "left")


SEGMENT_EVENT = "session_id string, speaker_id string, text string, start_ms int, end_ms int, final boolean, recognized_role string, speaker_confidence double, interviewer_sim double, candidate_sim double"


#: Why an event is rejected, the first reason first.
REASONS = ("malformed", "no_session", "blank")


def segment_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) segments from a column `value` of JSON, batch or stream; other columns are kept.

    Rejected rows keep their text as it came, with the reason: JSON that cannot be read (malformed), no session, blank text.
    """
    others = [c for c in raw.columns if c != "value"]
    read = F.from_json("value", f"{SEGMENT_EVENT}, _unread string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})
    rows = raw.select(read.alias("e"), "value", *others).select("e.*", "value", *others)
    reason = (
        F.when(F.col("value").isNull() | F.col("_unread").isNotNull(), "malformed")
        .when(F.trim(F.coalesce("session_id", F.lit(""))) == "", "no_session").when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank")
    )
    rows = rows.withColumn("reason", reason)
    fill = {"speaker_id": "speaker_a", "start_ms": 0, "end_ms": 0, "final": True, "interviewer_sim": 0.0, "candidate_sim": 0.0}
    good = rows.where("reason is null").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})
    return good.drop("_unread", "reason", "value"), rows.where("reason is not null").select(*others, "value", "reason")
