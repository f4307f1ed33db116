"""Runs and queues: ensure a run, publish and consume messages, follow a run from a snapshot on.

Queues and progress are folders of JSON lines in a shared store, which streams read; file
sinks commit whole batches, so a message is published once or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources import messages
from folioscope.streaming.stages import PIPELINE, stage_view

PROGRESS = "seq long, run_id string, stage string, status string, attempt int, error string"
#: Stage messages of one micro-batch are at most so many files for each message that a stage's worker would hold unanswered.
PREFETCH = {s.name: s.prefetch for s in PIPELINE}


def ensure_runs(wanted: DataFrame, existing: DataFrame | None = None, version: str = "1") -> DataFrame:
    """(document_id, run_id, created): a run for each document, the one that is there or a new one; rerunning makes the same id.

    wanted: document_id, repeats allowed; existing: document_id, run_id (of several the least stands).
    """
    made = F.substring(F.sha2(F.concat_ws("/", F.col("document_id").cast("string"), F.lit("run"), F.lit(version)), 256), 1, 32)
    rows = wanted.select("document_id").where(F.col("document_id").isNotNull()).distinct().withColumn("_new", made)
    if existing is None:
        return rows.select("document_id", F.col("_new").alias("run_id"), F.lit(True).alias("created"))
    there = existing.groupBy("document_id").agg(F.min("run_id").alias("_there"))
    out = rows.join(there, "document_id", "left")
    return out.select("document_id", F.coalesce("_there", "_new").alias("run_id"), F.col("_there").isNull().alias("created"))


def publish(df: DataFrame, path: str, message: str = "message") -> None:
    """Append messages to their stages' queues below path, as JSON lines."""
    rows = df.select(F.col(message)["stage"].alias("stage"), messages.encode(F.col(message)).alias("value"))
    rows.write.mode("append").partitionBy("stage").text(path)


def consume(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """A stream of a stage's queue: message and error. A micro-batch takes a bounded number of files, by the stage's prefetch."""
    if stage not in PREFETCH:
        raise ValueError(f"unknown stage {stage!r}; expected one of {', '.join(PREFETCH)}")
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", PREFETCH[stage]).text(f"{path}/stage={stage}")
    return messages.decode(raw.withColumnRenamed("value", "raw"))


def subscribe(spark: SparkSession, path: str, run_id: str | None = None, after: int | None = None) -> DataFrame:
    """A stream of progress rows, of one run or of all, after a sequence number."""
    rows = spark.readStream.schema(PROGRESS).json(path)
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    return rows if after is None else rows.where(F.col("seq") > after)


def snapshot_then_stream(spark: SparkSession, runs: DataFrame, path: str, run_id: str) -> tuple[DataFrame, DataFrame, int]:
    """(each stage of a run as it stands, a stream of what comes after, the last number in the snapshot).

    No row is missed or seen twice: the stream begins behind the last number that the snapshot holds.
    """
    rows = spark.read.schema(PROGRESS).json(path).where(F.col("run_id") == run_id)
    last = rows.agg(F.max("seq")).first()[0]
    last = -1 if last is None else last
    now = rows.where(F.col("seq") <= last).groupBy("run_id", "stage").agg(F.max_by(F.struct("status", "attempt", "error"), F.col("seq")).alias("s")).select("run_id", "stage", "s.*")
    return stage_view(runs.where(F.col("run_id") == run_id), now), subscribe(spark, path, run_id, last), last
