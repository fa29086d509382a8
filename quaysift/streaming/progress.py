"""Progress of jobs: the append-only event log as a stream, and states folded from it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaysift.session import ensure_checkpoint_dir

TERMINAL = ("complete", "error")


def latest(events: DataFrame) -> DataFrame:
    """State of each job by its last event (highest seq, then latest receipt): one partial aggregation."""
    return events.groupBy("job_id").agg(
        F.max_by(F.struct("status", "step", "total", "message", "event_ts"), F.struct("seq", "received_at", "event_key")).alias("e"),
        F.count("*").alias("n_events"), F.max("seq").alias("last_seq"),
    ).select("job_id", "n_events", "last_seq", "e.status", "e.step", "e.total", "e.message")


def unseen(events: DataFrame, cursor: DataFrame) -> DataFrame:
    """Events past each job's cursor (job_id, seen); a job without one has seen nothing."""
    return events.join(cursor, "job_id", "left").filter(F.col("seq") > F.coalesce("seen", F.lit(-1))).drop("seen")


def distinct_events(events: DataFrame) -> DataFrame:
    """Each (job_id, seq) once, as received first."""
    first = W.partitionBy("job_id", "seq").orderBy("received_at", "event_key")
    return events.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")


def expired(events: DataFrame, now: str, ttl_sec: int = 86400) -> DataFrame:
    """Jobs whose last write is older than the time to live."""
    last = events.groupBy("job_id").agg(F.max("received_at").alias("last_at"))
    return last.filter(F.col("last_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {ttl_sec} seconds"))


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """The event log as a stream of new files."""
    return spark.readStream.schema(schema).parquet(path)


def status_counts(stream: DataFrame) -> DataFrame:
    """Running number of events by job and status."""
    return stream.groupBy("job_id", "status").agg(F.count("*").alias("n_events"), F.max("seq").alias("last_seq"))


def windowed_counts(stream: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Events by hour of their own time; later ones than the watermark allows fall out."""
    return stream.withWatermark("event_ts", late).groupBy(F.window("event_ts", width).alias("w"), "status").agg(F.count("*").alias("n_events"))


def state_machine(stream: DataFrame, ttl_ms: int = 86_400_000, late: str = "2 hours") -> DataFrame:
    """State of each job after every batch: pending, running, then complete or error for good; forgotten after the time to live."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, seq, n = state.get if state.exists else ("pending", -1, 0)
        latest_ms = state.getCurrentWatermarkMs()
        for pdf in frames:
            latest_ms = max(latest_ms, int(pdf["event_ts"].max().timestamp() * 1000))
            for r in pdf.sort_values(["seq", "event_key"]).itertuples(index=False):
                n += 1
                if status not in TERMINAL and r.seq >= seq:
                    status, seq = r.status if r.status else "running", int(r.seq)
        state.update((status, seq, n))
        state.setTimeoutTimestamp(latest_ms + ttl_ms)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "last_seq": [seq], "n_events": [n]})

    # event time decides about forgetting: a processing-time limit would keep a run over available data going
    return stream.withWatermark("event_ts", late).groupBy("job_id").applyInPandasWithState(advance, "job_id string, status string, last_seq bigint, n_events bigint", "status string, last_seq bigint, n_events bigint", "update", "EventTimeTimeout")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there and gives its table.

    State and rows lie in the shared checkpoint folder: every batch is written by the executors, once under its number
    however often it is tried; in complete mode the last batch is the table.
    """
    spark = stream.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    batches: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        batches.append(number)

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint or f"{folder}/state").start().awaitTermination()
    kept = sorted(set(batches))[-1:] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/rows/{n}" for n in kept]) if kept else spark.createDataFrame([], stream.schema)
