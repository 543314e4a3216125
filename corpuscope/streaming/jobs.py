"""Jobs as a log of events: the state of each, as a fold over a table or kept by a stream."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("queued", "running", "succeeded", "failed")
OUTPUT = "job_id long, status string, started_at timestamp, updated_at timestamp, error string"


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, started_at, updated_at, error): the last status, the first start since the job was last queued,
    and an error only if it failed.

    events: job_id, seq, at, status, error; rows of equal seq are ordered by status. A job that is queued again after it
    ran has not started. Partial maxima are taken before the shuffle, so a job with very many events is no burden.
    """
    order = F.struct("seq", "status")
    when = lambda s, c: F.when(F.col("status") == s, c)
    queued = events.groupBy("job_id").agg(F.max(when("queued", order)).alias("_queued"))
    since = events.join(queued, "job_id").withColumn("_start", F.when((F.col("status") == "running") & (F.col("_queued").isNull() | (order > F.col("_queued"))), F.col("at")))
    last = since.groupBy("job_id").agg(F.max_by("status", order).alias("status"), F.min("_start").alias("started_at"), F.max_by("at", order).alias("updated_at"), F.max_by("error", order).alias("error"))
    return last.withColumn("error", F.when(F.col("status") == "failed", F.coalesce("error", F.lit("job failed"))).otherwise(""))


def progress_marks(events: DataFrame) -> DataFrame:
    """(job_id, progress, updated_at): each job's latest mark that is not null, and the time of its latest event."""
    return events.groupBy("job_id").agg(F.max_by("progress", F.when(F.col("progress").isNotNull(), F.struct("at", "seq"))).alias("progress"), F.max("at").alias("updated_at"))


def pending(jobs: DataFrame, order: str | None = None, types: tuple[str, ...] = (), conversation=None) -> DataFrame:
    """Jobs that are queued or run, of some types or one conversation if asked for, the oldest first by order."""
    rows = jobs.where(F.col("status").isin("queued", "running"))
    rows = rows.where(F.col("job_type").isin(*types)) if types else rows
    rows = rows if conversation is None else rows.where(F.col("conversation_id") == F.lit(conversation))
    return rows.orderBy(order) if order else rows


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart: what ran is queued again and has not started."""
    ran = F.col("status") == "running"
    return jobs.withColumn("started_at", F.when(~ran, F.col("started_at"))).withColumn("status", F.when(ran, "queued").otherwise(F.col("status")))


def stream_job_states(events: DataFrame) -> DataFrame:
    """The same over a stream, in update mode; events may come in any order. State by job: last order and status, last
    time, error, when it was last queued, and the starts since then that may still count (those earlier than all later
    ones in order)."""
    state = "seq long, status string, updated_at timestamp, error string, marks string"

    def step(key, batches, held):
        seq, status, at, error, marks = held.get if held.exists else (-(2**62), "", None, None, "[null, []]")
        queued, starts = json.loads(marks)
        for rows in batches:
            for r in rows.sort_values(["seq", "status"]).itertuples():
                if r.status == "queued":
                    queued = r.seq if queued is None else max(queued, r.seq)
                elif r.status == "running":
                    starts.append([r.seq, r.at.value])
                if (r.seq, r.status) >= (seq, status):
                    seq, status, at, error = r.seq, r.status, r.at, r.error
        kept: list[list[int]] = []
        for s, t in sorted(starts, reverse=True):
            if (queued is None or s >= queued) and (not kept or t < kept[-1][1]):
                kept.append([s, t])
        held.update((seq, status, at, error, json.dumps([queued, kept])))
        start = pd.Timestamp(kept[-1][1]) if kept else None
        said = (error or "job failed") if status == "failed" else ""
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "started_at": pd.to_datetime([start]), "updated_at": pd.to_datetime([at]), "error": [said]})

    return events.groupBy("job_id").applyInPandasWithState(step, OUTPUT, state, "update", "NoTimeout")


def stream_new_files(files: DataFrame) -> DataFrame:
    """A file stream without fingerprints that were seen before."""
    return files.dropDuplicates(["fingerprint"])
