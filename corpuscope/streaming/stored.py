"""Streams whose results are stored tables: each micro-batch is one commit that bears its number, so a batch that is run
again after a failure, wherever it failed, counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpuscope.operators import store, translation
from corpuscope.streaming import jobs


def stored(stream: DataFrame, root: str, name: str, make: Callable[[DataFrame, store.Version, str], dict[str, dict] | None]) -> DataStreamWriter:
    """A writer of the stream (name) that commits what make(batch, version, id) gives for each micro-batch."""

    def bring(batch: DataFrame, number: int) -> None:
        store.commit(batch.sparkSession, root, lambda now, own: make(batch, now, own), name, number)

    return stream.writeStream.foreachBatch(bring)


# ---------------------------------------------------------------- jobs
EVENTS = "job_events"


def log_events(events: DataFrame, root: str, name: str = "job-events") -> DataStreamWriter:
    """Events of jobs as a stored log; job_states(store.read(..., EVENTS)) are the states at any version of it."""
    return stored(events, root, name, lambda batch, now, own: {EVENTS: store.append(batch, root, EVENTS, now, own)})


MARKS = "job_progress"


def mark_progress(events: DataFrame, root: str, name: str = "job-progress") -> DataStreamWriter:
    """Each job's latest mark and time (see progress_marks()) as a stored table of one row a job. A mark that arrives after
    a later one changes nothing. events: job_id, at, seq, progress."""

    def make(batch: DataFrame, now: store.Version, own: str) -> dict[str, dict] | None:
        return marks_update(batch, root, now, own)

    return stored(events, root, name, make)


def marks_update(batch: DataFrame, root: str, now: store.Version, own: str) -> dict[str, dict] | None:
    order = F.when(F.col("progress").isNotNull(), F.struct("at", "seq"))
    new = batch.where("job_id IS NOT NULL").groupBy("job_id").agg(F.max_by("progress", order).alias("progress"), F.max(order).alias("marked"), F.max("at").alias("updated_at"))
    if MARKS in now.tables:
        old = store.read(batch.sparkSession, root, MARKS, now).select("job_id", *(F.col(c).alias(f"_{c}") for c in ("progress", "marked", "updated_at")))
        new = new.join(old, "job_id", "left")
        later = F.col("_marked").isNull() | (F.col("marked") > F.col("_marked"))
        new = new.select("job_id", F.when(later, F.col("progress")).otherwise(F.col("_progress")).alias("progress"), F.greatest("marked", "_marked").alias("marked"), F.greatest("updated_at", "_updated_at").alias("updated_at"))
    changed = store.upsert(new, root, MARKS, "job_id", now, own)
    return {MARKS: changed} if changed else None


def states(spark: SparkSession, root: str) -> DataFrame:
    """The states of all logged jobs."""
    return jobs.job_states(store.read(spark, root, EVENTS))


# ---------------------------------------------------------------- files
SEEN, NEW = "seen_files", "new_files"


def new_files(files: DataFrame, root: str, name: str = "new-files", at: str = "modificationTime", within: str = "1 hour", columns: tuple[str, ...] = ("path", "length")) -> DataStreamWriter:
    """Files of a stream (see file_stream()) whose fingerprint was never seen, as a stored table (fingerprint, at, columns).

    Copies that come soon after each other go within the stream, whose state holds fingerprints no longer than the
    watermark; copies of any age go by the stored fingerprints, so what is held in memory is bounded, and what was seen
    last year is still known. Of copies in one batch the first by time and path counts.
    """
    keep = [c for c in columns if c != at]
    soon = files.select("fingerprint", at, *keep).withWatermark(at, within).dropDuplicatesWithinWatermark(["fingerprint"])

    def make(batch: DataFrame, now: store.Version, own: str) -> dict[str, dict] | None:
        first = batch.groupBy("fingerprint").agg(F.min(F.struct(at, *keep)).alias("_f")).select("fingerprint", "_f.*")
        known = store.read(batch.sparkSession, root, SEEN, now) if SEEN in now.tables else batch.sparkSession.createDataFrame([], "fingerprint string")
        fresh = store.written(first.join(known.select("fingerprint"), "fingerprint", "left_anti"), "new-files")
        if fresh.isEmpty():
            return None
        return {SEEN: store.append(fresh.select("fingerprint"), root, SEEN, now, own), NEW: store.append(fresh, root, NEW, now, own)}

    return stored(soon, root, name, make)


def refused_uploads(files: DataFrame, extension: str = "pdf") -> DataFrame:
    """Uploads (path, length) with error: what is wrong with a file, null if nothing."""
    error = F.when(~F.endswith(F.lower("path"), F.lit(f".{extension}")), f"not a .{extension} file").when(F.coalesce("length", F.lit(0)) <= 0, "empty file")
    return files.withColumn("error", error)


# ---------------------------------------------------------------- translations
CONTEXTS, MESSAGES, OUTCOMES = "contexts", "messages", "outcomes"


def open_contexts(messages: DataFrame, root: str) -> store.Version:
    """Store what the newest messages say of each conversation: the state that replies go on from."""
    return store.commit(messages.sparkSession, root, lambda now, own: {CONTEXTS: store.replace(translation.latest_context(messages), root, CONTEXTS, own)})


def _brought(step, batch: DataFrame, root: str, now: store.Version, own: str) -> dict[str, dict] | None:
    """What a step (contexts, rows -> contexts, messages, outcomes) on one batch changes in the stored tables: contexts of
    the batch's conversations alone are read, and only files with changed ones are written anew."""
    spark = batch.sparkSession
    rows = store.written(batch, "batch")
    old = store.read(spark, root, CONTEXTS, now).join(rows.select("conversation_id").distinct(), "conversation_id", "left_semi")
    contexts, messages, outcomes = step(old, rows)
    outcomes = store.written(outcomes, "outcomes")
    if outcomes.isEmpty():
        return None
    counted = outcomes.where("error IS NULL").select("conversation_id").distinct()
    changed = store.update(contexts.join(counted, "conversation_id", "left_semi").select("conversation_id", "status", "glossary"), root, CONTEXTS, "conversation_id", now, own)
    tables = {OUTCOMES: store.append(outcomes, root, OUTCOMES, now, own), MESSAGES: store.append(messages, root, MESSAGES, now, own)}
    return tables | ({CONTEXTS: changed} if changed else {})


def continue_translations(replies: DataFrame, root: str, template: str, name: str = "replies") -> DataStreamWriter:
    """Replies that arrive (see translation.continued()): each that counts appends a pair of messages and moves its
    conversation on, each that doesn't leaves an outcome that says why. Contexts must be open."""
    return stored(replies, root, name, lambda batch, now, own: _brought(lambda old, rows: translation.continued(old, rows, template), batch, root, now, own))


def confirm_glossaries(submissions: DataFrame, root: str, asked: str, name: str = "glossaries") -> DataStreamWriter:
    """Glossaries that are confirmed as they arrive (see translation.confirmed())."""
    return stored(submissions, root, name, lambda batch, now, own: _brought(lambda old, rows: translation.confirmed(old, rows, asked), batch, root, now, own))
