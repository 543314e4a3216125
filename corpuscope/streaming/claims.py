"""One running job for each conversation: which requests are accepted, as a batch and as a stream.

Events are (conversation_id, at, seq, job_id, status). A request (status requested) is accepted if no job of its
conversation is queued or runs; it is then the one that does, until its job ends (succeeded or failed). Other jobs that
are queued or run keep their conversation busy as well. Events count in the order of at and seq.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUESTED, ACTIVE, ENDED = "requested", ("queued", "running"), ("succeeded", "failed")


def _after(active: set[str], job: str, status: str) -> bool | None:
    """Change a conversation's active jobs by one event; for a request, whether it is accepted."""
    if status == REQUESTED:
        accepted = not active
        if accepted:
            active.add(job)
        return accepted
    if status in ACTIVE:
        active.add(job)
    elif status in ENDED:
        active.discard(job)
    return None


def _result(events: DataFrame) -> T.StructType:
    own = events.schema
    return T.StructType([T.StructField("conversation_id", own["conversation_id"].dataType), T.StructField("seq", T.LongType()), T.StructField("job_id", T.StringType()), T.StructField("accepted", T.BooleanType())])


def claims(events: DataFrame) -> DataFrame:
    """(conversation_id, seq, job_id, accepted) of every request.

    Each conversation's events go to one task, in order, and are read in passing, so a conversation of any length takes
    the memory of its active jobs alone. Events without conversation or job are left out; other statuses change nothing.
    """
    rows = events.where("conversation_id IS NOT NULL AND job_id IS NOT NULL").select("conversation_id", "at", "seq", F.col("job_id").cast("string").alias("job_id"), "status")
    schema = _result(events)

    def run(batches: Iterable[pa.RecordBatch]):
        current, active = None, set()
        for batch in batches:
            out = []
            for key, seq, job, status in zip(*(batch.column(c).to_pylist() for c in ("conversation_id", "seq", "job_id", "status"))):
                if key != current:
                    current, active = key, set()
                accepted = _after(active, job, status)
                if accepted is not None:
                    out.append((key, seq, job, accepted))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_arrow(schema))], schema.names)

    return rows.repartition("conversation_id").sortWithinPartitions("conversation_id", "at", "seq").mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def stream_claims(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same of a stream, in append mode, for events that arrive in any order up to delay (of at) late.

    An event is held until the watermark has passed its time, since one that comes before it may still arrive; then it
    counts. Held by conversation: such events and the active jobs; a conversation with neither leaves no state.
    """
    state = "waiting string, active string"

    def step(key, batches, held):
        waiting, active = (json.loads(x) for x in held.get) if held.exists else ([], [])
        if not held.hasTimedOut:
            for rows in batches:
                waiting += [[r.at.value // 1000, int(r.seq), str(r.job_id), r.status] for r in rows.itertuples()]
        passed = held.getCurrentWatermarkMs() * 1000
        waiting.sort()
        jobs, out = set(active), []
        n = sum(x[0] <= passed for x in waiting)
        for _, seq, job, status in waiting[:n]:
            accepted = _after(jobs, job, status)
            if accepted is not None:
                out.append((key[0], seq, job, accepted))
        waiting = waiting[n:]
        if waiting or jobs:
            held.update((json.dumps(waiting), json.dumps(sorted(jobs))))
            if waiting:
                held.setTimeoutTimestamp(max(waiting[0][0] // 1000, passed // 1000 + 1))
        elif held.exists:
            held.remove()
        if out:
            yield pd.DataFrame(out, columns=["conversation_id", "seq", "job_id", "accepted"])

    rows = events.where("conversation_id IS NOT NULL AND job_id IS NOT NULL").select("conversation_id", F.col("at").cast("timestamp").alias("at"), "seq", F.col("job_id").cast("string").alias("job_id"), "status")
    return rows.withWatermark("at", delay).groupBy("conversation_id").applyInPandasWithState(step, _result(events), state, "append", "EventTimeTimeout")
