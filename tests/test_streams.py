"""Streams against the same rules as batches: any order of arrival, restarts, and batches that are run again."""

import datetime as dt

import pytest
from conftest import SF
from pyspark.sql import functions as F

from corpuscope.operators import store
from corpuscope.plans.catalogue import job_events
from corpuscope.plans.rules import claim_events
from corpuscope.sources import catalogue
from corpuscope.streaming import claims, jobs, stored

START = dt.datetime(2024, 1, 1)


def run(writer, checkpoint):
    q = writer.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return q


def folder(spark, df, path, parts):
    df.repartition(parts).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


# ---------------------------------------------------------------- claims
def in_order(events):
    """Which requests are accepted, event by event."""
    active, out = {}, {}
    for c, _, seq, job, status in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        jobs_ = active.setdefault(c, set())
        if status == "requested":
            out[c, seq] = not jobs_
            jobs_ |= set() if jobs_ else {job}
        elif status in ("queued", "running"):
            jobs_.add(job)
        elif status in ("succeeded", "failed"):
            jobs_.discard(job)
    return out


EVENT = "conversation_id string, at timestamp, seq long, job_id string, status string"


def test_claims(spark):
    rows = [("a", 1, 1, "j1", "requested"), ("a", 2, 2, "j2", "requested"), ("a", 3, 3, "j2", "failed"), ("a", 4, 4, "j3", "requested"), ("a", 5, 5, "j1", "running"), ("a", 6, 6, "j1", "succeeded"), ("a", 7, 7, "j4", "requested"),
            ("b", 1, 8, "x", "running"), ("b", 2, 9, "y", "requested"), ("b", 2, 10, "x", "failed"), ("b", 2, 11, "z", "requested"), ("b", 3, 12, "z", "odd"), (None, 1, 13, "n", "requested"), ("c", 1, 14, None, "requested")]
    events = [(c, START + dt.timedelta(minutes=m), s, j, k) for c, m, s, j, k in rows]
    got = {(r.conversation_id, r.seq): r.accepted for r in claims.claims(spark.createDataFrame(events, EVENT)).collect()}
    assert got == in_order([e for e in events if e[0] and e[3]]) == {("a", 1): True, ("a", 2): False, ("a", 4): False, ("a", 7): True, ("b", 9): False, ("b", 11): True}


def test_stream_claims(spark, tmp_path):
    """Events in any order over several batches and a restart give what the batch gives."""
    events = claim_events(spark, SF).select("conversation_id", F.col("at").cast("timestamp").alias("at"), "seq", F.col("job_id").cast("string").alias("job_id"), "status")
    want = {(r.conversation_id, r.seq, r.job_id): r.accepted for r in claims.claims(events).collect()}
    end = events.agg(F.max("at")).first()[0] + dt.timedelta(days=900)
    out, source = str(tmp_path / "out"), tmp_path / "in"

    def go(part):
        read = folder(spark, part, source, 3)
        run(claims.stream_claims(read, "800 days").writeStream.outputMode("append").format("parquet").option("path", out), tmp_path / "c")

    mixed = events.withColumn("_r", F.xxhash64("seq"))
    go(mixed.where("_r % 2 = 0").drop("_r"))
    go(mixed.where("_r % 2 <> 0").drop("_r"))
    later = lambda days, seq: spark.createDataFrame([(-1, end + dt.timedelta(days=days), seq, "end", "odd")], events.schema)
    go(later(0, -1))
    go(later(1, -2))
    got = spark.read.parquet(out).collect()
    assert len(got) == len(want) and {(r.conversation_id, r.seq, r.job_id): r.accepted for r in got} == want


# ---------------------------------------------------------------- states as stored tables
def test_logged_states(spark, tmp_path, monkeypatch):
    """A batch that fails after its commit, and one that fails before it, count once each."""
    root, events = str(tmp_path / "r"), job_events(spark, SF).withColumn("at", F.col("at").cast("timestamp"))
    source, fails, real = tmp_path / "in", {"before": 1, "after": 2}, store.commit

    def commit(spark, root, make, stream=None, batch=None, **more):
        if fails.get("before") == batch:
            del fails["before"]
            make(store.latest(spark, root), "lost")
            raise RuntimeError("lost before the commit")
        out = real(spark, root, make, stream, batch, **more)
        if fails.get("after") == batch:
            del fails["after"]
            raise RuntimeError("lost after the commit")
        return out

    monkeypatch.setattr(store, "commit", commit)
    read = folder(spark, events, source, 4)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            run(stored.log_events(read, root), tmp_path / "c")
    run(stored.log_events(read, root), tmp_path / "c")
    assert not fails and store.latest(spark, root).number == 4
    assert sorted(map(str, stored.states(spark, root).collect())) == sorted(map(str, jobs.job_states(events).collect()))


def test_stored_progress(spark, tmp_path):
    root = str(tmp_path / "r")
    events = job_events(spark, SF).select("job_id", F.col("at").cast("timestamp").alias("at"), "seq", F.when(F.col("seq") % 3 > 0, F.concat(F.lit("step "), F.col("seq"))).alias("progress"))
    read = folder(spark, events, tmp_path / "in", 4)
    run(stored.mark_progress(read, root), tmp_path / "c")
    run(stored.mark_progress(read, root), tmp_path / "c")  # nothing new
    got = store.read(spark, root, stored.MARKS).select("job_id", "progress", "updated_at")
    assert sorted(map(str, got.collect())) == sorted(map(str, jobs.progress_marks(events).collect()))
    replayed = lambda: store.commit(spark, root, lambda now, own: stored.marks_update(events.limit(50), root, now, own), "job-progress", 0)
    assert replayed().number == store.latest(spark, root).number == 4


def test_new_files(spark, tmp_path):
    """Copies within a batch, in later batches and after the watermark has passed are dropped, and the state stays small."""
    root, schema = str(tmp_path / "r"), "path string, modificationTime timestamp, length long, fingerprint string"

    def go(*files):
        rows = [(p, START + dt.timedelta(days=d), 1, f) for p, d, f in files]
        read = folder(spark, spark.createDataFrame(rows, schema), tmp_path / "in", 1)
        return run(stored.new_files(read, root), tmp_path / "c")

    go(("a", 0, "x"), ("b", 0, "x"), ("c", 0, "y"))
    go(("d", 1, "y"), ("e", 1, "z"))
    q = go(("f", 9, "x"), ("g", 9, "w"), ("h", 9, "y"))
    assert {r.fingerprint: r.path for r in store.read(spark, root, stored.NEW).collect()} == {"x": "a", "y": "c", "z": "e", "w": "g"}
    assert store.read(spark, root, stored.SEEN).count() == 4
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held[-1] <= 3  # those of the last day alone
    before = store.latest(spark, root).number
    batch = spark.createDataFrame([("i", START, 1, "n")], schema)
    assert store.commit(spark, root, lambda now, own: {stored.SEEN: store.append(batch.select("fingerprint"), root, stored.SEEN, now, own)}, "new-files", 0).number == before


def test_uploads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.PDF", b"x"), ("b.txt", b"x"), ("c.pdf", b""), ("d.pdf", b"x"), ("e.pdf", b"z")):
        (tmp_path / "in" / name).write_bytes(data)
    run(stored.new_files(catalogue.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "r")), tmp_path / "c")
    got = store.read(spark, str(tmp_path / "r"), stored.NEW).collect()
    assert len(got) == 2 and {r.path.rsplit("/", 1)[1] for r in got} <= {"a.PDF", "d.pdf", "e.pdf"}
    said = stored.refused_uploads(spark.createDataFrame([("a.PDF", 1), ("b.txt", 1), ("c.pdf", 0)], "path string, length long"))
    assert [r.error for r in said.collect()] == [None, "not a .pdf file", "empty file"]
    bytes_ = spark.createDataFrame([("eA==",), ("?",), (None,)], "s string").select(catalogue.from_base64(F.col("s")).alias("b")).collect()
    assert [r.b for r in bytes_] == [b"x", None, None]
