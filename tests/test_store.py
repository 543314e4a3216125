"""Stored tables: commits of several writers, updates of few files, schemas over time, and bundles."""

import threading

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import store, writes

BUNDLE = "conversation_id string, title string, file_record struct<filename:string,fingerprint:string,poe_url:string,content_type:string,poe_name:string>, messages array<struct<role:string,content:string>>, figures array<struct<figure_index:int>>, tables array<struct<table_index:int>>, tags array<struct<tag_code:string,category_code:string,category_label:string,tag_label:string,tag_path:string,source:string>>, meta struct<paper_id:string>"


def bundles(spark, *pairs):
    return spark.createDataFrame([(i, "t", ("f.pdf", p, "u", None, None), [("user", "hi")], [], [], [], None) for i, p in pairs], BUNDLE)


def put(spark, root, rows, schema="k long, v string", name="t"):
    return store.commit(spark, root, lambda now, own: {name: store.append(spark.createDataFrame(rows, schema).coalesce(1), root, name, now, own)})


def rows(spark, root, name="t", version=None):
    return sorted(map(tuple, store.read(spark, root, name, version).collect()), key=str)


def together(*calls):
    """Run calls at once; their results or errors."""
    out, gate = [None] * len(calls), threading.Barrier(len(calls))

    def run(i, f):
        gate.wait()
        try:
            out[i] = f()
        except Exception as e:  # noqa: BLE001
            out[i] = e

    threads = [threading.Thread(target=run, args=x) for x in enumerate(calls)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_put_if_absent(spark, tmp_path):
    won = together(*(lambda i=i: store.put_if_absent(spark, f"{tmp_path}/c/1.json", f"writer {i}") for i in range(8)))
    assert sorted(won) == [False] * 7 + [True]
    assert (tmp_path / "c" / "1.json").read_text() == f"writer {won.index(True)}"
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if not p.name.endswith(".crc")) == ["1.json"]


def test_another_file_system(spark, tmp_path):
    """By a rename that does not overwrite, where a link can't be made."""
    key = "fs.viewfs.mounttable.other.link./in"
    spark.conf.set(key, f"file://{tmp_path}")
    try:
        root = "viewfs://other/in/r"
        won = together(*(lambda i=i: store.put_if_absent(spark, f"{root}/c/1.json", str(i)) for i in range(3)))
        assert any(won) and (tmp_path / "r" / "c" / "1.json").exists() and not store.put_if_absent(spark, f"{root}/c/1.json", "late")
        put(spark, root, [(1, "a"), (2, "b")])
        change = spark.createDataFrame([(1, "new")], "k long, v string")
        store.commit(spark, root, lambda now, own: {"t": store.update(change, root, "t", "k", now, own)})
        assert rows(spark, root) == [(1, "new"), (2, "b")] and store.versions(spark, root) == [1, 2]
    finally:
        spark.conf.unset(key)


def test_writers_at_once(spark, tmp_path):
    """All commits stand, with numbers of their own, and every version holds whole commits only."""
    root = str(tmp_path)
    done = together(*(lambda i=i: put(spark, root, [(i, "a"), (i, "b")]).number for i in range(6)))
    assert sorted(done) == [1, 2, 3, 4, 5, 6] and len(rows(spark, root)) == 12
    for n in store.versions(spark, root):
        found = rows(spark, root, version=store.at_version(spark, root, n))
        assert len(found) == 2 * n and all(sum(k == i for k, _ in found) in (0, 2) for i in range(6))


def test_readers_see_whole_commits(spark, tmp_path):
    """A writer that fails after its files are written leaves nothing to see."""
    root = str(tmp_path)
    put(spark, root, [(1, "a")])

    def fails(now, own):
        store.append(spark.createDataFrame([(2, "b")], "k long, v string"), root, "t", now, own)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        store.commit(spark, root, fails)
    assert rows(spark, root) == [(1, "a")] and store.latest(spark, root).number == 1


def test_update_writes_touched_files_only(spark, tmp_path):
    root = str(tmp_path)
    for i in range(5):
        put(spark, root, [(2 * i, "a"), (2 * i + 1, "b")])
    before = {f for f, _ in store.file_list(spark, root, store.latest(spark, root), "t")}
    changes = spark.createDataFrame([(2, "new"), (3, None), (9, "x"), (77, "none"), (None, "null")], "k long, v string")
    store.commit(spark, root, lambda now, own: {"t": store.update(changes, root, "t", "k", now, own)})
    after = {f for f, _ in store.file_list(spark, root, store.latest(spark, root), "t")}
    assert len(before) == 5 and len(before & after) == 3
    want = {(k, {2: "new", 3: None, 9: "x"}.get(k, "ab"[k % 2])) for k in range(10)}
    assert set(rows(spark, root)) == want
    with pytest.raises(ValueError, match="twice"):
        store.update(changes.union(changes), root, "t", "k", store.latest(spark, root), "x")
    with pytest.raises(ValueError, match="unknown columns: z"):
        store.update(changes.withColumn("z", F.lit(1)), root, "t", "k", store.latest(spark, root), "x")
    assert store.update(changes.where("k = 77"), root, "t", "k", store.latest(spark, root), "x") is None


def test_updates_at_once(spark, tmp_path):
    """Two updates of one file: the later one is made from what the earlier one left."""
    root = str(tmp_path)
    put(spark, root, [(1, "a"), (2, "b"), (3, "c")])
    change = lambda k: lambda: store.commit(spark, root, lambda now, own: {"t": store.update(spark.createDataFrame([(k, "new")], "k long, v string"), root, "t", "k", now, own)})
    together(change(1), change(2))
    assert rows(spark, root) == [(1, "new"), (2, "new"), (3, "c")]


def test_upsert(spark, tmp_path):
    root = str(tmp_path)
    up = lambda data, keep=(): store.commit(spark, root, lambda now, own: {"t": store.upsert(spark.createDataFrame(data, "k long, v string, at int"), root, "t", "k", now, own, keep)})
    up([(1, "a", 1), (2, "b", 1)])
    up([(2, "c", 2), (3, "d", 2)], ("at",))
    up([(9, "z", 3)])
    assert rows(spark, root) == [(1, "a", 1), (2, "c", 1), (3, "d", 2), (9, "z", 3)]


def test_schemas_over_time(spark, tmp_path):
    """Files of three schemas are read as one table, and are not written anew."""
    root = str(tmp_path)
    alter = lambda **x: store.commit(spark, root, lambda now, own: {"t": store.alter(spark, root, "t", now, own, **x)})
    put(spark, root, [(1, "a")])
    alter(add={"kind": "string", "shown": "boolean"})
    put(spark, root, [(2, "b", "bot")], "k long, v string, kind string")
    alter(drop=("v",))
    put(spark, root, [(3, "user", True)], "k long, kind string, shown boolean")
    files = {f for f, _ in store.file_list(spark, root, store.latest(spark, root), "t")}
    assert rows(spark, root) == [(1, None, None), (2, "bot", None), (3, "user", True)] and len(files) == 3
    assert store.read(spark, root, "t").columns == ["k", "kind", "shown"]
    assert rows(spark, root, version=store.at_version(spark, root, 1)) == [(1, "a")]
    with pytest.raises(ValueError, match="missing columns: v, z"):
        store.read(spark, root, "t", columns=("k", "v", "z"))
    with pytest.raises(ValueError, match="unknown columns: v"):
        put(spark, root, [(4, "x")])
    alter(add={"v": "string"})  # a column of an old name starts anew
    assert {r.v for r in store.read(spark, root, "t").collect()} == {None}
    change = spark.createDataFrame([(1, "now")], "k long, kind string")
    store.commit(spark, root, lambda now, own: {"t": store.update(change, root, "t", "k", now, own)})
    assert {r.k: r.kind for r in store.read(spark, root, "t").collect()} == {1: "now", 2: "bot", 3: "user"}


def test_batches_count_once(spark, tmp_path):
    root, one = str(tmp_path), spark.createDataFrame([(1, "a")], "k long, v string")
    for batch in (0, 0, 1, 0, 1):
        store.commit(spark, root, lambda now, own: {"t": store.append(one, root, "t", now, own)}, "s", batch)
    assert len(rows(spark, root)) == 2 and store.latest(spark, root).batches == {"s": 1}


def one_after_the_other(pairs, ids=(), prints=()):
    """What becomes of bundles (id, fingerprint) in order."""
    ids, prints, out = set(ids), dict(prints), []
    for i, p in sorted(pairs):
        if p in prints:
            out.append((prints[p], True, None))
        elif i in ids:
            out.append((i, False, f"conversation_id already exists: {i}"))
        else:
            ids.add(i)
            prints[p] = i
            out.append((i, False, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_bundles_of_one_call(spark, seed):
    import random

    draw = random.Random(seed)
    pairs = [(f"i{draw.randrange(12)}", f"p{draw.randrange(12)}") for _ in range(25)]
    none = spark.createDataFrame([], writes.FILES)
    tables, outcome = writes.bundle_tables(bundles(spark, *pairs), none, spark.createDataFrame([("i3",), ("i5",)], "id string"))
    assert sorted(map(tuple, outcome.select("conversation_id", "exists", "error").collect()), key=str) == one_after_the_other(pairs, ("i3", "i5"))
    stored = [r.id for r in tables["conversation"].collect()]
    assert len(stored) == len(set(stored)) == len({r.fingerprint for r in tables["file_record"].collect()})


def test_bundles_of_two_writers(spark, tmp_path):
    """Both commits stand; of the id and the fingerprint that both bring, one is refused and one known."""
    root = str(tmp_path)
    a, b = bundles(spark, ("both", "p1"), ("a", "p2"), ("a2", "same")), bundles(spark, ("both", "p3"), ("b", "p4"), ("b2", "same"))
    one, two = together(lambda: writes.commit_bundles(spark, a, root).collect(), lambda: writes.commit_bundles(spark, b, root).collect())
    errors = [r.error for r in [*one, *two] if r.error]
    assert errors == ["conversation_id already exists: both"] and sum(r.exists for r in [*one, *two]) == 1
    assert store.versions(spark, root) == [1, 2]
    assert len(rows(spark, root, "conversation")) == 4 == len(rows(spark, root, "file_record")) == len(rows(spark, root, "messages"))
    assert [r.error for r in writes.commit_bundles(spark, bundles(spark, ("a", "p9")), root).collect()] == ["conversation_id already exists: a"]
    assert store.latest(spark, root).number == 2  # nothing came, nothing is committed


def test_bundle_that_fails(spark, tmp_path):
    root = str(tmp_path)
    bad = bundles(spark, ("x", "p1")).withColumn("figures", F.array(F.struct(F.lit(1).alias("figure_index"), F.lit("?").alias("image_data_base64"))))
    with pytest.raises(Exception, match="no base64"):
        writes.commit_bundles(spark, bad, root)
    assert store.versions(spark, root) == []


def test_bundles_of_a_stream(spark, tmp_path):
    root = str(tmp_path)
    first = writes.commit_bundles(spark, bundles(spark, ("a", "p1")), root, stream="s", batch=4).collect()
    again = writes.commit_bundles(spark, bundles(spark, ("a", "p1")), root, stream="s", batch=4).collect()
    assert first == again and not first[0].exists and len(rows(spark, root, "conversation")) == 1


def test_compact(spark, tmp_path):
    root = str(tmp_path)
    for i in range(6):
        put(spark, root, [(i, "a")])
    put(spark, root, [(i, str(i) * 50) for i in range(100, 9000)])
    store.commit(spark, root, lambda now, own: {"t": store.alter(spark, root, "t", now, own, add={"n": "int"})})
    before, want = {f for f, _ in store.file_list(spark, root, store.latest(spark, root), "t")}, rows(spark, root)
    pack = lambda: store.commit(spark, root, lambda now, own: (t := store.compact(spark, root, "t", now, own, 40_000)) and {"t": t})
    pack()
    after = {f for f, _ in store.file_list(spark, root, store.latest(spark, root), "t")}
    assert rows(spark, root) == want and len(after) == 2 and len(before & after) == 1
    number = store.latest(spark, root).number
    assert pack().number == number  # one small file is left: nothing to do


def test_vacuum(spark, tmp_path):
    root = str(tmp_path)
    for i in range(4):
        store.commit(spark, root, lambda now, own, i=i: {"t": store.replace(spark.createDataFrame([(i,)], "k long").coalesce(1), root, "t", own)})
    store.append(spark.createDataFrame([(9,)], "k long").coalesce(1), root, "t", store.latest(spark, root), "lost")  # never committed
    assert store.vacuum(spark, root, keep=2) == 0  # all is young
    assert store.vacuum(spark, root, keep=2, hours=-1) == 3
    assert store.versions(spark, root) == [3, 4] and [rows(spark, root, version=store.at_version(spark, root, n)) for n in (3, 4)] == [[(2,)], [(3,)]]
    put(spark, root, [(5,)], "k long")
    assert rows(spark, root) == [(3,), (5,)]


def test_rows_of_stored_files_are_not_broadcast(spark, tmp_path):
    """Files of few bytes may hold rows that take a driver's memory: joins sort them, on either side, and rounds of bundles too."""
    ids = spark.range(100).select(F.concat(F.lit("p"), "id").alias("conversation_id"), F.lit("{}").alias("payload"))
    a, b = store.written(ids, "a"), store.written(ids, "b")
    for joined in (a.join(b, "conversation_id"), a.join(b.groupBy("conversation_id").count(), "conversation_id", "left"), b.where("payload = '{}'").join(a, "conversation_id", "left_anti")):
        joined.count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    o = spark.range(64).select(F.concat(F.lit("p"), F.col("id") % 4).alias("conversation_id"), F.concat(F.lit("f"), F.col("id") % 5).alias("_fingerprint"), F.col("id").alias("_row"))
    assert writes._accepted(o).count() == 4
