"""Runs over stored messages, replies that arrive, metadata that is looked up anew, and texts that are written out."""

import csv
import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F
from test_streams import folder, run

from corpuscope.functions import legacy, payloads, progress
from corpuscope.operators import layout, migration, search, store, translation, venues, writes
from corpuscope.sources import catalogue
from corpuscope.streaming import stored


# ---------------------------------------------------------------- JSON of one form
def plain(x):
    return json.dumps(x, ensure_ascii=False, sort_keys=True)


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


VALUES = [{"b": 1, "a": {"d": [1, {"z": 1, "y": [2, {"k": None, "j": True}]}], "c": None}, "é": 'ü"q\\ \n\t/', "Z": "x, y: {z}", "": []}, [], {}, [[1.0, 0.5, -3, 1.25]], "text, with: marks", 12, None, {"x": 10**30, "y": 0.1, "w": 123456789.125}, {"long": "ab\\\"" * 5000}]


@pytest.mark.parametrize("x", VALUES)
def test_canonical_json(spark, x):
    said = json.dumps(x, ensure_ascii=False, indent=3)
    assert one(spark, payloads.canonical_json(F.lit(said))) == plain(x)
    assert one(spark, payloads.canonical_json(F.lit(json.dumps(x)))) == plain(x)  # characters as escapes
    assert one(spark, payloads.spaced_json(F.lit(json.dumps(x, ensure_ascii=False, separators=(",", ":"))))) == json.dumps(x, ensure_ascii=False)


def test_canonical_json_odd(spark):
    df = spark.createDataFrame([("no",), ("",), (None,), ('{"a":1,"a":2}',), ('{"e":1e5,"d":1.50,"c":-0,"b":"1.0"}',)], "s string")
    assert [r.c for r in df.select(payloads.canonical_json(F.col("s")).alias("c")).collect()] == [None, None, None, None, '{"b": "1.0", "c": -0, "d": 1.50, "e": 1e5}']


def test_json_dump(spark):
    at = dt.datetime(2024, 5, 6, 7, 8, 9, 120, tzinfo=dt.timezone.utc)
    row = ("x", [(at, None), (at.replace(microsecond=0), 2.5)], at.date(), {"k": at})
    df = spark.createDataFrame([(row,)], "s struct<b:string,l:array<struct<t:timestamp,n:double>>,a:date,m:map<string,timestamp>>")
    want = {"b": "x", "l": [{"t": at.isoformat(), "n": None}, {"t": at.replace(microsecond=0).isoformat(), "n": 2.5}], "a": "2024-05-06", "m": {"k": at.isoformat()}}
    kind = df.schema["s"].dataType
    got = df.select(payloads.json_dump(F.col("s"), kind).alias("a"), payloads.json_dump(F.col("s"), kind, ordered=True).alias("b")).first()
    assert (got.a, got.b) == (json.dumps(want, ensure_ascii=False), plain(want))


# ---------------------------------------------------------------- migrations
def put_messages(spark, root, n=60):
    m = spark.range(n).select(
        F.col("id"), F.expr("CASE id % 4 WHEN 0 THEN 'bot' ELSE 'user' END").alias("role"), F.lit(None).cast("string").alias("message_kind"),
        F.expr("CASE WHEN id % 8 = 0 THEN '# 致谢\nx\n[TRANSLATION_STATUS]\nstate=body_done\nphase=正文\n[/TRANSLATION_STATUS]' WHEN id % 8 = 4 THEN '正文\n\n如需继续，请回复“继续”' ELSE '继 续' END").alias("content"),
        F.expr("CASE WHEN id % 8 = 4 THEN '{\"b\": 1, \"translation_status\": {\"state\": \"any\", \"source\": \"heuristic\"}}' WHEN id % 4 = 1 THEN '{ \"kept\": 1}' END").alias("payload"),
    )
    store.commit(spark, root, lambda now, own: {"messages": store.append(m.repartitionByRange(6, "id"), root, "messages", now, own)})
    return m


def stored_rows(spark, root, name="messages"):
    t = store.read(spark, root, name)
    return sorted(map(str, t.select(*sorted(t.columns)).collect()))


def test_migration_goes_on_where_it_stopped(spark, tmp_path):
    whole, halves = str(tmp_path / "a"), str(tmp_path / "b")
    for root in (whole, halves):
        put_messages(spark, root)
    first = store.file_list(spark, whole, store.latest(spark, whole), "messages")
    report = migration.migrate(spark, whole, "messages", "id", migration.message_kinds, "kinds", files=2)
    calls = []

    def dies(rows):
        calls.append(1)
        if len(calls) > 2:
            raise RuntimeError("killed")
        return migration.message_kinds(rows)

    with pytest.raises(RuntimeError, match="killed"):
        migration.migrate(spark, halves, "messages", "id", dies, "kinds", files=2)
    assert migration.run_counts(spark, halves, "messages", "kinds").first().n_files == 2
    assert stored_rows(spark, halves) != stored_rows(spark, whole)
    migration.migrate(spark, halves, "messages", "id", migration.message_kinds, "kinds", files=2, most=1)
    again = migration.migrate(spark, halves, "messages", "id", migration.message_kinds, "kinds", files=2)
    assert stored_rows(spark, halves) == stored_rows(spark, whole)
    assert sorted(map(str, again.collect())) == sorted(map(str, report.collect()))
    counts = migration.run_counts(spark, halves, "messages", "kinds").first()
    assert tuple(counts) == (len(first), 60, 60) == tuple(migration.run_counts(spark, whole, "messages", "kinds").first())
    before = store.latest(spark, whole).number
    migration.migrate(spark, whole, "messages", "id", migration.message_kinds, "kinds")
    assert store.latest(spark, whole).number == before  # all is done: nothing is left to commit


def test_rows_of_one_file_are_spread(spark, tmp_path):
    root = str(tmp_path)
    m = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("content")).coalesce(1)
    store.commit(spark, root, lambda now, own: {"messages": store.append(m, root, "messages", now, own)})
    assert len(store.file_list(spark, root, store.latest(spark, root), "messages")) == 1
    migration.migrate(spark, root, "messages", "id", lambda rows: rows.withColumn("next_part", F.spark_partition_id()), "parts")
    now = store.read(spark, root, "messages")
    assert now.select("part").distinct().count() > 1
    assert now.drop("part").exceptAll(m).count() == 0 and now.count() == 200_000


def test_marks_of_lines_are_found_once(spark):
    words = legacy.SERVICE + legacy.FULL_DONE + legacy.NEXT_START
    said = [f"{a}{w[:-1]} {w}{z}" for w in words for a, z in (("", ""), ("ab页", "。"))] + [w[1:] for w in words] + [w[:-1] for w in words] + ["", "plain English", "一页"]
    rows = spark.createDataFrame([(x,) for x in said], "x string")
    for some in (legacy.SERVICE, legacy.FULL_DONE, legacy.NEXT_START):
        assert {r.x: r.y for r in rows.select("x", F.col("x").rlike(legacy._any(some)).alias("y")).collect()} == {x: any(w in x for w in some) for x in said}
    plan = rows.select(legacy.displayed(F.col("x")).alias("d"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(legacy._any(legacy.SERVICE)) == 2  # of a line, and of what follows its bullet


def test_migrated_messages(spark, tmp_path):
    root = str(tmp_path)
    old = {r.id: r for r in put_messages(spark, root).collect()}
    audit = migration.audit(spark, root, "messages", "id", migration.message_kinds)
    assert audit.where("changed").count() == 60 and store.latest(spark, root).number == 1
    report = {r.id: r for r in migration.migrate(spark, root, "messages", "id", migration.message_kinds, "kinds").collect()}
    new = {r.id: r for r in store.read(spark, root, "messages").collect()}
    for i, r in new.items():
        kind = "bot_reply" if i % 4 == 0 else "continue_command"
        assert (r.message_kind, r.visible_to_user, r.content) == (kind, kind == "bot_reply", old[i].content)
        assert r.section_category == ({0: "acknowledgements", 4: "body"}[i % 8] if i % 4 == 0 else None)
        if i % 8 == 0:
            s = json.loads(r.payload)["translation_status"]
            assert (s["state"], s["phase"]) == ("BODY_DONE", "body")
        else:
            assert r.payload == ('{"b":1}' if i % 8 == 4 else old[i].payload)
        assert (report[i].message_kind_before, report[i].message_kind_after) == (None, kind)
    assert migration.audit(spark, root, "messages", "id", migration.message_kinds).where("changed").count() == 0


def test_display_filter_run(spark, tmp_path):
    root = str(tmp_path)
    rows = [(1, 1, "bot_reply", "正文\n\n如需继续，请回复“继续”", True), (2, 1, "bot_reply", "如需继续", True), (3, 1, "bot_reply", "正文", True), (4, 1, "user_message", "如需继续", True), (5, 2, "bot_reply", "如需继续", False)]
    m = spark.createDataFrame(rows, "id long, conversation_id long, message_kind string, content string, visible_to_user boolean").repartitionByRange(5, "id")
    store.commit(spark, root, lambda now, own: {"m": store.append(m, root, "m", now, own)})
    files = lambda: {f for f, _ in store.file_list(spark, root, store.latest(spark, root), "m")}
    before = files()
    audit = migration.audit(spark, root, "m", "id", migration.display_filter)
    assert {r.action: r.n for r in search.action_counts(audit).collect()} == {"trim": 1, "hide": 2, "keep": 2} and files() == before
    report = migration.migrate(spark, root, "m", "id", migration.display_filter, "filter").collect()
    assert sorted((r.id, r.action, r.changed) for r in report) == [(1, "trim", True), (2, "hide", True)]
    assert {r.id: (r.content, r.visible_to_user) for r in store.read(spark, root, "m").collect()} == {1: ("正文", True), 2: ("如需继续", False), 3: ("正文", True), 4: ("如需继续", True), 5: ("如需继续", False)}
    assert len(before & files()) == 3


# ---------------------------------------------------------------- replies that arrive
OK = 'text [TRANSLATION_STATUS_JSON]{"state":"OK"}[/TRANSLATION_STATUS_JSON]'
PAYLOAD = '{"translation_plan":{"status":"ok","units":["u1","u2"],"appendix_units":["a1"]},"translation_status":{"planner_status":"ok","state":"IN_PROGRESS","active_scope":"body","completed_unit_ids":[],"remaining_unit_ids":["u1","u2","a1"]}%s}'
REPLY = "conversation_id long, seq long, action string, target_scope string, unit string, reply string"


def opened(spark, root, glossary="", ids=(1, 2, 3, 4)):
    m = spark.createDataFrame([(i, 1, "bot_reply", PAYLOAD % glossary) for i in ids], "conversation_id long, id long, message_kind string, payload string")
    stored.open_contexts(m, root)


def test_replies_that_arrive(spark, tmp_path):
    """Over batches and a restart, what counts is what whole runs give; stale replies are refused."""
    root, template = str(tmp_path / "r"), "go <<CURRENT_UNIT_ID>>"
    opened(spark, root)
    go = lambda i, seq, unit, reply=OK, scope="body", action="continue": (i, seq, action, scope, unit, reply)
    batches = [
        [go(1, 1, "u1"), go(1, 2, "u1"), go(2, 1, "u1"), go(3, 1, None, scope="appendix"), go(9, 1, "u1")],
        [go(1, 3, "u2"), go(1, 4, "a1", scope="appendix"), go(2, 2, "u2", "lost"), go(2, 3, "a1", scope="appendix"), go(4, 1, "u1", action="stop"), go(4, 2, "u1", scope="x")],
        [go(1, 5, "a1", scope="appendix"), go(3, 2, "u2"), go(3, 3, "u1")],
    ]
    for b in batches:
        read = folder(spark, spark.createDataFrame(b, REPLY), tmp_path / "in", 1)
        run(stored.continue_translations(read, root, template), tmp_path / "c")
    got = {(r.conversation_id, r.seq): (r.unit, r.state, r.error) for r in store.read(spark, root, stored.OUTCOMES).collect()}
    assert got == {
        (1, 1): ("u1", "IN_PROGRESS", None), (1, 2): ("u2", None, "stale reply"), (1, 3): ("u2", "BODY_DONE", None), (1, 4): ("a1", "ALL_DONE", None), (1, 5): (None, None, "no unit left"),
        (2, 1): ("u1", "IN_PROGRESS", None), (2, 2): ("u2", "UNSUPPORTED", None), (2, 3): (got[2, 3][0], None, "no unit left"), (3, 1): (None, None, "no unit left in this scope"), (3, 2): ("u1", None, "stale reply"),
        (3, 3): ("u1", "IN_PROGRESS", None), (4, 1): ("u1", None, "unsupported action"), (4, 2): (got[4, 2][0], None, "unsupported scope"), (9, 1): (None, None, "no plan or status"),
    }
    plan = payloads.plan_of_reply(F.lit('{"status":"ok","units":["u1","u2"],"appendix_units":["a1"]}'))
    plans = spark.range(1, 3).select(F.col("id").alias("conversation_id"), plan.alias("plan"))
    replies = spark.createDataFrame([(1, 0, OK), (1, 1, OK), (1, 2, OK), (2, 0, OK), (2, 1, "lost")], "conversation_id long, step int, reply string")
    whole = sorted((r.conversation_id, r.unit, r.status.state) for r in translation.run_states(plans, replies, 5).collect())
    assert whole == sorted((i, u, s) for (i, _), (u, s, e) in got.items() if e is None and i < 3)
    m = store.read(spark, root, stored.MESSAGES).where("conversation_id = 1").orderBy("seq", "position").collect()
    assert [(x.message_kind, x.visible_to_user) for x in m] == [("continue_command", False), ("bot_reply", True)] * 3
    assert [x.content for x in m] == ["go u1", "text", "go u2", "text", "go a1", "text"]
    assert json.loads(m[-1].payload)["translation_status"]["state"] == "ALL_DONE"
    # messages alone say the same as the stored contexts
    as_read = translation.latest_context(store.read(spark, root, stored.MESSAGES).withColumn("id", F.col("seq") * 2 + F.col("position")))
    now = {r.conversation_id: r.status for r in store.read(spark, root, stored.CONTEXTS).collect()}
    assert all(now[r.conversation_id] == r.status for r in as_read.collect())


def test_unconfirmed_glossary(spark, tmp_path):
    root = str(tmp_path / "r")
    opened(spark, root, ',"translation_glossary":{"status":"draft","entries":[{"term":"t","candidates":["x","y"]}]}', (1, 2))
    reply = spark.createDataFrame([(1, 1, "continue", "body", "u1", OK)], REPLY)
    run(stored.continue_translations(folder(spark, reply, tmp_path / "in", 1), root, "t"), tmp_path / "c")
    entry = "array<struct<term:string,candidates:array<string>,selected:string>>"
    given = spark.createDataFrame([(1, 5, [("t", ["x", "y"], "y")]), (2, 6, [("t", ["x"], "x")]), (7, 7, [])], f"conversation_id long, seq long, entries {entry}")
    run(stored.confirm_glossaries(folder(spark, given, tmp_path / "g", 1), root, "Confirmed."), tmp_path / "cg")
    again = spark.createDataFrame([(1, 8, "continue", "body", "u1", OK)], REPLY)
    run(stored.continue_translations(folder(spark, again, tmp_path / "in", 1), root, "<<CONFIRMED_GLOSSARY_JSON>>"), tmp_path / "c")
    assert {(r.conversation_id, r.seq): r.error for r in store.read(spark, root, stored.OUTCOMES).collect()} == {(1, 1): "glossary not confirmed", (1, 5): None, (2, 6): "glossary changed", (7, 7): "no plan or status", (1, 8): None}
    m = store.read(spark, root, stored.MESSAGES).orderBy("seq", "position").collect()
    assert [(x.message_kind, x.content, x.visible_to_user) for x in m] == [("user_message", "Confirmed.", False), ("bot_reply", "", False), ("continue_command", '[{"term": "t", "translation": "y"}]', False), ("bot_reply", "text", True)]
    assert json.loads(m[1].payload)["translation_glossary"]["entries"][0]["selected"] == "y"


def test_glossary_entries_are_stripped(spark):
    e = "array<struct<term:string,candidates:array<string>,selected:string>>"
    df = spark.createDataFrame([([("\tterm\n", ["x\n", "x", "　y", None, ""], " y\t"), ("term", ["z"], None), (" ", ["a"], None), ("n", [" "], None), (None, ["a"], None)],)], f"e {e}")
    got = df.select(progress.glossary_entries(F.col("e")).alias("g")).first().g
    assert [(g.term, g.candidates, g.selected) for g in got] == [("term", ["x", "y"], "y")]


# ---------------------------------------------------------------- metadata
PUBS = "item string, position int, abbr string, full_name string, category string, type string"


def test_one_bad_reply(spark):
    replies = spark.range(1000).select(F.col("id").alias("conversation_id"), F.when(F.col("id") == 500, '{"error": "x"}').otherwise('{"data": [{"title": "T", "authors": [{"name": "B", "authorId": "1"}]}]}').alias("response"))
    pubs = spark.createDataFrame([], PUBS)
    rows = venues.metadata_rows(replies, pubs)
    assert rows.count() == 999 and rows.where("conversation_id = 500").isEmpty()
    assert rows.first().authors_json == '[{"authorId": "1", "name": "B"}]'
    assert [tuple(r) for r in venues.metadata_errors(replies).collect()] == [(500, "a metadata reply without a list of papers", '{"error": "x"}')]
    odd = spark.createDataFrame([(1, None), (2, " "), (3, "<html>"), (4, '{"data": {}}'), (5, '{"data": []}')], "conversation_id long, response string")
    assert [r.error for r in venues.metadata_errors(odd).orderBy("conversation_id").collect()] == ["no reply", "no reply", "a reply that is no JSON", "a metadata reply without a list of papers"]
    assert [(r.conversation_id, r.status) for r in venues.metadata_rows(odd, pubs).collect()] == [(5, "not_found")]


def test_refresh_metadata(spark):
    papers = spark.createDataFrame([(1, "One", "1.pdf"), (2, None, "2.pdf"), (3, "Three", "3.pdf"), (4, "Four", "4.pdf")], "id long, title string, original_filename string")
    messages = spark.createDataFrame([(1, 1, "user_message", "no"), (1, 2, "bot_reply", " "), (1, 3, "bot_reply", "# Abstract\n\nOwn words.\n\n## Next\nx"), (2, 1, "bot_reply", ""), (4, 1, "bot_reply", "Four's.")], "conversation_id long, id long, message_kind string, content string")
    old = spark.createDataFrame([(4, "matched", "old", "kept", 1)], "conversation_id long, status string, abstract string, source string, created_at int").withColumns({"created_at": F.lit(dt.datetime(2020, 1, 1)), "updated_at": F.lit(dt.datetime(2020, 1, 1))})
    replies = spark.createDataFrame([(1, '{"data":[{"abstract":"not used"}]}'), (2, '{"data":[{"abstract":" From  metadata. "}]}'), (3, '{"data":[]}'), (4, "down")], "conversation_id long, response string")
    definitions = spark.createDataFrame([("L1", "L", "Lang", "One", "Lang/One"), ("M2", "M", "Model", "Two", "Model/Two")], "tag_code string, category_code string, category_label string, tag_label string, tag_path string")
    tags = spark.createDataFrame([(1, "M2", "manual"), (3, "M2", "poe"), (4, "M2", "poe")], "conversation_id long, tag_code string, source string")
    said = spark.createDataFrame([(1, "l1, X9, l1"), (2, "M2"), (3, "L1"), (4, "none")], "conversation_id long, reply string")
    new, asked, after, errors = venues.refresh_metadata(papers, messages, old, tags, replies, spark.createDataFrame([], PUBS), said, definitions)
    assert {r.conversation_id: (r.title, r.abstract, r.origin) for r in asked.collect()} == {1: ("One", "Own words.", "reply"), 2: ("2.pdf", "From metadata.", "metadata"), 3: ("Three", "", "none"), 4: ("Four", "Four's.", "reply")}
    assert {r.conversation_id: (r.status, r.abstract) for r in new.collect()} == {1: ("matched", "not used"), 2: ("matched", " From  metadata. "), 3: ("not_found", None), 4: ("matched", "old")}
    assert sorted(map(tuple, after.collect())) == [(1, "L1", "poe"), (2, "M2", "poe"), (3, "M2", "poe"), (4, "M2", "poe")]
    assert [r.conversation_id for r in errors.collect()] == [4]


def test_tag_prompts(spark):
    tree = spark.createDataFrame([("T", "Task", "task", [("T2", "b", ""), ("T1", "a", "")]), ("L", "Lang", "lang", [("L1", "c", "")])], "code string, label string, label_en string, tags array<struct<code:string,label:string,label_en:string>>")
    library = search.prompt_library(search.tag_definitions(tree))
    papers = spark.createDataFrame([("  A \n title", "word " * 400), (None, "")], "title string, abstract string")
    one_, two = [r.prompt for r in search.category_prompts(papers, library, "{categories}|{title}|{abstract}").collect()]
    assert one_.startswith("L=Lang,T=Task|A title|word word") and 1190 < len(one_.rsplit("|", 1)[1]) <= 1200 and two == "L=Lang,T=Task|-|-"
    said = spark.createDataFrame([("t, Q",), ("none",)], "reply string")
    assert [r.prompt for r in search.tag_prompts(said, library, "<{tags}>").collect()] == ["<T:T2b T1a>", "<L:L1c\nT:T2b T1a>"]


# ---------------------------------------------------------------- written out
def test_metadata_export(spark, tmp_path):
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 600000, tzinfo=dt.timezone.utc)
    m = spark.createDataFrame([(1, 7, "matched", 'a "quoted", text\nof lines', True, 0.5, 3, at), (2, 8, None, None, None, None, None, None)], "id long, conversation_id long, status string, abstract string, is_open_access boolean, match_score double, citation_count int, created_at timestamp")
    writes.write_export(m.coalesce(1), spark.createDataFrame([(7, "Title")], "id long, title string"), str(tmp_path / "x"))
    (path,) = (tmp_path / "x").glob("*.csv")
    with path.open(newline="") as f:
        rows = sorted(csv.DictReader(f), key=lambda r: r["id"])
    assert list(rows[0]) == list(writes.EXPORT) and len(writes.EXPORT) == 29
    assert {k: v for k, v in rows[0].items() if v} == {"id": "1", "conversation_id": "7", "conversation_title": "Title", "status": "matched", "abstract": 'a "quoted", text\nof lines', "is_open_access": "True", "match_score": "0.5", "citation_count": "3", "created_at": at.isoformat()}
    assert {k: v for k, v in rows[1].items() if v} == {"id": "2", "conversation_id": "8"}


def test_json_list(spark, tmp_path):
    rows = spark.createDataFrame([(1, "B", None), (0, "A", "Aa")], "position int, abbr string, full_name string")
    writes.write_json_list(rows, str(tmp_path / "l"), "position")
    (path,) = (tmp_path / "l").glob("part-*")
    assert json.loads(path.read_text()) == [{"abbr": "A", "full_name": "Aa"}, {"abbr": "B"}] and "\n" in path.read_text()
    assert [r.abbr for r in catalogue.venue_file(spark, str(path)).orderBy("position").collect()] == ["A", "B"]
    with pytest.raises(ValueError, match="no reference list"):
        writes.write_json_list(rows, str(tmp_path / "m"), "position", most=1)


# ---------------------------------------------------------------- assets
def test_reprocess(spark):
    r = spark.createDataFrame([(1, "figure", "above", "below", None), (2, None, None, None, "below"), (3, "image", "above", None, None), (4, "table", None, None, None), (5, None, None, "left", None), (6, None, None, None, None)], "conversation_id long, asset_type string, caption_direction string, figure_caption_direction string, table_caption_direction string")
    asked = writes.reprocess_requests(r)
    assert [(x.figure_direction, x.table_direction, x.error and re.sub(" must.*| is.*", "", x.error)) for x in asked.orderBy("conversation_id").collect()] == [
        ("above", None, None), (None, "below", None), (None, None, "asset_type"), (None, None, "caption_direction"), ("left", None, "figure_caption_direction"), (None, None, "at least one caption direction")]
    old = spark.createDataFrame([(1, "old"), (2, "old"), (5, "old")], "conversation_id long, label string")
    found = spark.createDataFrame([(1, "above", "new"), (1, "below", "no"), (2, "below", "no"), (5, "left", "no")], "conversation_id long, direction string, label string")
    assert sorted(map(tuple, writes.reprocessed(old, found, asked, "figure").collect())) == [(1, "new"), (2, "old"), (5, "old")]
    captions = spark.createDataFrame([(d, 1, 1, 100.0, 400.0, 300.0, 415.0) for d in (1, 2, 3)], "doc_id long, page int, caption_id int, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([(d, 1, i, "image", 100.0, y, 300.0, y + 150) for d in (1, 2, 3) for i, y in ((1, 240.0), (2, 425.0))], "doc_id long, page int, region_id int, kind string, x0 double, y0 double, x1 double, y1 double")
    given = spark.createDataFrame([(1, "below"), (2, "above")], "doc_id long, direction string")
    got = layout.matches(captions, regions, given)
    assert {r.doc_id: (r.region_id, r.direction) for r in got.collect()} == {1: (2, "below"), 2: (1, "above"), 3: (1, "above")}
    assert {r.doc_id: r.direction for r in layout.direction_vote(got).collect()} == {1: "below", 2: "above", 3: "above"}


# ---------------------------------------------------------------- older backfills, artifacts
def test_payload_cleanup(spark):
    block = '[TRANSLATION_STATUS_JSON]%s[/TRANSLATION_STATUS_JSON]'
    rows = [(1, "bot_reply", "a " + block % '{"state":"OK"}', '{"parse_error":"e","k":1}'), (2, "bot_reply", "a " + block % '{bad}', None), (3, "bot_reply", "a", '{ "k" : 1 }'), (4, "user_message", " a ", "x"), (5, "bot_reply", " a ", None), (6, "bot_reply", None, None)]
    m = spark.createDataFrame(rows, "id long, message_kind string, content string, payload string")
    got = {r.id: (r.action, r.next_content, r.next_payload) for r in migration.payload_cleanup(m).collect()}
    assert got == {1: ("update", "a", '{"k":1}'), 2: ("skip_parse_error", rows[1][2], None), 3: ("keep", "a", '{ "k" : 1 }'), 4: ("keep", " a ", "x"), 5: ("update", "a", None), 6: ("keep", None, None)}
    assert {r.id: r.changed for r in migration.report(migration.payload_cleanup(m), "id").collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_status_version_2(spark, tmp_path):
    block = "[TRANSLATION_STATUS]\nstate=%s\nphase=body\n[/TRANSLATION_STATUS]"
    rows = [(1, "bot_reply", block % "body_done", '{"k":[1],"parse_error":"x"}'), (2, "bot_reply", block % "odd", None), (3, "bot_reply", "x", '{"translation_status":{"state":"ALL_DONE"}}'), (4, "bot_reply", "x", None), (5, "user_message", block % "body_done", None)]
    m = spark.createDataFrame(rows, "id long, message_kind string, content string, payload string")
    root = str(tmp_path)
    store.commit(spark, root, lambda now, own: {"m": store.append(m, root, "m", now, own)})
    got = {r.id: (r.action, r.reasons) for r in migration.audit(spark, root, "m", "id", migration.status_version_2).collect()}
    assert got == {1: ("update", []), 2: ("skip_error", ["content.translation_status_block:invalid_state"]), 3: ("update", []), 4: ("skip_error", ["missing:missing_translation_status"]), 5: ("keep", [])}
    migration.migrate(spark, root, "m", "id", migration.status_version_2, "v2")
    new = {r.id: r for r in store.read(spark, root, "m").collect()}
    one_, three = json.loads(new[1].payload), json.loads(new[3].payload)
    assert (one_["k"], one_["translation_status"]["state"], "parse_error" in one_, three["translation_status"]["is_all_done"]) == ([1], "BODY_DONE", False, True)
    assert new[2].payload is None and new[1].content == rows[0][2]
    assert migration.audit(spark, root, "m", "id", migration.status_version_2).where("action = 'update'").isEmpty()  # done once, done for good


def test_artifact_files(spark, tmp_path):
    for name, data in (("a", '\ufeff{"m": [1], "p": {}, "t": " x"}'), ("b", "[1]"), ("c", "{bad"), ("d", '{"m": "[x", "p": [], "t": " "}')):
        (tmp_path / f"{name}.json").write_text(data, encoding="utf-8")
    rows = catalogue.artifact_files(spark, str(tmp_path / "*.json")).withColumn("shape", catalogue.shape_errors(F.col("value"), ("p",), ("m",), ("t",)))
    got = {r.path[-6:-5]: (r.error, r["shape"]) for r in rows.collect()}
    wrong = ["field 'p' must be an object", "field 'm' must be a list", "t is required"]
    assert got == {"a": (None, []), "b": ("the input must be a JSON object", wrong), "c": ("the input must be a JSON object", wrong), "d": (None, wrong)}
    asked = spark.createDataFrame([(str(tmp_path / "a.json"),), ("/no",), (str(tmp_path),), (" ",), (None,)], "f string")
    known = rows.select("path", F.lit(True).alias("is_file")).union(spark.createDataFrame([(str(tmp_path), False)], "path string, is_file boolean"))
    errors = {r.f: r.path_error for r in catalogue.with_path_errors(asked, "f", known).collect()}
    assert errors == {str(tmp_path / "a.json"): None, "/no": "f does not exist: /no", str(tmp_path): f"f must be a file: {tmp_path}", " ": "f is required", None: "f is required"}


# ---------------------------------------------------------------- HTML tables
HTML = [
    "<table><tr><td>a</td><td> b \n c </td></tr><tr><td> </td></tr></table>", "<table><tr><td>a<td>b</td></tr></table>", "<div id='x'><div><table><tr><th>1&amp;2 &lt;i&gt; &#233;&#x4f1a;&nbsp;z</th></tr></table></div></div><table><tr><td>no</td></tr></table>",
    "<TABLE><TR><TD CLASS='q'>x <b>y</b><!-- <td>z</td> --></TD></TR></TABLE>", "<tr><td>open", "a < b <tr><td>1 < 2</td></tr>", "", None, "<div id=x><tr><td>in</td></tr></div><tr><td>out</td></tr>", "<div id='y'><div id='x'><tr><td>1</td></tr><div><tr><td>2</td></tr></div></div><tr><td>3</td></tr></div>",
    "<script>if (a<b) document.write('<tr><td>s</td></tr>')</script><tr><td>t</td></tr>", "<tr><td>1</td><td></td></tr></tr><tr></tr><tr><td></td></tr>", "<tr><td>a</td><tr><td>b</td></tr>", "<p>x</p><tr><td>&copy;&#0;&unknown;</td></tr>",
]


@pytest.mark.parametrize("element_id", [None, "x"])
def test_html_rows(spark, element_id):
    """Against the standard library's parser, but for entities that are not common."""
    df = spark.createDataFrame(list(enumerate(HTML[:-1])), "id long, html string")
    want = [(i, n, row) for i, h in enumerate(HTML[:-1]) for n, row in enumerate(catalogue.table_rows(h or "", element_id))]
    assert sorted(map(tuple, catalogue.html_rows(df, "id", element_id=element_id).collect())) == want and want


def test_html_entities(spark):
    df = spark.createDataFrame([(1, HTML[-1])], "id long, html string")
    assert catalogue.html_rows(df, "id").first().cells == ["&copy;&#0;&unknown;"]


def test_html_of_pages(spark):
    from conftest import SF

    pages = catalogue.table(spark, SF, "pages").select("page_id", "html")
    want = sorted((r.page_id, n, row) for r in pages.collect() for n, row in enumerate(catalogue.table_rows(r.html or "")))
    assert sorted(map(tuple, catalogue.html_rows(pages, "page_id").collect())) == want


# ---------------------------------------------------------------- small expressions
def test_small_expressions(spark):
    rows = spark.createDataFrame([('{"a":1}',), ("[1]",), ("{bad",), (None,)], "s string")
    default = F.named_struct(F.lit("a"), F.lit(9))
    assert [r.v.a for r in rows.select(payloads.json_or(F.col("s"), "struct<a:int>", default).alias("v")).collect()] == [1, 9, 9, 9]
    block = '[TRANSLATION_STATUS_JSON]{"state":"OK"}[/TRANSLATION_STATUS_JSON]'
    said = spark.createDataFrame([(f"a {block} b",), ("none",), (None,)], "s string")
    assert [r.t for r in said.select(payloads.status_text(F.col("s")).alias("t")).collect()] == [block, None, None]
    regions = spark.createDataFrame([(1, "image", 0.0, 0.0, 50.0, 20.0), (2, "image", 0.0, 0.0, 30.0, 20.0), (3, "drawing", 0.0, 0.0, 550.0, 300.0), (4, "image", 0.0, 0.0, 550.0, 300.0), (5, "drawing", 0.0, 0.0, 100.0, 60.0)], "i int, kind string, x0 double, y0 double, x1 double, y1 double")
    assert [r.i for r in layout.graphic_regions(regions.withColumns({"page_w": F.lit(600.0), "page_h": F.lit(800.0)})).orderBy("i").collect()] == [1, 4, 5]
    bundle = spark.createDataFrame([("f", "\t\n", "u")], "filename string, fingerprint string, poe_url string")
    assert writes.bundle_error(bundle).first().error == "missing: fingerprint"


def test_status_texts_are_stripped(spark):
    s = progress.status(F.lit("ok"), F.array(F.lit("u1"), F.lit("u2")), F.array().cast("array<string>"), F.array(F.lit("u1")), F.lit("\tu1\n"), F.lit("\nBODY "), F.lit("OK"), F.lit(""))
    r = spark.range(1).select(s.alias("s")).first().s
    assert (r.current_unit_id, r.next_unit_id, r.active_scope) == ("u1", "u2", "body")
