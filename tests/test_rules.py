"""Replies, old replies, runs, bundles, listings, formulas and page layout on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import legacy, markup, payloads, text
from corpuscope.operators import filters, layout, search, translation, venues, writes
from corpuscope.sources import catalogue
from corpuscope.streaming import jobs


def values(spark, given, column, type_="string"):
    return [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(given)], f"i int, x {type_}").orderBy("i").select(column(F.col("x")).alias("y")).collect()]


def test_fences_and_numbers(spark):
    assert values(spark, ["```json\n{}\n```", "```\n```", "``` x", "a", None], payloads.without_fences) == ["{}", "", "``` x", "a", ""]
    assert values(spark, ["3", "+3", "-2", "2.7", "9999999999", "x", None], lambda x: text.safe_int(x, 7, 1)) == [3, 3, 1, 7, 7, 7, 7]
    assert values(spark, [2.7, -3.2, None], lambda x: text.safe_int(x, 7, 0), "double") == [2, 0, 7]


def test_glossaries_and_plans(spark):
    plans = values(spark, ['{"status":"ok","units":[]}', '{"status":"unsupported","reason":" r "}', '{"status":"x"}', "[1]", '{"translation_plan":{"status":"OK","units":["a","a"," b"],"appendix_units":["b","c"]}}'], payloads.plan_of_reply)
    assert [p and (p.status, p.units, p.appendix_units, p.reason) for p in plans] == [("unsupported", [], [], "no_supported_units"), ("unsupported", [], [], "r"), None, None, ("ok", ["a", "b"], ["c"], "")]
    said = ['{"glossary":[{"term":"t","candidates":["x"]}]}', '{"translation_glossary":{"status":"confirmed","entries":[{"term":"t","candidates":["x","y"],"selected":"y"}]}}', '{"translation_glossary":{"status":"odd","entries":[]}}', "no", ""]
    got = values(spark, said, payloads.glossary_of_reply)
    assert [g and (g.status, [(e.term, e.selected) for e in g.entries]) for g in got] == [("draft", [("t", "x")]), ("confirmed", [("t", "y")]), ("confirmed", []), ("confirmed", []), None]
    assert values(spark, ['[{"skill":" s ","retryable":1}, 3, {"message":"m"}]', "x", None], payloads.errors) == [[("s", "", "", True), ("", "", "m", False)], [], []]


def test_stored_reply_and_payload(spark):
    row = spark.createDataFrame([("a", '{"n":1,"o":{"p":[2]},"parse_error":"e"}'), ("b", None), ("c", "[]"), ("d", '{"parse_error":"e"}')], "c string, p string").select(payloads.stored_reply(F.col("c"), F.col("p")).alias("s"))
    assert [r.j for r in row.select(payloads.payload_json(F.col("s")).alias("j")).collect()] == ['{"n":1,"o":{"p":[2]}}', None, None, None]
    one = row.select(payloads.envelope(F.lit("raw"), F.col("s")).alias("e")).first().e
    assert (one.reply, one.content, one.section_category) == ("raw", "a", None)


@pytest.mark.parametrize("said, shown, reasons", [
    ("正文\n\n如需继续，请回复“继续”", "正文", ["trimmed_legacy_footer"]), ("正文\n✅ **全文翻译完成**\n- 生成 x\n## y", "正文", ["trimmed_trailing_service_block"]),
    ("如需继续", "", ["trimmed_legacy_footer", "empty_after_cleanup"]), ("---\n参考文献\na", "", ["trimmed_optional_section_tail:references", "empty_after_cleanup"]), ("致谢 a\nb", "", ["hidden_optional_section_only:acknowledgements"]),
    ("x\n[TRANSLATION_STATUS]a=1[/TRANSLATION_STATUS]\n如需继续", "x\n\n如需继续", []), (None, "", ["empty_after_status_strip"]), ("## y\n全文翻译完成\nx", "## y\n全文翻译完成\nx", []),
])
def test_shown_replies(spark, said, shown, reasons):
    d = values(spark, [said], legacy.displayed)[0]
    assert (d.display, d.reasons) == (shown, reasons)


def test_old_statuses(spark):
    names = values(spark, ["Appendices", "BODY_ONLY", "补充材料 x", "none", "all_done", "?", None], legacy.scope_name)
    assert names == ["appendix", "body", "appendix", "none", "done", None, None]
    assert values(spark, ["references、附录|x,附录", '["acknowledgment"]', ""], legacy.scope_list) == [["appendix", "references"], ["acknowledgements"], []]
    assert values(spark, ["[COMMAND]\naction = stop\ntarget=a\ntarget= b \n[/COMMAND]", "x"], lambda x: legacy.command_fields(x)["target"]) == ["b", None]
    block = "[TRANSLATION_STATUS]\nstate=body_done\nnext_action_command=[COMMAND]\naction=continue\n\ntarget=附录\n[/COMMAND]\nphase=正文\nstate=in_progress\n[/TRANSLATION_STATUS]"
    v = values(spark, [block, "none", "[TRANSLATION_STATUS]\nstate=odd\n[/TRANSLATION_STATUS]"], lambda x: legacy.status_v2(legacy.old_status(x, F.lit(None).cast("string"))["status"]))
    assert [r.reason for r in v] == ["ok", "missing_translation_status", "invalid_state"]
    assert (v[0].status.state, v[0].status.phase, v[0].status.next_action.type, v[0].status.next_action.target_scope) == ("IN_PROGRESS", "body", "continue", "appendix")
    stored = spark.createDataFrame([("", '{"translation_status":{"state":"any","source":"heuristic"}}'), ("", '{"translation_status":{"state":"any","phase":"done"}}'), (block, "{}")], "c string, p string")
    m = [r.m for r in stored.select(legacy.migrated_status(F.col("c"), F.col("p")).alias("m")).collect()]
    assert m[0] is None and (m[1].state, m[1].phase) == ("ANY", "done") and (m[2].state, m[2].next_action.command) == ("IN_PROGRESS", "[COMMAND]")


def test_sections_by_source(spark):
    got = spark.createDataFrame([("# 致谢", "body", "x"), ("", "Appendix", "x"), (" ", "", "References"), ("", None, "")], "a string, b string, c string").select(text.message_section(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()
    assert [tuple(r.s) for r in got] == [("acknowledgements", "display_content"), ("appendix", "translation_status.active_scope"), ("references", "original_content"), (None, "empty")]


# ---------------------------------------------------------------- runs
PLAN = '{"translation_plan":{"status":"ok","units":["u1","u2"],"appendix_units":["a1"]},"translation_status":{"planner_status":"ok","state":"IN_PROGRESS","completed_unit_ids":["u1"]},"translation_glossary":{"status":"%s","entries":[{"term":"t","candidates":["x"]}]}}'


def contexts(spark):
    rows = [(1, 1, "bot_reply", PLAN % "draft"), (1, 2, "bot_reply", PLAN % "confirmed"), (1, 3, "user_message", PLAN % "draft"), (2, 1, "bot_reply", PLAN % "draft"), (3, 1, "bot_reply", "{}"), (4, 1, "bot_reply", PLAN.replace('"u1"]', '"u1","u2"]') % "confirmed")]
    return translation.latest_context(spark.createDataFrame(rows, "conversation_id long, id long, message_kind string, payload string")).withColumn("target_scope", F.when(F.col("conversation_id") == 4, "appendix").otherwise("body"))


def test_next_steps(spark):
    steps = translation.next_steps(contexts(spark), "go <<CURRENT_UNIT_ID>> <<CONFIRMED_GLOSSARY_JSON>>")
    got = {r.conversation_id: (r.unit, r.error, r.prompt) for r in steps.collect()}
    assert got[1] == ("u2", None, 'go u2 [{"term": "t", "translation": "x"}]') and got[2][1] == "glossary not confirmed" and got[3][1] == "no plan or status" and got[4][0] == "a1"
    replies = {1: 'done [TRANSLATION_STATUS_JSON]{"state":"OK"}[/TRANSLATION_STATUS_JSON]', 4: "no status"}
    said = F.element_at(F.create_map(*(F.lit(x) for kv in replies.items() for x in kv)), F.col("conversation_id").cast("int"))
    after = {r.conversation_id: r for r in translation.after_reply(steps.withColumn("reply", said)).collect()}
    assert (after[1].new_status.state, after[1].new_status.next_unit_id, after[1].stored.content) == ("BODY_DONE", "a1", "done")
    assert (after[4].new_status.state, after[4].new_status.reason, after[4].stored.content) == ("UNSUPPORTED", "translator_status_missing", "no status")


def test_glossary_confirmation(spark):
    c = contexts(spark).where("conversation_id = 2").withColumn("status", F.col("status").withField("completed_unit_count", F.lit(0)))
    given = lambda *e: F.array(*(F.struct(F.lit(t).alias("term"), F.array(*map(F.lit, cs)).alias("candidates"), F.lit(s).alias("selected")) for t, cs, s in e))
    ok = translation.confirm_glossary(c.withColumn("entries", given(("t", ["x"], "x")))).first()
    assert ok.error is None and ok.confirmed.status == "confirmed"
    assert translation.confirm_glossary(c.withColumn("entries", given(("t", ["y"], "y")))).first().error == "glossary changed"
    assert translation.confirm_glossary(contexts(spark).where("conversation_id = 2").withColumn("entries", given(("t", ["x"], "x")))).first().error == "units are done"


def test_runs_artifacts_and_markdown(spark):
    ok = '[TRANSLATION_STATUS_JSON]{"state":"OK"}[/TRANSLATION_STATUS_JSON]'
    plan = payloads.plan_of_reply(F.lit('{"status":"ok","units":["u1","u2"],"appendix_units":["a1"]}'))
    plans = spark.range(1, 4).select(F.col("id").alias("conversation_id"), plan.alias("plan"))
    replies = spark.createDataFrame([(1, 0, ok), (1, 1, ok), (1, 2, ok), (2, 0, ok), (2, 1, "lost"), (2, 2, ok), (3, 0, ok), (3, 2, ok)], "conversation_id long, step int, reply string")
    got = {}
    for r in translation.run_states(plans, replies, 5).orderBy("step").collect():
        got.setdefault(r.conversation_id, []).append((r.unit, r.status.state))
    assert got == {1: [("u1", "IN_PROGRESS"), ("u2", "BODY_DONE"), ("a1", "ALL_DONE")], 2: [("u1", "IN_PROGRESS"), ("u2", "UNSUPPORTED")], 3: [("u1", "IN_PROGRESS")]}
    results = [[("u1", "ok", "", "one"), ("u2", "UNSUPPORTED", "r", "")], [("u2", "OK", "", "x")], [], [("u1", "UNSUPPORTED", "r", ""), ("u2", "OK", "", "")]]
    rows = spark.createDataFrame(list(enumerate(results)), f"i int, results {translation.RESULT}").withColumn("plan", plan)
    built = {r.i: r for r in translation.build_artifact(rows, "Begin with {unit}.", "Continue with {unit}.", "Plan it.").collect()}
    assert built[0].artifact_errors == [] and [m.content for m in built[0].messages] == ["Begin with u1.", "one", "Continue with u2.", ""]
    assert (built[0].translation_status.state, built[0].first_bot_message, built[0].continue_count_used) == ("UNSUPPORTED", "one", 1)
    assert built[1].artifact_errors == ["unit_results[0] is not the next planned unit"] and built[2].artifact_errors == ["unit_results must be a non-empty list"] and built[1].messages is None
    assert built[3].artifact_errors == ["unit_results[1].content is required"]
    good = translation.build_artifact(rows.where("i = 0"), "Begin with {unit}.", "Continue with {unit}.", "Plan it.")
    md = good.select(translation.markdown(F.col("messages"), F.col("plan"), F.col("translation_status"), payloads.errors(F.lit('[{"skill":"s"}]')), F.col("continue_count_used"), F.col("first_bot_message"), F.lit("T")).alias("m")).first().m
    assert md.startswith("# T\n\n- 可见译文段数: 1\n- 续翻次数: 1\n- 首段摘要预览: one\n") and "## 1. u1\n\none\n" in md and md.endswith("- [1] skill=s; type=-; retryable=no; message=-\n")
    plans_ = F.transform("messages", lambda m: F.when(m["role"] == "bot", F.col("plan")))
    check = lambda messages, status: good.select(translation.message_errors(messages, plans_, F.col("plan"), F.transform("messages", lambda m: m["status"]), status).alias("e")).first().e
    assert check(F.col("messages"), F.col("translation_status")) == []
    assert check(F.slice("messages", 2, 2), F.col("translation_status"))[0] == "messages[0] must be a user message"


# ---------------------------------------------------------------- writes and listings
def test_bundles(spark, tmp_path):
    message, figure, tag = "struct<role:string,content:string>", "struct<figure_index:string,caption:string,image_data_base64:string>", "struct<tag_code:string,category_code:string,category_label:string,tag_label:string,tag_path:string,source:string>"
    schema = f"conversation_id string, title string, file_record struct<filename:string,fingerprint:string,poe_url:string,content_type:string,poe_name:string>, messages array<{message}>, figures array<{figure}>, tables array<struct<table_index:int>>, tags array<{tag}>, meta struct<paper_id:string,year:int>"
    record = ("f.pdf", "p1", "u", None, "")
    rows = [("a", " ", record, [("bot", "hi [TRANSLATION_STATUS_JSON]{\"state\":\"OK\"}[/TRANSLATION_STATUS_JSON]"), None, ("user", "继续")], [("0", "c", "eA=="), ("x", "d", "")], [], [("T1", "T", None, "", None, None), (" ", None, None, None, None, None)], (None, 2001)), ("b", "t", ("f", "", "u", None, None), None, None, None, None, None), ("c", "t", record, None, None, None, None, None), ("old", "t", ("f", "p9", "u", None, None), [], [], [], [], None)]
    parts, outcome = writes.bundle_tables(spark.createDataFrame(rows, schema), spark.createDataFrame([], "file_id string, conversation_id string, fingerprint string, uploaded_at int"), spark.createDataFrame([("old",)], "id string"))
    got = {(r.conversation_id, r.exists, r.error): r.committed_parts for r in outcome.collect()}
    assert got == {("a", False, None): ["conversation", "file_record", "messages", "figures", "tags", "meta"], ("b", False, "missing: fingerprint"): [], ("a", True, None): [], ("old", False, "conversation_id already exists: old"): []}
    writes.publish(spark, parts, str(tmp_path / "r"))
    read = lambda n: writes.published(spark, str(tmp_path / "r"), n)
    assert [(m.message_kind, m.content, m.visible_to_user) for m in read("messages").orderBy("position").collect()] == [("bot_reply", "hi", True), ("continue_command", "继续", False)]
    assert [(f.figure_index, f.image_data) for f in read("figures").orderBy("position").collect()] == [(1, b"x"), (2, None)]
    assert [tuple(t) for t in read("tags").select("tag_code", "tag_path", "source").collect()] == [("T1", "T/T1", "agent")]
    assert read("meta").first().status == "matched" and read("conversation").first().title == "f.pdf" and read("file_record").first().content_type == "application/pdf"
    assert [r.error for r in writes.compose_error(spark.createDataFrame(rows, schema)).orderBy("conversation_id").collect()] == ["title is required", "file_record.fingerprint is required", "messages must be a list", None]


def test_small_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "conversation_id long, tag string")
    found = spark.createDataFrame([(1, [("n",)]), (2, [])], "conversation_id long, t array<struct<tag:string>>")
    assert sorted(map(tuple, writes.replace_if_any(old, found, "t").collect())) == [(1, "n"), (2, "y")]
    shells = writes.paper_shells(spark.createDataFrame([(1, "f")], "conversation_id long, filename string"))
    assert writes.retitled(shells, spark.createDataFrame([(1, " T ")], "id long, title string")).first().title == "T"
    assert writes.evolve(old, {"note": "string", "tag": "int"}, ("conversation_id",)).columns == ["tag", "note"] and writes.chosen(old, ["z", "tag"]).columns == ["tag"]
    with pytest.raises(ValueError, match="missing columns: z"):
        writes.assert_columns(old, ["tag", "z"])
    files = spark.createDataFrame([("a", 1, "p", 1), ("b", 9, "p", 2), ("c", 9, "q", 1)], "file_id string, conversation_id long, fingerprint string, uploaded_at int")
    live, stale = writes.live_files(files, spark.createDataFrame([(1,)], "id long"))
    assert [tuple(r) for r in live.collect()] == [("p", "a")] and [r.file_id for r in stale.collect()] == ["c"]
    report = spark.createDataFrame([(1, 2, "trim", ["r"], "a\nb", "a"), (2, 2, "keep", [], "a", "a"), (3, 2, "hide", [], "a\n\nb", "")], "message_id long, conversation_id long, action string, reasons array<string>, original_content string, display_content string")
    writes.write_report(report, str(tmp_path / "d"), "deleted", split=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "d/action=trim")).collect()] == ["message_id=1 conversation_id=2 action=trim", "reasons=r", "deleted:", "- b", ""]
    writes.write_report(report, str(tmp_path / "j"))
    writes.write_report(report, str(tmp_path / "u"), "diff")
    assert spark.read.json(str(tmp_path / "j")).count() == 3 and spark.read.text(str(tmp_path / "u")).where("value = '-b'").count() == 2
    papers = spark.createDataFrame([(1, "T")], "id long, title string")
    writes.csv_export(old, papers, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).fillna("").collect()) == [("1", "x", "T"), ("2", "y", "")]
    assert {r.action: r.n for r in search.action_counts(report).collect()} == {"trim": 1, "keep": 1, "hide": 1}


def test_listing_pieces(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k long, id long, v string")
    assert [tuple(r) for r in filters.first_rows(rows, "k").orderBy("k").collect()] == [(1, 1, "a"), (2, 5, "c")]
    assert filters.first_rows(rows, "k", last=True).where("k = 1").first().v == "b" and filters.by_key(rows, "id", 5).first().v == "c"
    assert [r.name for r in filters.columns_of(rows).collect()] == ["k", "id", "v"]
    assert [r.id for r in filters.select_slice(rows, "id", True, 2, -3, k=None, v="").collect()] == [5, 2]
    (tmp_path / "t.json").write_text('\ufeff{"categories":[{"code":"L","label":"甲","label_en":"l","tags":[{"code":"L1","label":"乙","label_en":"m"}]}]}')
    d = search.tag_definitions(catalogue.tag_tree(spark, str(tmp_path / "t.json")))
    assert tuple(d.select("tag_code", "tag_path", "tag_path_en").first()) == ("L1", "甲/乙", "l/m")
    assert [r.tag_code for r in search.resolved_tags(spark.createDataFrame([(1, " l1"), (1, "L1"), (1, "Q")], "conversation_id long, tag_code string"), d).collect()] == ["L1"]
    papers = spark.createDataFrame([(1, "the a", 5), (2, "other", 6)], "id long, title string, created_at long")
    assert [(r.id, r.tier) for r in search.search_page(papers, papers, "the a")[0].collect()] == [(1, "exact"), (2, "fuzzy")]
    assert search.search_page(papers, papers, "the a", "fuzzy")[0].count() == 1 and search.search_page(papers, papers)[0].count() == 0
    child = spark.createDataFrame([(1, 1, "x", 1, "A", "T2", "u")], "conversation_id long, id long, content string, figure_index int, category_code string, tag_code string, poe_url string").withColumn("table_index", F.col("figure_index"))
    one = search.paper_details(papers.where("id = 1"), child, child, child, child, child, child).first()
    assert len(one.messages) == len(one.figures) == len(one.tables) == len(one.tags) == 1 and one.file.poe_url == "u" and one.figures[0].image_url == "/assets/figures/1"
    (tmp_path / "v.json").write_text('[{"abbr":"RW","full_name":"Red","category":"A","type":"journal","field":"f"}]')
    assert tuple(catalogue.venue_file(spark, str(tmp_path / "v.json")).first()) == ("0", 0, "RW", "Red", "A", "journal", "f")


def test_long_venue_list(spark, monkeypatch):
    pubs = spark.createDataFrame([("0", 0, "ab", "abc def"), ("1", 1, "x", "xyz long name")], "item string, position int, abbr string, full_name string")
    names = spark.createDataFrame([("abc",), ("xyz long",), ("say ab",), ("q",)], "name string")
    want = {r.name: r.item for r in venues.resolve(names, pubs).collect()}
    monkeypatch.setattr(venues, "BROADCAST_BYTES", 0)
    assert {r.name: r.item for r in venues.resolve(names, pubs).collect()} == want and want["abc"] == "0"


def test_job_recovery(spark, tmp_path):
    rows = [(1, 1, 10, "running"), (1, 2, 20, "queued"), (1, 3, 30, "running"), (2, 1, 5, "queued"), (3, 1, 5, "running"), (3, 2, 9, "queued")]
    e = spark.createDataFrame([(*r, None) for r in rows], "job_id long, seq long, at long, status string, error string").withColumn("at", F.timestamp_seconds("at"))
    got = {r.job_id: (r.status, r.started_at and r.started_at.timestamp()) for r in jobs.job_states(e).select("job_id", "status", F.col("started_at")).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["running", "queued", "queued"] and got[2][1] is None and got[3][1] is None
    assert [r.job_id for r in jobs.pending(jobs.job_states(e), "updated_at").collect()] == [2, 3, 1]


# ---------------------------------------------------------------- formulas, texts and pages
@pytest.mark.parametrize("said, shown", [("[\nx = 1\n]", "\\[\nx = 1\n\\]"), ("[see this]", "[see this]"), ("[a_1]", "\\[a_1\\]"), ("so (x^2) and (text) and \\(y\\)", "so \\(x^2\\) and (text) and \\(y\\)"), ("[ x = 1\nno end", "[ x = 1\nno end"), ("\\[ a+b \\]", "\\[a+b\\]")])
def test_formulas(spark, said, shown):
    assert markup.normal_math(said) == shown
    df = spark.createDataFrame([(said,), (None,)], "x string").withColumn("y", markup.normalised_math("x")).withColumn("p", markup.protected_math("y"))
    got = df.select("y", markup.restored_math("p.text", "p.formulas").alias("z")).collect()
    assert [tuple(r) for r in got] == [(shown, shown), (None, None)]


def test_registered_functions(spark):
    markup.register(spark)
    assert spark.sql("SELECT normalised_math('[a_1]') AS m").first().m == "\\[a_1\\]"
    assert [tuple(r) for r in spark.sql("SELECT * FROM html_rows('<table><tr><td>a<td>b</td></tr></table>', '')").collect()] == [(0, ["b"])]
    assert values(spark, ["a\n\nb"], lambda x: markup.deleted_lines(x, F.lit("a"))) == [["", "b"]]


def test_text_measures(spark):
    rows = ["line text of many words 12 34"] * 3 + ["other words here 100 200"]
    assert values(spark, [rows, ["1"] * 5], text.has_line_numbers, "array<string>") == [True, False]
    assert values(spark, ["Figure 3a: x", "see Fig. 2", "a. Figure 2", "图 4 说明", "none"], text.caption_label) == ["Figure 3a", "Fig. 2", None, "图 4", None]
    assert values(spark, ["Table 2", "table 2 shows", "Table 2 Shows", "TABLE IV. x", "x"], text.has_caption_suffix) == [True, False, True, True, False]
    assert values(spark, [0.0, 1.0, 9.0], text.retry_delay, "double") == [1.0, 2.0, 30.0] and values(spark, [1.0, 9.0], text.download_delay, "double") == [2.0, 5.0]
    assert spark.range(1).select(text.local_time(F.lit("2024-01-01 00:00:00").cast("timestamp"), "Asia/Shanghai").alias("t")).first().t == "2024-01-01T08:00:00+08:00"


def page(spark, *blocks, drawings=()):
    rows = [(1, n, 600.0, 800.0, [(t, *map(float, box), [(x, float(box[0]), float(box[1] + 10 * i), float(box[2]), float(box[1] + 10 * i + 9)) for i, x in enumerate(said)]) for t, box, said in b], [tuple(map(float, d)) for d in drawings]) for n, b in enumerate(blocks)]
    return spark.createDataFrame(rows, layout.PAGE)


def test_page_assets(spark):
    image, other = (1, (100, 100, 280, 200), []), (1, (100, 210, 280, 290), [])
    near = (1, (102, 101, 281, 202), [])  # nearly the first
    caption = (0, (100, 300, 300, 310), ["Figure 1: what it shows"])
    label = (0, (120, 85, 200, 95), ["axis"])
    table = (0, (100, 500, 300, 540), ["1 2 3 4", "5 6 7 8"])
    named = (0, (100, 480, 320, 490), ["Table 1. Numbers"])
    got = {r.kind: r for r in layout.page_assets(page(spark, [image, near, other, caption, label, table, named])).collect()}
    f, t = got["figure"], got["table"]
    assert (f.label, f.asset_index, f.page) == ("Figure 1", 1, 0) and (f.x0, f.y0, f.y1) == (92.0, 77.0, 298.0) and f.x1 == 288.0
    assert (t.label, t.caption) == ("Table 1", "Table 1. Numbers") and (t.y0, t.y1) == (492.0, 527.0) and (t.pixel_height, t.pixel_width) == (70, 432)
    assert layout.page_assets(page(spark, [image], [caption])).count() == 0


def test_votes_and_used_regions(spark):
    up = [(1, (100, 100, 300, 200), []), (0, (100, 210, 300, 220), ["Figure 1"])]
    both = [(1, (100, 100, 300, 200), []), (0, (100, 210, 300, 220), ["Figure 2"]), (1, (100, 230, 300, 420), []), (0, (100, 430, 300, 440), ["Figure 3"])]
    pages = page(spark, up, both)
    assert {r.kind: r.direction for r in layout.page_votes(pages).collect()}["figure"] == "above"
    got = sorted((r.asset_index, r.page, r.label, r.y0) for r in layout.page_assets(pages).collect())
    assert got == [(1, 0, "Figure 1", 92.0), (2, 1, "Figure 2", 92.0), (3, 1, "Figure 3", 222.0)]
