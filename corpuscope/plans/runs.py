"""Queries over stored tables and arriving replies, each with SQL that states what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import formulas, payloads
from corpuscope.operators import migration, store, translation, venues, writes
from corpuscope.plans.catalogue import query
from corpuscope.plans.rules import new_root
from corpuscope.sources import catalogue as c


# ---------------------------------------------------------------- JSON
@query("""SELECT event_id, '{"a": [{"x": ' || user_id || ', "y": "' || event_type || '"}], "props": {"k": ' || json_extract_string(props, '$.k') || '}, "ratio": 0.50, "t": "é, \\"q\\": {}", "z": ' || event_id || '}' AS said FROM events""", False)
def canonical_props(spark: SparkSession, sf: str) -> DataFrame:
    """Objects within objects, their keys in no order, in the one form that all equal ones have."""
    e = c.table(spark, sf, "events")
    text = F.concat(F.lit('{"z":'), "event_id", F.lit(', "t" : "é, \\"q\\": {}","props":'), "props", F.lit(',\n"ratio":0.50,"a":[ {"y":"'), "event_type", F.lit('","x":'), "user_id", F.lit("}]}"))
    return e.select("event_id", payloads.canonical_json(text).alias("said"))


@query("""SELECT event_id, '{"user": ' || user_id || ', "at": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || '", "marks": [null, "' || event_type || '"], "more": {"none": null}}' AS said FROM events""", False)
def event_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with times as JSON texts, nulls included."""
    e = c.table(spark, sf, "events").withColumn("row", F.struct(F.col("user_id").alias("user"), F.col("ts").cast("timestamp_ntz").alias("at"), F.array(F.lit(None), "event_type").alias("marks"), F.struct(F.lit(None).cast("string").alias("none")).alias("more")))
    return e.select("event_id", payloads.json_dump(F.col("row"), e.schema["row"].dataType).alias("said"))


# ---------------------------------------------------------------- formulas
@query(r"""SELECT p_partkey, '\(x=' || p_size || '\) (' || p_type || ') \(a (b=1)\)' || chr(10) || '\[y_' || p_size || '\]' || chr(10) || '\[' || chr(10) || 'z' || chr(10) || '= ' || p_partkey || chr(10) || '\]' || chr(10) || '[' || chr(10) || 'not closed (c=1)' AS said FROM part""", False)
def formula_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with formulas in brackets of all kinds, marked."""
    text = F.concat(F.lit("(x="), "p_size", F.lit(") ("), "p_type", F.lit(") \\(a (b=1)\\)\n [y_"), "p_size", F.lit("] \n[\nz\n= "), "p_partkey", F.lit("\n]\n[\nnot closed (c=1)"))
    return c.table(spark, sf, "part").select("p_partkey", formulas.math_marks(text).alias("said"))


@query("SELECT p_partkey, p_name || ' @@MATH_0@@ ' || p_type || ' @@MATH_1@@' AS said, CAST(2 AS INTEGER) AS n, true AS whole FROM part", False)
def formulas_set_aside(spark: SparkSession, sf: str) -> DataFrame:
    """Marked formulas as tokens, and put back."""
    p = c.table(spark, sf, "part").withColumn("t", F.concat("p_name", F.lit(" \\[x="), "p_size", F.lit("\\] "), "p_type", F.lit(" \\(y\\)"))).withColumn("s", formulas.set_aside(F.col("t")))
    return p.select("p_partkey", F.col("s.text").alias("said"), F.size("s.formulas").alias("n"), (formulas.put_back(F.col("s.text"), F.col("s.formulas")) == F.col("t")).alias("whole"))


# ---------------------------------------------------------------- replies
@query("""WITH p AS (SELECT p_partkey AS k, 1 + p_size % 3 AS n, p_partkey % 5 AS m, p_partkey % 7 = 3 AND p_partkey % 5 >= 2 AS fails FROM part),
r AS (SELECT k, n, m, fails, unnest(range(1, m + 1)) AS s FROM p),
steps AS (SELECT k AS conversation_id, s AS seq, CASE WHEN (fails AND s > 2) OR s > n + 1 THEN 'no unit left' END AS error, CASE WHEN (fails AND s > 2) OR s > n + 1 THEN NULL WHEN fails AND s = 2 THEN 'UNSUPPORTED' WHEN s < n THEN 'IN_PROGRESS' WHEN s = n THEN 'BODY_DONE' ELSE 'ALL_DONE' END AS state FROM r),
late AS (SELECT k AS conversation_id, 100 AS seq, CASE WHEN m = 0 THEN NULL WHEN fails OR m > n THEN 'no unit left' WHEN m = n THEN 'no unit left in this scope' ELSE 'stale reply' END AS error, CASE WHEN m = 0 THEN CASE WHEN n = 1 THEN 'BODY_DONE' ELSE 'IN_PROGRESS' END END AS state FROM p WHERE k % 4 = 1)
SELECT conversation_id, CAST(seq AS BIGINT) AS seq, state, error FROM steps UNION ALL SELECT conversation_id, CAST(seq AS BIGINT), state, error FROM late""", False)
def continued_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as conversations with plans of their size, and replies that come in: some without a status, some for a unit that is done."""
    n = (1 + F.col("p_size") % 3).cast("int")
    p = c.table(spark, sf, "part").select(F.col("p_partkey").alias("conversation_id"), n.alias("n"), (F.col("p_partkey") % 5).cast("int").alias("m"))
    units = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("u"), i.cast("string")))
    plan = F.struct(F.lit("ok").alias("status"), units.alias("units"), F.array(F.lit("a1")).alias("appendix_units"))
    none = F.array().cast("array<string>")
    status = F.struct(F.lit("ok").alias("planner_status"), F.lit("IN_PROGRESS").alias("state"), none.alias("completed_unit_ids"), units.alias("remaining_unit_ids"))
    payload = F.to_json(F.struct(plan.alias("translation_plan"), status.alias("translation_status")))
    contexts = translation.latest_context(p.select("conversation_id", F.lit(1).alias("id"), F.lit("bot_reply").alias("message_kind"), payload.alias("payload")))
    said = F.lit('x [TRANSLATION_STATUS_JSON]{"state":"OK"}[/TRANSLATION_STATUS_JSON]')
    s = p.where("m > 0").select("conversation_id", "n", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("s"))
    lost = (F.col("conversation_id") % 7 == 3) & (F.col("s") == 2)
    unit = F.when(F.col("s") <= F.col("n"), F.concat(F.lit("u"), "s")).when(F.col("s") == F.col("n") + 1, "a1").otherwise("u1")
    go = F.lit("continue").alias("action")
    in_order = s.select("conversation_id", F.col("s").cast("long").alias("seq"), go, F.when(unit == "a1", "appendix").otherwise("body").alias("target_scope"), unit.alias("unit"), F.when(lost, "lost").otherwise(said).alias("reply"))
    late = p.where("conversation_id % 4 = 1").select("conversation_id", F.lit(100).cast("long").alias("seq"), go, F.lit("body").alias("target_scope"), F.lit("u1").alias("unit"), said.alias("reply"))
    return translation.continued(contexts, in_order.unionByName(late), "go on")[2].select("conversation_id", "seq", "state", "error")


# ---------------------------------------------------------------- migrations
KINDS = "SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'assistant' THEN 'bot_reply' WHEN turn % 7 = 0 THEN 'continue_command' ELSE 'user_message' END AS kind FROM conversations"


@query(f"SELECT id, kind AS message_kind, kind IN ('bot_reply', 'user_message') AS visible_to_user FROM ({KINDS}) x", False)
def migrated_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Stored messages without kinds, and what a run that stops after each commit and goes on makes of them."""
    root, t = new_root(spark), c.table(spark, sf, "conversations")
    m = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("role") == "assistant", " Bot ").otherwise(F.col("role")).alias("role"), F.when(F.col("turn") % 7 == 0, "继 续\n").otherwise(F.col("text")).alias("content"))
    store.commit(spark, root, lambda now, own: {"messages": store.append(m.repartitionByRange(4, "id"), root, "messages", now, own)})
    for most in (1, 1, None):
        migration.migrate(spark, root, "messages", "id", migration.message_kinds, "kinds", files=2, most=most)
    return store.read(spark, root, "messages").select("id", "message_kind", "visible_to_user")


@query("""SELECT conv_id * 1000 + turn AS id, CASE WHEN role <> 'assistant' THEN text WHEN turn % 3 = 1 THEN '如需继续' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS content, role <> 'assistant' OR turn % 3 <> 1 AS visible_to_user FROM conversations""".replace("\\\\", "\\"), False)
def filtered_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Stored replies with footers, some nothing else, after the run that trims and hides them."""
    root, t = new_root(spark), c.table(spark, sf, "conversations")
    bot = F.col("role") == "assistant"
    said = F.when(~bot, F.col("text")).when(F.col("turn") % 3 == 1, "如需继续").when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\n\n如需继续，请回复“继续”"))).otherwise(F.col("text"))
    m = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(bot, "bot_reply").otherwise("user_message").alias("message_kind"), said.alias("content"), F.lit(True).alias("visible_to_user"))
    store.commit(spark, root, lambda now, own: {"messages": store.append(m.repartitionByRange(4, "id"), root, "messages", now, own)})
    migration.migrate(spark, root, "messages", "id", migration.display_filter, "filter")
    return store.read(spark, root, "messages").select("id", "content", "visible_to_user")


@query(r"""SELECT conv_id * 1000 + turn AS id, CASE WHEN role <> 'assistant' THEN 'keep' WHEN turn % 3 = 1 THEN 'skip_parse_error' ELSE 'update' END AS action, CASE WHEN role <> 'assistant' THEN text WHEN turn % 3 = 1 THEN text || chr(10) || '[TRANSLATION_STATUS_JSON]{bad}[/TRANSLATION_STATUS_JSON]' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS content,
CASE WHEN role = 'assistant' AND turn % 3 <> 1 THEN '{"turn":' || turn || '}' ELSE '{"turn":' || turn || ',"parse_error":"x"}' END AS payload FROM conversations""", False)
def cleaned_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with status blocks, some of them no JSON, and outdated payload keys, as they would be stored today."""
    t = c.table(spark, sf, "conversations")
    bot, block = F.col("role") == "assistant", F.lit('\n[TRANSLATION_STATUS_JSON]{"state": "OK"}[/TRANSLATION_STATUS_JSON]')
    said = F.when(~bot, F.col("text")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit("\n[TRANSLATION_STATUS_JSON]{bad}[/TRANSLATION_STATUS_JSON]"))).otherwise(F.concat("text", block))
    payload = F.concat(F.lit('{"turn":'), "turn", F.lit(',"parse_error":"x"}'))
    m = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(bot, "bot_reply").otherwise("user_message").alias("message_kind"), said.alias("content"), payload.alias("payload"))
    return migration.payload_cleanup(m).select("id", "action", F.col("next_content").alias("content"), F.col("next_payload").alias("payload"))


# ---------------------------------------------------------------- metadata
@query("""WITH m AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant' AND turn % 5 <> 0 AND trim(text, ' \t\n\r') <> '')
SELECT d.doc_id AS conversation_id, CASE WHEN d.doc_id % 9 = 0 THEN CASE WHEN l.doc_id IS NULL THEN NULL ELSE 'old' END WHEN d.doc_id % 7 = 0 THEN 'not_found' ELSE 'matched' END AS status,
CASE WHEN m.conv_id IS NOT NULL THEN 'reply' WHEN d.doc_id % 9 <> 0 AND d.doc_id % 7 <> 0 AND trim(d.text, ' \t\n\r') <> '' THEN 'metadata' ELSE 'none' END AS origin, CASE WHEN d.doc_id % 9 = 0 THEN 'a reply that is no JSON' END AS error
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN m ON m.conv_id = d.doc_id""", False)
def refreshed_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Papers that are looked up anew; some replies can't be used, and leave what there was and a row that says why."""
    d = c.table(spark, sf, "documents")
    papers = d.select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), F.col("source").alias("original_filename"))
    old = c.table(spark, sf, "labels").select(F.col("doc_id").alias("conversation_id"), F.lit("old").alias("status"), F.lit(None).cast("string").alias("abstract"))
    found = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("abstract"))).alias("data")))
    replies = d.select(F.col("doc_id").alias("conversation_id"), F.when(F.col("doc_id") % 9 == 0, "down").when(F.col("doc_id") % 7 == 0, '{"data": []}').otherwise(found).alias("response"))
    empty = lambda schema: spark.createDataFrame([], schema)
    tags = empty("conversation_id long, tag_code string, source string")
    definitions = empty("tag_code string, category_code string, category_label string, tag_label string, tag_path string")
    publications = empty("item string, position int, abbr string, full_name string, category string, type string")
    new, asked, _, errors = venues.refresh_metadata(papers, c.messages(spark, sf), old, tags, replies, publications, empty("conversation_id long, reply string"), definitions)
    out = asked.join(new.select("conversation_id", "status"), "conversation_id", "left").join(errors.select("conversation_id", "error"), "conversation_id", "left")
    return out.select("conversation_id", "status", "origin", "error")


@query("SELECT " + ", ".join({"conversation_id": "CAST(l.doc_id AS VARCHAR) AS conversation_id", "conversation_title": "coalesce(d.text, '') AS conversation_title", "status": "CASE WHEN quality = 1 THEN 'matched' ELSE '' END AS status", "match_score": "CASE WHEN quality = 1 THEN '0.5' ELSE '1.5' END AS match_score", "is_open_access": "CASE WHEN toxic = 1 THEN 'True' ELSE 'False' END AS is_open_access", "year": "CAST(2000 + l.doc_id % 20 AS VARCHAR) AS year", "created_at": "strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (l.doc_id % 86400), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at"}.get(x, f"'' AS {x}") for x in writes.EXPORT) + " FROM labels l LEFT JOIN documents d USING (doc_id)", False)
def metadata_export(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as metadata rows, as texts under all columns of the export."""
    m = c.table(spark, sf, "labels").select(
        F.col("doc_id").alias("conversation_id"), F.when(F.col("quality") == 1, "matched").alias("status"), F.when(F.col("quality") == 1, 0.5).otherwise(1.5).alias("match_score"), (F.col("toxic") == 1).alias("is_open_access"),
        (2000 + F.col("doc_id") % 20).alias("year"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 86400).alias("created_at"),
    )
    return writes.export_rows(m, c.papers(spark, sf))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderkey % 4 AS kind FROM orders), n AS (SELECT l_orderkey AS k, l_linenumber AS label FROM lineitem WHERE l_linenumber % 2 = 0), hit AS (SELECT DISTINCT r.k FROM r JOIN n USING (k) WHERE kind IN (0, 1))
SELECT l_orderkey AS conversation_id, CAST(l_linenumber AS BIGINT) AS label FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM hit) UNION ALL SELECT k, CAST(label + 100 AS BIGINT) FROM n WHERE k IN (SELECT k FROM hit)""", False)
def reprocessed_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that ask for their lines anew, in one direction, by the older or the present way or wrongly."""
    o, line = c.table(spark, sf, "orders"), c.table(spark, sf, "lineitem")
    kind = F.col("o_orderkey") % 4
    requests = o.select(F.col("o_orderkey").alias("conversation_id"), F.when(kind == 0, "figure").when(kind == 3, "image").alias("asset_type"), F.when(kind == 0, "above").when(kind == 3, "below").alias("caption_direction"), F.when(kind == 1, "above").when(kind == 2, "left").alias("figure_caption_direction"))
    old = line.select(F.col("l_orderkey").alias("conversation_id"), F.col("l_linenumber").cast("long").alias("label"))
    found = line.select(F.col("l_orderkey").alias("conversation_id"), F.when(F.col("l_linenumber") % 2 == 0, "above").otherwise("below").alias("direction"), (F.col("l_linenumber") + 100).cast("long").alias("label"))
    return writes.reprocessed(old, found, writes.reprocess_requests(requests), "figure")
