"""Queries that apply the catalogue's rules to columns of the given tables, each with SQL that states the rule."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.functions import legacy, markup, payloads, progress, text
from corpuscope.operators import filters, layout, search, store, translation, venues, writes
from corpuscope.plans.catalogue import FOLD, job_events, job_events_of, query
from corpuscope.sources import catalogue as c
from corpuscope.streaming import claims, jobs, stored


def _list(values: str, order: str, alias: str):
    """Values of a group in the order of another column, each once; groups are the lines of one order."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.expr(order).alias("o"), F.expr(values).alias("v")))), lambda x: x["v"])).alias(alias)


# ---------------------------------------------------------------- units
TITLE = """CASE p_size % 6 WHEN 0 THEN 'Appendix ' || chr(65 + CAST(p_partkey % 5 AS INT)) || '.' || (p_partkey % 7) || ' ' || p_name WHEN 1 THEN chr(97 + CAST(p_partkey % 9 AS INT)) || '.' || (p_partkey % 4) || ' ' || p_name
WHEN 2 THEN chr(65 + CAST(p_partkey % 9 AS INT)) || '. ' || p_name WHEN 3 THEN (p_partkey % 12) || '.' || (p_partkey % 5) || ' ' || p_type WHEN 4 THEN p_name || ' :: 3.1 ' || p_type ELSE substring('XVI', 1 + CAST(p_partkey % 3 AS INT), 2) || '. ' || p_name END"""


@query(f"""SELECT p_partkey, CASE WHEN contains(t, '::') THEN '' ELSE lower(coalesce(nullif(regexp_extract(t, '(?i)^(appendix\\s+[a-z0-9]+(?:\\.\\d+)*)\\b', 1), ''), nullif(regexp_extract(t, '(?i)^([a-z](?:\\.\\d+)+)\\b', 1), ''), nullif(regexp_extract(t, '(?i)^([a-z])\\.\\s+', 1), ''),
nullif(regexp_extract(t, '^(\\d+(?:\\.\\d+)*)\\b', 1), ''), nullif(regexp_extract(t, '(?i)^([ivxlcdm]+)\\.\\s+', 1), ''), '')) END AS prefix FROM (SELECT p_partkey, {TITLE} AS t FROM part)""", False)  # fmt: skip
def unit_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return c.table(spark, sf, "part").select("p_partkey", text.hierarchy_prefix(F.expr(TITLE)).alias("prefix"))


UNIT = "CASE WHEN l_suppkey % 3 = 0 THEN (l_linenumber % 3 + 1) || ' top' ELSE (l_linenumber % 3 + 1) || '.' || (l_partkey % 4) || ' sub' END"


@query(f"""SELECT k, string_agg(u, ',' ORDER BY o, u) AS units FROM (SELECT l_orderkey AS k, {UNIT} AS u, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2) a
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT l_orderkey AS k, {UNIT} AS u FROM lineitem) b WHERE b.k = a.k AND b.u <> a.u AND starts_with(split_part(a.u, ' ', 1), split_part(b.u, ' ', 1) || '.')) GROUP BY 1""", False)  # fmt: skip
def unit_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of an order as units, less those under another one."""
    units = c.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(_list(UNIT, f"struct(l_linenumber, {UNIT})", "units"))
    return units.select("k", F.array_join(text.top_units(F.col("units")), ",").alias("units"))


LINES = "(SELECT l_orderkey AS k, 'u' || l_linenumber AS u, min(l_linenumber) AS n, bool_or(l_returnflag = 'R') AS appendix, bool_or(l_linestatus = 'F') AS done FROM lineitem GROUP BY 1, 2)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    one = c.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.concat(F.lit("u"), "l_linenumber").alias("u")).agg(F.min("l_linenumber").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("appendix"), F.bool_or(F.col("l_linestatus") == "F").alias("done"))
    some = lambda when, name: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("n", "u")))), lambda x: x["u"]).alias(name)
    return one.groupBy("k").agg(some(~F.col("appendix"), "body"), some(F.col("appendix"), "rest"), some(F.col("done"), "done"))


@query(f"""SELECT k, CASE WHEN b > 0 THEN 'IN_PROGRESS' WHEN a > 0 THEN 'BODY_DONE' ELSE 'ALL_DONE' END AS state, CASE WHEN b > 0 THEN 'body' WHEN a > 0 THEN 'appendix' ELSE 'done' END AS scope, coalesce(nb, na, '') AS next_unit,
CAST(d AS INTEGER) AS completed, CAST(t AS INTEGER) AS total, coalesce(CASE WHEN b > 0 THEN lb ELSE la END, '') AS remaining FROM (SELECT k, count(*) FILTER (WHERE NOT appendix AND NOT done) AS b, count(*) FILTER (WHERE appendix AND NOT done) AS a,
arg_min(u, n) FILTER (WHERE NOT appendix AND NOT done) AS nb, arg_min(u, n) FILTER (WHERE appendix AND NOT done) AS na, count(*) FILTER (WHERE done) AS d, count(*) AS t,
string_agg(u, ',' ORDER BY n) FILTER (WHERE NOT appendix AND NOT done) AS lb, string_agg(u, ',' ORDER BY n) FILTER (WHERE appendix AND NOT done) AS la FROM {LINES} x GROUP BY 1)""", False)  # fmt: skip
def run_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as runs: returned lines are the appendix, finished lines are done."""
    none = F.lit(None).cast("string")
    s = progress.status(F.lit("ok"), F.col("body"), F.col("rest"), F.col("done"), F.lit(""), F.lit("body"), none, none)
    return _runs(spark, sf).withColumn("s", s).select("k", "s.state", F.col("s.active_scope").alias("scope"), F.col("s.next_unit_id").alias("next_unit"), F.col("s.completed_unit_count").alias("completed"), F.col("s.total_unit_count").alias("total"), F.array_join("s.remaining_unit_ids", ",").alias("remaining"))


# ---------------------------------------------------------------- replies
@query("""SELECT k, CASE WHEN n = 0 THEN 'unsupported' ELSE 'ok' END AS status, coalesce(units, '') AS units, CASE WHEN n = 0 THEN 'no_supported_units' ELSE '' END AS reason, CAST(coalesce(a, 0) AS INTEGER) AS n_appendix
FROM (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) FILTER (WHERE l_returnflag <> 'R') AS n, (SELECT string_agg('part ' || m, ',' ORDER BY m) FROM (SELECT DISTINCT l_linenumber AS m FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_returnflag <> 'R')) AS units,
(SELECT count(DISTINCT y.l_linenumber) FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_returnflag = 'R' AND y.l_linenumber NOT IN (SELECT z.l_linenumber FROM lineitem z WHERE z.l_orderkey = x.l_orderkey AND z.l_returnflag <> 'R')) AS a FROM lineitem x GROUP BY 1)""", False)  # fmt: skip
def plan_replies(spark: SparkSession, sf: str) -> DataFrame:
    """A planning reply in JSON for each order, between fences for some, read back as a plan."""
    names = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.col("l_linenumber")))), lambda x: F.concat(F.lit(" part "), x))
    one = c.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(names(F.col("l_returnflag") != "R").alias("units"), names(F.col("l_returnflag") == "R").alias("appendix_units"))
    said = F.to_json(F.struct(F.struct(F.lit("OK ").alias("status"), "units", "appendix_units").alias("translation_plan")))
    said = F.when(F.col("k") % 2 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(said)
    return one.withColumn("p", payloads.plan_of_reply(said)).select("k", "p.status", F.array_join("p.units", ",").alias("units"), "p.reason", F.size("p.appendix_units").alias("n_appendix"))


@query(r"""SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') || CASE WHEN turn % 4 = 1 THEN chr(10) || '[TRANSLATION_STATUS_JSON] nothing [/TRANSLATION_STATUS_JSON]' ELSE '' END AS content, CASE WHEN turn % 3 = 0 THEN 'IN_PROGRESS' END AS state,
CAST(CASE WHEN turn % 3 = 0 THEN greatest(turn - 3, 0) END AS INTEGER) AS completed, CASE WHEN turn % 4 = 0 THEN 'OK' END AS raw_state, '{"k":' || conv_id || '}' AS rest FROM conversations""", False)
def stored_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with a status block, good or bad, and a payload with known, outdated and other keys, as they are stored."""
    t = c.table(spark, sf, "conversations")
    block = F.when(F.col("turn") % 4 == 0, F.concat(F.lit('\n[TRANSLATION_STATUS_JSON]{"state": "ok", "current_unit_id": "u'), F.col("turn").cast("string"), F.lit('"}[/TRANSLATION_STATUS_JSON]'))).when(F.col("turn") % 4 == 1, "\n[TRANSLATION_STATUS_JSON] nothing [/TRANSLATION_STATUS_JSON]").otherwise("")
    status = F.struct(F.lit("ok").alias("planner_status"), F.when(F.col("turn") % 3 == 0, "in_progress").otherwise("lost").alias("state"), (F.col("turn") - 3).alias("completed_unit_count"))
    payload = F.to_json(F.struct(F.col("conv_id").alias("k"), F.lit("x").alias("parse_error"), status.alias("translation_status")))
    s = t.select("conv_id", "turn", payloads.stored_reply(F.concat("text", block), payload).alias("s"))
    return s.select("conv_id", "turn", "s.content", F.col("s.translation_status.state").alias("state"), F.col("s.translation_status.completed_unit_count").alias("completed"), F.col("s.raw.state").alias("raw_state"), F.to_json("s.others").alias("rest"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 5 = 1 THEN '' ELSE t END AS display, CASE WHEN turn % 5 = 1 THEN 'hide' WHEN turn % 5 = 4 AND t = text THEN 'keep' ELSE 'trim' END AS action, CASE turn % 5 WHEN 0 THEN 'trimmed_legacy_footer' WHEN 1 THEN 'hidden_optional_section_only:references'
WHEN 2 THEN 'trimmed_optional_section_tail:appendix' WHEN 3 THEN 'trimmed_trailing_service_block' ELSE '' END AS reasons FROM (SELECT conv_id, turn, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)""", False)
def shown_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with the footers and sections of old replies, as they are shown."""
    t = c.table(spark, sf, "conversations")
    tail = {0: "\n\n---\n如需继续，请回复“继续”", 2: "\n\n## 附录 A\nmore", 3: "\n\n✅ **全文翻译完成**\n- 生成 摘要\n## 下一步"}
    said = F.when(F.col("turn") % 5 == 1, F.concat(F.lit("# 参考文献\n"), "text"))
    for k, v in tail.items():
        said = said.when(F.col("turn") % 5 == k, F.concat("text", F.lit(v)))
    t = t.withColumn("said", said.otherwise(F.col("text"))).withColumn("d", legacy.displayed(F.col("said")))
    return t.select("conv_id", "turn", "d.display", legacy.display_action(F.lit("bot_reply"), F.col("said"), F.col("d.display")).alias("action"), F.array_join("d.reasons", ",").alias("reasons"))


PRIORITY = {"1-URGENT": "附录|致谢", "2-HIGH": "body_only", "3-MEDIUM": "References; supplementary", "4-NOT SPECIFIED": "", "5-LOW": "appendix，bibliography、acknowledgment"}


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'appendix,acknowledgements' WHEN '3-MEDIUM' THEN 'appendix,references' WHEN '5-LOW' THEN 'appendix,acknowledgements,references' ELSE '' END AS extensions, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'ok' ELSE 'invalid_state' END AS reason,
CASE o_orderstatus WHEN 'F' THEN 'stop' WHEN 'O' THEN 'continue' END AS action, CASE o_orderstatus WHEN 'F' THEN 'none' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'appendix' ELSE 'body' END END AS target FROM orders""", False)
def old_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Status blocks of orders in the old form, brought to version 2."""
    state = F.when(F.col("o_orderstatus") == "F", "all_done").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("lost")
    phase = F.when(F.col("o_orderkey") % 2 == 0, "附录").otherwise("none")
    more = F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("o_orderpriority"))
    block = F.concat(F.lit("text\n[TRANSLATION_STATUS]\nstate = "), state, F.lit("\nphase="), phase, F.lit("\navailable_scope_extensions="), more, F.lit("\nother=1\n[/TRANSLATION_STATUS]"))
    v = legacy.status_v2(legacy.old_status(block, F.lit(None).cast("string"))["status"])
    o = c.table(spark, sf, "orders").select("o_orderkey", v.alias("v"), F.array_join(legacy.scope_list(more), ",").alias("extensions"))
    return o.select("o_orderkey", "extensions", "v.reason", F.col("v.status.next_action.type").alias("action"), F.col("v.status.next_action.target_scope").alias("target"))


# ---------------------------------------------------------------- texts and boxes
@query(r"""SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0 ELSE length(regexp_replace(text, '\P{Nd}', '', 'g')) / length(text) END, 9) AS digits, length(text) >= 120 AND length(regexp_replace(text, '\P{L}', '', 'g')) > 40 AND length(regexp_replace(text, '[^,.;:()\[\]]', '', 'g')) >= 2
AND len(string_split(text, chr(10))) >= 3 AS is_paragraph FROM documents""", False)  # fmt: skip
def text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(F.split("text", "\n"))
    return c.table(spark, sf, "documents").select("doc_id", F.round(text.digit_ratio(F.col("text")), 9).alias("digits"), text.is_paragraph(F.col("text"), n).alias("is_paragraph"))


CAPTION = "CASE p_partkey % 5 WHEN 0 THEN 'Figure ' || p_size || ': ' || p_name WHEN 1 THEN 'see fig. ' || p_size || 'a ' || p_name WHEN 2 THEN p_name || '. figure ' || p_size WHEN 3 THEN 'Table ' || p_size || ' ' || p_type ELSE p_brand || ' table IV, ' || p_name END"


@query(rf"""SELECT p_partkey, CASE WHEN s <> '' THEN s WHEN i <> '' AND length(head) <= 48 AND length(trim(head)) <= 24 AND NOT regexp_matches(head, '[.:;!?]') THEN i END AS label, regexp_matches(t, '(?i)^\s*table\.?\s*(?:\d+|[ivxlcdm]+)[a-z]?\b\s*($|[.:;,\-(]|(?-i:[A-Z0-9]))') AS styled
FROM (SELECT p_partkey, t, trim(regexp_extract(t, '(?i)^\s*(fig(?:ure)?\.?\s*(?:\d+|[ivxlcdm]+)[a-z]?)\b', 1)) AS s, regexp_extract(t, '(?is)^(.*?)(fig(?:ure)?\.?\s*(?:\d+|[ivxlcdm]+)[a-z]?)\s*[:.]?', 1) AS head, trim(regexp_extract(t, '(?is)^(.*?)(fig(?:ure)?\.?\s*(?:\d+|[ivxlcdm]+)[a-z]?)\s*[:.]?', 2)) AS i
FROM (SELECT p_partkey, {CAPTION} AS t FROM part))""", False)  # fmt: skip
def caption_labels(spark: SparkSession, sf: str) -> DataFrame:
    t = F.expr(CAPTION)
    return c.table(spark, sf, "part").select("p_partkey", text.caption_label(t).alias("label"), text.has_caption_suffix(t).alias("styled"))


BOXES = "SELECT l_orderkey AS doc_id, 1 AS page, l_suppkey % 97 * 4.0 AS x0, l_partkey % 83 * 9.0 AS y0, l_suppkey % 97 * 4.0 + 40 + l_quantity * 6 AS x1, l_partkey % 83 * 9.0 + 16 + l_quantity * 3 AS y1, l_linenumber AS n, l_returnflag AS flag FROM lineitem"
MATCHES = """WITH b AS ({boxes}), cap AS (SELECT doc_id, min(n) AS caption_id, arg_min(x0, n) AS cx0, arg_min(y0, n) AS cy0, arg_min(x1, n) AS cx1, arg_min(y0, n) + 12 AS cy1 FROM (SELECT doc_id, n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1 FROM b WHERE flag = 'N' GROUP BY 1, 2) GROUP BY 1),
reg AS (SELECT doc_id, n AS region_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b WHERE flag <> 'N' GROUP BY 1, 2),
cand AS (SELECT *, CASE d WHEN 'above' THEN cy0 - y1 ELSE y0 - cy1 END AS dist, 2.0 + CASE WHEN x1 - x0 >= 140 THEN 0.5 ELSE 0 END + CASE WHEN y1 - y0 >= 60 THEN 0.5 ELSE 0 END + least((x1 - x0) * (y1 - y0) / 12000.0, 6.0) AS score FROM cap JOIN reg USING (doc_id) CROSS JOIN (VALUES ('above'), ('below')) v(d)),
ok AS (SELECT *, score - 0.02 * dist AS v FROM cand WHERE dist BETWEEN -6 AND 260 AND (greatest(0, least(cx1, x1) - greatest(cx0, x0)) >= 0.25 * least(cx1 - cx0, x1 - x0) OR (cx0 + cx1) / 2 BETWEEN x0 - 30 AND x1 + 30)),
best AS (SELECT doc_id, d, region_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, d ORDER BY v DESC, region_id) AS r FROM ok) WHERE r = 1)
SELECT coalesce(a.doc_id, w.doc_id) AS doc_id, CASE WHEN w.doc_id IS NULL OR a.score >= w.score - 0.5 THEN a.region_id ELSE w.region_id END AS region_id, CASE WHEN w.doc_id IS NULL OR a.score >= w.score - 0.5 THEN 'above' ELSE 'below' END AS direction
FROM (SELECT * FROM best WHERE d = 'above') a FULL JOIN (SELECT * FROM best WHERE d = 'below') w ON a.doc_id = w.doc_id"""


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    x0, y0 = F.col("l_suppkey") % 97 * 4.0, F.col("l_partkey") % 83 * 9.0
    return c.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 40 + F.col("l_quantity") * 6).alias("x1"), (y0 + 16 + F.col("l_quantity") * 3).alias("y1"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"))


@query(MATCHES.format(boxes=BOXES), False)
def caption_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as boxes of one page: the first of a kind is a caption, the others are regions."""
    b = _boxes(spark, sf)
    one = lambda rows: rows.groupBy("doc_id", "page", "n").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    first = one(b.where("flag = 'N'")).groupBy("doc_id", "page").agg(F.min("n").alias("caption_id"), *(F.min_by(x, "n").alias(x) for x in ("x0", "y0", "x1"))).withColumn("y1", F.col("y0") + 12)
    regions = one(b.where("flag <> 'N'")).withColumnRenamed("n", "region_id").withColumn("kind", F.lit("image"))
    return layout.matches(first, regions).select("doc_id", "region_id", "direction")


@query(f"WITH b AS (SELECT DISTINCT doc_id, n, x0, y0, x1, y1 FROM ({BOXES})) SELECT a.doc_id, count(*) AS pairs, count(*) FILTER (WHERE abs(a.x0 - o.x0) <= 60 AND abs(a.y0 - o.y0) <= 60 AND abs(a.x1 - o.x1) <= 60 AND abs(a.y1 - o.y1) <= 60) AS same, count(*) FILTER (WHERE (least(a.x1, o.x1) > greatest(a.x0, o.x0) AND greatest(0, o.y0 - a.y1, a.y0 - o.y1) <= 40) OR (least(a.y1, o.y1) > greatest(a.y0, o.y0) AND greatest(0, o.x0 - a.x1, a.x0 - o.x1) <= 40)) AS beside FROM b a JOIN b o ON a.doc_id = o.doc_id AND a.n < o.n GROUP BY 1", False)
def box_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of boxes of one order that are nearly the same, or beside each other."""
    b = _boxes(spark, sf).select("doc_id", "n", "x0", "y0", "x1", "y1").distinct()
    side = lambda s: {x: F.col(f"{s}.{x}") for x in ("x0", "y0", "x1", "y1")}
    pairs = b.alias("a").join(b.alias("o"), (F.col("a.doc_id") == F.col("o.doc_id")) & (F.col("a.n") < F.col("o.n")))
    return pairs.groupBy("a.doc_id").agg(F.count("*").alias("pairs"), F.count_if(text.near_same(side("a"), side("o"), 60.0)).alias("same"), F.count_if(text.adjacent(side("a"), side("o"))).alias("beside"))


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as blocks of pages."""
    b = _boxes(spark, sf).withColumn("type", F.when(F.col("flag") == "A", 1).otherwise(0))
    said = F.when(F.col("flag") == "N", F.concat(F.lit("Figure "), F.col("n"), F.lit(". order"))).otherwise(F.concat(F.lit("Table "), F.col("n"), F.lit(": 1 2 3")))
    line = F.array(F.struct(said.alias("text"), "x0", "y0", "x1", "y1"))
    block = F.struct("type", "x0", "y0", "x1", "y1", F.when(F.col("type") == 0, line).alias("lines"))
    pages = b.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    drawings = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return pages.select("doc_id", "page", F.lit(900.0).alias("page_w"), F.lit(1000.0).alias("page_h"), "blocks", drawings.alias("drawings"))


@query(None)
def figures_and_tables(spark: SparkSession, sf: str) -> DataFrame:
    """What is found on the pages. No SQL: groups of regions grow step by step; tests hold the pages against plain Python."""
    return layout.page_assets(page_rows(spark, sf))


# ---------------------------------------------------------------- listings
@query("SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1", False)
def rows_by_key(spark: SparkSession, sf: str) -> DataFrame:
    e = c.table(spark, sf, "events")
    first, last = (filters.first_rows(e, "user_id", "event_id", last=x).select("user_id", F.col("event_type").alias(n)) for x, n in ((False, "first_type"), (True, "last_type")))
    return first.join(last, "user_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7 ORDER BY o_orderkey DESC LIMIT 20 OFFSET 1", False)
def record_slice(spark: SparkSession, sf: str) -> DataFrame:
    return filters.select_slice(c.table(spark, sf, "orders"), "o_orderkey", True, 20, 1, o_orderstatus="F", o_custkey=7, o_orderpriority="").select("o_orderkey", "o_totalprice")


@query("""SELECT value, value AS label, full_label, n, CAST(row_number() OVER (ORDER BY lower(value), f) AS INTEGER) AS place FROM (SELECT coalesce(nullif(venue_abbr, ''), nullif(venue, '')) AS value, arg_min(coalesce(nullif(venue, ''), venue_abbr), conversation_id) AS full_label, count(*) AS n, min(conversation_id) AS f FROM ven GROUP BY 1 HAVING value IS NOT NULL)""")
def facet_venue_ordered(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.venue_facet(c.venues(spark, sf), ordered=True)
    one = rows.groupBy().agg(F.collect_list(F.struct("value", "label", "full_label", "n")).alias("all"))  # one row for each venue
    return one.select(F.posexplode("all").alias("p", "r")).select("r.*", (F.col("p") + 1).cast("int").alias("place"))


TREE = [("A", "接受", "accepted", [("A", "甲", "first"), ("N", "乙", "second")]), ("Z", "其他", "other", [("X", "丙", "third")])]


def _tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TREE, "code string, label string, label_en string, tags array<struct<code:string,label:string,label_en:string>>")


TAG_ROWS = "(SELECT DISTINCT l_orderkey AS conversation_id, l_returnflag AS tag_code FROM lineitem)"


@query(f"SELECT conversation_id, tag_code, CASE tag_code WHEN 'A' THEN '接受/甲' WHEN 'N' THEN '接受/乙' ELSE 'old/' || tag_code END AS tag_path, CASE tag_code WHEN 'A' THEN 'accepted/first' WHEN 'N' THEN 'accepted/second' ELSE '' END AS tag_path_en FROM {TAG_ROWS} t", False)
def tags_labelled(spark: SparkSession, sf: str) -> DataFrame:
    t = c.tags(spark, sf).distinct().withColumns({"category_label": F.lit("old"), "tag_label": F.col("tag_code"), "tag_path": F.concat(F.lit("old/"), "tag_code")})
    return search.labelled_tags(t, search.tag_definitions(_tree(spark))).select("conversation_id", "tag_code", "tag_path", "tag_path_en")


@query(f"SELECT code, string_agg(tag || '=' || n, ',' ORDER BY p) AS tags FROM (VALUES ('A', 'A', 0), ('A', 'N', 1), ('Z', 'X', 0)) v(code, tag, p) JOIN LATERAL (SELECT count(*) AS n FROM {TAG_ROWS} t WHERE t.tag_code = v.tag) ON true GROUP BY 1", False)
def tag_library_tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.tag_tree(_tree(spark), c.tags(spark, sf))
    return rows.select("code", F.array_join(F.transform("tags", lambda t: F.concat(t["code"], F.lit("="), t["usage_count"])), ",").alias("tags"))


@query("""SELECT id, summary, pdf_url, n_tags, ccf_category FROM (SELECT p.id, coalesce(CASE WHEN trim(s.content) = '' THEN NULL WHEN length(s.content) > 200 THEN substring(s.content, 1, 200) || '...' ELSE s.content END, '已生成全文规划，等待确认关键术语与译法。') AS summary, 'u' || p.id AS pdf_url,
(SELECT count(*) FROM (SELECT DISTINCT tag_code FROM tags t WHERE t.conversation_id = p.id)) AS n_tags, coalesce(m.ccf_category, 'None') AS ccf_category FROM (SELECT * FROM papers ORDER BY created_at DESC, id LIMIT 26) p
LEFT JOIN (SELECT conversation_id, content FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY trim(content) = '' OR id % 3 <> 0, trim(content) = '', id) AS r FROM msg WHERE message_kind = 'bot_reply' AND id <> 1) WHERE r = 1) s ON s.conversation_id = p.id LEFT JOIN meta m ON m.conversation_id = p.id)""")
def listed_papers(spark: SparkSession, sf: str) -> DataFrame:
    """A page of papers as shown. Replies with ids that three divides have done units; the second of a conversation is hidden."""
    m = c.messages(spark, sf)
    status = F.to_json(F.struct(F.struct(F.lit("ok").alias("planner_status"), F.lit("IN_PROGRESS").alias("state"), F.when(F.col("id") % 3 == 0, 2).otherwise(0).alias("completed_unit_count")).alias("translation_status")))
    m = m.withColumn("visible_to_user", F.col("id") != 1).withColumn("payload", status)
    p = c.papers(spark, sf)
    files = p.select(F.col("id").alias("conversation_id"), "id", F.concat(F.lit("u"), "id").alias("poe_url"))
    t = c.tags(spark, sf).distinct().withColumns({"category_code": F.lit("A"), "category_label": F.lit("old"), "tag_label": F.col("tag_code"), "tag_path": F.lit("p")})
    meta = c.metadata(spark, sf).withColumns({"id": F.col("conversation_id"), "venue_abbr": F.lit(None).cast("string"), "ccf_type": F.lit("")})
    rows = search.list_items(search.page(p, 25), m, files, t, meta, search.tag_definitions(_tree(spark)))
    return rows.select("id", "summary", "pdf_url", F.size("tags").cast("long").alias("n_tags"), F.coalesce("ccf_category", F.lit("None")).alias("ccf_category"))


@query("""SELECT id, relevance, tier FROM (SELECT id, CAST(CASE WHEN lower(title) = 'the' THEN 100 WHEN contains(lower(title), 'the') THEN 50 ELSE 0 END AS INTEGER) AS relevance, 'exact' AS tier FROM (SELECT * FROM papers WHERE id % 2 = 0 AND title ILIKE '%the%' ORDER BY created_at DESC, id LIMIT 5))
UNION ALL SELECT * FROM (SELECT id, CAST(3 AS INTEGER) AS relevance, 'fuzzy' AS tier FROM papers WHERE false)""")
def search_both_tiers(spark: SparkSession, sf: str) -> DataFrame:
    p = c.papers(spark, sf)
    rows, _ = search.search_page(p, p.where("id % 2 = 0"), " the ", "all", filtered=True)
    return rows.select("id", "relevance", "tier")


# ---------------------------------------------------------------- writes
def new_root(spark: SparkSession) -> str:
    return f"{store.scratch_dir(spark)}/store-{uuid.uuid4().hex}"


@query("SELECT conversation_id, CASE WHEN conversation_id % 7 = 0 THEN 'C' ELSE ccf_category END AS ccf_category FROM meta")
def stored_update(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table of several files, of which an update by key writes those anew that it touches."""
    root, m = new_root(spark), c.metadata(spark, sf)
    store.commit(spark, root, lambda now, own: {"meta": store.append(m.repartitionByRange(8, "conversation_id"), root, "meta", now, own)})
    changes = writes.changed(m, m.withColumn("ccf_category", F.when(F.col("conversation_id") % 7 == 0, "C").otherwise(F.col("ccf_category"))), "conversation_id")
    store.commit(spark, root, lambda now, own: {"meta": store.update(changes, root, "meta", "conversation_id", now, own)})
    return store.read(spark, root, "meta")


@query("""SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_orderkey % 3 = 1 THEN l_returnflag END AS flag, CASE WHEN l_orderkey % 3 = 2 THEN CAST(l_suppkey AS VARCHAR) END AS note FROM lineitem""", False)
def stored_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """A table of three schemas, read as one: a column comes, another goes, and no file is written anew."""
    root, line = new_root(spark), c.table(spark, sf, "lineitem")
    part = lambda i, *more: line.where(F.col("l_orderkey") % 3 == i).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), *more)
    put = lambda rows: store.commit(spark, root, lambda now, own: {"t": store.append(rows, root, "t", now, own)})
    alter = lambda **x: store.commit(spark, root, lambda now, own: {"t": store.alter(spark, root, "t", now, own, **x)})
    put(part(0, F.lit("x").alias("old")))
    alter(add={"flag": "string"})
    put(part(1, F.col("l_returnflag").alias("flag")))
    alter(add={"note": "string"}, drop=("old",))
    put(part(2, F.col("l_suppkey").cast("string").alias("note")))
    return store.read(spark, root, "t", columns=("k", "line", "flag", "note"))


@query("""WITH RECURSIVE f AS (SELECT o_orderkey // 32 AS g, 'p' || (o_orderkey // 32) || '-' || (o_custkey % 4) AS id, 'f' || (o_orderkey // 32) || '-' || (o_orderkey % 5) AS fp, o_orderkey AS k FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id, fp, k) AS i FROM f),
s AS (SELECT g, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS fps, '' AS said, false AS known, '' AS error FROM o WHERE i = 1
UNION ALL SELECT o.g, o.i, CASE WHEN list_contains(s.fps, o.fp) OR list_contains(s.ids, o.id) THEN s.ids ELSE list_append(s.ids, o.id) END, CASE WHEN list_contains(s.fps, o.fp) OR list_contains(s.ids, o.id) THEN s.fps ELSE list_append(s.fps, o.fp) END,
CASE WHEN list_contains(s.fps, o.fp) THEN s.ids[list_position(s.fps, o.fp)] ELSE o.id END, list_contains(s.fps, o.fp), CASE WHEN NOT list_contains(s.fps, o.fp) AND list_contains(s.ids, o.id) THEN 'conversation_id already exists: ' || o.id END FROM s JOIN o ON o.g = s.g AND o.i = s.i + 1)
SELECT said AS conversation_id, known AS "exists", error, CAST(count(*) AS BIGINT) AS n FROM s WHERE i > 0 GROUP BY ALL""", False)
def bundle_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as bundles that share ids and fingerprints with others of the same call, put into stored tables."""
    o = c.table(spark, sf, "orders").withColumn("g", F.expr("o_orderkey div 32").cast("string"))
    record = F.struct(F.lit("a.pdf").alias("filename"), F.concat(F.lit("f"), "g", F.lit("-"), F.col("o_orderkey") % 5).alias("fingerprint"), F.lit("u").alias("poe_url"), F.lit("").alias("content_type"), F.lit(None).cast("string").alias("poe_name"))
    none = lambda t: F.array().cast(f"array<struct<{t}>>")
    b = o.select(F.concat(F.lit("p"), "g", F.lit("-"), F.col("o_custkey") % 4).alias("conversation_id"), F.lit("").alias("title"), record.alias("file_record"), none("role:string,content:string").alias("messages"), none("figure_index:int").alias("figures"), none("table_index:int").alias("tables"), none("tag_code:string,category_code:string,category_label:string,tag_label:string,tag_path:string,source:string").alias("tags"), F.lit(None).cast("struct<paper_id:string>").alias("meta"))
    return writes.commit_bundles(spark, b, new_root(spark)).groupBy("conversation_id", "exists", "error").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'f' || (o_custkey % 50) || o_orderstatus END AS fp, o_orderkey % 10 = 0 AS taken FROM orders), known AS (SELECT 'f' || v AS fp, 'old' || v AS id FROM (VALUES ('7F'), ('13O')) t(v)),
first AS (SELECT fp, min(CAST(k AS VARCHAR)) AS k FROM f WHERE fp <> '' AND NOT taken GROUP BY 1), x AS (SELECT f.*, n.id AS other, i.k AS lead FROM f LEFT JOIN known n ON n.fp = f.fp LEFT JOIN first i ON i.fp = f.fp)
SELECT CASE WHEN fp <> '' AND coalesce(other, CASE WHEN lead < CAST(k AS VARCHAR) THEN lead END) IS NOT NULL THEN coalesce(other, lead) ELSE CAST(k AS VARCHAR) END AS conversation_id, fp <> '' AND coalesce(other, CASE WHEN lead < CAST(k AS VARCHAR) THEN lead END) IS NOT NULL AS "exists",
CASE WHEN fp = '' THEN 'missing: fingerprint' WHEN coalesce(other, CASE WHEN lead < CAST(k AS VARCHAR) THEN lead END) IS NULL AND taken THEN 'conversation_id already exists: ' || k END AS error FROM x""", False)
def bundle_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as bundles: some without fingerprint, some of a known file, some of a paper that is there."""
    o = c.table(spark, sf, "orders")
    print_ = F.when(F.col("o_custkey") % 11 == 0, "").otherwise(F.concat(F.lit("f"), F.col("o_custkey") % 50, "o_orderstatus"))
    record = F.struct(F.lit("a.pdf").alias("filename"), print_.alias("fingerprint"), F.lit("u").alias("poe_url"), F.lit("").alias("content_type"), F.lit(None).cast("string").alias("poe_name"))
    none = lambda t: F.array().cast(f"array<struct<{t}>>")
    b = o.select(F.col("o_orderkey").cast("string").alias("conversation_id"), F.lit("").alias("title"), record.alias("file_record"), none("role:string,content:string").alias("messages"), none("figure_index:int").alias("figures"), none("table_index:int").alias("tables"), none("tag_code:string,category_code:string,category_label:string,tag_label:string,tag_path:string,source:string").alias("tags"), F.lit(None).cast("struct<paper_id:string>").alias("meta"))
    old = spark.createDataFrame([("a", "old7F", "f7F", 1), ("b", "old13O", "f13O", 1), ("c", "gone", "f1F", 9)], "file_id string, conversation_id string, fingerprint string, uploaded_at int")
    there = o.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").cast("string").alias("id")).union(spark.createDataFrame([("old7F",), ("old13O",)], "id string"))
    return writes.bundle_tables(b, old, there)[1].select("conversation_id", "exists", "error")


@query("""SELECT conv_id AS conversation_id, turn, CAST(0 AS INTEGER) AS position, 'continue_command' AS message_kind, 'go on' AS content, false AS visible_to_user FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 1, 'bot_reply', regexp_replace(text, '^\\s+|\\s+$', '', 'g'), true FROM conversations WHERE role = 'assistant'""".replace("\\\\", "\\"), False)
def message_pairs(spark: SparkSession, sf: str) -> DataFrame:
    t = c.table(spark, sf, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("conversation_id"), "turn", F.lit("go on").alias("user_content"), F.col("text").alias("bot_content"), F.lit(None).cast("string").alias("payload"))
    return writes.message_pairs(t, "continue_command", False).select("conversation_id", "turn", "position", "message_kind", "content", "visible_to_user")


def claim_events(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks as requests, errors and purchases as ends of the job that the latest click before asked for, accepted or not."""
    e = c.table(spark, sf, "events")
    asked = F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    status = F.when(F.col("event_type") == "click", claims.REQUESTED).when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").otherwise("other")
    return e.select(F.col("user_id").alias("conversation_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), asked.alias("job_id"), status.alias("status"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS u, event_id AS seq, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS job FROM events),
r AS (SELECT u, seq, i, (SELECT min(x.i) FROM e x WHERE x.u = e.u AND x.job = e.seq AND x.t IN ('error', 'purchase')) AS until FROM e WHERE t = 'click'),
a AS (SELECT u, seq, i, until FROM r WHERE i = (SELECT min(x.i) FROM r x WHERE x.u = r.u) UNION ALL SELECT r.u, r.seq, r.i, r.until FROM a JOIN r ON r.u = a.u AND r.i = (SELECT min(x.i) FROM r x WHERE x.u = a.u AND x.i > a.until))
SELECT u AS conversation_id, seq, CAST(seq AS VARCHAR) AS job_id, seq IN (SELECT seq FROM a) AS accepted FROM r""", False)
def request_claims(spark: SparkSession, sf: str) -> DataFrame:
    return claims.claims(claim_events(spark, sf))


@query(FOLD, False)
def logged_states(spark: SparkSession, sf: str) -> DataFrame:
    """Events that come as a stream into a stored log, and the states of all jobs in it."""
    root, e = new_root(spark), c.table(spark, sf, "events")
    stream = job_events_of(spark.readStream.schema(e.schema).parquet(f"{sf}/events.parquet*"))
    stored.log_events(stream, root).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stored.states(spark, root)


@query("SELECT event_id AS seq, user_id AS conversation_id, event_id = min(event_id) OVER (PARTITION BY user_id) AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 5 = 0) AS accepted FROM events WHERE event_type = 'click'", False)
def claimed_requests(spark: SparkSession, sf: str) -> DataFrame:
    e = c.table(spark, sf, "events").withColumnRenamed("user_id", "conversation_id")
    busy = e.where("event_type = 'error' AND event_id % 5 = 0").select("conversation_id", F.lit("running").alias("status"), F.lit(translation.CONTINUE_TYPE).alias("job_type"))
    return translation.claim(e.where("event_type = 'click'").select("conversation_id", F.col("event_id").alias("seq")), busy).select("seq", "conversation_id", "accepted")


PUBS = [("0", 0, "Red Widget", "The Red Widget"), ("1", 1, "SR", "Small-Ring"), ("2", 2, "ring", "ring of"), ("3", 3, "gear box", "Annual Gear Box"), ("4", 4, "bolt x", "bolt y")]
VENUES = r"""WITH norm AS (SELECT item, position, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(n), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '\b(the|of|on|for|annual|international|ieee|acm|cvf)\b', ' ', 'g'), '\s+', ' ', 'g')) AS n
  FROM (VALUES ('0', 0, 'Red Widget', 'The Red Widget'), ('1', 1, 'SR', 'Small-Ring'), ('2', 2, 'ring', 'ring of'), ('3', 3, 'gear box', 'Annual Gear Box'), ('4', 4, 'bolt x', 'bolt y')) v(item, position, a, b), LATERAL (SELECT unnest([a, b]) AS n)),
cand AS (SELECT p_partkey AS k, i, trim(regexp_replace(regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g'), '\b(the|of|on|for|annual|international|ieee|acm|cvf)\b', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM part, LATERAL (SELECT unnest([p_brand, p_name, 'the ' || split_part(p_name, ' ', 2)]) AS n, unnest([0, 1, 2]) AS i)),
ex AS (SELECT k, i, arg_min(item, position) AS item FROM cand JOIN norm ON n = c WHERE c <> '' GROUP BY 1, 2),
sc AS (SELECT k, i, item, max(least(length(n), length(c)) / greatest(length(n), length(c))) AS s FROM cand JOIN norm ON contains(n, c) OR contains(c, n) WHERE c <> '' AND n <> '' GROUP BY 1, 2, 3),
nr AS (SELECT k, i, any_value(item) AS item FROM (SELECT *, max(s) OVER (PARTITION BY k, i) AS top FROM sc) WHERE s = top GROUP BY 1, 2 HAVING count(*) = 1)
SELECT p_partkey, coalesce((SELECT arg_min(item, i) FROM ex WHERE k = p_partkey), (SELECT arg_min(item, i) FROM nr WHERE k = p_partkey)) AS item FROM part"""


@query(VENUES, False)
def venue_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Several names of each part, the first that a publication has deciding."""
    pubs = spark.createDataFrame(PUBS, "item string, position int, abbr string, full_name string")
    p = c.table(spark, sf, "part").select("p_partkey", F.array("p_brand", "p_name", F.concat(F.lit("the "), F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("names"))
    return venues.resolve_candidates(p, pubs, "p_partkey", "names").select("p_partkey", "item")


@query("SELECT doc_id AS conversation_id, CASE WHEN doc_id % 7 = 0 THEN 'not_found' ELSE 'matched' END AS status, CASE WHEN doc_id % 7 <> 0 THEN text END AS matched_title, CAST(CASE WHEN doc_id % 7 <> 0 THEN 2000 + doc_id % 20 END AS INTEGER) AS year, CASE WHEN doc_id % 7 <> 0 AND lang = 'en' THEN 'EN' ELSE '' END AS venue_abbr, CASE WHEN doc_id % 7 <> 0 AND lang = 'en' THEN 'A' ELSE 'None' END AS ccf_category FROM documents", False)
def metadata_replies(spark: SparkSession, sf: str) -> DataFrame:
    paper = F.struct(F.col("text").alias("title"), (2000 + F.col("doc_id") % 20).alias("year"), F.concat(F.lit("nothing "), "source").alias("venue"), F.struct(F.lit("zzz").alias("name"), F.array("lang").alias("alternate_names")).alias("publicationVenue"))
    reply = F.when(F.col("doc_id") % 7 == 0, '{"data": []}').otherwise(F.to_json(F.struct(F.array(paper).alias("data"))))
    pubs = spark.createDataFrame([("x", 0, "EN", "en", "A", "journal")], "item string, position int, abbr string, full_name string, category string, type string")
    rows = venues.metadata_rows(c.table(spark, sf, "documents").select(F.col("doc_id").alias("conversation_id"), reply.alias("response")), pubs)
    return rows.select("conversation_id", "status", "matched_title", "year", "venue_abbr", "ccf_category")


@query("SELECT conv_id, turn, len(string_split(text, chr(10))) > 1 AS any_deleted FROM conversations", False)
def deleted_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Texts against their first line: whether lines are gone."""
    t = c.table(spark, sf, "conversations")
    return t.select("conv_id", "turn", (F.size(markup.deleted_lines(F.col("text"), F.split_part("text", F.lit("\n"), F.lit(1)))) > 0).alias("any_deleted"))


@query("SELECT user_id AS job_id, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS progress FROM events GROUP BY 1", False)
def job_progress(spark: SparkSession, sf: str) -> DataFrame:
    from corpuscope.streaming import jobs

    e = job_events(spark, sf).join(c.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.nullif("event_type", F.lit("view")).alias("progress")), "seq")
    return jobs.progress_marks(e.withColumn("at", F.col("seq"))).select("job_id", "progress")

