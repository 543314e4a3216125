"""Set-based writes: replace and upsert by key, bundles of several tables, and what changed."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.functions import payloads
from corpuscope.functions.text import inferred_kind, safe_int, strip, whole_number
from corpuscope.operators import store


def replace_by_key(target: DataFrame, keys: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """target without the rows of the keys, and the new rows. A key without new rows loses its old ones."""
    return target.join(keys.select(key), key, "left_anti").unionByName(new)


def upsert(target: DataFrame, changes: DataFrame, key: str, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """New values where the key has changes (but the columns in keep stay as they were), and rows of new keys."""
    t, c = target.withColumn("_t", F.lit(True)).alias("t"), changes.withColumn("_c", F.lit(True)).alias("c")
    both = t.join(c, F.col(f"t.{key}") == F.col(f"c.{key}"), "full_outer")
    take = lambda n: F.coalesce(F.col(f"t.{n}"), F.col(f"c.{n}")) if n in (key, *keep) else F.when(F.col("_c"), F.col(f"c.{n}")).otherwise(F.col(f"t.{n}"))
    return both.select(*(take(n).alias(n) for n in target.columns))


def changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new that differ from old in any column, nulls compared like values."""
    o = old.select(F.col(key).alias("_k"), F.struct(*sorted(old.columns)).alias("_old"))
    return new.join(o, F.col(key) == F.col("_k"), "left").where(~F.struct(*sorted(new.columns)).eqNullSafe(F.col("_old"))).select(*new.columns)


def export_text(c: Column) -> Column:
    """A value as exports write it: null as nothing."""
    return F.coalesce(c.cast("string"), F.lit(""))


# The export's columns.
EXPORT = (
    "id", "conversation_id", "conversation_title", "status", "paper_id", "corpus_id", "matched_title", "url", "abstract", "year", "venue", "venue_abbr", "ccf_category", "ccf_type", "publication_date", "is_open_access", "match_score",
    "citation_count", "reference_count", "authors_json", "external_ids_json", "publication_types_json", "publication_venue_json", "journal_json", "open_access_pdf_json", "raw_response_json", "source", "created_at", "updated_at",
)


def export_rows(metadata: DataFrame, papers: DataFrame) -> DataFrame:
    """All metadata rows with their paper's title, if there is one, in the export's columns and as its texts: nulls and
    columns that are not there are empty, times and dates ISO, truth True or False, and numbers as they are."""
    rows = metadata.join(papers.select(F.col("id").alias("conversation_id"), F.col("title").alias("conversation_title")), "conversation_id", "left")

    def text(c: str) -> Column:
        if c not in rows.columns:
            return F.lit("")
        kind = rows.schema[c].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return export_text(payloads.iso(F.col(c), isinstance(kind, T.TimestampType)))
        return export_text(F.initcap(F.col(c).cast("string")) if isinstance(kind, T.BooleanType) else F.col(c))

    return rows.select(*(text(c).alias(c) for c in EXPORT))


def write_export(metadata: DataFrame, papers: DataFrame, path: str) -> None:
    """export_rows() as CSV files with a header; quotes within values are doubled."""
    export_rows(metadata, papers).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def csv_export(metadata: DataFrame, papers: DataFrame, path: str) -> None:
    """All metadata rows as they are, with their paper's title, if there is one."""
    rows = metadata.join(papers.select(F.col("id").alias("conversation_id"), "title"), "conversation_id", "left")
    rows.select(*(export_text(F.col(c)).alias(c) for c in rows.columns)).write.mode("overwrite").option("header", True).csv(path)


# ---------------------------------------------------------------- files and bundles
def live_files(files: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By fingerprint, the newest file whose paper exists; and the files to delete: stale ones of fingerprints without any live."""
    marked = files.join(papers.select(F.col("id").alias("conversation_id"), F.lit(True).alias("_live")), "conversation_id", "left")
    live = marked.where("_live").groupBy("fingerprint").agg(F.max_by("file_id", F.struct("uploaded_at", "file_id")).alias("file_id"))
    return live, files.join(live, "fingerprint", "left_anti")


def new_files(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """The first file of each fingerprint that is not known yet."""
    fresh = batch.join(existing.select("fingerprint"), "fingerprint", "left_anti")
    return fresh.groupBy("fingerprint").agg(F.min("file_id").alias("file_id"))


def _indexed(rows: DataFrame, part: str) -> DataFrame:
    index = {"figures": "figure_index", "tables": "table_index"}.get(part)
    return rows.withColumn(index, F.greatest(F.coalesce(whole_number(F.col(index)).try_cast("int"), F.col("position") + 1), F.lit(1))) if index else rows


def _given(c: str, default: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.col(c).cast("string")), F.lit("")), default)


def bundle_children(bundles: DataFrame, part: str, key: str = "conversation_id") -> DataFrame:
    """One row for each element of an array of structs, with its place; null elements go. Figures and tables without an
    index get their place, whole numbers are 1 at least; tags without a code go, and their labels and paths have defaults;
    messages get their kind, and whether they are shown where that is not given."""
    rows = bundles.select(key, F.posexplode(part).alias("position", "_e")).where("_e IS NOT NULL").select(key, "position", "_e.*")
    has = set(rows.columns)
    if part in ("figures", "tables"):
        rows = _indexed(rows, part)
        rows = rows.withColumns({c: safe_int(F.col(c), 1, 1) for c in ("page_number", "image_width", "image_height") if c in has} | {"image_mime_type": _given("image_mime_type", F.lit("image/webp")) for c in ("image_mime_type",) if c in has})
        if "image_data_base64" in has:
            data = strip(F.col("image_data_base64"))
            bad = F.when((data != "") & F.try_to_binary(data, F.lit("base64")).isNull(), F.raise_error(F.lit("image data is no base64")).cast("binary"))
            rows = rows.withColumn("image_data", F.coalesce(bad, F.when(data != "", F.try_to_binary(data, F.lit("base64")))))
    if part == "tags":
        rows = rows.where(strip(F.coalesce("tag_code", F.lit(""))) != "")
        none = F.lit("")
        rows = rows.withColumns({"tag_code": strip(F.col("tag_code")), "category_code": _given("category_code", none)})
        rows = rows.withColumns({"category_label": _given("category_label", F.col("category_code")), "tag_label": _given("tag_label", F.col("tag_code")), "source": _given("source", F.lit("agent"))})
        rows = rows.withColumn("tag_path", _given("tag_path", F.concat_ws("/", "category_label", "tag_label")))
    if part == "messages":
        null = F.lit(None).cast("string")
        rows = rows.withColumn("message_kind", inferred_kind(*(F.col(c) if c in has else null for c in ("message_kind", "message_type", "role", "content"))))
        shown = F.col("message_kind").isin("bot_reply", "user_message")
        rows = rows.withColumn("visible_to_user", F.coalesce("visible_to_user", shown) if "visible_to_user" in has else shown)
    return rows


PARTS = ("messages", "figures", "tables", "tags")


def _accepted(rows: DataFrame) -> DataFrame:
    """Of bundles (_row, conversation_id, _fingerprint) that come together, those that would be stored if one came after
    the other, in the order of these columns, and neither an id nor a fingerprint could be stored twice.

    A round accepts those that are the first left of their id and of their fingerprint, and leaves out all that share one
    with them. Mostly one round is enough; there are as many as the longest row of bundles that share an id with the one
    before and a fingerprint with the one after.
    """
    order = F.struct("conversation_id", "_fingerprint", "_row")
    left, out = rows, rows.limit(0)
    while True:
        by_id, by_print = (store.sorted_join(left.groupBy(c).agg(F.min(order).alias(f"_{n}"))) for c, n in (("conversation_id", "a"), ("_fingerprint", "b")))
        marked = left.join(by_id, "conversation_id").join(by_print, "_fingerprint").withColumn("_won", (F.col("_a") == order) & (F.col("_b") == order))
        marked = store.written(marked.select(*rows.columns, "_won"), "bundles-round")
        won = marked.where("_won").select(*rows.columns)
        out = out.unionByName(won)
        left = store.written(marked.where("NOT _won").join(won, "_fingerprint", "left_anti").join(won, "conversation_id", "left_anti").select(*rows.columns), "bundles-left")
        if left.isEmpty():
            return out


def bundle_tables(bundles: DataFrame, existing_files: DataFrame, existing_papers: DataFrame, now: Column | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by name, outcome): what bundles of papers become, ready for publish().

    bundles: conversation_id (may be null), title, file_record struct (filename, fingerprint, poe_url, content_type,
    poe_name), messages, figures, tables, tags (arrays of structs), meta struct. A bundle without its three file fields, or
    with the id of a paper that is there, is refused; one whose fingerprint is known gives the paper that has it and adds
    nothing. Among themselves the bundles of a call count in the order of id and fingerprint, as if each came by itself:
    one whose fingerprint an earlier one has stored gives that one's paper, one whose id is taken is refused. outcome:
    conversation_id, exists, error and committed_parts, a part being named if its list is not empty. All rows of a call
    have one time.
    """
    now = F.current_timestamp() if now is None else now
    field = lambda c: strip(F.coalesce(F.col(f"file_record.{c}").cast("string"), F.lit("")))
    b = bundles.withColumns({f"_{c}": field(c) for c in ("filename", "fingerprint", "poe_url", "content_type", "poe_name")})
    b = b.withColumn("conversation_id", F.coalesce(F.nullif(strip(F.col("conversation_id")), F.lit("")), F.substring(F.sha2(F.concat_ws("\n", "_fingerprint", "_filename", "_poe_url"), 256), 1, 12)))
    missing = F.filter(F.array(*(F.when(F.col(f"_{c}") == "", F.lit(c)) for c in ("filename", "fingerprint", "poe_url"))), lambda x: x.isNotNull())
    b = b.withColumn("error", F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))))
    known = live_files(store.sorted_join(existing_files), store.sorted_join(existing_papers))[0].join(store.sorted_join(existing_files.select("file_id", F.col("conversation_id").alias("_known"))), "file_id").select(F.col("fingerprint").alias("_fingerprint"), "_known")
    taken = existing_papers.select(F.col("id").cast("string").alias("conversation_id"), F.lit(True).alias("_taken"))
    b = store.written(b.withColumn("_row", F.monotonically_increasing_id()), "bundles")
    b = b.join(store.sorted_join(known), "_fingerprint", "left").join(store.sorted_join(taken), "conversation_id", "left").withColumn("_known", F.col("_known").cast("string"))
    order = ("conversation_id", "_fingerprint", "_row")
    won = _accepted(b.where("error IS NULL AND _known IS NULL AND _taken IS NULL").select(*order))
    b = b.join(store.sorted_join(won.select("_fingerprint", F.struct(*order).alias("_won"))), "_fingerprint", "left")
    b = b.withColumn("_known", F.coalesce("_known", F.when(F.col("error").isNull() & (F.col("_won") < F.struct(*order)), F.col("_won.conversation_id"))))
    refused = F.col("_known").isNull() & ~F.coalesce(F.col("_won") == F.struct(*order), F.lit(False))
    b = b.withColumn("error", F.coalesce("error", F.when(refused, F.concat(F.lit("conversation_id already exists: "), "conversation_id")))).withColumn("exists", F.col("error").isNull() & F.col("_known").isNotNull())
    good = b.where("error IS NULL AND NOT exists")
    papers = good.select(F.col("conversation_id").alias("id"), _given("title", F.col("_filename")).alias("title"), F.col("_filename").alias("original_filename"), F.lit("active").alias("status"), now.alias("created_at"))
    files = good.select("conversation_id", F.col("_filename").alias("filename"), F.col("_fingerprint").alias("fingerprint"), F.col("_poe_url").alias("poe_url"), _given("_content_type", F.lit("application/pdf")).alias("content_type"), _given("_poe_name", F.col("_filename")).alias("poe_name"), now.alias("uploaded_at"))
    tables = {"conversation": papers, "file_record": files} | {p: bundle_children(good, p).withColumn("created_at", now) for p in PARTS}
    tables["messages"] = normalized_messages(tables["messages"])
    m = good.where("meta IS NOT NULL").select("conversation_id", "meta.*")
    found = F.lit(False)
    for c in ("paper_id", "venue", "year"):
        if c in m.columns:
            found = found | (F.coalesce(F.col(c).cast("string"), F.lit("")) != "") & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "0")
    status = F.when(found, "matched").otherwise("not_found")
    m = m.withColumn("status", _given("status", status) if "status" in m.columns else status)
    tables["meta"] = m.withColumns({c: _given(c, F.lit(d)) if c in m.columns else F.lit(d) for c, d in (("ccf_category", "None"), ("ccf_type", "None"), ("source", "agent"), ("raw_response_json", "{}"))}).withColumn("created_at", now).withColumn("updated_at", now)
    parts = F.concat(F.array(F.lit("conversation"), F.lit("file_record")), F.filter(F.array(*(F.when(F.coalesce(F.size(p), F.lit(0)) > 0, F.lit(p)) for p in PARTS), F.when(F.col("meta").isNotNull(), F.lit("meta"))), lambda x: x.isNotNull()))
    none = F.array().cast("array<string>")
    return tables, b.select(F.when(F.col("exists"), F.col("_known")).otherwise(F.col("conversation_id")).alias("conversation_id"), "exists", "error", F.when(F.col("error").isNull() & ~F.col("exists"), parts).otherwise(none).alias("committed_parts"))


def compose_error(bundles: DataFrame) -> DataFrame:
    """bundles with error and error_code: title, the three file fields and messages are needed for a bundle to be valid."""
    blank = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    error = F.when(blank("title"), "title is required")
    for c in ("filename", "fingerprint", "poe_url"):
        error = error.when(blank(f"file_record.{c}"), f"file_record.{c} is required")
    out = bundles.withColumn("error", error.when(F.col("messages").isNull(), "messages must be a list"))
    return out.withColumn("error_code", F.when(F.col("error").isNotNull(), "invalid_bundle"))


# ---------------------------------------------------------------- messages
def normalized_messages(messages: DataFrame) -> DataFrame:
    """Messages as they are stored: kind by what is known of them, a section only for replies, and of replies the cleaned
    text and payload. payload may be missing."""
    m = messages if "payload" in messages.columns else messages.withColumn("payload", F.lit(None).cast("string"))
    null, has = F.lit(None).cast("string"), set(m.columns)
    kind = inferred_kind(*(F.col(c) if c in has else null for c in ("message_kind", "message_type", "role", "content")))
    bot = F.col("message_kind") == "bot_reply"
    m = m.withColumn("message_kind", kind).withColumn("_s", F.when(F.col("message_kind") == "bot_reply", payloads.stored_reply(F.col("content"), F.col("payload"))))
    out = m.withColumns({"content": F.when(bot, F.col("_s.content")).otherwise(F.col("content")), "payload": F.when(bot, payloads.payload_json(F.col("_s"))).otherwise(F.col("payload"))})
    return (out.withColumn("section_category", F.when(bot, F.col("section_category"))) if "section_category" in has else out).drop("_s")


def message_pairs(turns: DataFrame, user_kind: str = "user_message", user_visible: bool = True) -> DataFrame:
    """Two messages for each turn (conversation_id, user_content, bot_content, payload), the user's first, as stored."""
    null = F.lit(None).cast("string")
    row = lambda kind, content, payload, shown: F.struct(F.lit(kind).alias("message_kind"), F.col(content).alias("content"), payload.alias("payload"), F.lit(shown).alias("visible_to_user"))
    both = F.array(row(user_kind, "user_content", null, user_visible), row("bot_reply", "bot_content", F.col("payload"), True))
    rest = [c for c in turns.columns if c not in ("user_content", "bot_content", "payload")]
    return normalized_messages(turns.select(*rest, F.posexplode(both).alias("position", "_m")).select(*rest, "position", "_m.*"))


def replace_if_any(target: DataFrame, found: DataFrame, part: str, key: str = "conversation_id") -> DataFrame:
    """target with the rows of keys for which something was found, an array of structs (part), replaced; keys with nothing
    found, or an error, keep theirs."""
    some = found.where(F.coalesce(F.size(part), F.lit(0)) > 0)
    new = some.select(key, F.explode(part).alias("_e")).select(key, "_e.*")
    return replace_by_key(target, some.select(key).distinct(), new, key)


def reprocess_requests(requests: DataFrame) -> DataFrame:
    """requests with figure_direction, table_direction and error: where captions are asked to stand, above or below, null
    for what is not to be done anew. An asset_type with its caption_direction, the older way to ask, overrides the
    direction of that kind. Columns that requests lack count as null."""
    col = lambda c: F.col(c) if c in requests.columns else F.lit(None).cast("string")
    kind, old, sides = col("asset_type"), col("caption_direction"), ("above", "below")
    asked = kind.isNotNull() | old.isNotNull()
    own = {k: F.when(asked & (kind == k), old).otherwise(col(f"{k}_caption_direction")) for k in ("figure", "table")}
    bad = lambda c: c.isNotNull() & ~c.isin(*sides)
    error = F.when(asked & ~F.coalesce(kind.isin("figure", "table"), F.lit(False)), "asset_type must be 'figure' or 'table'").when(asked & ~F.coalesce(old.isin(*sides), F.lit(False)), "caption_direction must be 'above' or 'below'")
    for k, c in own.items():
        error = error.when(bad(c), f"{k}_caption_direction must be 'above' or 'below'")
    error = error.when(own["figure"].isNull() & own["table"].isNull(), "at least one caption direction is needed")
    return requests.withColumns({f"{k}_direction": c for k, c in own.items()} | {"error": error})


def reprocessed(assets: DataFrame, found: DataFrame, requests: DataFrame, kind: str) -> DataFrame:
    """assets (figures or tables: kind figure or table) after requests (see reprocess_requests()): of papers whose request
    has a direction for the kind and for which something was found in it (found: conversation_id, direction and the
    columns of assets), the found ones; of all others those that there were."""
    good = requests.where(F.col("error").isNull()).select("conversation_id", F.col(f"{kind}_direction").alias("direction")).where("direction IS NOT NULL").distinct()
    new = found.join(good, ["conversation_id", "direction"], "left_semi")
    return replace_by_key(assets, new.select("conversation_id").distinct(), new.select(*assets.columns), "conversation_id")


def paper_shells(files: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of papers for new files (conversation_id, filename): without a title yet."""
    return files.select(F.col("conversation_id").alias("id"), F.lit(None).cast("string").alias("title"), F.col("filename").alias("original_filename"), F.lit("active").alias("status"), (F.current_timestamp() if now is None else now).alias("created_at"))


def retitled(papers: DataFrame, titles: DataFrame) -> DataFrame:
    """papers with new titles (id, title) where there are any that are not blank."""
    t = titles.where(strip(F.coalesce("title", F.lit(""))) != "").select("id", strip(F.col("title")).alias("_title"))
    return papers.join(t, "id", "left").withColumn("title", F.coalesce("_title", "title")).select(*papers.columns)


# ---------------------------------------------------------------- schemas
def evolve(rows: DataFrame, columns: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """rows with all the columns (name: type), null where they were not there, and without those to drop."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns}).drop(*drop)


def assert_columns(rows: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def chosen(rows: DataFrame, wanted) -> DataFrame:
    """Those of the wanted columns that rows have."""
    return rows.select(*(c for c in wanted if c in rows.columns))


# ---------------------------------------------------------------- reports
def write_report(rows: DataFrame, path: str, view: str = "jsonl", split: bool = False) -> None:
    """Report rows as lines: jsonl (all), or deleted and diff (rows whose action is not keep, with the text of their view).
    split: one folder for each action."""
    from corpuscope.functions.markup import deleted_view, diff_view

    if view != "jsonl":
        rows = rows.where("action != 'keep'")
        shown = deleted_view if view == "deleted" else diff_view
        rows = rows.select("action", shown(*(F.col(c) for c in ("message_id", "conversation_id", "action", "reasons", "original_content", "display_content"))).alias("value"))
    writer = rows.write.mode("overwrite")
    writer = writer.partitionBy("action") if split else writer
    writer.json(path) if view == "jsonl" else (writer if split else rows.select("value").write.mode("overwrite")).text(path)


def write_json_list(rows: DataFrame, path: str, order: str, most: int = 100_000) -> None:
    """A reference list (publications, a taxonomy) as one indented JSON list in the order of a column, which is left out,
    as are null fields. For lists that are read whole by their readers: more than most rows are an error."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows are no reference list")
    fields = F.struct(*(F.col(c) for c in rows.columns if c != order))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), fields.alias("_row")))).alias("l"))
    listed.select(F.to_json(F.transform("l", lambda x: x["_row"]), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def numbered_children(rows: DataFrame, part: str, order: list[str], key: str = "conversation_id") -> DataFrame:
    """Like bundle_children, of children that are rows: their places within a key by order. A key of very many rows is cut
    into ranges, whose rows are numbered after the counts of the ranges before."""
    ranged = store.written(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = counts.select(key, "_range", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)))
    placed = own.join(before, [key, "_range"]).withColumn("position", (F.col("_before") + F.col("_own") - 1).cast("int"))
    return _indexed(placed.select(key, "position", *(c for c in rows.columns if c != key)), part)


def bundle_error(bundles: DataFrame) -> DataFrame:
    """bundles with error: what of filename, fingerprint and url is missing; null if nothing."""
    missing = F.filter(F.array(*(F.when(strip(F.coalesce(F.col(c), F.lit(""))) == "", c) for c in ("filename", "fingerprint", "poe_url"))), lambda x: x.isNotNull())
    return bundles.withColumn("error", F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))))


# ---------------------------------------------------------------- commits
def publish(spark: SparkSession, parts: dict[str, DataFrame], root: str) -> str:
    """Write several tables, each as a whole, so that readers see all or none; the id of the commit."""
    return store.commit(spark, root, lambda now, own: {name: store.replace(df, root, name, own) for name, df in parts.items()}).id


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as the last commit has it."""
    return store.read(spark, root, name)


PAPERS, FILES = "id string, title string, original_filename string, status string, created_at timestamp", "file_id string, conversation_id string, filename string, fingerprint string, poe_url string, content_type string, poe_name string, uploaded_at timestamp"


def commit_bundles(spark: SparkSession, bundles: DataFrame, root: str, now: Column | None = None, stream: str | None = None, batch: int | None = None) -> DataFrame:
    """Put bundles into the stored tables in one commit; the outcome of each (see bundle_tables()).

    Ids and fingerprints are checked against the version that the commit follows: if another writer comes first, they are
    checked again against what it has brought, so of two writers with one id one is refused. Nothing is there of a call
    that fails, and a call that adds nothing makes no commit. stream and batch: as in store.commit(); the outcome of a
    batch that was brought before is that of its first run.
    """
    outcome = f"{root}/outcomes/{stream}/{batch}" if stream is not None else f"{root}/outcomes/{uuid.uuid4().hex}"

    def make(version: store.Version, own: str) -> dict[str, dict] | None:
        there = lambda name, schema: store.read(spark, root, name, version) if name in version.tables else spark.createDataFrame([], schema)
        tables, said = bundle_tables(bundles, there("file_record", FILES), there("conversation", PAPERS), now)
        said.write.mode("overwrite").parquet(outcome)
        if spark.read.parquet(outcome).where("error IS NULL AND NOT exists").isEmpty():
            return None
        tables["file_record"] = tables["file_record"].withColumn("file_id", F.substring(F.sha2(F.concat_ws("\n", "conversation_id", "fingerprint"), 256), 1, 32))
        return {name: store.append(df, root, name, version, own) for name, df in tables.items()}

    store.commit(spark, root, make, stream, batch)
    return spark.read.parquet(outcome)
