"""Listings, facets and the two tiers of title search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions import payloads
from corpuscope.functions.text import category_codes, compact, cut_at_word, default_if_blank, let, strip, summary
from corpuscope.operators import filters


def page(papers: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """The latest papers, from an offset, and one more than asked for, by which the caller sees that there are more."""
    return papers.orderBy(F.desc("created_at"), "id").offset(max(0, offset)).limit(max(1, min(limit, 50)) + 1)


def pattern(query: str, escape: bool = False) -> str:
    """The query as it stands; % and _ in it act as wildcards unless escaped."""
    if escape:
        query = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{query}%"


def exact(papers: DataFrame, query: str, top: int = 5) -> DataFrame:
    """The latest papers whose title holds the query, with relevance 100 for equal titles, 50 for others; without a
    query the ten latest."""
    query = query.strip()
    if not query:
        return papers.orderBy(F.desc("created_at"), "id").limit(10).withColumn("relevance", F.lit(100))
    low = F.lower("title")
    score = F.when(low == query.lower(), 100).when(F.contains(low, F.lit(query.lower())), 50).otherwise(0)
    return papers.where(F.col("title").ilike(pattern(query))).orderBy(F.desc("created_at"), "id").limit(top).withColumn("relevance", score)


def fuzzy(papers: DataFrame, query: str, top: int = 5, word_bonus: bool = False) -> DataFrame:
    """Papers whose title lacks the whole query but holds words of it, best first; a word counts its length, and 5 more
    where it stands alone if word_bonus is set. Repeated words count again."""
    words = [w.lower() for w in query.split() if len(w) > 1]
    if not words:
        return papers.limit(0).withColumn("relevance", F.lit(0))
    low, score = F.lower("title"), F.lit(0)
    for w in words:
        bonus = F.when(low.rlike(rf"\b\Q{w}\E\b"), 5).otherwise(0) if word_bonus else F.lit(0)
        score = score + F.when(F.contains(low, F.lit(w)), F.lit(len(w)) + bonus).otherwise(0)
    return papers.where(~F.col("title").ilike(pattern(query.strip()))).withColumn("relevance", score).where("relevance > 0").orderBy(F.desc("relevance"), "created_at", "id").limit(top)


# ---------------------------------------------------------------- facets
def category_facet(papers: DataFrame, metadata: DataFrame) -> DataFrame:
    """Always A, B, C and None, in this order; None is what the others leave of all papers."""
    n = papers.agg(F.count("*").alias("total")).join(metadata.agg(*(F.count_if(F.col("ccf_category") == c).alias(c) for c in "ABC")))  # one row each
    left = F.greatest(F.col("total") - F.col("A") - F.col("B") - F.col("C"), F.lit(0))
    rows = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(v).alias("value"), c.alias("n")) for i, (v, c) in enumerate([*((x, F.col(x)) for x in "ABC"), ("None", left)])))
    return n.select(F.explode(rows).alias("r")).select("r.*")


def venue_facet(venues: DataFrame, ordered: bool = False) -> DataFrame:
    """Papers by abbreviation, or by name where there is none; the full label is that of the first row. ordered: with the
    label, by it without regard to case, equal ones by their first row."""
    key = F.coalesce(F.nullif(F.col("venue_abbr"), F.lit("")), F.nullif(F.col("venue"), F.lit("")))
    full = F.coalesce(F.nullif(F.col("venue"), F.lit("")), F.col("venue_abbr"))
    keyed = venues.withColumn("value", key).where("value IS NOT NULL")
    if not ordered:
        return keyed.groupBy("value").agg(F.min_by(full, "conversation_id").alias("full_label"), F.count("*").alias("n"))
    n = keyed.groupBy("value").agg(F.min_by(full, "conversation_id").alias("full_label"), F.count("*").alias("n"), F.min("conversation_id").alias("_first"))
    return n.withColumn("label", F.col("value")).orderBy(F.lower("label"), "_first").drop("_first")


def year_facet(venues: DataFrame) -> DataFrame:
    return venues.where("year IS NOT NULL").groupBy(F.col("year").cast("string").alias("value")).agg(F.count("*").alias("n"))


def tag_library(dimension: DataFrame, tags: DataFrame, code: str) -> DataFrame:
    """Every code of the taxonomy with the number of papers that use it, 0 included."""
    used = tags.groupBy("tag_code").agg(F.count_distinct("conversation_id").alias("usage"))
    return dimension.join(used, dimension[code] == used["tag_code"], "left").select(*dimension.columns, F.coalesce("usage", F.lit(0)).alias("usage_count"))


# ---------------------------------------------------------------- what a listing shows
def summary_message(messages: DataFrame) -> DataFrame:
    """(conversation_id, id, content) of the reply that stands for a conversation: among those shown, the first that is not
    blank and whose status has done units, else the first that is not blank, else the first.

    visible_to_user and payload (JSON with translation_status) are read where messages have them.
    """
    bots = messages.where("message_kind = 'bot_reply'")
    if "visible_to_user" in messages.columns:
        bots = bots.where("visible_to_user")
    done = F.lit(False)
    if "payload" in messages.columns:
        done = F.coalesce(payloads.stored_status(payloads.parsed(payloads.key(F.col("payload"), "translation_status"), payloads.STATUS))["completed_unit_count"] > 0, F.lit(False))
    blank = strip(F.coalesce("content", F.lit(""))) == ""
    order = F.struct((blank | ~done).alias("undone"), blank.alias("blank"), F.col("id"))
    return bots.groupBy("conversation_id").agg(F.min_by(F.struct("id", "content"), order).alias("m")).select("conversation_id", "m.id", "m.content")


def latest_value(messages: DataFrame, value, order: str = "id", key: str = "conversation_id") -> DataFrame:
    """The newest value that is not null, by key."""
    return messages.withColumn("value", value).where("value IS NOT NULL").groupBy(key).agg(F.max_by("value", order).alias("value"))


def child_counts(papers: DataFrame, **children: DataFrame) -> DataFrame:
    """Papers with the number of rows of each kind of children: name=rows by conversation_id."""
    out = papers
    for name, rows in children.items():
        own = rows.groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias(name))
        out = out.join(own, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def details(papers: DataFrame, most: int = 10_000, **children: tuple[DataFrame, str]) -> DataFrame:
    """Papers with an ordered array of structs for each kind of children: name=(rows by conversation_id, order column).
    More than so many children of one paper are an error, raised before any array is made."""
    out = papers
    for name, (rows, order) in children.items():
        rest = [c for c in rows.columns if c not in ("conversation_id", order)]
        large = rows.groupBy("conversation_id").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
        bounded = rows.join(F.broadcast(large), "conversation_id", "left").where(F.when(F.col("_n").isNotNull(), F.raise_error(F.lit(f"more than {most} {name} in one conversation")).cast("boolean")).otherwise(True))
        own = bounded.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))
        out = out.join(own.withColumnRenamed("conversation_id", "id"), "id", "left").withColumn(name, F.coalesce(name, F.array()))
    return out


# ---------------------------------------------------------------- tags
def tag_definitions(tree: DataFrame) -> DataFrame:
    """(tag_code, labels and paths in both languages, position) of a taxonomy: rows code, label, label_en, tags: an array of
    structs (code, label, label_en)."""
    t = tree.select("code", "label", "label_en", F.posexplode("tags").alias("position", "t"))
    path = lambda a, b: F.concat_ws("/", a, b)
    return t.select(
        F.col("t.code").alias("tag_code"), F.col("code").alias("category_code"), F.col("label").alias("category_label"), F.col("label_en").alias("category_label_en"), F.col("t.label").alias("tag_label"), F.col("t.label_en").alias("tag_label_en"),
        path("label", "t.label").alias("tag_path"), path("label_en", "t.label_en").alias("tag_path_en"), "position",
    )


def labelled_tags(tags: DataFrame, definitions: DataFrame) -> DataFrame:
    """tags with the taxonomy's labels and paths where it knows the code, else their own; English ones are empty then."""
    d = definitions.select("tag_code", F.struct("category_label", "tag_label", "tag_path").alias("_d"), F.struct("category_label_en", "tag_label_en", "tag_path_en").alias("_en"))
    own = tags.join(F.broadcast(d), "tag_code", "left")
    return own.withColumns({k: F.coalesce(f"_d.{k}", k) for k in ("category_label", "tag_label", "tag_path")} | {k: F.coalesce(f"_en.{k}", F.lit("")) for k in ("category_label_en", "tag_label_en", "tag_path_en")}).drop("_d", "_en")


def tag_tree(tree: DataFrame, tags: DataFrame) -> DataFrame:
    """The taxonomy as it is, each tag with the number of papers that use it."""
    used = tags.groupBy("tag_code").agg(F.count_distinct("conversation_id").alias("usage"))
    d = tag_definitions(tree).join(used, "tag_code", "left")
    rows = F.struct("position", F.col("tag_code").alias("code"), F.col("tag_label").alias("label"), F.col("tag_label_en").alias("label_en"), F.coalesce("usage", F.lit(0)).alias("usage_count"))
    return d.groupBy(F.col("category_code").alias("code"), F.col("category_label").alias("label"), F.col("category_label_en").alias("label_en")).agg(F.array_sort(F.collect_list(rows)).alias("tags"))  # bounded by the taxonomy


def resolved_tags(codes: DataFrame, definitions: DataFrame, source: str = "manual") -> DataFrame:
    """codes (conversation_id, tag_code) as tag rows, known codes only, each once: what replaces a paper's tags by hand."""
    known = definitions.select("tag_code", "category_code", "category_label", "tag_label", "tag_path")
    return codes.select("conversation_id", F.upper(strip(F.col("tag_code"))).alias("tag_code")).distinct().join(F.broadcast(known), "tag_code").withColumn("source", F.lit(source))


def prompt_library(definitions: DataFrame) -> DataFrame:
    """(category_code, category, tags): how a classifier is told of each category, as code=label and as code:tags, a tag
    being its code and label; as long as the taxonomy."""
    tag = F.struct("position", F.concat("tag_code", "tag_label").alias("t"))
    each = definitions.groupBy("category_code", "category_label").agg(F.array_sort(F.collect_list(tag)).alias("l"))
    return each.select("category_code", F.concat_ws("=", "category_code", "category_label").alias("category"), F.concat_ws(":", "category_code", F.array_join(F.transform("l", lambda x: x["t"]), " ")).alias("tags"))


def category_prompts(papers: DataFrame, library: DataFrame, template: str) -> DataFrame:
    """papers (title, abstract) with prompt: the template with all categories, the title (240 characters at most) and the
    abstract (1200 at most, whole words) in place of {categories}, {title} and {abstract}."""
    listed = ",".join(r.category for r in library.orderBy("category_code").collect())  # as long as the taxonomy
    said = lambda c, n: F.coalesce(F.nullif(cut_at_word(compact(F.coalesce(c, F.lit(""))), n), F.lit("")), F.lit("-"))
    fill = F.replace(F.replace(F.replace(F.lit(template), F.lit("{categories}"), F.lit(listed)), F.lit("{title}"), said("title", 240)), F.lit("{abstract}"), said("abstract", 1200))
    return papers.withColumn("prompt", fill)


def tag_prompts(replies: DataFrame, library: DataFrame, template: str) -> DataFrame:
    """replies (conversation_id, reply: categories as a classifier named them) with prompt: the template with the tags of
    the known ones among them, or of all categories if it named none, in place of {tags}."""
    every = F.array(*(F.struct(F.lit(r.category_code).alias("c"), F.lit(r.tags).alias("t")) for r in library.orderBy("category_code").collect()))  # as long as the taxonomy
    named = lambda codes: F.filter(every, lambda x: F.array_contains(codes, x["c"]))
    own = let(let(category_codes(F.col("reply")), named), lambda some: F.when(F.size(some) > 0, some).otherwise(every))
    return replies.withColumn("prompt", F.replace(F.lit(template), F.lit("{tags}"), F.array_join(F.transform(own, lambda x: x["t"]), "\n")))


def asset_urls(assets: DataFrame, kind: str) -> DataFrame:
    """Assets with an id, and the address of each: kind is figures or tables."""
    return assets.where("id IS NOT NULL").withColumn("image_url", F.concat(F.lit(f"/assets/{kind}/"), F.col("id").cast("string")))


# ---------------------------------------------------------------- listings as shown
#: What stands for a summary where a paper has none (fixed value).
NO_SUMMARY = "已生成全文规划，等待确认关键术语与译法。"


def list_items(papers: DataFrame, messages: DataFrame, files: DataFrame, tags: DataFrame, metadata: DataFrame, definitions: DataFrame) -> DataFrame:
    """A page of papers as listings show them: summary, pdf_url, tags (ordered by category and code), and metadata with its
    defaults. Children are joined once for the page, which is small, so its ids filter them first."""
    page_ids = papers.select(F.col("id").alias("conversation_id"))
    own = lambda rows: rows.join(F.broadcast(page_ids), "conversation_id", "left_semi")
    said = summary_message(own(messages)).select("conversation_id", F.col("content").alias("_said"))
    file = filters.first_rows(own(files), "conversation_id").select("conversation_id", F.col("poe_url").alias("pdf_url"))
    label = F.struct("category_code", "tag_code", "category_label", "tag_label", "tag_path", "category_label_en", "tag_label_en", "tag_path_en")
    listed = labelled_tags(own(tags), definitions).groupBy("conversation_id").agg(F.array_sort(F.collect_list(label)).alias("tags"))
    meta = filters.first_rows(own(metadata), "conversation_id", last=True)
    out = papers.withColumn("conversation_id", F.col("id"))
    for rows in (said, file, listed, meta.drop("id")):
        out = out.join(rows, "conversation_id", "left")
    defaults = {"venue_abbr": F.coalesce("venue_abbr", F.lit("")), "ccf_category": default_if_blank(F.col("ccf_category"), "None"), "ccf_type": default_if_blank(F.col("ccf_type"), "None")}
    return out.withColumn("summary", summary(F.col("_said"), NO_SUMMARY)).withColumns({k: v for k, v in defaults.items() if k in out.columns}).withColumn("tags", F.coalesce("tags", F.array())).drop("_said", "conversation_id")


def search_page(papers: DataFrame, matching: DataFrame, query: str = "", search_type: str = "all", filtered: bool = False) -> tuple[DataFrame, int]:
    """(rows with tier and relevance, number of all papers). matching: papers that pass the filters; filtered: whether any
    was given. Without query and filters there are no rows; fuzzy and exact give their own tier alone, other types both."""
    total = papers.count()
    tiers = {"exact": exact(matching, query), "fuzzy": fuzzy(matching, query)}
    kept = [rows.withColumn("tier", F.lit(name)) for name, rows in tiers.items() if search_type not in tiers or name == search_type]
    out = kept[0] if len(kept) == 1 else kept[0].unionByName(kept[1])
    return (out if query.strip() or filtered else out.limit(0)), total


def paper_details(papers: DataFrame, messages: DataFrame, files: DataFrame, figures: DataFrame, tables: DataFrame, tags: DataFrame, metadata: DataFrame) -> DataFrame:
    """Papers with all their children: messages by id, figures and tables by index, tags by category and code, the first
    file and the last metadata row. For chosen papers: details() refuses one with very many children."""
    tags = tags.withColumn("_order", F.struct("category_code", "tag_code"))
    out = details(papers, messages=(messages, "id"), figures=(asset_urls(figures, "figures"), "figure_index"), tables=(asset_urls(tables, "tables"), "table_index"), tags=(tags, "_order"))
    for name, rows in (("file", filters.first_rows(files, "conversation_id")), ("metadata", filters.first_rows(metadata, "conversation_id", last=True))):
        out = out.join(rows.select(F.col("conversation_id").alias("id"), F.struct(*(c for c in rows.columns if c != "conversation_id")).alias(name)), "id", "left")
    return out


def action_counts(rows: DataFrame, action: str = "action") -> DataFrame:
    return rows.groupBy(action).agg(F.count("*").alias("n"))
