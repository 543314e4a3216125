"""Venue resolution: exact by normalised name, else by unambiguous containment; and the mapping of metadata replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.payloads import canonical_json, parsed
from corpuscope.functions.text import abstract, compact, strip, tag_codes, venue_name
from corpuscope.operators import search, store, writes

#: Bytes of names up to which a publication list is broadcast for containment; a longer one is joined by its words.
BROADCAST_BYTES = 8 << 20


def _names(publications: DataFrame, key: str) -> DataFrame:
    """(n, item, position) of each name of each publication."""
    pubs = publications.select("position", F.col(key).alias("item"), F.explode(F.array("abbr", "full_name")).alias("n")).withColumn("n", venue_name(F.col("n"))).where("n != ''")
    return pubs.groupBy("n", "item").agg(F.min("position").alias("position"))


def _contained(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(c, item): the item of the best ratio of lengths among names that hold c or are held by it, unless two reach it.

    A list of checked size is broadcast. Of a longer one, only names are compared that share their first word's letters
    with some place of the other: each side is dealt out by the runs of three characters that it holds, and the shorter
    of a pair by its first alone.
    """
    size = names.agg(F.sum(F.octet_length("n"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        pairs = asked.join(F.broadcast(names), F.contains("n", "c") | F.contains("c", "n"))
    else:
        runs = lambda x, k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - k + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(k)))
        grams = lambda x: F.concat(runs(x, 1), runs(x, 2), runs(x, 3))  # noqa: E731  (names of one or two characters have a short key)
        all_ = lambda df, x: df.withColumn("g", F.explode(F.array_distinct(grams(F.col(x)))))
        first = lambda df, x: df.withColumn("g", F.substring(x, 1, 3))
        inner = first(asked, "c").join(all_(names, "n"), "g").where(F.contains("n", "c"))
        outer = all_(asked, "c").join(first(names, "n"), "g").where(F.contains("c", "n"))
        pairs = inner.drop("g").unionByName(outer.drop("g")).distinct()
    ratio = F.least(F.length("n"), F.length("c")) / F.greatest(F.length("n"), F.length("c"))
    items = pairs.withColumn("s", ratio).groupBy("c", "item").agg(F.max("s").alias("s"))
    tied = items.groupBy("c", "s").agg(F.count("*").alias("n"), F.min("item").alias("item"))  # how many reach each ratio
    best = tied.groupBy("c").agg(F.max_by(F.struct("n", "item"), "s").alias("b"))
    return best.where("b.n = 1").select("c", "b.item")


def resolve(names: DataFrame, publications: DataFrame, name: str = "name", key: str = "item") -> DataFrame:
    """names with item, the publication's key, or null.

    publications: (item, position, abbr, full_name). An equal normalised name wins, the first in the file among several;
    else the publication of the best ratio of lengths among names that hold the candidate or are held by it, unless two
    different ones reach it. Distinct names are resolved once.
    """
    one = resolve_candidates(names.select(F.col(name).alias("_id"), F.array(name).alias("_all")).distinct(), publications, "_id", "_all", key).select("_id", key)
    return names.join(one, F.col(name).eqNullSafe(F.col("_id")), "left").drop("_id")


def resolve_candidates(rows: DataFrame, publications: DataFrame, id_: str, candidates: str, key: str = "item") -> DataFrame:
    """rows (id_, candidates: an array of names in order, ...) with item: the first candidate with an equal name decides;
    if none has one, the first with an unambiguous containment; else null. Rows of one id_ are one."""
    names = _names(publications, key)
    each = rows.select(id_, F.posexplode_outer(candidates).alias("_place", "_n")).withColumn("c", venue_name(F.col("_n"))).where("c != ''").groupBy(id_, "c").agg(F.min("_place").alias("_place"))
    exact = names.groupBy("n").agg(F.min_by("item", "position").alias("_exact")).withColumnRenamed("n", "c")
    asked = each.select("c").distinct().join(exact, "c", "left_anti")
    found = each.join(exact, "c", "left").join(_contained(asked, names).withColumnRenamed("item", "_near"), "c", "left")
    order = F.struct(F.col("_exact").isNull().alias("none"), "_place")
    item = found.where("_exact IS NOT NULL OR _near IS NOT NULL").groupBy(F.col(id_).alias("_key")).agg(F.min_by(F.coalesce("_exact", "_near"), order).alias(key))
    return rows.join(item, F.col(id_).eqNullSafe(F.col("_key")), "left").drop("_key")


# ---------------------------------------------------------------- metadata replies
PAPER = (
    "struct<data:array<struct<paperId:string,corpusId:bigint,title:string,url:string,abstract:string,year:int,venue:string,publicationDate:string,isOpenAccess:boolean,matchScore:double,citationCount:int,referenceCount:int,"
    "publicationVenue:struct<name:string,alternate_names:array<string>>,journal:struct<name:string>>>>"
)
#: Result columns and the reply's fields.
FIELDS = {"paper_id": "paperId", "corpus_id": "corpusId", "matched_title": "title", "url": "url", "abstract": "abstract", "year": "year", "venue": "venue", "publication_date": "publicationDate", "is_open_access": "isOpenAccess", "match_score": "matchScore", "citation_count": "citationCount", "reference_count": "referenceCount"}
NESTED = {"authors_json": "authors", "external_ids_json": "externalIds", "publication_types_json": "publicationTypes", "publication_venue_json": "publicationVenue", "journal_json": "journal", "open_access_pdf_json": "openAccessPdf"}


def reply_error(response: Column) -> Column:
    """Why a metadata reply can't be used; null if it can."""
    data = F.get_json_object(response, "$.data")
    blank = strip(F.coalesce(response, F.lit(""))) == ""
    return F.when(blank, "no reply").when(F.try_parse_json(response).isNull(), "a reply that is no JSON").when(~F.coalesce(F.startswith(data, F.lit("[")), F.lit(False)), "a metadata reply without a list of papers")


def first_paper(response: Column) -> Column:
    """The first paper of a reply; null for an empty list, and where there is no list of papers."""
    return F.when(reply_error(response).isNull(), F.get(parsed(response, PAPER)["data"], F.lit(0)))


def metadata_errors(replies: DataFrame, response: str = "response") -> DataFrame:
    """(conversation_id, error, response) of the replies that give no row: what is put aside to be looked at."""
    return replies.select("conversation_id", reply_error(F.col(response)).alias("error"), F.col(response).alias("response")).where("error IS NOT NULL")


def metadata_rows(replies: DataFrame, publications: DataFrame, response: str = "response") -> DataFrame:
    """One metadata row for each conversation's reply (conversation_id, response): matched or not_found, the paper's
    fields, nested parts as JSON in one form, and abbreviation, category and type of the publication that its venue names
    resolve to. Replies that can't be used give no row, see metadata_errors(). publications: (item, position, abbr,
    full_name, category, type)."""
    p = replies.where(reply_error(F.col(response)).isNull()).withColumn("_p", first_paper(F.col(response)))
    venue, names = F.col("_p.publicationVenue"), F.array("_p.venue", "_p.publicationVenue.name", "_p.journal.name")
    p = p.withColumn("_names", F.filter(F.concat(names, F.coalesce(venue["alternate_names"], F.array())), lambda n: n.isNotNull()))
    # read twice from here on: for the venues and for the rows
    p = store.written(p.select("conversation_id", F.col(response).alias("_response"), "_p", "_names"), "replies")
    p = resolve_candidates(p, publications.withColumnRenamed("item", "_item"), "conversation_id", "_names", "_item")
    out = p.join(F.broadcast(publications.select(F.col("item").alias("_item"), "abbr", "category", "type")), "_item", "left")
    nested = [canonical_json(F.get_json_object("_response", f"$.data[0].{v}")).alias(k) for k, v in NESTED.items()]
    rank = [F.coalesce("abbr", F.lit("")).alias("venue_abbr"), F.coalesce("category", F.lit("None")).alias("ccf_category"), F.coalesce("type", F.lit("None")).alias("ccf_type")]
    return out.select("conversation_id", F.when(F.col("_p").isNotNull(), "matched").otherwise("not_found").alias("status"), *(F.col(f"_p.{v}").alias(k) for k, v in FIELDS.items()), *rank, *nested, canonical_json(F.col("_response")).alias("raw_response_json"), F.lit("semantic_scholar").alias("source"))


def abstracts(papers: DataFrame, messages: DataFrame, metadata: DataFrame) -> DataFrame:
    """(conversation_id, title, abstract, origin): what a paper's tags are chosen by. The abstract is that of the first
    reply that is not blank, else that of the metadata; origin says which, none if there is neither. papers: id, title,
    original_filename (the title's stand-in); messages: conversation_id, id, message_kind, content."""
    said = messages.where((F.col("message_kind") == "bot_reply") & (strip(F.coalesce("content", F.lit(""))) != ""))
    first = said.groupBy("conversation_id").agg(F.min_by("content", "id").alias("_said")).select("conversation_id", abstract(F.col("_said")).alias("_own"))
    known = metadata.select("conversation_id", compact(F.coalesce("abstract", F.lit(""))).alias("_other"))
    title = F.coalesce(F.nullif(strip(F.coalesce("title", F.lit(""))), F.lit("")), F.col("original_filename"), F.lit(""))
    p = papers.select(F.col("id").alias("conversation_id"), title.alias("title")).join(first, "conversation_id", "left").join(known, "conversation_id", "left")
    own, other = (F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in ("_own", "_other"))
    origin = F.when(own.isNotNull(), "reply").when(other.isNotNull(), "metadata").otherwise("none")
    return p.select("conversation_id", "title", F.coalesce(own, other, F.lit("")).alias("abstract"), origin.alias("origin"))


def refresh_metadata(papers: DataFrame, messages: DataFrame, metadata: DataFrame, tags: DataFrame, replies: DataFrame, publications: DataFrame, tag_replies: DataFrame, definitions: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(metadata, abstracts, tags, errors) after papers were looked up anew.

    replies: conversation_id, response. A reply that can't be used leaves the paper's row as it is and gives an error row;
    the others replace it, created_at apart. tag_replies: conversation_id, reply (a classifier's answer). Known codes in
    it replace a paper's tags; without any, or without a title or an abstract to ask by, they stay.
    """
    now = F.current_timestamp() if now is None else now
    new = metadata_rows(replies, publications).withColumns({"created_at": now, "updated_at": now})
    known = writes.upsert(metadata, new.select(*metadata.columns), "conversation_id")
    asked = abstracts(papers, messages, known)
    could = asked.where("title <> '' AND abstract <> ''").select("conversation_id")
    codes = tag_replies.join(could, "conversation_id", "left_semi").select("conversation_id", F.explode(tag_codes(F.col("reply"))).alias("tag_code"))
    found = search.resolved_tags(codes, definitions, "poe")
    after = writes.replace_by_key(tags, found.select("conversation_id").distinct(), found.select(*tags.columns), "conversation_id")
    return known, asked, after, metadata_errors(replies)
