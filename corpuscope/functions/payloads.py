"""Replies and their payloads as Column expressions: plans, glossaries, progress, and what is stored of a reply.

JSON texts are parsed once into typed structs; what is not of the expected shape is null. Values of other types in text
fields are taken as their JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.functions import progress, text
from corpuscope.functions.text import STATUS_JSON, let, ordered_set, strip

# Fixed values.
PLAN_PROTOCOL, GLOSSARY_PROTOCOL = "unit_v1", "glossary_v1"
PLAN_STATES, STATES, SCOPES = ("ok", "unsupported"), ("IN_PROGRESS", "BODY_DONE", "ALL_DONE", "UNSUPPORTED"), ("body", "appendix", "done")
DROPPED_KEYS = ("translation_status", "translation_plan", "translation_glossary", "raw_translation_status", "raw_translation_status_text", "raw_document_outline_text", "parse_error")

ENTRY = "array<struct<term:string,candidates:array<string>,selected:string>>"
PLAN = "struct<status:string,units:array<string>,appendix_units:array<string>,reason:string>"
GLOSSARY = f"struct<status:string,entries:{ENTRY}>"
STATUS = (
    "struct<protocol:string,planner_status:string,active_scope:string,active_units:array<string>,current_unit_id:string,current_unit_index:string,completed_unit_ids:array<string>,remaining_unit_ids:array<string>,"
    "next_unit_id:string,state:string,reason:string,total_unit_count:string,completed_unit_count:string,source:string>"
)


def _word(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def parsed(c: Column, schema: str) -> Column:
    """A JSON text as a struct or array; null if it is empty or no such JSON."""
    return F.from_json(F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit("")), schema)


def key(c: Column, name: str) -> Column:
    """The JSON text of one key of an object."""
    return F.get_json_object(c, f"$.{name}")


def json_or(c: Column, schema: str, default: Column) -> Column:
    """A JSON object as a struct, else the default; bad JSON and other kinds of values give the default."""
    is_object = F.startswith(strip(F.coalesce(c, F.lit(""))), F.lit("{")) & F.try_parse_json(c).isNotNull()
    return F.when(is_object, F.coalesce(F.from_json(c, schema), default)).otherwise(default)


# ---------------------------------------------------------------- JSON texts of one form
# A string with its escapes, a number, a run of blanks, or any other character.
TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*|\s+|[^"]'
NUMBER = "\u0001"  # marks numbers that would be written in another way


def _tokens(c: Column, each) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), each), "")


def spaced_json(c: Column) -> Column:
    """A JSON text without blanks but one after each comma and colon."""
    return _tokens(c, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).when(t.rlike(r"^\s+$"), "").otherwise(t))


def canonical_json(c: Column) -> Column:
    """A JSON text with the keys of all objects in order, at any depth, and one blank after each comma and colon; null if it
    is no JSON, or an object has a key twice. Keys are ordered by UTF-16 code units, numbers stay as they are written, and
    characters are written as such. Equal texts mean equal values."""
    odd = lambda t: t.rlike(r"^-?[0-9]") & t.rlike(r"[.eE]|^-0|[0-9]{19}")
    marked = _tokens(c, lambda t: F.when(odd(t), F.concat(F.lit('"' + r"\u0001"), t, F.lit('"'))).otherwise(t))
    ordered = F.when(F.try_parse_json(c).isNotNull(), F.to_json(F.try_parse_json(marked)))
    mark = F.lit('"' + r"\u0001")
    own = lambda t: F.startswith(t, mark)
    return _tokens(ordered, lambda t: F.when(own(t), F.substring(t, 8, F.length(t) - 8)).when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t))


def iso(c: Column, offset: bool = True) -> Column:
    """A time as ISO text, microseconds only where there are any, and with its offset unless it is a time of no zone."""
    micros = F.when(F.date_format(c, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(c, "SSSSSS"))).otherwise("")
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), micros, F.date_format(c, "xxx") if offset else F.lit(""))


def _dated(c: Column, kind: T.DataType) -> Column:
    """c with all times and dates in it as ISO texts."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso(c, isinstance(kind, T.TimestampType))
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _dated(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _dated(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_dated(c[f.name], f.dataType).alias(f.name) for f in kind)))
    return c


def json_dump(c: Column, kind: T.DataType, ordered: bool = False) -> Column:
    """A struct, array or map of a type as a JSON text, nulls included, times as ISO; ordered: in the canonical form."""
    said = F.to_json(_dated(c, kind), {"ignoreNullFields": "false"})
    return canonical_json(said) if ordered else spaced_json(said)


def without_fences(c: Column) -> Column:
    """The text between a first line of three backticks and a last line of them alone, if both are there."""
    said = strip(F.coalesce(c, F.lit("")))
    inner = F.regexp_extract(said, r"(?s)\A```[^\r\n]*(?:\r\n|[\r\n])(.*?)(?:\r\n|[\r\n])?[ \t]*```\z", 1)
    whole = said.rlike(r"(?s)\A```[^\r\n]*(?:\r\n|[\r\n])(?:.*[\r\n])?[ \t]*```\z")
    return F.when(whole, strip(inner)).otherwise(said)


def unit_ids(c: Column) -> Column:
    return F.coalesce(ordered_set(c), F.array().cast("array<string>"))


# ---------------------------------------------------------------- plans and glossaries
def plan(p: Column) -> Column:
    return let(p, _plan)


def _plan(p: Column) -> Column:
    """(protocol, status, units, appendix_units, reason) of a struct like PLAN; null for an unknown status. A plan without
    units is unsupported, but keeps its appendix."""
    none, status, reason = F.array().cast("array<string>"), F.lower(_word(p["status"])), _word(p["reason"])

    def made(units: Column) -> Column:
        ok, some = status == "ok", F.size(units) > 0
        rest = F.filter(text.top_units(unit_ids(p["appendix_units"])), lambda u: ~F.array_contains(units, u))
        return F.struct(
            F.lit(PLAN_PROTOCOL).alias("protocol"), F.when(ok & some, "ok").otherwise("unsupported").alias("status"), F.when(ok, units).otherwise(none).alias("units"), F.when(ok, rest).otherwise(none).alias("appendix_units"),
            F.when(~ok, reason).when(some, "").otherwise(F.coalesce(F.nullif(reason, F.lit("")), F.lit("no_supported_units"))).alias("reason"),
        )

    return F.when(status.isin(*PLAN_STATES), let(text.top_units(unit_ids(p["units"])), made))


def plan_of_reply(c: Column) -> Column:
    """The plan in a planning reply: under its own key, or the reply itself."""
    own = lambda said: F.coalesce(F.when(F.startswith(key(said, "translation_plan"), F.lit("{")), key(said, "translation_plan")), said)
    return plan(parsed(let(without_fences(c), own), PLAN))


def glossary(g: Column) -> Column:
    return let(g, _glossary)


def _glossary(g: Column) -> Column:
    """(protocol, status, entries) of a struct like GLOSSARY; null stays null. Without entries it is confirmed."""

    def made(entries: Column) -> Column:
        status = F.lower(_word(g["status"]))
        state = F.when(F.size(entries) == 0, "confirmed").when(status.isin("draft", "confirmed"), status).otherwise("draft")
        return F.struct(F.lit(GLOSSARY_PROTOCOL).alias("protocol"), state.alias("status"), entries.alias("entries"))

    return F.when(g.isNotNull(), let(progress.glossary_entries(F.coalesce(g["entries"], F.array().cast(ENTRY))), made))


def glossary_json(c: Column) -> Column:
    """A glossary's JSON, an object or a list of entries, as a struct like GLOSSARY."""
    listed = F.named_struct(F.lit("status"), F.lit(None).cast("string"), F.lit("entries"), parsed(c, ENTRY))
    return F.when(F.startswith(c, F.lit("[")), listed).when(F.startswith(c, F.lit("{")), parsed(c, GLOSSARY))


def glossary_of_reply(c: Column) -> Column:
    """The glossary in a planning reply, under either key; of any other text an empty confirmed one, of none null."""
    said = without_fences(c)
    own = F.coalesce(key(said, "translation_glossary"), key(said, "glossary"))
    empty = F.from_json(F.lit('{"status": "confirmed", "entries": []}'), GLOSSARY)
    listed = F.named_struct(F.lit("status"), F.lit("draft"), F.lit("entries"), parsed(own, ENTRY))
    found = F.when(F.startswith(own, F.lit("[")), listed).when(F.startswith(own, F.lit("{")), parsed(own, GLOSSARY))
    return F.when(said != "", glossary(F.coalesce(found, empty)))


def signature(g: Column) -> Column:
    """Terms and candidates of a normalised glossary, in order: what must not change between draft and confirmation."""
    return F.transform(g["entries"], lambda e: F.struct(e["term"].alias("term"), e["candidates"].alias("candidates")))


# ---------------------------------------------------------------- progress
def _count(c: Column, default: Column) -> Column:
    return F.greatest(F.coalesce(text.whole_number(c), default.cast("long")), F.lit(0)).cast("int")


def stored_status(s: Column) -> Column:
    return let(s, _stored_status)


def _stored_status(s: Column) -> Column:
    """A struct like STATUS with its lists cleaned, counts from 0 on and flags made anew; null for another protocol or an
    unknown state or plan status."""

    def made(lists: Column) -> Column:
        done, left = lists["done"], lists["left"]
        state, scope = F.upper(_word(s["state"])), F.lower(_word(s["active_scope"]))
        return F.struct(
            F.lit(PLAN_PROTOCOL).alias("protocol"), F.lower(_word(s["planner_status"])).alias("planner_status"), F.when(scope.isin(*SCOPES), scope).otherwise("").alias("active_scope"), unit_ids(s["active_units"]).alias("active_units"),
            _word(s["current_unit_id"]).alias("current_unit_id"), F.greatest(F.coalesce(text.whole_number(s["current_unit_index"]), F.lit(-1)), F.lit(-1)).cast("int").alias("current_unit_index"),
            done.alias("completed_unit_ids"), left.alias("remaining_unit_ids"), _word(s["next_unit_id"]).alias("next_unit_id"), state.alias("state"), _word(s["reason"]).alias("reason"),
            _count(s["total_unit_count"], F.size(done) + F.size(left)).alias("total_unit_count"), _count(s["completed_unit_count"], F.size(done)).alias("completed_unit_count"),
            F.coalesce(F.nullif(_word(s["source"]), F.lit("")), F.lit("canonical_payload")).alias("source"), state.isin("BODY_DONE", "ALL_DONE").alias("is_completed"), (state == "ALL_DONE").alias("is_all_done"),
        )

    known = F.coalesce(F.nullif(_word(s["protocol"]), F.lit("")), F.lit(PLAN_PROTOCOL)) == PLAN_PROTOCOL
    valid = known & F.lower(_word(s["planner_status"])).isin(*PLAN_STATES) & F.upper(_word(s["state"])).isin(*STATES)
    return F.when(valid, let(F.struct(unit_ids(s["completed_unit_ids"]).alias("done"), unit_ids(s["remaining_unit_ids"]).alias("left")), made))


# ---------------------------------------------------------------- what is stored
def status_text(c: Column) -> Column:
    """The first status block as it stands in a reply, marks included; null without one."""
    return F.nullif(strip(F.regexp_extract(F.coalesce(c, F.lit("")), STATUS_JSON, 0)), F.lit(""))


def stored_reply(content: Column, payload: Column) -> Column:
    """(content, payload, translation_plan, translation_status, translation_glossary, raw): a reply as it is stored.

    payload: a JSON object's text. The three known parts are normalised, outdated keys go, others stay as they are; the
    status block goes from the text only if it could be read. payload is null where nothing is left of it.
    """
    obj = F.when(F.startswith(strip(F.coalesce(payload, F.lit(""))), F.lit("{")), payload)
    others = F.map_filter(F.try_parse_json(obj).cast("map<string,variant>"), lambda k, _: ~k.isin(*DROPPED_KEYS))

    def made(s: Column) -> Column:
        return F.struct(
            F.when(s["raw"].isNotNull(), text.without_status_block(content)).otherwise(strip(F.coalesce(content, F.lit("")))).alias("content"),
            F.when(s["plan"].isNotNull() | s["status"].isNotNull() | s["glossary"].isNotNull() | (F.size(s["others"]) > 0), s["others"]).alias("others"),
            s["plan"].alias("translation_plan"), s["status"].alias("translation_status"), s["glossary"].alias("translation_glossary"), s["raw"].alias("raw"),
        )

    found = F.struct(
        plan(parsed(key(obj, "translation_plan"), PLAN)).alias("plan"), stored_status(parsed(key(obj, "translation_status"), STATUS)).alias("status"), glossary(glossary_json(key(obj, "translation_glossary"))).alias("glossary"),
        text.status_block(F.coalesce(content, F.lit(""))).alias("raw"), F.coalesce(others, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))).alias("others"),
    )
    return let(found, made)


def payload_json(stored: Column) -> Column:
    """The payload of stored_reply() as a JSON text: the normalised parts, and other keys with the values that they had."""
    parts = F.to_json(F.struct(*(stored[k].alias(k) for k in ("translation_plan", "translation_status", "translation_glossary"))))
    return F.when(stored["others"].isNotNull(), F.to_json(F.map_concat(stored["others"], F.parse_json(parts).cast("map<string,variant>"))))


def envelope(reply: Column, stored: Column) -> Column:
    """What a caller gets of a reply: the reply itself, the cleaned text to show and to store, and the normalised parts."""
    own = [stored[k].alias(k) for k in ("translation_plan", "translation_status", "translation_glossary")]
    return F.struct(reply.alias("reply"), stored["content"].alias("content"), stored["content"].alias("display_reply"), F.lit(None).cast("string").alias("section_category"), *own)


def json_list(values: Column) -> Column:
    """Texts as a JSON list with a blank after each comma, characters as they are."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, _quoted), ", "), F.lit("]"))


def _quoted(v: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(v)), r"(?s)\A\[(.*)\]\z", "$1")


def unit_prompt(template: Column, units: Column, current: Column, g: Column | None = None) -> Column:
    """A template with the units, the current unit and the confirmed terms (of a normalised glossary) put in."""
    said = F.replace(F.replace(_word(template), F.lit("<<ACTIVE_UNITS_JSON>>"), json_list(units)), F.lit("<<CURRENT_UNIT_ID>>"), _word(current))
    pair = lambda e: F.concat(F.lit('{"term": '), _quoted(e["term"]), F.lit(', "translation": '), _quoted(e["selected"]), F.lit("}"))
    terms = F.lit("[]") if g is None else F.coalesce(F.when(g["status"] == "confirmed", F.concat(F.lit("["), F.array_join(F.transform(g["entries"], pair), ", "), F.lit("]"))), F.lit("[]"))
    return strip(F.replace(said, F.lit("<<CONFIRMED_GLOSSARY_JSON>>"), terms))


def errors(c: Column) -> Column:
    """(skill, type, message, retryable) of a list of errors; what is no object goes, texts are trimmed."""
    rows = F.from_json(c, "array<string>")
    kept = F.filter(rows, lambda r: F.startswith(strip(r), F.lit("{")))
    each = lambda r: F.struct(*(_word(key(r, k)).alias(k) for k in ("skill", "type", "message")), F.coalesce(~F.lower(_word(key(r, "retryable"))).isin("", "false", "0", "null", "[]", "{}"), F.lit(False)).alias("retryable"))
    return F.coalesce(F.transform(kept, each), F.array().cast("array<struct<skill:string,type:string,message:string,retryable:boolean>>"))
