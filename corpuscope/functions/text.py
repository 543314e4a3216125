"""Text rules of the catalogue as Column expressions: message kinds, sections, unit hierarchies, names and codes.

White space and line ends are meant in the Unicode sense, so trimming goes through regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE_KINDS = ("system_prompt", "continue_command", "user_message", "bot_reply")
CONTINUE = "继续"
# Titles that only wrap other units.
WRAPPERS = ("appendix", "appendices", "supplementary material", "supplementary materials", "supplementary", "supplemental material", "supplemental materials", "supplemental")
# Headings of sections; the last two kinds are the same with and without heading marks.
HEADINGS = {
    "abstract": r"(摘要|abstract)",
    "acknowledgements": r"(致谢|acknowledg(?:e)?ments?)",
    "references": r"(参考文献|references?|bibliography)",
    "appendix": r"(附录|appendix|supplement(?:ary|al)?(?:\s+material)?)",
}
STATUS_JSON = r"(?s)\[TRANSLATION_STATUS_JSON\]\s*(\{.*?\})\s*\[/TRANSLATION_STATUS_JSON\]"
STATUS_OLD = r"(?s)\[TRANSLATION_STATUS\]\s*(.*?)\s*\[/TRANSLATION_STATUS\]"
SEPARATOR = r"^\s*[-*_—]{3,}\s*$"
STATUS_TYPE = "current_unit_id string, state string, reason string"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, also where body reads it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends; found from the ends, as a search for it would try each place of a long text."""
    return F.regexp_extract(c, r"(?sU)\A\s*+(.*\S)", 1)


def squeezed(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def compact(c: Column) -> Column:
    """Runs of white space as one blank."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def lines(c: Column) -> Column:
    return F.split(c, r"\R")


def ordered_set(values: Column, upper: bool = False) -> Column:
    """Trimmed, without blanks and repeats, in the order of first sight. Null stays null."""
    each = F.transform(values, lambda x: F.upper(strip(x)) if upper else strip(x))
    return F.array_distinct(F.filter(each, lambda x: x.isNotNull() & (x != "")))


def default_if_blank(c: Column, value: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(value))


# ---------------------------------------------------------------- messages
def message_kind(c: Column) -> Column:
    """The kind, if it is a known one."""
    low = F.lower(strip(c))
    return F.when(low.isin(*MESSAGE_KINDS), low)


def role_of_kind(kind: Column) -> Column:
    return F.when(message_kind(kind) == "bot_reply", "bot").otherwise("user")


def inferred_kind(kind: Column, type_: Column, role: Column, content: Column, prompts: tuple[str, ...] = ()) -> Column:
    """A known kind, else a known type, else by role, else by what is said."""
    said = squeezed(F.coalesce(content, F.lit("")))
    prompts = tuple("".join(p.split()) for p in prompts if p)
    by_text = F.when(said == CONTINUE, "continue_command")
    if prompts:
        by_text = by_text.when(said.isin(*prompts), "system_prompt")
    bot = F.lower(strip(F.coalesce(role, F.lit("")))) == "bot"
    return F.coalesce(message_kind(kind), message_kind(type_), F.when(bot, "bot_reply").otherwise(by_text.otherwise("user_message")))


def visible(kind: Column) -> Column:
    return kind.isin("bot_reply", "user_message")


def message_metadata(kind: Column, type_: Column, role: Column, content: Column, prompts: tuple[str, ...] = ()) -> Column:
    """(message_kind, role, visible_to_user) of a message, by what is known of it."""
    return let(inferred_kind(kind, type_, role, content, prompts), lambda k: F.struct(k.alias("message_kind"), role_of_kind(k).alias("role"), visible(k).alias("visible_to_user")))


def summary(c: Column, blank: str, limit: int = 200) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(strip(text) == "", blank).when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def status_block(c: Column) -> Column:
    """The status that a reply reports in its block; null without a block or with an unknown state."""
    parsed = F.from_json(F.nullif(F.regexp_extract(c, STATUS_JSON, 1), F.lit("")), STATUS_TYPE)
    state = F.upper(strip(F.coalesce(parsed["state"], F.lit(""))))
    clean = lambda f: strip(F.coalesce(parsed[f], F.lit(""))).alias(f)
    return F.when(state.isin("OK", "UNSUPPORTED"), F.struct(clean("current_unit_id"), state.alias("state"), clean("reason")))


def without_status_block(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), STATUS_JSON, ""))


def section(c: Column) -> Column:
    """The first section heading among the meaningful lines, else body; null for blank texts and separators alone."""

    def category(line: Column) -> Column:
        out = None
        for name, words in HEADINGS.items():
            tail, plain = (r"\b", r"\b") if name == "appendix" else (r"\s*$", r"\s*[:：]?\s*$")
            is_ = line.rlike(rf"(?iU)^(?:#{{1,6}}\s*{words}{tail}|{words}{plain})")
            out = F.when(is_, name) if out is None else out.when(is_, name)
        return out

    any_ = "|".join(rf"(?:#{{1,6}}\s*)?{words}" for words in HEADINGS.values())
    text = F.regexp_replace(F.coalesce(c, F.lit("")), STATUS_OLD, "")
    rows = lambda x: F.filter(F.transform(lines(x), strip), lambda r: (r != "") & ~r.rlike(SEPARATOR))
    found = lambda kept: F.get(F.filter(F.transform(F.filter(kept, lambda r: r.rlike(f"(?iU)^(?:{any_})")), category), lambda r: r.isNotNull()), F.lit(0))
    return let(rows(text), lambda kept: F.when(F.size(kept) > 0, F.coalesce(found(kept), F.lit("body"))))


def message_section(shown: Column, scope: Column, content: Column) -> Column:
    """(section, source): by the text as shown, else by the scope of its status, else by the stored text."""
    stored = F.regexp_replace(F.coalesce(content, F.lit("")), STATUS_OLD, "")
    low = F.lower(strip(F.coalesce(scope, F.lit(""))))
    # Sections by scope.
    by_scope = F.when(low.isin("body", "appendix", "acknowledgements", "references"), low)
    made = lambda s, source: F.struct(s.alias("section"), F.lit(source).alias("source"))
    tries = lambda t: F.when(t["a"].isNotNull(), made(t["a"], "display_content")).when(t["b"].isNotNull(), made(t["b"], "translation_status.active_scope")).when(t["c"].isNotNull(), made(t["c"], "original_content")).otherwise(made(F.lit(None).cast("string"), "empty"))
    return let(F.struct(section(F.coalesce(shown, stored)).alias("a"), by_scope.alias("b"), section(stored).alias("c")), tries)


# ---------------------------------------------------------------- units
def hierarchy_prefix(c: Column) -> Column:
    """The numbering that a unit's title starts with, in lower case; empty without one and for split units."""
    text = strip(F.coalesce(c, F.lit("")))
    rules = (r"(?i)^(appendix\s+[a-z0-9]+(?:\.\d+)*)\b", r"(?i)^([a-z](?:\.\d+)+)\b", r"(?i)^([a-z])\.\s+", r"^(\d+(?:\.\d+)*)\b", r"(?i)^([ivxlcdm]+)\.\s+")
    found = F.coalesce(*(F.nullif(F.regexp_extract(text, r, 1), F.lit("")) for r in rules), F.lit(""))
    return F.when(F.contains(text, F.lit("::")), "").otherwise(F.lower(found))


def is_wrapper(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", " ")).isin(*WRAPPERS)


def top_units(units: Column) -> Column:
    return let(units, _top_units)


def _top_units(units: Column) -> Column:
    """Units without those split further, without wrapper titles (unless all are), and without numbered descendants. Each
    unit's numbering is found once."""
    tagged = F.transform(units, lambda u: F.struct(u.alias("u"), hierarchy_prefix(u).alias("p"), is_wrapper(u).alias("w")))
    whole = lambda rows: F.filter(rows, lambda r: ~F.exists(rows, lambda o: (o["u"] != r["u"]) & F.startswith(o["u"], F.concat(r["u"], F.lit(" :: ")))))
    named = lambda rows: F.when((F.size(rows) > 1) & F.exists(rows, lambda r: ~r["w"]), F.filter(rows, lambda r: ~r["w"])).otherwise(rows)
    top = lambda rows: F.filter(rows, lambda r: ~F.exists(rows, lambda o: (o["u"] != r["u"]) & (o["p"] != "") & F.startswith(r["p"], F.concat(o["p"], F.lit(".")))))
    kept = let(tagged, lambda t: let(whole(t), lambda w: let(named(w), top)))
    return F.when(F.size(units) <= 1, units).otherwise(F.transform(kept, lambda r: r["u"]))


# ---------------------------------------------------------------- names and codes
def venue_name(c: Column) -> Column:
    """A venue's name without case, marks and common words."""
    text = F.regexp_replace(F.replace(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    # fixed values: common words of venues
    text = F.regexp_replace(text, r"\b(the|of|on|for|annual|international|ieee|acm|cvf)\b", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def codes(c: Column, pattern: str, known: tuple[str, ...] | None = None) -> Column:
    """Codes in a reply, in upper case and order of first sight; only known ones if these are given."""
    found = F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(1)))
    return F.filter(found, lambda x: x.isin(*known)) if known is not None else found


def category_codes(c: Column, known: tuple[str, ...] | None = None) -> Column:
    return codes(c, r"\b([A-Z])\b", known)


def tag_codes(c: Column, known: tuple[str, ...] | None = None) -> Column:
    return codes(c, r"\b([LMTSAP]\d{1,2})\b", known)


def cut_at_word(c: Column, limit: int) -> Column:
    """At most limit characters, back to the last blank if one is cut off."""
    head = F.regexp_replace(F.substring(c, 1, limit), r"(?U)\s+$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.regexp_replace(head, r" [^ ]*$", ""))


def abstract(c: Column, limit: int = 1200) -> Column:
    """The abstract at the start of a reply: without code, headings and list marks, up to the next heading."""
    rows = F.filter(F.transform(lines(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)```.*?```", " ")), strip), lambda x: x != "")
    head = r"(?i)^(?:#{1,6}\s*(?:摘要|abstract)\s*|(?:摘要|abstract)\s*[:：]?\s*)$"
    own = lambda r: F.filter(r, lambda x: ~x.rlike(head))
    stop = lambda o: F.array_position(F.transform(o, lambda x, i: (i > 0) & x.rlike(r"^#{1,6}\s+")), True)
    upto = lambda o: let(stop(o), lambda s: F.when(s > 0, F.slice(o, F.lit(1), (s - 1).cast("int"))).otherwise(o))
    joined = lambda r: let(let(own(r), upto), lambda k: F.array_join(F.when(F.size(k) > 0, F.transform(k, lambda x: F.regexp_replace(x, r"^[*-]\s*", ""))).otherwise(r), " "))
    return let(compact(let(rows, joined)), lambda t: cut_at_word(t, limit))


def whole_number(c: Column) -> Column:
    """A number as a whole one: fractions of numbers are cut off, texts must be whole numbers, with or without a sign; else
    null, also for what a long cannot hold."""
    return F.coalesce(F.nullif(F.regexp_extract(c.cast("string"), r"^\s*([+-]?\d+)\s*$", 1), F.lit("")).try_cast("long"), F.when(F.typeof(c).isin("double", "float") | F.startswith(F.typeof(c), F.lit("decimal")), c.try_cast("long")))


def safe_int(c: Column, default: int, least: int) -> Column:
    """whole_number() in the range of an int and at least least; else the default."""
    return F.greatest(F.coalesce(whole_number(c).try_cast("int"), F.lit(default)), F.lit(least))


# ---------------------------------------------------------------- numbers
def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The distance of two intervals on a line; 0 if they touch or overlap."""
    return F.greatest(F.lit(0.0), b0 - a1, a0 - b1)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def _share(c: Column, others: str) -> Column:
    return F.length(F.regexp_replace(c, others, ""))


def digit_ratio(c: Column) -> Column:
    """Digits among all characters; 0 for an empty text."""
    text = F.coalesce(c, F.lit(""))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(_share(text, r"\P{Nd}") / F.length(text))


def is_paragraph(c: Column, n_lines: Column) -> Column:
    """Running text: long, of letters, with marks, on several lines."""
    text = F.coalesce(c, F.lit(""))
    return (F.length(text) >= 120) & (_share(text, r"\P{L}") > 40) & (_share(text, r"[^,.;:()\[\]]") >= 2) & (n_lines >= 3)


def has_line_numbers(rows: Column) -> Column:
    """Lines of a text that mixes in line numbers: many end in two numbers, or many are a number alone."""
    n, letters = F.size(rows), _share(F.array_join(rows, ""), r"\P{L}")
    ends = F.size(F.filter(rows, lambda x: x.rlike(r"\b\d{2,4}\s+\d{2,4}\s*$")))
    alone = F.size(F.filter(rows, lambda x: x.rlike(r"^\d{2,4}$")))
    return (n >= 4) & (letters > 40) & ((ends >= F.greatest(F.lit(3), F.floor(n / 2))) | (alone >= F.greatest(F.lit(3), F.floor(n / 3))))


# ---------------------------------------------------------------- captions
# How figures and tables are named.
FIGURE, TABLE = r"(?:fig(?:ure)?\.?\s*(?:\d+|[ivxlcdm]+)[a-z]?)|(?:图\s*\d+[a-z]?)", r"(?:table\.?\s*(?:\d+|[ivxlcdm]+)[a-z]?)"


def caption_label(c: Column, name: str = FIGURE) -> Column:
    """The label of a caption: at the start, or after a short prefix without marks; null if it is none."""
    start = F.nullif(F.regexp_extract(c, rf"(?i)^\s*({name})\b", 1), F.lit(""))
    prefix = F.regexp_extract(c, rf"(?is)^(.*?)({name})\s*[:.]?", 1)
    inner = F.nullif(F.regexp_extract(c, rf"(?is)^(.*?)({name})\s*[:.]?", 2), F.lit(""))
    near = (F.length(prefix) <= 48) & (F.length(strip(prefix)) <= 24) & ~prefix.rlike("[.:;!?]")
    return F.coalesce(strip(start), F.when(near, strip(inner)))


def has_caption_suffix(c: Column, name: str = TABLE) -> Column:
    """After the label comes nothing, a mark, a capital or a digit; false without a label at the start."""
    rest = F.regexp_extract(c, rf"(?is)^\s*(?:{name})\b\s*(.*)$", 1)
    return c.rlike(rf"(?i)^\s*(?:{name})\b") & ((rest == "") | rest.rlike(r"(?s)^[.:;,\-(\p{Lu}\p{Nd}].*"))


# ---------------------------------------------------------------- boxes
def near_same(a: dict[str, Column], b: dict[str, Column], tolerance: float = 6.0) -> Column:
    """Boxes (x0, y0, x1, y1) that differ by no more than the tolerance at each edge."""
    out = F.lit(True)
    for edge in ("x0", "y0", "x1", "y1"):
        out = out & (F.abs(a[edge] - b[edge]) <= tolerance)
    return out


def adjacent(a: dict[str, Column], b: dict[str, Column], across: float = 40.0, down: float = 40.0) -> Column:
    """Boxes that overlap in one direction and are near in the other."""
    gaps = {d: gap(a[f"{d}0"], a[f"{d}1"], b[f"{d}0"], b[f"{d}1"]) for d in "xy"}
    meets = {d: overlap(a[f"{d}0"], a[f"{d}1"], b[f"{d}0"], b[f"{d}1"]) > 0 for d in "xy"}
    return (meets["x"] & (gaps["y"] <= down)) | (meets["y"] & (gaps["x"] <= across))


# ---------------------------------------------------------------- retries


def retry_delay(attempt: Column, header: Column | None = None) -> Column:
    """Seconds before the next try: what the server asks for, else twice as long each time, 30 at most."""
    wait = F.least(F.lit(30.0), F.pow(F.lit(2.0), attempt))
    return F.coalesce(header.try_cast("double"), wait) if header is not None else wait


def download_delay(attempt: Column) -> Column:
    return F.least(F.lit(5.0), 2.0 * attempt)


def local_time(c: Column, zone: str) -> Column:
    """A UTC time as ISO text with the zone's offset."""
    shifted = F.from_utc_timestamp(c, zone)
    minutes = ((F.unix_timestamp(shifted) - F.unix_timestamp(c)) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    return F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), sign, F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
