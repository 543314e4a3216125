"""Readers: tables, files with fingerprints, JSON texts, HTML tables, and the catalogue's views of the given tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.text import compact, strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- the catalogue over the given tables
def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("n_chars").alias("created_at"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of papers with labels only, so that some papers have none."""
    category = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "A").when((F.col("quality") == 0) & (F.col("toxic") == 0), "B").when((F.col("quality") == 0) & (F.col("toxic") == 1), "C").otherwise("None")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conversation_id"), category.alias("ccf_category"))


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("conversation_id"), F.col("source").alias("venue"), F.when(F.col("lang") == "en", F.upper("source")).otherwise("").alias("venue_abbr"), (2015 + F.col("doc_id") % 10).cast("int").alias("year"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("conversation_id"), F.col("l_returnflag").alias("tag_code"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "bot_reply").when(F.col("role") == "system", "system_prompt").otherwise("user_message")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("id"), kind.alias("message_kind"), F.when(F.col("turn") % 5 == 0, "").otherwise(F.col("text")).alias("content"))


# ---------------------------------------------------------------- files and texts
def files(spark: SparkSession, path: str, extension: str = "pdf") -> DataFrame:
    """Non-empty files with the extension (in any case), with the fingerprint of their bytes."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read.where((F.col("length") > 0) & F.endswith(F.lower("path"), F.lit(f".{extension}"))).withColumn("fingerprint", F.sha2("content", 256))


def file_stream(spark: SparkSession, path: str, extension: str = "pdf") -> DataFrame:
    """The same of a folder that files are put into, as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    return read.where((F.col("length") > 0) & F.endswith(F.lower("path"), F.lit(f".{extension}"))).withColumn("fingerprint", F.sha2("content", 256))


def tag_tree(spark: SparkSession, path: str) -> DataFrame:
    """A taxonomy file: a JSON list of categories (code, label, label_en, tags), or an object with it under categories."""
    tag = "array<struct<code:string,label:string,label_en:string>>"
    fields = f"struct<code:string,label:string,label_en:string,tags:{tag}>"
    text = spark.read.text(path, wholetext=True).withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    listed = F.coalesce(F.get_json_object("value", "$.categories"), F.col("value"))
    return text.select(F.explode(F.from_json(listed, f"array<{fields}>")).alias("c")).select("c.*")


def venue_file(spark: SparkSession, path: str) -> DataFrame:
    """A venue list file, a JSON list of objects: (item, position, abbr, full_name, category, type, field)."""
    fields = "array<struct<abbr:string,full_name:string,category:string,type:string,field:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", fields)).alias("position", "v"))
    return rows.select(F.col("position").cast("string").alias("item"), "position", "v.*")


def artifact_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON files (path, value, error): the text without a byte order mark; error says if it is no JSON object."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    return rows.withColumn("error", F.when(~F.coalesce(F.startswith(json_kind(F.col("value")), F.lit("OBJECT")), F.lit(False)), "the input must be a JSON object"))


def json_kind(c, path: str = "$") -> F.Column:
    """What stands at a path of a JSON text: OBJECT<...>, ARRAY<...>, STRING and so on; null if nothing does."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), path, "variant"))


def shape_errors(c, objects: tuple[str, ...] = (), lists: tuple[str, ...] = (), texts: tuple[str, ...] = ()) -> F.Column:
    """What is wrong with the fields of a JSON object, as texts in the order of the fields given: objects and lists must be
    such, texts must be there and not blank."""
    kind = lambda f: F.coalesce(json_kind(c, f"$.{f}"), F.lit(""))
    blank = lambda f: F.coalesce(F.regexp_replace(F.get_json_object(c, f"$.{f}"), r"(?U)\s+", ""), F.lit("")) == ""
    found = [F.when(~F.startswith(kind(f), F.lit("OBJECT")), f"field '{f}' must be an object") for f in objects]
    found += [F.when(~F.startswith(kind(f), F.lit("ARRAY")), f"field '{f}' must be a list") for f in lists]
    found += [F.when(blank(f), f"{f} is required") for f in texts]
    return F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array().cast("array<string>")


def with_path_errors(rows: DataFrame, field: str, known: DataFrame) -> DataFrame:
    """rows with path_error: whether the path in a field is given and names a file. known: path and is_file of what there
    is, as a listing of the store gives it; paths are compared as they are, without their scheme."""
    plain = lambda c: F.regexp_replace(c, r"^[a-z0-9+.-]+:/+", "/")
    there = known.select(plain(F.col("path")).alias("_path"), F.col("is_file").alias("_is_file")).groupBy("_path").agg(F.max("_is_file").alias("_is_file"))
    said = strip(F.coalesce(F.col(field), F.lit("")))
    out = rows.withColumn("_path", plain(said)).join(there, "_path", "left")
    error = F.when(said == "", f"{field} is required").when(F.col("_is_file").isNull(), F.concat(F.lit(f"{field} does not exist: "), said)).when(~F.col("_is_file"), F.concat(F.lit(f"{field} must be a file: "), said))
    return out.withColumn("path_error", error).drop("_path", "_is_file")


def from_base64(c) -> F.Column:
    """Bytes of a base64 text; null where it is no base64."""
    return F.try_to_binary(c, F.lit("base64"))


class _Tables(HTMLParser):
    """Cells of all table rows, with white space made single; only within the element of an id if one is given."""

    def __init__(self, element_id: str | None):
        super().__init__()
        self.element_id, self.depth, self.rows, self.row, self.cell = element_id, 0 if element_id else 1, [], None, None

    def handle_starttag(self, tag, attrs):
        if self.element_id and tag == "div" and (self.depth or dict(attrs).get("id") == self.element_id):
            self.depth += 1
        if self.depth and tag == "tr":
            self.row = []
        elif self.row is not None and tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if self.element_id and tag == "div" and self.depth:
            self.depth -= 1
        if tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if any(self.row):
                self.rows.append(self.row)
            self.row = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def table_rows(html: str, element_id: str | None = None) -> list[list[str]]:
    parser = _Tables(element_id)
    parser.feed(html)
    return parser.rows


# A comment, a tag, text between tags, or a lone sign; names of tags; the signs that texts write as entities (fixed values).
HTML_TOKEN, HTML_NAME = r"(?s)<!--.*?-->|<[/!?]?[a-zA-Z][^>]*>|[^<]+|<", r"^<(/?[a-zA-Z][a-zA-Z0-9]*)"
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "amp": "&"}
_ROWS = "struct<depth:int,row:array<string>,cell:string,rows:array<array<string>>>"


def unescaped(c) -> F.Column:
    """A text with numeric and common entities as the characters they stand for."""

    def one(t: F.Column) -> F.Column:
        code = F.when(t.rlike("^&#[xX]"), F.conv(F.regexp_extract(t, "^&#[xX]([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(t, "^&#([0-9]+);", 1)).try_cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(t.rlike("^&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});$") & (code > 0) & (code < 0x110000), char).otherwise(t)

    parts = F.regexp_extract_all(c, F.lit(r"&#[0-9xX][0-9a-fA-F]*;|[^&]+|&"), F.lit(0))
    out = F.when(F.contains(c, F.lit("&#")), F.array_join(F.transform(parts, one), "")).otherwise(c)
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return out


def html_rows(pages: DataFrame, key: str, html: str = "html", element_id: str | None = None) -> DataFrame:
    """(key, row_no, cells) of each row of a page's tables that has a cell with text; element_id: only of those within the
    div of this id. A cell goes from its tag to its end tag, runs of white space being one blank; one that is not ended
    before the next begins is lost. Scripts and styles have no text. A page is cut into tags and texts, and these are gone
    through once, by expressions."""
    whole = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>)", "$1$3")
    named = lambda t: F.struct(t.alias("t"), F.lower(F.regexp_extract(t, HTML_NAME, 1)).alias("name"))
    tokens = F.transform(F.regexp_extract_all(whole, F.lit(HTML_TOKEN), F.lit(0)), named)
    opens = F.lit(False)
    if element_id:
        opens = lambda t: t.rlike(rf"(?is)^<div\b[^>]*?\bid\s*=\s*[\"']?{re.escape(element_id)}[\"']?[\s/>]")

    def step(s: F.Column, x: F.Column) -> F.Column:
        t, name = x["t"], x["name"]
        depth = s["depth"]
        if element_id:
            depth = F.when((name == "div") & ((depth > 0) | opens(t)), depth + 1).when((name == "/div") & (depth > 0), depth - 1).otherwise(depth)
        text = F.when(name == "", F.when(F.startswith(t, F.lit("<!--")), "").otherwise(unescaped(t)))
        cell_ends, row_ends = name.isin("/td", "/th") & s["cell"].isNotNull(), (name == "/tr") & s["row"].isNotNull()
        cell_ends_row = F.concat(s["row"], F.array(compact(s["cell"])))
        starts = (name == "tr") & (depth > 0)
        none = F.lit(None).cast("string")
        row = F.when(starts, F.array().cast("array<string>")).when(cell_ends, cell_ends_row).when(row_ends, F.lit(None).cast("array<string>")).otherwise(s["row"])
        cell = F.when(~starts & name.isin("td", "th") & s["row"].isNotNull(), "").when(cell_ends, none).when(s["cell"].isNotNull() & text.isNotNull(), F.concat(s["cell"], text)).otherwise(s["cell"])
        rows = F.when(row_ends & ~cell_ends & F.exists(F.coalesce(s["row"], F.array().cast("array<string>")), lambda v: v != ""), F.concat(s["rows"], F.array(s["row"]))).otherwise(s["rows"])
        return F.when(name.isin("div", "/div", "tr", "/tr", "td", "/td", "th", "/th", ""), F.struct(depth.cast("int").alias("depth"), row.alias("row"), cell.alias("cell"), rows.alias("rows")).cast(_ROWS)).otherwise(s)

    first = F.struct(F.lit(0 if element_id else 1).alias("depth"), F.lit(None).cast("array<string>").alias("row"), F.lit(None).cast("string").alias("cell"), F.array().cast("array<array<string>>").alias("rows")).cast(_ROWS)
    return pages.select(key, F.posexplode(F.aggregate(tokens, first, step)["rows"]).alias("row_no", "cells"))


# How the list writes its two types.
VENUE_TYPES = {"会议": "conference", "期刊": "journal"}


def venue_list(pages: DataFrame, key: str, html: str = "html", element_id: str | None = None) -> DataFrame:
    """Venues of a scraped list: rows of six cells or more, without headers: abbr, full_name, category, type, field."""
    rows = html_rows(pages, key, html, element_id).where(F.size("cells") >= 6)
    cell = lambda i: F.get("cells", F.lit(i))
    kind = F.coalesce(*(F.when(F.contains(cell(4), F.lit(k)), v) for k, v in VENUE_TYPES.items()))
    return rows.select(key, "row_no", cell(1).alias("abbr"), cell(2).alias("full_name"), cell(3).alias("category"), kind.alias("type"), cell(5).alias("field")).where(F.col("type").isNotNull())
