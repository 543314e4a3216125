"""Catalogue filters: sets of tags, categories with a missing one, venues and years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("A", "B", "C", "None")


def normalised(values, upper: bool = False) -> list[str]:
    """Trimmed, without blanks and repeats, in order."""
    found = (str(v).strip().upper() if upper else str(v).strip() for v in values or [] if v is not None)
    return list(dict.fromkeys(v for v in found if v))


def years(values) -> list[int]:
    out = []
    for v in normalised(values):
        try:
            out.append(int(v))
        except ValueError:
            continue
    return list(dict.fromkeys(out))


def having_all_tags(tags: DataFrame, codes, key: str = "conversation_id") -> DataFrame:
    """Keys that have every one of the codes. The codes are filtered at the scan; each task counts before the shuffle."""
    codes = normalised(codes, upper=True)
    return tags.where(F.col("tag_code").isin(*codes)).groupBy(key).agg(F.count_distinct("tag_code").alias("n")).where(F.col("n") == len(codes)).select(key)


def by_tags(papers: DataFrame, tags: DataFrame, codes) -> DataFrame:
    return papers.join(having_all_tags(tags, codes), F.col("id") == F.col("conversation_id"), "left_semi") if normalised(codes) else papers


def by_category(papers: DataFrame, metadata: DataFrame, wanted) -> DataFrame:
    """Papers of any wanted category; None also means papers without metadata. Unknown categories are ignored."""
    wanted = [c for c in normalised(wanted) if c in CATEGORIES]
    if not wanted:
        return papers
    named = F.max(F.col("ccf_category").isin(*wanted))
    known = metadata.groupBy("conversation_id").agg(named.alias("_hit"))
    hit = F.coalesce(F.col("_hit"), F.lit(False)) if "None" not in wanted else F.coalesce(F.col("_hit"), F.col("conversation_id").isNull())
    return papers.join(known, F.col("id") == F.col("conversation_id"), "left").where(hit).select(*papers.columns)


def by_venue(papers: DataFrame, venues: DataFrame, wanted) -> DataFrame:
    wanted = normalised(wanted)
    return papers.join(venues.where(F.col("venue_abbr").isin(*wanted) | F.col("venue").isin(*wanted)), F.col("id") == F.col("conversation_id"), "left_semi") if wanted else papers


def by_year(papers: DataFrame, venues: DataFrame, wanted) -> DataFrame:
    wanted = years(wanted)
    return papers.join(venues.where(F.col("year").isin(*wanted)), F.col("id") == F.col("conversation_id"), "left_semi") if wanted else papers


def filtered(papers: DataFrame, tags: DataFrame, metadata: DataFrame, venues: DataFrame, tag_codes=(), categories=(), venue_names=(), year_values=()) -> DataFrame:
    """All filters at once; each asks for some row of its own, so different rows of a paper may answer different ones."""
    return by_year(by_venue(by_category(by_tags(papers, tags, tag_codes), metadata, categories), venues, venue_names), venues, year_values)


def unprocessed(rows: DataFrame, done: DataFrame, key: str, done_key: str) -> DataFrame:
    return rows.join(done.select(F.col(done_key).alias(key)), key, "left_anti")


# ---------------------------------------------------------------- rows by key
def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, by a filter that reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def first_rows(rows: DataFrame, key: str, order: str = "id", last: bool = False) -> DataFrame:
    """One row of each key, whole: the first by order, or the last. Counted before the shuffle, so frequent keys are cheap."""
    rest = [c for c in rows.columns if c != key]
    pick = F.max_by if last else F.min_by
    return rows.groupBy(key).agg(pick(F.struct(*rest), order).alias("_r")).select(*((F.col(key) if c == key else F.col(f"_r.{c}").alias(c)) for c in rows.columns))


def select_slice(rows: DataFrame, order: str, descending: bool = False, limit: int | None = None, offset: int = 0, **equals) -> DataFrame:
    """Rows with the given values (None: any), by one column up or down, from an offset on and at most limit; negative
    numbers count as 0. Empty texts count as not given, numbers do."""
    for name, value in equals.items():
        if value is not None and value != "":
            rows = rows.where(F.col(name) == F.lit(value))
    rows = rows.orderBy(F.desc(order) if descending else F.asc(order)).offset(max(0, offset))
    return rows if limit is None else rows.limit(max(0, limit))


def columns_of(rows: DataFrame) -> DataFrame:
    """(position, name, type, nullable) of a table's columns."""
    return rows.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(rows.schema)], "position int, name string, type string, nullable boolean")
