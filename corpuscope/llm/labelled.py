"""Folds and bounded samples of labelled rows, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """About limit rows at most, chosen by a hash of key: all rows of a small table, an even share of a large one."""
    n = rows.count()
    share = 1 << 30
    return rows if n <= limit else rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(share)) < int(share * limit / n))


def bounded(docs: DataFrame, chosen: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """Of a bounded sample, the rows whose texts take at most so many bytes together: the first by a hash of the id."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    sizes = docs.select(key, size.alias("size")).join(F.broadcast(chosen.select(key)), key).groupBy(key).agg(F.sum("size").alias("size")).withColumn("order", F.xxhash64(key, F.lit("bytes")))
    rows = sorted(sizes.collect(), key=lambda r: (r.order, r[key]))  # an id and a size for each row of the sample
    if sum(r.size for r in rows) <= most:
        return chosen
    kept, total = [], 0
    for r in rows:
        total += r.size
        if total > most:
            break
        kept.append(r[key])
    return chosen.where(F.col(key).isin(*kept)) if kept else chosen.limit(0)


def with_text(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The texts of a bounded sample (doc_id, ...), which is small by its limit and hence broadcast."""
    return docs.select(doc_id, text).join(F.broadcast(chosen), doc_id)
