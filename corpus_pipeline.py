"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each stage's rows as
Parquet in the shared folder and reads them back. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import saved, table
from corpuscope.llm.decontaminate import decontaminate
from corpuscope.llm.neardup import near_duplicates
from corpuscope.llm.packing import pack
from corpuscope.llm.repeats import KEY, remove_repeats, text_keys
from corpuscope.llm.toxicity import score_toxicity

#: SQL has no trained network, no byte suffixes and no tokenizer; the stages are tested one by one and as a whole.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold. Null texts are harmless; all labelled documents may be learnt from."""
    own = [c for c in docs.columns if c in ("score", "predicted")]  # columns of the input that are named like results
    scored = score_toxicity(docs.withColumnsRenamed({c: f"_{c}" for c in own}), table(spark, sf_dir, "labels"), F.lit(True))
    return scored.where("predicted = 0").drop("score", "predicted").withColumnsRenamed({f"_{c}": c for c in own}).select(*docs.columns)


def _key(seed: int):
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _row, a number for each pair of doc_id and text. Pairs that would share one, as some among very many do,
    are told by a second hash and get another; the driver holds no more than the numbers that are shared."""
    row, seed = _key(0), 2
    while True:
        both = docs.select(row.alias("_row"), _key(1).alias("_other")).groupBy("_row").agg(F.min("_other").alias("a"), F.max("_other").alias("b"))
        shared = [r[0] for r in both.where("a < b").select("_row").collect()]
        if not shared:
            return docs.withColumn("_row", row)
        row, seed = F.when(row.isin(*shared), _key(seed)).otherwise(row), seed + 1


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose sets of five-word shingles are linked by a similarity of 0.8 or more, that of
    the smallest doc_id, one without doc_id only if no other has one. Groups are of rows, not of ids: of rows equal in
    doc_id and text one stays, and a doc_id's other texts are judged on their own. A row's key is a hash of both."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    ids = keyed.groupBy("_row").agg(F.first("doc_id").alias("id"), F.count("*").alias("copies"))
    groups = near_duplicates(keyed.select("_row", "text"), doc_id="_row", words=5).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    rows = saved(groups.join(ids, "_row"), "rows")
    best = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row")).alias("best")).select("best._row")
    lost = rows.join(best, "_row", "left_anti").select("_row").union(rows.where("copies > 1").select("_row")).distinct()
    twice = rows.where("copies > 1").join(best, "_row", "left_semi").select("_row")
    once = keyed.join(lost, "_row", "left_anti").select(*docs.columns)
    return once.union(keyed.join(twice, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns))


def _aside(docs: DataFrame, names: tuple[str, ...], step) -> DataFrame:
    """step(docs) with the input's columns of these names, those of results, renamed before and named as they were after."""
    own = {c: f"_own_{c}" for c in docs.columns if c in names}
    return step(docs.withColumnsRenamed(own)).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that stand more than once; n_chars follows. A document of which nothing is left
    goes; one that was empty stays. Characters cut in two are left out."""
    return _aside(docs, ("k1", "k2", "n_removed"), _without_repeats)


def _without_repeats(docs: DataFrame) -> DataFrame:
    each = remove_repeats(docs, as_text=True).select(*KEY, F.col("kept").alias("_kept"), "n_removed")
    joined = docs.select(*(c for c in docs.columns if c != "text"), F.col("text").isNull().alias("_null"), *text_keys()).join(each, KEY)
    text = F.when(~F.col("_null"), F.col("_kept"))
    return joined.where("n_removed = 0 OR length(_kept) > 0").select(*(c for c in docs.columns if c not in ("text", "n_chars")), text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _aside(docs, ("n_words", "n_hit", "item_ids", "hit_spans"), lambda own: decontaminate(own, benchmark).where("n_hit = 0"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 1024 tokens."""
    return pack(docs, with_ids=False)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", drop_repeats), ("decontamination", drop_contaminated), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


pipeline = run
