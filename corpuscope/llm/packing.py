"""Best-fit packing planned on the histogram of lengths.

Documents are cut into pieces of at most one sequence; only the number of pieces of each length (a table of at most
``capacity`` rows, whatever the corpus) goes to the driver. Best fit, longest first, is run over these counts: a step
places as many equal pieces as equal sequences can take, so its work depends on the lengths and not on the documents.
The plan says, for each length, which run of ranks goes to which run of sequences at which offset, and pieces take
their slots by joining on their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_array, ranges, saved, slices, table
from .tokens import default_tokenizer, encoded

CAPACITY = 1024
#: Ranks within one length are counted in salted groups of about so many pieces, so that a frequent length has no single owner.
GROUP = 100_000
PLAN = "length int, rank long, n long, sequence long, each long, at long"


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Rows (length, first rank, pieces, first sequence, pieces in each sequence, first offset), and how many sequences.

    Pieces of one length go, rank by rank, to the fullest open sequences that take them; without any, to new ones.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, how many)
    rooms: list[int] = []
    rows, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in free:
                bisect.insort(rooms, room)
                free[room] = []
            free[room].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[k]
            else:
                room, first = capacity, sequences
                n = -(-left // (capacity // length))
                sequences += n
            each = room // length
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, whole * each, first, each, capacity - room))
                put(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and left:  # fewer than fill one more
                rows.append((length, rank, left, first + whole, left, capacity - room))
                put(room - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            put(room, first + whole, n - whole)
    return rows, sequences


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, and ids if asked for): each text's ids with the end id, cut to capacity.

    All pieces but the first are full, so a document of more than capacity ids has one piece that may be shorter.
    """
    tokenizer = tokenizer or default_tokenizer()
    schema = T.StructType([docs.schema[doc_id], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.IntegerType()), ("ids_crc32", T.LongType()))), *([T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if with_ids else [])])

    def run(batches):
        for batch in slices(batches, text):
            ids, n = encoded(batch.column(text), tokenizer)
            each = -(-n // capacity)
            piece, owner = ranges(np.zeros(len(n), np.int64), each)
            head = n - (each - 1) * capacity  # of the first piece
            start = np.where(piece > 0, head[owner] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[owner])
            view, at = memoryview(ids).cast("B"), 4 * (np.cumsum(length) - length)
            crc = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            arrays = [batch.column(doc_id).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64())]
            if with_ids:
                arrays.append(list_array(pa.array(ids.view(np.int32)), length))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """pieces() with sequence_id and offset: no sequence holds more than capacity ids, and each is filled from 0 without gaps.

    Null texts, and empty ones, have one piece of the end id. Repeated documents are packed each for itself. Other input
    columns are not carried. Empty tables give no rows. The pieces are written once to the shared folder, since the plan
    and the placing both read them.
    """
    cut = saved(pieces(docs, tokenizer, capacity, doc_id, text, with_ids), "pieces")
    spark = docs.sparkSession
    each = [(r.length, 1 + r["count"] // GROUP) for r in cut.groupBy("length").count().collect()]  # at most capacity rows
    groups = F.broadcast(spark.createDataFrame(each, "length int, groups long"))
    salted = cut.join(groups, "length").withColumn("salt", F.pmod(F.xxhash64(doc_id, "piece", "start", "ids_crc32"), F.col("groups")).cast("int")).drop("groups")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()  # at most capacity rows, and one for GROUP pieces
    counts: dict[int, int] = {}
    before = []
    for r in sorted(sizes):
        before.append((r.length, r.salt, counts.get(r.length, 0)))
        counts[r.length] = counts.get(r.length, 0) + r.n
    rows, _ = plan_best_fit(counts, capacity)
    plan = F.broadcast(spark.createDataFrame(rows, PLAN).withColumnRenamed("length", "plan_length"))
    offsets = F.broadcast(spark.createDataFrame(before, "length int, salt int, before long"))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy(doc_id, "piece")) - 1).join(offsets, ["length", "salt"]).withColumn("r", F.col("r") + F.col("before"))
    placed = ranked.join(plan, (F.col("length") == F.col("plan_length")) & (F.col("r") >= F.col("rank")) & (F.col("r") < F.col("rank") + F.col("n")))
    k = F.col("r") - F.col("rank")
    return placed.select(*cut.columns, (F.col("sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + (k % F.col("each")) * F.col("length")).cast("long").alias("offset"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
