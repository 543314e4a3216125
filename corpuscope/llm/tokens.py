"""Token-ID output: whole texts as Parquet list columns, in the order of ids, with row groups and page indexes set for
selective reads. Also the encoder that packing uses.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_hashes, list_array, ranges, scratch_dir, slices, table, text_bytes

END = 2
#: Pieces whose ids a worker keeps (some 30 bytes each; beyond, it goes on with the latest), the longest of them in bytes,
#: and new pieces that are encoded as one text.
MEMORY, LONGEST, TOGETHER = 1_200_000, 64, 200


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Bytes that are white space, or may be taken for it; white space of two and three bytes is found by its lead byte.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARKS = ",.;:!?)\""


def space_bytes(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space of any kind; a few that don't may be among them."""
    space = _SPACE[raw]
    lead = np.flatnonzero(_LEADS[raw])
    if len(lead):
        padded = np.append(raw, np.zeros(2, np.uint8))
        a, b, c = raw[lead], padded[lead + 1], padded[lead + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = ((a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        three |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | ((b == 0x81) & (c == 0x9F)))
        for j in range(3):
            space[lead[three] + j] = True
            if j < 2:
                space[lead[two] + j] = True
    return space


class Encoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library, encoding equal pieces once.

    The tokenizer first cuts a text by a fixed pattern and merges within the cuts. A blank or line break between two
    characters that are not white space always starts a cut, and so does one of MARKS after an ASCII letter or digit
    (unless a special token holds one). So the ids of a text are those of its pieces from one such place to the next,
    whatever else they hold: other white space, runs of it, special tokens. Pieces are found with numpy on the bytes of
    many texts, told apart by 64-bit hashes, and new ones are encoded together. A very long text is worked on in arrays
    of some 40 bytes for each of its own.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.starts = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.starts[[i for t, i in tokens.items() if t[0] in "ĠĊ"]] = True  # how byte-level vocabularies write a blank and a line break
        self.marks = np.zeros(256, bool)
        if not any(m in t.content for t in self.tokenizer.get_added_tokens_decoder().values() for m in MARKS):
            self.marks[[ord(m) for m in MARKS]] = True
        self.known, self.recent = Pieces(), Pieces()

    def fresh(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        raw, offsets = text_bytes(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        space = space_bytes(raw)
        first = np.zeros(len(raw) + 1, bool)
        first[offsets] = True
        cut = ((raw == 0x20) | (raw == 0x0A)) & ~first[:-1] & ~first[1:]
        cut[1:] &= ~space[:-1]
        cut[:-1] &= ~space[1:]
        mark = self.marks[raw] & ~first[:-1]
        mark[1:] &= _ALNUM[raw[:-1]]
        starts = np.flatnonzero(cut | mark | first[:-1])
        ends = np.append(starts[1:], len(raw))
        found, check = pa.array(byte_hashes(raw, starts, ends)).dictionary_encode(), byte_hashes(raw, starts, ends, 1)
        which, keys = found.indices.to_numpy(), found.dictionary.to_numpy()
        order = np.argsort(keys)  # looked up in order, which is kinder to caches
        which, keys = np.argsort(order)[which], keys[order]
        at = np.empty(len(keys), np.int64)
        at[which[::-1]] = np.arange(len(which))[::-1]  # where each piece stands first
        if (check != check[at][which]).any():  # two pieces of one hash: nothing is told by it
            each = self.fresh([x or "" for x in column.to_pylist()])
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        check = check[at]
        start, count = self.known.find(keys, check)
        s, c = self.recent.find(keys, check)
        start, count = np.where(c > 0, s + len(self.known.ids), start), np.where(c > 0, c, count)
        new = np.flatnonzero(count == 0)
        ids = [self.known.ids, self.recent.ids]
        if len(new):
            s, c, flat = self._learn(raw, space, starts[at[new]], ends[at[new]])
            start[new], count[new] = s + len(ids[0]) + len(ids[1]), c
            ids.append(flat)
            keep = ends[at[new]] - starts[at[new]] <= LONGEST
            keep &= ~self.known.has(keys[new]) & ~self.recent.has(keys[new])  # a piece of the same hash is kept there
            self._keep(keys[new][keep], check[new][keep], c[keep], flat[ranges(s[keep], c[keep])[0]])
        place, _ = ranges(start[which], count[which])
        sums = np.concatenate([[0], np.cumsum(count[which])])
        return np.concatenate(ids)[place], np.diff(sums[np.searchsorted(starts, offsets)])

    def _learn(self, raw: np.ndarray, space: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each piece's ids are among those returned last, and how many. Pieces with white space at their start
        alone are joined to texts in which each starts a cut."""
        size = ends - starts
        within = np.concatenate([[0], np.cumsum(space)])
        plain = (within[ends] - within[starts] == 1) & ((raw[starts] == 0x20) | (raw[starts] == 0x0A)) & (size <= LONGEST)
        own = np.flatnonzero(plain)
        joined, cuts = raw[ranges(starts[own], size[own])[0]].tobytes(), np.concatenate([[0], np.cumsum(size[own])])[[*range(0, len(own), TOGETHER), len(own)]]
        found = self.fresh([joined[a:b].decode() for a, b in zip(cuts.tolist(), cuts[1:].tolist())])
        sizes = np.minimum(TOGETHER, len(own) - np.arange(len(found)) * TOGETHER)
        right = [self.starts[x].sum() == n and self.starts[x[0]] for x, n in zip(found, sizes)]
        plain[own[~np.repeat(np.array(right, bool), sizes)]] = False
        found, alone = [x for x, ok in zip(found, right) if ok], np.flatnonzero(~plain)
        single = self.fresh([raw[starts[i] : ends[i]].tobytes().decode() for i in alone])
        flat = np.concatenate([np.zeros(0, np.uint32), *found, *single])
        cut = np.concatenate([np.flatnonzero(self.starts[flat[: sum(map(len, found))]]), np.cumsum([0, *map(len, single)])[:-1] + sum(map(len, found))]).astype(np.int64)
        start, order = np.empty(len(starts), np.int64), np.concatenate([np.flatnonzero(plain), alone])
        start[order] = cut
        count = np.empty_like(start)
        count[order] = np.diff(np.append(cut, len(flat)))
        return start, count, flat

    def _keep(self, keys: np.ndarray, check: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.recent = self.recent.with_(keys, check, lengths, ids)
        if len(self.recent.keys) > max(20_000, len(self.known.keys) // 4):
            whole = len(self.known.keys) + len(self.recent.keys) > MEMORY
            self.known = self.recent if whole else self.known.with_(self.recent.keys, self.recent.check, self.recent.count, self.recent.ids)
            self.recent = Pieces()


class Pieces:
    """The ids of pieces by hash: sorted keys with another hash of each, and where in ids each one's are and how many."""

    def __init__(self):
        self.keys, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.keys[self._at(keys)] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def find(self, keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and count; a count of 0 for pieces that are unknown by either hash."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = self._at(keys)
        return self.start[at], np.where((self.keys[at] == keys) & (self.check[at] == check), self.count[at], 0)

    def with_(self, keys: np.ndarray, check: np.ndarray, count: np.ndarray, ids: np.ndarray) -> Pieces:
        """These and others; ids come in the order of keys, which are unknown so far."""
        order = np.argsort(keys)
        at, size = np.searchsorted(self.keys, keys[order]), count[order]
        out = Pieces()
        out.keys, out.check, out.count = np.insert(self.keys, at, keys[order]), np.insert(self.check, at, check[order]), np.insert(self.count, at, size)
        where = np.insert(self.start, at, len(self.ids) + (np.cumsum(count) - count)[order])
        out.ids, out.start = np.concatenate([self.ids, ids])[ranges(where, out.count)[0]], np.cumsum(out.count) - out.count
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, kept over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with the end id after each (null: that alone), and how many each has."""
    ids, counts = encoder(path).encode(column)
    return np.insert(ids, np.cumsum(counts), END), counts + 1


# ---------------------------------------------------------------- output
def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", metadata: list[str] | None = None, partitions: int | None = None, row_group_bytes: int = 16 << 20, page_rows: int = 512) -> None:
    """Write (doc_id, metadata..., part, local_start, n_tokens, tokens) as Parquet, files and rows in ascending doc_id order.

    tokens is a list column with dictionary encoding (ids repeat), the id and start columns are delta encoded (they
    ascend), and every column chunk has a page index, so a reader that filters on doc_id skips files, row groups and
    pages. part and local_start give each document's place in its file; starts() turns them into places in the whole.
    Null texts are empty and hold only the end id. Rows without id come first; rows of equal id are ordered by text.
    An empty table gives a table without rows. metadata columns named like a result give way to it.
    """
    tokenizer = tokenizer or default_tokenizer()
    own = ("part", "local_start", "n_tokens", "tokens", doc_id, text)
    metadata = [c for c in (metadata or []) if c not in own]
    rows = docs.select(doc_id, *metadata, text)
    ordered = (rows.repartitionByRange(partitions, doc_id) if partitions else rows.repartitionByRange(doc_id)).sortWithinPartitions(doc_id, text)
    schema = T.StructType([*(rows.schema[c] for c in (doc_id, *metadata)), T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        for batch in slices(batches, text):
            ids, n = encoded(batch.column(text), tokenizer)
            flat, ends = pa.array(ids.view(np.int32)), start + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (doc_id, *metadata)), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(n), list_array(flat, n)], schema.names)
            start = int(ends[-1])

    (ordered.mapInArrow(run, schema).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows).option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "true").option(f"parquet.enable.dictionary#{doc_id}", "false").option("parquet.enable.dictionary#local_start", "false").option("parquet.enable.dictionary#n_tokens", "false").parquet(path))


def read_tokens(spark: SparkSession, path: str, ids: tuple[int, int] | None = None, doc_id: str = "doc_id") -> DataFrame:
    """The documents written to path, or those with an id in a range (both ends included), by column and page indexes."""
    out = spark.read.parquet(path)
    return out.where(F.col(doc_id).between(*ids)) if ids else out


def with_starts(tokens: DataFrame) -> DataFrame:
    """tokens with start, the number of ids of all documents before. Only one sum for each written file is ordered in
    one place; their number is that of the files."""
    from pyspark.sql import Window

    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return tokens.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def with_crc32(tokens: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and the unsigned crc32 of each row's ids as little-endian 32-bit integers."""
    schema = T.StructType([*(tokens.schema[c] for c in keep), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        for batch in batches:
            column = pc.fill_null(batch.column("tokens"), []) if batch.column("tokens").null_count else batch.column("tokens")
            values, offsets = column.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            view = memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else memoryview(b"")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(crc, pa.int64())], schema.names)

    return tokens.select(*dict.fromkeys([*keep, "tokens"])).mapInArrow(run, schema)


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    placed = with_starts(read_tokens(spark, path))  # the sums read two columns, the checks below all ids once
    return with_crc32(placed, ["doc_id", "start", "n_tokens"])
