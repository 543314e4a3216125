"""Removal of repeated 200-byte strings: suffix-array deduplication over the whole collection.

Two places that hold the same 200 bytes also hold the same smallest 32-gram in them (its leftmost place is the string's
anchor), at the same distance. So strings are dealt out by anchor; an anchor that stands once in the collection needs
no more work. For the others the bytes around each place are cut out, and the suffixes that start 200-byte strings are
sorted by column-wise construction over many segments at once: from right to left, each round inserts one symbol of
every segment. The symbols in suffix order are the collection's Burrows-Wheeler column; splitting it stably by symbol
gives the next order, and the common prefix with the neighbour grows by one or falls to the smallest between. A string
is repeated where that prefix reaches 200. Segments of one anchor are aligned, so only suffixes of the same column are
compared. The symbols come from spool files of sixteen columns each, the Burrows-Wheeler column and the prefixes go
from round to round through two sequential files, and the marks of each round are appended to another; only the order
of the segments stays in memory. Files belong to the task that writes them, and no other task reads them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_array, map_texts, mix, prefix_sums, ranges, slices, span_hashes, table, text_bytes


WIDTH, GRAM = 200, 32
#: Segments sorted together, if they are of several anchors. The segments of an anchor at more than HOT places are cut into
#: parts of RANGE string starts each, dealt out by the bytes that all strings of a part share; all are sorted alike.
BATCH, HOT, RANGE = 40_000, 50_000, 16
COLUMNS = 16  # of one spool file
KEY = ["k1", "k2"]
_POSITION_BITS = np.uint64(28)


def anchors(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor places, hashes, and the first string start and number of string starts that each stands for."""
    span = width - gram + 1
    n = len(raw) - width + 1
    if n > 0 and n >> int(_POSITION_BITS):
        raise ValueError(f"a text of {len(raw)} bytes is too long: its places take more than {_POSITION_BITS} bits")
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    at = np.arange(len(raw) - gram + 1)
    h = span_hashes(prefix_sums(raw), at, at + gram)
    pad = -len(h) % span
    rank = np.concatenate([(h >> _POSITION_BITS) << _POSITION_BITS | at.astype(np.uint64), np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(rank, axis=1).ravel()
    behind = np.minimum.accumulate(rank[:, ::-1], axis=1)[:, ::-1].ravel()
    low = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64((1 << int(_POSITION_BITS)) - 1)).astype(np.int64)
    lengths = np.diff(offsets)
    inside, _ = ranges(offsets[:-1], np.maximum(0, lengths - width + 1))
    own = low[inside]
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)
    cut = np.flatnonzero(first)
    return own[cut], h[own[cut]], inside[cut], np.diff(np.append(cut, len(own)))


class Spool:
    """Aligned segments column by column: files of COLUMNS columns each, which are read once, the last first.

    A segment's bytes lie around its anchor, at most width - gram before it and width from it on. Symbols are 0 where a
    segment has no byte, else the byte plus one.
    """

    def __init__(self, left: int = WIDTH - GRAM, right: int = WIDTH):
        self.left, self.columns, self.n = left, left + right, 0
        self.files = [tempfile.TemporaryFile() for _ in range(-(-self.columns // COLUMNS))]
        self.blocks: list[int] = []

    def add(self, data: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> None:
        starts = np.cumsum(sizes) - sizes
        for i in range(0, len(sizes), 4096):  # a block of rows is turned in memory
            own = slice(i, i + 4096)
            place, row = ranges(starts[own], sizes[own])
            column = place - starts[own][row] + (self.left - before[own])[row]
            block = np.zeros((len(self.files) * COLUMNS, len(sizes[own])), np.int16)
            block[column, row] = data[place].astype(np.int16) + 1
            for k, f in enumerate(self.files):
                f.write(block[k * COLUMNS : (k + 1) * COLUMNS].tobytes())
            self.blocks.append(block.shape[1])
            self.n += block.shape[1]

    def backwards(self) -> Iterator[tuple[int, np.ndarray]]:
        """(column, its symbols), from the last column to the first."""
        for k in range(len(self.files) - 1, -1, -1):
            with self.files[k] as f:
                f.seek(0)
                held = np.concatenate([np.frombuffer(f.read(2 * COLUMNS * m), np.int16).reshape(COLUMNS, m) for m in self.blocks], axis=1)
            for c in range(min(COLUMNS, self.columns - k * COLUMNS) - 1, -1, -1):
                yield k * COLUMNS + c, held[c]


def repeated_columns(groups: np.ndarray, spool: Spool, width: int = WIDTH) -> np.ndarray:
    """Rows (segment, first, end): runs of columns at which strings start that also start in another segment of the group.

    groups: ascending, one number for each segment of the spool."""
    n = spool.n
    order, last = np.arange(n), spool.columns
    with tempfile.TemporaryFile() as bwt, tempfile.TemporaryFile() as prefixes, tempfile.TemporaryFile() as marks:
        np.zeros(n + 1, np.int16).tofile(prefixes)
        for c, symbols in spool.backwards():
            bwt.seek(0)
            symbols[order].tofile(bwt)  # the symbols before the suffixes, in their order
            bwt.seek(0), prefixes.seek(0)
            symbol, common = np.fromfile(bwt, np.int16, n), np.fromfile(prefixes, np.int16, n + 1)
            key = groups[order] * 257 + symbol
            to = np.argsort(key, kind="stable")
            key, symbol = key[to], symbol[to]
            same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[1:] > 0))
            a, b = to[same], to[same + 1]
            least = common[b].copy()
            far = np.flatnonzero(b > a + 1)
            if len(far):
                least[far] = np.minimum.reduceat(common, np.stack([a[far] + 1, b[far] + 1], 1).ravel())[::2]
            common = np.zeros(n + 1, np.int16)
            common[same + 1] = least + 1
            prefixes.seek(0)
            common.tofile(prefixes)
            order = order[to]
            full = common >= width
            hit = order[full[:-1] | full[1:]]
            np.stack([np.full(len(hit), c), hit], 1).astype(np.int32).tofile(marks)
        marks.seek(0)
        got = np.fromfile(marks, np.int32).reshape(-1, 2).astype(np.int64)
    at = np.sort(got[:, 1] * (last + 1) + got[:, 0])  # by segment, then column
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, np.int64)
    end = at[np.append(new[1:], len(at)) - 1] + 1 if len(at) else at
    return np.stack([at[new] // (last + 1), at[new] % (last + 1), end % (last + 1)], 1)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _fields(**types) -> list[T.StructField]:
    return [T.StructField(k, t) for k, t in types.items()]


def _find_anchors(texts: DataFrame, members: bool) -> DataFrame:
    """(h, n): how often an anchor stands in some texts read together; or (h, members): where, one list for these texts.
    A place is the anchor's byte, how far ahead of it the first string that it stands for starts, and how many such
    strings there are (48, 8 and 8 bits)."""
    rest = {"members": T.ArrayType(T.StructType(_fields(k1=T.LongType(), k2=T.LongType(), place=T.LongType())))} if members else {"n": T.LongType()}
    schema = T.StructType(_fields(h=T.LongType(), **rest))

    def run(batches):
        for batch in slices(batches, "text"):
            raw, offsets = text_bytes(batch.column("text"))
            at, h, first, n = anchors(raw, offsets)
            order = np.argsort(h, kind="stable")
            h = h[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else order
            times = np.diff(np.append(new, len(h)))
            if members:
                doc = np.searchsorted(offsets, at, side="right") - 1
                place = ((at - offsets[doc]) << 16 | (at - first) << 8 | n)[order]
                pair = pa.StructArray.from_arrays([*(batch.column(k).take(pa.array(doc[order])) for k in KEY), pa.array(place)], [*KEY, "place"])
            yield pa.RecordBatch.from_arrays([_long(h[new]), list_array(pair, times) if members else pa.array(times)], schema.names)

    return texts.mapInArrow(run, schema)


def _cut(texts: DataFrame, hot: int, members: bool) -> DataFrame:
    """The bytes of all strings of an anchor, or of a part of a hot one's: (s, h, before, segment, times) once for some
    texts together, s being a hash of the bytes and h of the group; or (s, h, members), where they stand. copies is read
    so that both uses of texts have one plan, and hence one shuffle."""
    fields = {"members": T.ArrayType(T.StructType(_fields(k1=T.LongType(), k2=T.LongType(), first=T.IntegerType(), n=T.IntegerType())))} if members else {"before": T.IntegerType(), "segment": T.BinaryType(), "times": T.LongType()}
    schema = T.StructType(_fields(s=T.LongType(), h=T.LongType(), **fields))

    def run(batches):
        for batch in slices(batches, "text"):
            raw, offsets = text_bytes(batch.column("text"))
            listed = batch.column("places")
            counts = listed.value_lengths().to_numpy(zero_copy_only=False)
            p = listed.flatten()
            get = lambda name: p.field(name).to_numpy(zero_copy_only=False).astype(np.int64)
            h, place, copies = (get(x) for x in ("h", "place", "copies"))
            at, n = place >> 16, place & 255
            far, doc = place >> 8 & 255, np.repeat(np.arange(len(counts)), counts)
            near, often = far - n + 1, copies > hot  # the last string starts so far ahead of the anchor
            step, row = ranges(np.where(often, near // RANGE, 0), np.where(often, far // RANGE - near // RANGE + 1, 1))
            often, doc, at, h = often[row], doc[row], at[row], h[row].astype(np.uint64)
            far, near = np.where(often, np.minimum(far[row], step * RANGE + RANGE - 1), far[row]), np.where(often, np.maximum(near[row], step * RANGE), near[row])
            first, n = at - far, far - near + 1
            sums, start, size = prefix_sums(raw), offsets[doc] + first, n + WIDTH - 1
            if often.any():
                core = offsets[doc[often]] + at[often] - step[often] * RANGE
                h[often] = mix(h[often] ^ span_hashes(sums, core, core + WIDTH - RANGE + 1) + step[often].astype(np.uint64))
            mark = mix(span_hashes(sums, start, start + size) + far.astype(np.uint64))
            order = np.lexsort((h, mark))
            new = np.flatnonzero(np.append(True, (mark[order][1:] != mark[order][:-1]) | (h[order][1:] != h[order][:-1]))) if len(order) else order
            times, one = np.diff(np.append(new, len(order))), order[new]
            if members:
                arrays = [*(batch.column(k).take(pa.array(doc[order])) for k in KEY), pa.array(first[order].astype(np.int32)), pa.array(n[order].astype(np.int32))]
                rest = [list_array(pa.StructArray.from_arrays(arrays, [*KEY, "first", "n"]), times)]
            else:
                place, ends = ranges(start[one], size[one])[0], np.concatenate([[0], np.cumsum(size[one])])
                segment = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(one), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[place].tobytes())]).cast(pa.binary())
                rest = [pa.array(far[one].astype(np.int32)), segment, pa.array(times)]
            yield pa.RecordBatch.from_arrays([_long(mark[one]), _long(h[one]), *rest], schema.names)

    return texts.mapInArrow(run, schema)


def _compare(segments: DataFrame) -> DataFrame:
    """(s, h, runs): segments in, sorted by group and by hash within it; out come those with repeated strings, as places
    in them: all strings of a segment that stands more than once, else those that other segments of the group hold."""
    schema = T.StructType(_fields(s=T.LongType(), h=T.LongType(), runs=T.ArrayType(T.StructType(_fields(a=T.IntegerType(), b=T.IntegerType())))))

    def solve(held: list[list[np.ndarray]], spool: Spool) -> pa.RecordBatch:
        s, h, before, size, times = (np.concatenate([x[k] for x in held]) for k in range(5))
        found = repeated_columns(np.cumsum(np.append(0, h[1:] != h[:-1])), spool)
        shift = (spool.left - before)[found[:, 0]]
        found[:, 1:] -= shift[:, None]
        whole = np.flatnonzero(times > 1)
        found = np.concatenate([found[times[found[:, 0]] == 1], np.stack([whole, np.zeros_like(whole), size[whole] - WIDTH + 1], 1)])
        found = found[np.argsort(found[:, 0], kind="stable")]
        own, new = np.unique(found[:, 0], return_index=True)
        pair = pa.StructArray.from_arrays([pa.array(found[:, k].astype(np.int32)) for k in (1, 2)], ["a", "b"])
        return pa.RecordBatch.from_arrays([pa.array(s[own]), pa.array(h[own]), list_array(pair, np.diff(np.append(new, len(found))))], schema.names)

    def run(batches):
        held, spool = [], Spool()
        for part in _groups(batches):
            s, h, before, times = (part.column(c).to_numpy() for c in ("s", "h", "before", "times"))
            last = held[-1] if held else None
            if spool.n >= BATCH and h[0] != last[1][-1]:
                yield solve(held, spool)
                held, spool, last = [], Spool(), None
            new = np.append(last is None or last[0][-1] != s[0] or last[1][-1] != h[0], (s[1:] != s[:-1]) | (h[1:] != h[:-1]))
            if not new[0]:  # goes on with the last segment of the batch before
                last[4][-1] += times[: np.argmax(new) if new.any() else len(new)].sum()
            own = np.flatnonzero(new)
            if len(own):
                raw, offsets = text_bytes(part.column("segment").take(pa.array(own)))
                spool.add(raw, np.diff(offsets), before[own].astype(np.int64))
                held.append([s[own], h[own], before[own].astype(np.int64), np.diff(offsets), np.add.reduceat(times, own)])
        if spool.n:
            yield solve(held, spool)

    return segments.repartition("h").sortWithinPartitions("h", "s").mapInArrow(run, schema)


def _groups(batches) -> Iterator[pa.RecordBatch]:
    """The batches, cut where about BATCH rows are followed by another group."""
    for batch in batches:
        while batch.num_rows > BATCH:
            h = batch.column("h").to_numpy()
            cut = np.flatnonzero(h[BATCH:] != h[BATCH - 1 : -1])
            cut = BATCH + int(cut[0]) if len(cut) else batch.num_rows
            yield batch.slice(0, cut)
            batch = batch.slice(cut)
        if batch.num_rows:
            yield batch


def repeated_spans(docs: DataFrame, text: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (k1, k2, text, copies) and, for those that share strings with others or themselves, (k1, k2, starts):
    runs of byte places where a repeated string starts."""
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"), body.alias("text"))
    again = _find_anchors(keyed, False).groupBy("h").agg(F.sum("n").alias("copies")).where("copies > 1")
    places = _find_anchors(keyed, True)  # found twice, which costs less than keeping them on disk
    shared = places.join(again, "h").select("h", "copies", F.explode("members").alias("m")).groupBy("m.k1", "m.k2").agg(F.collect_set(F.struct("h", "m.place", "copies")).alias("places"))
    texts = keyed.groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    placed = texts.join(shared, KEY)
    verdict = _compare(_cut(placed, hot, False))
    one = _cut(placed, hot, True).join(verdict, ["s", "h"]).select("runs", F.explode("members").alias("m"))
    runs = F.transform("runs", lambda r: F.struct((r["a"] + F.col("m.first")).alias("a"), (r["b"] + F.col("m.first")).alias("b")))
    return texts, one.select("m.k1", "m.k2", runs.alias("runs")).groupBy(*KEY).agg(F.flatten(F.collect_list("runs")).alias("starts"))


def remove_repeats(docs: DataFrame, text: str = "text", hot: int = HOT, as_text: bool = False) -> DataFrame:
    """For each distinct text: k1, k2 (see text_keys), n_bytes, n_removed, spans (removed byte runs), kept (the bytes left).

    A byte goes if any 200-byte string over it also starts anywhere else in the collection, be it in the same text or
    in a copy of it. Null texts count as empty. Texts under 200 bytes stay. Repeated rows are copies of each other. An
    empty table gives no rows. Other columns of docs are not read, whatever their names. Texts are told apart by 128
    bits of hash. A text of 256 MiB or more is an error, since places in it are held in 28 bits.
    as_text: kept is a string, without the bytes of characters that were cut in two.
    """
    texts, starts = repeated_spans(docs, text, hot)
    joined = texts.join(starts, KEY, "left")
    fields = _fields(n_bytes=T.LongType(), n_removed=T.LongType(), spans=T.ArrayType(T.StructType(_fields(start=T.IntegerType(), end=T.IntegerType()))), kept=T.StringType() if as_text else T.BinaryType())

    def start():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            raw, offsets = text_bytes(batch.column("text"))
            sizes, copies = np.diff(offsets), batch.column("copies").to_numpy(zero_copy_only=False)
            found, spans, counts, kept, left = batch.column("starts"), [], [], [], []
            for d in range(batch.num_rows):
                own = [(0, int(sizes[d]))] if copies[d] > 1 and sizes[d] >= WIDTH else []
                if not own and found[d].is_valid:
                    for a, b in sorted((r["a"], r["b"] + WIDTH - 1) for r in found[d].as_py()):
                        if own and a <= own[-1][1]:
                            own[-1] = (own[-1][0], max(b, own[-1][1]))
                        else:
                            own.append((a, b))
                data, out, last = raw[offsets[d] : offsets[d + 1]].tobytes(), [], 0
                for a, b in own:
                    out.append(data[last:a])
                    last = b
                out.append(data[last:])
                kept.append("".join(x.decode(errors="ignore") for x in out) if as_text else b"".join(out))
                left.append(sum(map(len, out)))
                spans += own
                counts.append(len(own))
            pair = pa.StructArray.from_arrays([pa.array([a for a, _ in spans], pa.int32()), pa.array([b for _, b in spans], pa.int32())], ["start", "end"])
            return [pa.array(sizes), pa.array(sizes - np.array(left, np.int64)), list_array(pair, np.array(counts, np.int64)), pa.array(kept, pa.string() if as_text else pa.binary())]

        return step

    return map_texts(joined, fields, start, KEY, "text", ("copies", "starts"))


def text_keys(text: str = "text") -> list:
    """The columns k1 and k2 of a document's text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2")]


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    each = remove_repeats(docs).select(*KEY, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", *text_keys()).join(each, KEY).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
