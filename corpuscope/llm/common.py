"""What the text operators share: shared scratch tables, row-wise Arrow maps, and vectorised word scanning.

Texts are handled as UTF-8 bytes. Both word patterns in use depend on ASCII bytes only (every byte of a non-ASCII
character belongs to a word), so words are found with numpy on the bytes of many texts at once.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that one numpy step handles; a longer single text is handled whole.
CHUNK_BYTES = 1 << 20
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes of [^\x20\x09-\x0D]+ and, after lower-casing, of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


# ---------------------------------------------------------------- shared scratch
def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, but
    only if all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corpuscope-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def saved(df: DataFrame, name: str, compression: str = "snappy", by: tuple[str, ...] = (), options: dict[str, str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: later plans read files, which outlive lost executors. The shuffle files of
    the write are deleted when it ends. by: columns of whose values each has its own files. options: of the writer."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    small_batches(df.sparkSession)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        df.write.options(**options or {}).parquet(path, partitionBy=list(by) or None, compression=compression)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Rows go to Python and back some MB at a time, unless the session says otherwise: rows with whole texts or lists are
    large, and what the JVM holds for a batch lies outside its heap, in several copies."""
    if spark.conf.get(BATCH, None) in (None, "67108864b", "64MB"):  # Spark's own value
        spark.conf.set(BATCH, size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_lower(text: str) -> str:
    """SQL that lower-cases A-Z alone."""
    for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        text = f"replace({text}, '{letter}', '{letter.lower()}')"
    return text


# ---------------------------------------------------------------- row-wise maps
def give_back() -> None:
    """Return memory that this Python worker has freed to the system: workers are kept from task to task, beside a JVM that
    needs the same memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


@lru_cache(maxsize=1)
def keep_modules() -> None:
    """Once a Python worker, which goes through all its objects after each task: leave out those that are there by now, which
    are nearly all of imported modules, in some 50 ms."""
    gc.freeze()


def map_texts(df: DataFrame, fields: list[T.StructField], start: Callable[[], Callable], keep: list[str], text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Add columns computed from each text. start() runs once a task and returns batch -> arrays, in the order of fields.

    keep: input columns to carry along (one that is named like a new column gives way to it). also: input columns that
    the function reads beside the text. Each step sees rows of about CHUNK_BYTES of text.
    """
    new = {f.name for f in fields}
    keep = [c for c in keep if c not in new]
    read = list(dict.fromkeys([*keep, text, *also]))
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for part in slices(batches, text):
            arrays = step(part)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *arrays], [*keep, *(f.name for f in fields)])
        give_back()

    return df.select(*read).mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one text after the other, and where each text starts (with the end last). Null: empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


# ---------------------------------------------------------------- words and hashes
_B = np.uint64(0x9E3779B97F4A7C55)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1))
        for k, b in enumerate((_B, _B_INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """sums[j] - sums[i], times the inverse power of i, is the polynomial hash of raw[i:j] (64 bits, wrapping). It is for
    windows at every byte; texts can be built whose long spans collide, so words and pieces have byte_hashes()."""
    power, _ = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


#: Spans of up to so many bytes are hashed eight bytes a step, all together; longer ones by blake2b, one by one.
LONG = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each raw[start:end]. Each step mixes eight bytes into what is known so far by a bijection, so spans
    of equal length and up to eight bytes never collide, and longer ones have no sums that cancel out. Hashes of two seeds
    are independent."""
    padded = np.append(raw, np.zeros(8, np.uint8))
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    live, longest = np.arange(len(size)), int(size.max(initial=0))
    if longest > LONG:
        live = np.flatnonzero(size <= LONG)
        whole = np.ascontiguousarray(raw)
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = int.from_bytes(blake2b(whole[starts[i] : ends[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
    for j in range(0, min(longest, LONG), 8):
        if j:
            live = live[size[live] > j]
        rest = np.minimum(size[live] - j, 8)
        step = (eight[starts[live] + j] & _MASKS[rest]) ^ out[live]
        out[live] = mix(step) + np.uint64(j + 1)
    return out


class Words:
    """The words of a string column: 64-bit hashes of all of them in order, and where each text's words start."""

    def __init__(self, column: pa.Array, is_word: np.ndarray):
        raw, offsets = text_bytes(column)
        self.raw = raw = _LOWER[raw]
        inside = is_word[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[offsets] = True
        before = np.empty(len(raw), bool)
        before[1:] = inside[:-1]
        before[:1] = False
        after = np.empty(len(raw), bool)
        after[:-1] = inside[1:]
        after[-1:] = False
        self.starts = np.flatnonzero(inside & (~before | first[:-1]))
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.offsets = np.searchsorted(self.starts, offsets)
        self.hashes = byte_hashes(raw, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def doc(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, at the place of the first; runs that leave the array are left out."""
    n = max(0, len(hashes) - k + 1)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out + np.uint64(k))


def gram_ok(offsets: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the first n - k + 1 places start k words of one text."""
    left = np.repeat(offsets[1:], np.diff(offsets))
    return left[: max(0, n - k + 1)] >= np.arange(max(0, n - k + 1)) + k


def ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places start, start + 1, ... of each range, one range after the other, and the range that each is from."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(owner)), owner


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross texts: starts, ends, and how many each text has."""
    first = np.zeros(len(mask) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], mask[:-1]]) if len(mask) else mask
    after = np.concatenate([mask[1:], [False]]) if len(mask) else mask
    starts = np.flatnonzero(mask & (~before | first[:-1]))
    ends = np.flatnonzero(mask & (~after | first[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def list_array(values: pa.Array | np.ndarray, counts: np.ndarray) -> pa.Array:
    """Lists, one after the other in values; so many that 32 bits can't place them are an error."""
    if len(values) >= 1 << 31:
        raise ValueError("a text is too long: its lists have 2^31 values or more")
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
