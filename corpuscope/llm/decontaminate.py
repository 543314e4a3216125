"""Benchmark decontamination by winnowing.

Every item and every document is fingerprinted: the smallest hash of 5 words among any 6 that start one after the
other. A window of 10 words holds exactly 6 such grams, so whoever shares the window shares its smallest gram. Shared
fingerprints are joined, and each hit is extended to the 10-word windows around it, which must agree word by word. An
item of fewer than 10 words is one window of its own length and is looked up whole at every place of every document.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, covered, gram_ok, grams, list_array, map_texts, ranges, runs, saved, sql_lower, table

WINDOW, GRAM = 10, 5
#: Bytes of benchmark text whose fingerprints executors hold at once; a larger benchmark goes over the documents in blocks.
BLOCK_BYTES = 32 << 20
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hit_spans", SPAN)]


def _winnowed(g: np.ndarray, ok: np.ndarray, ok_window: np.ndarray, width: int) -> np.ndarray:
    """Places of grams that are the smallest of some run of width grams inside one text."""
    g = np.where(ok, g, np.uint64(2**64 - 1))
    n = len(ok_window)
    low = g[:n].copy()
    for j in range(1, width):
        np.minimum(low, g[j : j + n], out=low)
    chosen = np.zeros(len(g), bool)
    for j in range(width):
        chosen[j : j + n] |= ok_window & (g[j : j + n] == low)
    return np.flatnonzero(chosen)


class ItemIndex:
    """Fingerprints of benchmark items with the windows that each stands for."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        w = Words(pa.array(texts, pa.string()), ALNUM)
        doc, n = w.doc, len(w.hashes)
        self.ids = np.array(ids, dtype=object)
        key, item = [], []
        g, ok, ok_window = grams(w.hashes, gram), gram_ok(w.offsets, n, gram), gram_ok(w.offsets, n, window)
        full = grams(w.hashes, window)
        place = np.flatnonzero(ok_window)
        key.append(full[place])
        item.append(doc[place])
        at, back = np.zeros(0, np.int64), np.zeros(0, np.int64)
        chosen = _winnowed(g, ok, ok_window, window - gram + 1)
        for j in range(window - gram + 1):  # the window that starts j words before the gram
            start = chosen - j
            good = (start >= 0) & (start < len(ok_window))
            good[good] = ok_window[start[good]]
            at, back = np.concatenate([at, chosen[good]]), np.concatenate([back, np.full(good.sum(), j)])
        # (fingerprint, words before it, window) without repeats, so that repeated items cost nothing
        rows = np.unique(np.rec.fromarrays([g[at], back, full[at - back]], names="f,b,w"))
        self.prints, self.print_starts = np.unique(rows["f"], return_index=True)
        self.print_counts = np.diff(np.append(self.print_starts, len(rows)))
        self.back, self.full = rows["b"].copy(), rows["w"].copy()
        first = place[np.unique(full[place], return_index=True)[1]]  # one place of each window, in the order of hashes
        self.windows, self.words = full[first], w.hashes[first[:, None] + np.arange(window)]
        self.short: dict[int, np.ndarray] = {}
        counts = w.counts
        for k in range(1, window):
            own = np.flatnonzero(counts == k)
            if len(own):
                keys = grams(w.hashes, k)[w.offsets[own]]
                self.short[k] = np.unique(keys)
                key.append(keys)
                item.append(own)
        pairs = np.unique(np.rec.fromarrays([np.concatenate(key), np.concatenate(item)], names="w,i"))
        self.keys, self.key_starts = np.unique(pairs["w"], return_index=True)
        self.key_counts = np.diff(np.append(self.key_starts, len(pairs)))
        self.items = pairs["i"].copy()

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and key of every place where a window of an item stands."""
        n = len(w.hashes)
        found = [np.zeros((3, 0), np.uint64)]
        if len(self.prints):
            ok_window = gram_ok(w.offsets, n, self.window)
            g = grams(w.hashes, self.gram)
            at = _winnowed(g, gram_ok(w.offsets, n, self.gram), ok_window, self.window - self.gram + 1)
            where = np.minimum(np.searchsorted(self.prints, g[at]), len(self.prints) - 1)
            same = self.prints[where] == g[at]
            at, where = at[same], where[same]
            row, owner = ranges(self.print_starts[where], self.print_counts[where])
            start = at[owner] - self.back[row]
            good = (start >= 0) & (start < len(ok_window))
            good[good] = ok_window[start[good]]
            start, row = start[good], row[good]
            there = np.searchsorted(self.windows, self.full[row])
            agree = np.ones(len(start), bool)
            for j in range(self.window):  # word by word
                agree &= w.hashes[start + j] == self.words[there, j]
            found.append(np.stack([start[agree].astype(np.uint64), np.full(agree.sum(), self.window, np.uint64), self.full[row[agree]]]))
        for k, keys in self.short.items():
            g = grams(w.hashes, k)
            where = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            start = np.flatnonzero((keys[where] == g) & gram_ok(w.offsets, n, k))
            found.append(np.stack([start.astype(np.uint64), np.full(len(start), k, np.uint64), g[start]]))
        start, length, key = np.concatenate(found, axis=1)
        return start.astype(np.int64), length.astype(np.int64), key

    def scan(self, column: pa.Array) -> tuple[Words, np.ndarray, list[np.ndarray]]:
        """Words, which of them are hit, and each text's items."""
        w = Words(column, ALNUM)
        start, length, key = self.hits(w)
        mask = covered(start, start + length, len(w.hashes))
        pairs = np.unique(np.rec.fromarrays([w.doc[start], np.searchsorted(self.keys, key)], names="d,k"))
        row, owner = ranges(self.key_starts[pairs["k"]], self.key_counts[pairs["k"]])
        pairs = np.unique(np.rec.fromarrays([pairs["d"][owner], self.items[row]], names="d,i"))
        cut = np.searchsorted(pairs["d"], np.arange(len(w.counts) + 1))
        return w, mask, [pairs["i"][a:b] for a, b in zip(cut, cut[1:])]


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document with n_words, n_hit (words inside a shared window), item_ids (strings, sorted) and hit_spans (word places).

    Null or empty texts have no words and no hits. Items without id or without words take no part; repeated items count
    once. Repeated documents each get their row; without documents there are no rows, without items no hits. A text of up
    to 2 GiB is held whole in a task, in some 60 bytes for each of its own. An input column named like a result gives way to it. The documents are
    read in place, without a shuffle; the benchmark's size is measured, and beyond block_bytes it goes over the
    documents in several blocks, each held by the executors in turn, with the same result.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    blocks = max(1, ceil((items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / block_bytes))
    out = docs
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = part.toPandas()
        shared = spark.sparkContext.broadcast(ItemIndex(rows["i"].tolist(), rows["t"].tolist()))
        out = _pass(out, shared, keep, text, again=b > 0, more=b < blocks - 1)
        if b < blocks - 1:
            out = saved(out, "decontaminate")
    return out


def _pass(docs: DataFrame, shared, keep: list[str], text: str, again: bool, more: bool) -> DataFrame:

    def start():
        index = shared.value

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            w, mask, items = index.scan(batch.column(text))
            ids = [sorted(set(index.ids[x])) for x in items]
            if again:  # join with what earlier blocks found
                old = batch.column("hit_spans").to_pylist()
                spans = [(w.offsets[d] + s["start"], w.offsets[d] + s["end"]) for d, x in enumerate(old) for s in x]
                if spans:
                    mask |= covered(*np.array(spans).T, len(mask))
                ids = [sorted({*a, *b}) for a, b in zip(ids, batch.column("item_ids").to_pylist())]
            s, e, counts = runs(mask, w.offsets)
            base = np.repeat(w.offsets[:-1], counts)
            hit = np.diff(np.concatenate([[0], np.cumsum(mask)])[w.offsets])
            pair = pa.StructArray.from_arrays([pa.array((s - base).astype(np.int32)), pa.array((e - base).astype(np.int32))], ["start", "end"])
            return [pa.array(w.counts), pa.array(hit), pa.array(ids, pa.list_(pa.string())), list_array(pair, counts)]

        return step

    return map_texts(docs, FIELDS, start, list(dict.fromkeys([*keep, text])) if more else keep, text, ("item_ids", "hit_spans") if again else ())


def op8_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(sql_lower("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(sql_lower("coalesce(text, '')"))} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0))),
spots AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, item, spots.k AS k, i FROM spots JOIN win ON spots.k = win.k AND spots.g = win.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS m, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(m, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
