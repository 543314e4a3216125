"""Collocations: frequent phrases of a few words, scored by how much they hold together, for each language.

Phrases are found level by level. The pass that counts phrases of k words exactly also counts those of k + 1 words in
hash buckets. A bucket that stays under the threshold rules out all phrases in it, and so does a part of k words that is
not frequent; both are known by bit maps of a fixed size, which are broadcast. Only what passes both is counted exactly,
by its own text, so buckets that are shared by chance cost time and change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_hashes, give_back, mix, ranges, saved, slices, sql_lower, table, text_bytes

#: Longest phrase in words, least count, phrases listed for each language, scale of scores, share (in percent) of a
#: phrase's places that must lie in a longer one for it to be dropped.
WORDS, LEAST, LISTED, SCALE, WITHIN = 4, 30, 2000, 2_000_000, 80
#: Bytes of text for each bucket, and the least and most buckets (powers of two; 2^28 buckets are a map of 32 MB).
BUCKET_BYTES, FEWEST, MOST = 16, 1 << 16, 1 << 28
#: Bytes of text that one step handles.
STEP_BYTES = 1 << 20
_SPACE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Maps:
    """What a pass knows: buckets that phrases of its length may be in, and buckets of the frequent ones of one word less.
    None: not known, so nothing is ruled out."""

    size: int
    buckets: np.ndarray | None = None
    parts: np.ndarray | None = None


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Pieces:
    """The words of texts, and phrases of them that cross neither the end of a piece nor of a text."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw, offsets = text_bytes(texts)
        raw = np.insert(_LOWER[raw], offsets[1:], np.uint8(0x0A))  # a line end after each text
        offsets = offsets + np.arange(len(offsets))
        ends_piece = _BREAK[raw]
        inside = ~(_SPACE[raw] | ends_piece)
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        codes = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        self.langs = codes.dictionary
        self.lang = np.repeat(codes.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(starts, offsets)))
        self.piece = np.cumsum(ends_piece)[starts] if len(starts) else starts
        names = pa.array(self.langs.to_pylist(), pa.string())
        salt, at = text_bytes(names)
        self.hashes = byte_hashes(raw, starts, ends) ^ byte_hashes(salt, at[:-1], at[1:], 1)[self.lang] if len(starts) else np.zeros(0, np.uint64)
        # the words again, each with one blank after it
        size = ends - starts
        self.text = np.full(int(size.sum() + len(size)), 0x20, np.uint8)
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.text[ranges(self.start, size)[0]] = raw[ranges(starts, size)[0]]

    def buckets(self, k: int, size: int) -> np.ndarray:
        """The bucket of the k words from each place on (also of those that are no phrase)."""
        n = max(0, len(self.hashes) - k + 1)
        out = self.hashes[:n].copy()
        for j in range(1, k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.hashes[j : j + n]
        return mix(out + np.uint64(k)) & np.uint64(size - 1)

    def whole(self, k: int) -> np.ndarray:
        """Places from which k words of one piece follow."""
        n = max(0, len(self.piece) - k + 1)
        return self.piece[:n] == self.piece[k - 1 :] if n else np.zeros(0, bool)

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The texts of the k words from each of the places on."""
        first, size = self.start[at], self.end[at + k - 1] - self.start[at]
        data, offsets = self.text[ranges(first, size)[0]], np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


_COUNT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])


def _counts(p: Pieces, k: int, maps: Maps, longest: int) -> list[pa.RecordBatch]:
    """Rows (lang, phrase, bucket, n) of phrases of k words that are not ruled out, and rows without phrase for buckets of
    those of one word more; in the first pass also one row without bucket for each language's words."""
    out = []
    keys = p.buckets(k, maps.size)
    ok = p.whole(k)
    if maps.buckets is not None:
        parts = _has(maps.parts, p.buckets(k - 1, maps.size))
        ok &= _has(maps.buckets, keys) & parts[:-1] & parts[1:]
    at = np.flatnonzero(ok)
    if k == 1 and len(at):
        words = np.bincount(p.lang, minlength=len(p.langs))
        out.append(_batch(p.langs, None, None, words))
    if len(at):
        found = p.phrases(at, k).dictionary_encode()
        pairs = found.indices.to_numpy().astype(np.int64) * len(p.langs) + p.lang[at]
        code, first, n = np.unique(pairs, return_index=True, return_counts=True)
        out.append(_batch(p.langs.take(pa.array(code % len(p.langs))), found.dictionary.take(pa.array(code // len(p.langs))).cast(pa.binary()).cast(pa.string()), keys[at[first]], n))
    if k < longest:
        more = p.whole(k + 1)
        if len(more):  # a longer phrase starts and ends with one that may be frequent
            more &= ok[:-1] & ok[1:]
            bucket, n = np.unique(p.buckets(k + 1, maps.size)[more], return_counts=True)
            out.append(_batch(None, None, bucket, n))
    return out


def _batch(lang, phrase, bucket, n) -> pa.RecordBatch:
    size = len(n)
    null = lambda kind: pa.nulls(size, kind)
    columns = [null(pa.string()) if lang is None else lang.cast(pa.string()), null(pa.string()) if phrase is None else phrase, null(pa.int64()) if bucket is None else pa.array(bucket.astype(np.int64)), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, _COUNT.names)


def _pass(docs: DataFrame, k: int, maps: Maps, least: int, longest: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def run(batches):
        own = shared.value
        for part in slices(batches, "text", STEP_BYTES):
            yield from _counts(Pieces(part.column("text"), part.column("lang")), k, own, longest)
        give_back()

    summed = docs.mapInArrow(run, _COUNT).groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))
    return saved(summed.where((F.col("n") >= least) | F.col("bucket").isNull()), f"phrases-{k}")


def _bits(rows: DataFrame, size: int) -> np.ndarray:
    """A bit for each of size buckets: those of the rows are set. It is put together by Spark in parts of 4 KB."""
    place = F.col("bucket") + 1  # Spark's maps count from one
    parts = rows.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(max(size // 8, 4096), np.uint8)
    for r in parts.collect():  # size / 8 bytes in all
        out[(r.part - 1) * 4096 : r.part * 4096] |= np.frombuffer(r.bits, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all phrases of up to longest words with f >= least, (lang, n) with all words counted)."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    size = int(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    buckets = FEWEST
    while buckets < min(MOST, size // BUCKET_BYTES):
        buckets *= 2
    maps, levels, words = Maps(buckets), [], None
    for k in range(1, longest + 1):
        counted = _pass(rows, k, maps, least, longest)
        found = counted.where("phrase IS NOT NULL")
        words = counted.where("bucket IS NULL").select("lang", "n") if k == 1 else words
        levels.append(found.select("lang", "phrase", F.lit(k).alias("words"), F.col("n").alias("f")))
        if k < longest:
            maps = Maps(buckets, _bits(counted.where("phrase IS NULL AND bucket IS NOT NULL"), buckets), _bits(found, buckets))
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole, words


def _part(first, count):
    """The words from place first (from 0) on, count of them, of the array column w as one phrase."""
    return F.array_join(F.slice("w", first + 1, count), " ")


def _inner(candidates: DataFrame, size: int) -> DataFrame:
    """(lang, longer, phrase): the phrases of size words in longer candidates, with the counts of these."""
    places = F.sequence(F.lit(0), F.col("words") - size)
    return candidates.where(F.col("words") > size).select("lang", F.col("f").alias("longer"), F.explode(F.transform(places, lambda i: _part(i, F.lit(size)))).alias("phrase"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = WORDS, listed: int = LISTED, within: int = WITHIN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to longest words.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends, and these into words at blanks and tabs. a is how
    often the phrase stands within a piece, l and r how often the two parts of its worst cut do, score is
    floor(2000000 * a / (l + r)), n all words of the language. Phrases that mostly (within percent of their places) lie in
    one longer phrase are dropped. The first listed ones are given, by score, a, and the phrase's bytes.

    Null texts are empty, a null language is `und`, like one of that name. Repeated rows count as often as they stand; an
    empty table, and one without frequent phrases, has no rows; other columns take no part. Long texts are held whole, in
    some 60 bytes for each of their own. What the driver holds is of a fixed size, whatever the input's.
    """
    found, words = frequent_phrases(docs, text, lang, least, longest)
    candidates = saved(found.where("words > 1").withColumn("w", F.split("phrase", " ")), "phrases-candidates")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(0), F.col("k")).alias("left"), _part(F.col("k"), F.col("words") - F.col("k")).alias("right"))
    left, right = (found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    both = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    exact = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    score = F.expr(f"(cast(a AS decimal(20,0)) * cast({SCALE} AS decimal(7,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    worst = both.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("cut"))
    parts = [_inner(candidates, size) for size in range(2, longest)]
    scored = worst.select("lang", "phrase", "cut.*")
    if parts:
        inner = parts[0]
        for p in parts[1:]:
            inner = inner.unionByName(p)
        inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        scored = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (exact("longer", 20) * 100 < exact("a", 20) * within)).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = scored
    for salts in (4096, 64, 1):  # the best of parts, then of these, so that no task sorts all phrases of a language
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        ranked = ranked.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= listed)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({sql_lower("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)) GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS s FROM g WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.a, c.k, j, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(s[1:j], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(s[j + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_parts AS (SELECT lang, array_to_string(s[i + 1:i + m], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, s, a, m, unnest(range(0, k - m + 1)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inner_parts USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {WITHIN} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept JOIN n USING (lang) QUALIFY rank <= {LISTED}
"""
