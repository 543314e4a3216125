"""Language-model scores by a hierarchical Pitman-Yor model over words.

Every word of the training texts has a restaurant for what follows it; all these share one parent, the unigram
restaurant, whose base is uniform over the known words and one for all unknown. Customers are seated by Gibbs sampling:
each sweep draws the number of tables of each word in the parent given its customers, then that of each pair (context,
word) given what the parent, without the pair's own customers there, predicts for so many more (see seating.py). All
pairs are drawn side by side, given the state after the sweep before. Pairs, contexts and words are Spark tables keyed by hashes; the totals that a sweep
needs are summed over all of them before it, and frequent words are salted in joins. Texts are written once, as blocks of
numbered words. A block asks the buckets of pairs and of words for all it needs in lists, and gets lists in the same order. A pair of one customer always has
one table, so only pairs of two and more are drawn. Draws depend on the pair and the sweep, not on partitions.
Probabilities are the mean of several samples' predictions, so each context's probabilities sum to 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, Words, keep_modules, list_array, mix, saved, slices, table
from .labelled import fold
from .seating import Parent, draw_tables

#: Words of about this share of all tokens are spread in joins, so there are at most 2 / HOT_SHARE. Results don't depend on it.
HOT_SHARE = 1e-3
#: Bytes of text that are one block, and tokens of the table for each bucket of pairs. Results don't depend on them.
BLOCK, BUCKET = 4 << 20, 1_000_000
DISCOUNT, STRENGTH = (0.6, 0.75), (5.0, 1.0)  # of the parent, and of contexts
BURN_IN, SAMPLES = 4, 3
#: Rounds in which blocks are scored, so that as large a share of all answers moves between tasks at a time.
ROUNDS = 4
END = np.uint64(0x0E4D0E4D0E4D0E4D)


def token_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words with one end after each text, where each text starts, and the token before each (END at starts)."""
    w = Words(column, NOT_SPACE)
    n = len(w.counts)
    tokens = np.insert(w.hashes, w.offsets[1:], END)
    offsets = w.offsets + np.arange(n + 1)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offsets[:-1]] = END
    return tokens, offsets, before


def _key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for a pair; both are spread hashes already."""
    return u ^ (w << np.uint64(17) | w >> np.uint64(47))


# ---------------------------------------------------------------- lists of numbers as bytes, which Spark copies whole
_TYPES = {**dict.fromkeys("words u w n once ones uones totals c t sum cs ts of m".split(), np.int64), **dict.fromkeys("tokens k count at srcs size code".split(), np.int32), **dict.fromkeys("v p".split(), np.float32)}


_WHOLE = ("words", "u", "w", "p")  # of the others each list has all first bytes, then all second bytes and so on, which compresses well


def _packed(name: str, x: np.ndarray, counts: np.ndarray | None = None) -> pa.Array:
    """A binary column of lists, one after the other in x, of the number type that columns of this name have."""
    x = np.ascontiguousarray(x, _TYPES[name])
    ends = np.append(0, np.cumsum([len(x)] if counts is None else counts)).astype(np.int64)
    if x.nbytes >= 1 << 31:
        raise ValueError("a text is too long: its words take 2 GiB or more")
    raw = x.view(np.uint8)
    if name not in _WHOLE:
        raw = np.concatenate([raw[:0], *(x[a:b].view(np.uint8).reshape(-1, x.itemsize).T.ravel() for a, b in zip(ends, ends[1:]))])
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(raw)])


def _numbers(name: str, raw: np.ndarray) -> np.ndarray:
    kind = np.dtype(_TYPES[name])
    return raw.view(kind) if name in _WHOLE else np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def _list(batch, name: str, row: int) -> np.ndarray:
    return _numbers(name, np.frombuffer(batch.column(name)[row].as_buffer(), np.uint8))


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    out = []
    for chunk in table.column(name).chunks:
        if len(chunk) and chunk.buffers()[2] is not None:
            offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            raw = np.frombuffer(chunk.buffers()[2], np.uint8)
            out += [_numbers(name, raw[a:b]) for a, b in zip(offsets, offsets[1:])]
    return out


def _flat(table: pa.Table, name: str) -> np.ndarray:
    """All lists of a column, one after the other."""
    return np.concatenate([np.zeros(0, _TYPES[name]), *_lists(table, name)])


def _lengths(table: pa.Table, name: str) -> np.ndarray:
    return pc.binary_length(table.column(name)).to_numpy().astype(np.int64) // np.dtype(_TYPES[name]).itemsize


# ---------------------------------------------------------------- blocks of texts as numbers of words
def _blocks(docs: DataFrame) -> DataFrame:
    """docs (row, text, train) as one row for each BLOCK bytes of text: the block's words, most frequent first, the tokens
    as their places there, and the words of a large share with their counts."""
    schema = T.StructType.fromDDL("block long, n_tokens long, words binary, tokens binary, lengths array<int>, train array<boolean>, often array<long>, times array<long>")
    schema = schema.add("rows", T.ArrayType(docs.schema["row"].dataType))

    def run(batches):
        keep_modules()
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(slices(batches, "text", BLOCK)):
            streams = [token_stream(p.column("text")) for p in slices([batch], "text")]
            inverse, words = pd.factorize(np.concatenate([x[0] for x in streams]))
            counts = np.bincount(inverse, minlength=len(words))
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            lengths = np.concatenate([np.diff(x[1]) for x in streams]).astype(np.int32)
            often = order[: np.searchsorted(-counts[order], -HOT_SHARE * len(inverse), "right")]
            one = lambda x: list_array(x, np.array([len(x)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + i]), pa.array([len(inverse)]), _packed("words", words[order].view(np.int64)), _packed("tokens", place[inverse]), one(lengths), one(batch.column("train")), one(words[often].view(np.int64)), one(counts[often]), one(batch.column("row"))],
                schema.names,
            )

    return docs.mapInArrow(run, schema)


class _Pairs:
    """The distinct pairs (u, w) of a block, as places in its words, in the order of their buckets."""

    def __init__(self, batch, row: int, buckets: int, hot: np.ndarray, places: bool = False):
        """places: also find the place of each token's pair."""
        self.block = batch.column("block")[row].as_py()
        self.words, self.tokens = _list(batch, "words", row), _list(batch, "tokens", row)
        self.lengths, train = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("lengths", "train"))
        self.starts = np.cumsum(self.lengths) - self.lengths
        key = np.empty(len(self.tokens), np.int64)
        key[1:] = self.tokens[:-1]
        key[self.starts] = np.flatnonzero(self.words == END.view(np.int64))[0]
        key *= len(self.words)
        key += self.tokens
        by_key = np.argsort(key) if places else None
        key <<= 1
        key |= np.repeat(train, self.lengths)
        key = key[by_key] if places else np.sort(key)
        new = np.append(True, key[1:] >> 1 != key[:-1] >> 1)
        first = np.flatnonzero(new)
        n = np.add.reduceat(key & 1, first).astype(np.int32)
        u, w = (x.astype(np.int32) for x in np.divmod(key[first] >> 1, len(self.words)))
        del key
        bucket = (self.words % buckets).astype(np.int32)[u]
        own = np.flatnonzero(np.isin(self.words, hot)[u])
        bucket[own] = _key(*(self.words[x[own]].view(np.uint64) for x in (u, w))).view(np.int64) % buckets
        order = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")
        self.u, self.w, self.n, self.bucket = u[order], w[order], n[order], bucket[order]
        if places:
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            self.of_token = np.empty(len(by_key), np.int32)
            self.of_token[by_key] = place[np.cumsum(new) - 1]


def _pair_requests(blocks: DataFrame, buckets: int, hot: list[int]) -> DataFrame:
    """Each block's pairs by bucket: contexts, the number of words of each, these words, and counts in training texts.
    Pairs of one context share a bucket, but those of hot contexts are spread."""

    def run(batches):
        keep_modules()
        for batch in batches:
            for row in range(batch.num_rows):
                b = _Pairs(batch, row, buckets, np.array(hot, np.int64))
                u, w, n, bucket = b.u, b.w, b.n, b.bucket
                first = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (bucket[1:] != bucket[:-1])))
                ids, sizes = np.unique(bucket, return_counts=True)
                runs = np.unique(bucket[first], return_counts=True)[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.astype(np.int32)), pa.array(np.full(len(ids), b.block)), _packed("u", b.words[u[first]], runs), _packed("k", np.diff(np.append(first, len(u))), runs), _packed("w", b.words[w], sizes), _packed("count", n, sizes)],
                    ["bucket", "block", "u", "k", "w", "count"],
                )

    return blocks.select("block", "words", "tokens", "lengths", "train").mapInArrow(run, "bucket int, block long, u binary, k binary, w binary, count binary")


def _totals(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's requests: u, w and count over all blocks of each pair, sorted by key, and each request's pair."""
    u, w, n = np.repeat(_flat(table, "u"), _flat(table, "k")), _flat(table, "w"), _flat(table, "count").astype(np.int64)
    key = _key(u.view(np.uint64), w.view(np.uint64))
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(new) - 1
    return u[order[first]], w[order[first]], np.add.reduceat(n[order], first), of


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values, sorted, and the place of each x there."""
    found, ids = pd.factorize(x)
    order = np.argsort(ids)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    return ids[order], place[found]


#: A bucket's pairs of two customers and more: contexts (u, their tables of one customer, totals of each sample) and of
#: each pair the word, its context's place, customers, tables and the sum of the samples' tables, in order of the words' buckets.
_PAIRS = "bucket int, u binary, once binary, totals binary, w binary, c binary, t binary, sum binary, at binary, hot array<long>, hot_t array<long>"
#: A bucket's words: customers in texts (n), tables of pairs of one customer that serve the word (ones) or stand in its own
#: restaurant (uones), customers and tables in the parent, those of each sample and its tables as a context (cs, ts, of),
#: the words that each bucket of pairs (srcs) has its size of, and sums over the words of two customers and more, or of all.
_WORDS = "bucket int, w binary, n binary, ones binary, uones binary, c binary, t binary, cs binary, ts binary, of binary, at binary, srcs binary, size binary, sum_c long, sum_t long, sums array<double>"
#: From buckets of pairs to those of words: kind 0 has tables of words (in order), kind 1 tables of contexts by sample.
_MESSAGE = "kind int, bucket int, src int, w binary, m binary"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def _rows(schema: str, **values) -> pa.Table:
    """One row of a table of lists."""
    one = lambda name, kind: _packed(name, values[name]) if kind == "binary" else pa.array([values[name]], _ARROW[kind])
    return pa.table({name: one(name, kind) for name, kind in (x.split(" ") for x in schema.split(", "))})


def _by(ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of words, each with where its words start and how many it has; ids are in order of buckets."""
    bucket = ids % buckets
    first = np.flatnonzero(np.append(len(ids) > 0, bucket[1:] != bucket[:-1]))
    return bucket[first].astype(np.int32), first, np.diff(np.append(first, len(ids)))


def _counts(requests: DataFrame, buckets: int, hot: list[int]) -> DataFrame:
    """(kind, bucket, src, block, u, once, w, n, ones, at, code, hot, hot_ones): a bucket's pairs of two customers and more (kind 0), and lists to the
    buckets of words: customers, pairs of one customer and other pairs of each word (1), pairs of one customer of each context (2), those of hot contexts also as arrays.
    Of each request (3), in order: 0 for a pair of no customer, 1 for one of one, 2 and its place among those of kind 0 for others."""
    schema = "kind int, bucket int, src int, block long, u binary, once binary, w binary, n binary, ones binary, at binary, code binary, hot array<long>, hot_ones array<long>"

    def run(table: pa.Table) -> pa.Table:
        keep_modules()
        own = table.column("bucket")[0].as_py()
        u, w, n, of = _totals(table)
        seen, none = np.flatnonzero(n > 0), np.zeros(0, np.int64)
        code, single, two = np.minimum(n, 1).astype(np.int32), n[seen] == 1, n[seen] >= 2
        row = {"bucket": own, "src": own, "block": None, **dict.fromkeys("u once w n ones at code hot hot_ones".split(), none)}
        out = [_rows(schema, **row | {"kind": 0}).slice(0, 0)]  # all columns, even if no pair is of training texts
        for kind, x in ((1, w[seen]), (2, u[seen])):
            ids, inverse = _distinct(x)
            all_n, ones, more = (y.astype(np.int64) for y in (np.bincount(inverse, n[seen], len(ids)), np.bincount(inverse[single], minlength=len(ids)), np.bincount(inverse[two], minlength=len(ids))))
            order = np.argsort(ids % buckets, kind="stable")
            for to, a, k in zip(*_by(ids[order], buckets)):
                part = order[a : a + k]
                often = part[np.isin(ids[part], hot)] if kind == 2 and len(hot) else part[:0]
                out.append(_rows(schema, **row | {"kind": kind, "bucket": to, "w": ids[part], "n": all_n[part], "ones": ones[part], "once": more[part] if kind == 1 else none, "hot": ids[often], "hot_ones": ones[often]}))
            if kind == 2 and two.any():
                have, at = np.unique(inverse[two], return_inverse=True)
                own_pairs = seen[two]
                order = np.lexsort((w[own_pairs], w[own_pairs] % buckets))
                own_pairs = own_pairs[order]
                code[own_pairs] = 2 + np.arange(len(order))
                out.append(_rows(schema, **row | {"kind": 0, "u": ids[have], "once": ones[have], "w": w[own_pairs], "n": n[own_pairs], "at": at[order]}))
        sizes = _lengths(table, "w")
        codes = pa.table({"kind": np.full(len(sizes), 3, np.int32), "bucket": table.column("bucket"), "block": table.column("block"), "code": _packed("code", code[of], sizes)})
        return pa.concat_tables([*out, codes], promote_options="default")

    return requests.groupBy("bucket").applyInArrow(run, schema)


#: Kind 0: of each pair what its seats come to (v). Kind 1: of each word n, then for each of c, t and tables as a context
#: the first sample's and the other samples' differences from it, as one list a value (m).
_ANSWER = "kind int, bucket int, block long, m binary, v binary"


def _seats(codes: DataFrame, state: DataFrame) -> DataFrame:
    """Answers to pair requests: customers less discounts of each pair, in order. state: the pairs of two customers and more."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        keep_modules()
        if not table.num_rows:
            return pa.table([pa.array([], f.type) for f in pa_answer], schema=pa_answer)
        v = np.array([0, 1 - DISCOUNT[1]])
        if known.num_rows:
            v = np.append(v, _flat(known, "c") - DISCOUNT[1] * (_flat(known, "sum") / SAMPLES))
        rows = table.num_rows
        return pa.table([np.zeros(rows, np.int32), table.column("bucket"), table.column("block"), pa.nulls(rows, pa.binary()), _packed("v", v.astype(np.float32)[_flat(table, "code")], _lengths(table, "code"))], schema=pa_answer)

    pa_answer = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("m", pa.binary()), ("v", pa.binary())])
    return codes.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(run, _ANSWER)


def _word_answers(blocks: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """Of each block's words, in order of buckets: customers in texts, customers and tables in the parent and tables as a
    context in each sample; all 0 of unknown words."""

    def ask(batches):
        keep_modules()
        for batch in batches:
            for row in range(batch.num_rows):
                words = _list(batch, "words", row)
                order = np.argsort(words % buckets, kind="stable")
                ids, sizes = np.unique(words % buckets, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(np.full(len(ids), batch.column("block")[row].as_py())), _packed("w", words[order], sizes)], ["bucket", "block", "w"])

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        keep_modules()
        if not table.num_rows:
            return pa.table([pa.array([], f.type) for f in pa_answer], schema=pa_answer)
        have = _flat(known, "w") if known.num_rows else np.zeros(0, np.int64)
        words = _flat(table, "w")
        sizes = _lengths(table, "w")
        every = np.zeros((len(have) + 1, 1 + 3 * SAMPLES), np.int64)  # the last is for unknown words
        at = np.full(len(words), len(have))
        if len(have):
            every[:-1, 0] = _flat(known, "n")
            for i, c in enumerate(("cs", "ts", "of")):
                x = _flat(known, c).reshape(SAMPLES, -1)
                every[:-1, 1 + i * SAMPLES : 1 + (i + 1) * SAMPLES] = np.concatenate([x[:1], x[1:] - x[0]]).T
            at = np.minimum(np.searchsorted(have, words), len(have) - 1)
            at[have[at] != words] = len(have)
        v, width, rows, ends = every[at], every.shape[1], table.num_rows, np.append(0, np.cumsum(sizes))
        m = np.concatenate([v[a:b].T.ravel() for a, b in zip(ends, ends[1:])])
        return pa.table([np.ones(rows, np.int32), table.column("bucket"), table.column("block"), _packed("m", m, sizes * width), pa.nulls(rows, pa.binary())], schema=pa_answer)

    pa_answer = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("m", pa.binary()), ("v", pa.binary())])
    asked = blocks.select("block", "words").mapInArrow(ask, "bucket int, block long, w binary")
    return asked.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(run, _ANSWER)


def _scored(blocks: DataFrame, answers: DataFrame, buckets: int, hot: list[int], known_words: int, N: int, totals: list[float]) -> DataFrame:
    """(row, m, known, base, score) of each text, from its block and the answers to the block's requests.
    totals: of customers, then of tables, of the parent in each sample."""
    schema = T.StructType([T.StructField("row", blocks.schema["rows"].dataType.elementType), *(T.StructField(n, t) for n, t in (("m", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType())))])

    def run(table: pa.Table, answer: pa.Table) -> pa.Table:
        keep_modules()
        table = table.combine_chunks()
        b = _Pairs(table, 0, buckets, np.array(hot, np.int64), places=True)
        answer = answer.sort_by("bucket")
        kind = answer.column("kind").to_numpy()
        seat = _flat(answer.filter(pa.array(kind == 0)), "v").astype(np.float64)
        of_words = answer.filter(pa.array(kind == 1))
        order = np.argsort(b.words % buckets, kind="stable")
        v = np.empty((1 + 3 * SAMPLES, len(order)), np.int64)
        v[:, order] = np.concatenate([x.reshape(len(v), -1) for x in _lists(of_words, "m")], axis=1)
        n = v[0]
        p = seat / (STRENGTH[1] + n[b.u])
        for i in range(SAMPLES):
            c, t, of = (v[1 + k * SAMPLES] + (v[1 + k * SAMPLES + i] if i else 0) for k in range(3))
            left = (STRENGTH[1] + DISCOUNT[1] * of) / (STRENGTH[1] + n) / SAMPLES
            p += left[b.u] * _p0(c, t, totals[i], totals[SAMPLES + i], known_words)[b.w]
        sums = lambda x: np.add.reduceat(x, b.starts)
        base, known = np.log10((n + 0.5) / (N + 0.5 * (known_words + 1))), (n > 0).astype(np.int64)
        rows = table.column("rows").combine_chunks().flatten()
        return pa.table([rows, b.lengths.astype(np.int64), sums(known[b.tokens]), sums(base[b.tokens]), sums(np.log10(np.minimum(p, 1.0))[b.of_token])], ["row", "m", "known", "base", "score"])

    return blocks.drop("often", "times", "n_tokens").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


# ---------------------------------------------------------------- seating
def _drawn(u: np.ndarray, w: np.ndarray, c: np.ndarray, t: np.ndarray, total: np.ndarray, parent: Parent, level: int, sweep: int) -> np.ndarray:
    """t drawn anew, in parts: tables of c customers in restaurants of total tables, whose parent gives them customers."""
    out = np.empty_like(t)
    shift = np.array([2 * sweep + level + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for a in range(0, len(t), 50_000):
        x = slice(a, a + 50_000)
        seed = mix(_key(u[x].view(np.uint64), w[x].view(np.uint64)) + shift)
        out[x] = draw_tables(c[x], parent.of(x), total[x] - t[x], DISCOUNT[level], STRENGTH[level], seed)
    return out


def _without_own(p: np.ndarray, t: np.ndarray, customers: int, all_tables: int, known: int) -> Parent:
    """The parent as each pair sees it: without the customers that the pair's own t tables are there. p: its prediction."""
    mass = STRENGTH[0] + customers
    return Parent(np.maximum(p * mass - t, (STRENGTH[0] + DISCOUNT[0] * all_tables) / (known + 1)), mass - t)


def _p0(customers, tables, all_customers: float, all_tables: float, known: int):
    """The parent's prediction; a word without customers is the unknown one."""
    return (customers - DISCOUNT[0] * tables + (STRENGTH[0] + DISCOUNT[0] * all_tables) / (known + 1)) / (STRENGTH[0] + all_customers)


def _first_words(counts: DataFrame) -> DataFrame:
    """Buckets of words (_WORDS), each known word at one table of the parent."""

    def run(table: pa.Table) -> pa.Table:
        keep_modules()
        table = table.sort_by("src")
        kind = table.column("kind").to_numpy()
        words, contexts = (table.filter(pa.array(kind == k)) for k in (1, 2))
        ids, more = _flat(words, "w"), _flat(words, "once")
        w, at = _distinct(ids)
        n, ones = (np.bincount(at, _flat(words, x), len(w)).astype(np.int64) for x in ("n", "ones"))
        of = np.searchsorted(w, _flat(contexts, "w"))
        uones = np.bincount(of, _flat(contexts, "ones"), len(w)).astype(np.int64)
        src = np.repeat(words.column("src").to_numpy(), _lengths(words, "w"))[more > 0]
        names, sizes = np.unique(src, return_counts=True)
        zero = np.zeros(0, np.int64)
        return _rows(_WORDS, bucket=table.column("bucket")[0].as_py(), w=w, n=n, ones=ones, uones=uones, c=ones, t=np.ones_like(n), cs=zero, ts=zero, of=zero, at=at[more > 0], srcs=names, size=sizes, sum_c=n.sum(), sum_t=(n == 1).sum(), sums=zero)

    return counts.where("kind in (1, 2)").select("kind", "bucket", "src", "once", "w", "n", "ones").groupBy("bucket").applyInArrow(run, _WORDS)


def _first_pairs(counts: DataFrame, hot: list[int]) -> DataFrame:
    """Buckets of pairs of two customers and more (_PAIRS), each pair at one table."""

    def run(batches):
        keep_modules()
        for batch in batches:
            for i in range(batch.num_rows):
                x = {k: _list(batch, k, i) for k in ("u", "once", "w", "n", "at")}
                t, zero = np.ones_like(x["n"]), np.zeros(0, np.int64)
                places = np.flatnonzero(np.isin(x["u"], hot))
                tables = np.bincount(x["at"], t, len(x["u"])).astype(np.int64)
                yield from _rows(_PAIRS, bucket=batch.column("bucket")[i].as_py(), u=x["u"], once=x["once"], totals=zero, w=x["w"], c=x["n"], t=t, sum=t * 0, hot=x["u"][places], hot_t=tables[places], at=x["at"]).to_batches()

    return counts.where("kind = 0").select("bucket", "u", "once", "w", "n", "at").mapInArrow(run, _PAIRS)


def _sent(pairs: DataFrame, buckets: int, last: bool) -> DataFrame:
    """_MESSAGE: the tables of each word in each bucket of pairs; in the last round also the samples' tables of contexts."""

    def run(batches):
        keep_modules()
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda k: _list(batch, k, i)
                own, w, none = batch.column("bucket")[i].as_py(), get("w"), np.zeros(0, np.int64)
                start = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                m, out = np.add.reduceat(get("t"), start), []
                for to, a, k in zip(*_by(w[start], buckets)):
                    out.append((0, to, none, m[a : a + k]))
                if last:
                    u = get("u")
                    totals = get("totals").reshape(SAMPLES, len(u))
                    order = np.argsort(u % buckets, kind="stable")
                    for to, a, k in zip(*_by(u[order], buckets)):
                        part = order[a : a + k]
                        out.append((1, to, u[part], totals[:, part].T.ravel()))
                lists = lambda k: _packed("wm"[k - 2], np.concatenate([x[k] for x in out]), np.array([len(x[k]) for x in out]))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([own] * len(out), pa.int32()), lists(2), lists(3)], ["kind", "bucket", "src", "w", "m"])

    return pairs.select("bucket", "u", "totals", "w", "t").mapInArrow(run, _MESSAGE)


def _parents(words: DataFrame, messages: DataFrame, sweep: int, all_tables: int, known: int) -> DataFrame:
    """Buckets of words with customers as the messages say and, but in the last round, tables in the parent drawn anew.
    From the second round after burn-in on, customers and tables of the round before are kept as a sample."""

    def run(table: pa.Table, sent: pa.Table) -> pa.Table:
        keep_modules()
        x = {k: _flat(table, k) for k in ("w", "n", "ones", "uones", "t", "cs", "ts", "at", "srcs", "size")}
        sent = sent.sort_by("src")
        kind = sent.column("kind").to_numpy()
        m = _flat(sent.filter(pa.array(kind == 0)), "m")
        c, t, of, sums = x["ones"] + np.bincount(x["at"], m, len(x["w"])).astype(np.int64), x["t"], np.zeros(0, np.int64), np.zeros(0)
        cs, ts, two = x["cs"], x["ts"], x["n"] >= 2
        if sweep > BURN_IN:
            cs, ts = np.append(cs, c), np.append(ts, np.minimum(t, c))
        if sweep < BURN_IN + SAMPLES:
            w = x["w"][two]
            t = t.copy()
            t[two] = _drawn(w * 0, w, c[two], t[two], np.full(len(w), all_tables), Parent(np.full(len(w), 1 / (known + 1))), 0, sweep)
        else:
            of = np.repeat(x["uones"][None], SAMPLES, axis=0)
            contexts = sent.filter(pa.array(kind == 1))
            at = np.searchsorted(x["w"], _flat(contexts, "w"))
            more = _flat(contexts, "m").reshape(-1, SAMPLES)
            for i in range(SAMPLES):
                of[i] += np.bincount(at, more[:, i], len(x["w"])).astype(np.int64)
            of, sums = of.ravel(), np.concatenate([y.reshape(SAMPLES, -1).sum(axis=1) for y in (cs, ts)])
        return _rows(_WORDS, bucket=table.column("bucket")[0].as_py(), **{k: x[k] for k in ("w", "n", "ones", "uones", "at", "srcs", "size")}, c=c, t=t, cs=cs, ts=ts, of=of, sum_c=c[two].sum(), sum_t=t[two].sum(), sums=sums)

    return words.groupBy("bucket").cogroup(messages.groupBy("bucket")).applyInArrow(run, _WORDS)


def _predictions(words: DataFrame, customers: int, tables: int, known: int) -> DataFrame:
    """(bucket, src, p): the parent's predictions of the words of each bucket of pairs, in their order there."""

    def run(batches):
        keep_modules()
        for batch in batches:
            for i in range(batch.num_rows):
                c, t, at, src, size = (_list(batch, k, i) for k in ("c", "t", "at", "srcs", "size"))
                p = _p0(c, t, customers, tables, known)[at]
                own = np.full(len(src), batch.column("bucket")[i].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(own), _packed("p", p, size)], ["bucket", "src", "p"])

    return words.select("bucket", "c", "t", "at", "srcs", "size").mapInArrow(run, "bucket int, src int, p binary")


def _seated(pairs: DataFrame, predictions: DataFrame, sweep: int, hot: dict[int, int], customers: int, all_tables: int, known: int) -> DataFrame:
    """Buckets of pairs with tables drawn anew. hot: tables of the contexts that are spread over buckets; customers and
    all_tables: of the parent."""
    names = np.array(sorted(hot), np.int64)
    tables = np.array([hot[x] for x in sorted(hot)], np.int64)

    def run(table: pa.Table, sent: pa.Table) -> pa.Table:
        keep_modules()
        x = {k: _flat(table, k) for k in ("u", "once", "totals", "w", "c", "t", "sum", "at")}
        w, at, t, size = x["w"], x["at"], x["t"], len(x["u"])
        p = _flat(sent.sort_by("src"), "p").astype(np.float64)[np.cumsum(np.append(False, w[1:] != w[:-1]))]
        total = x["once"] + np.bincount(at, t, size).astype(np.int64)
        spread = np.flatnonzero(np.isin(x["u"], names))
        total[spread] = tables[np.searchsorted(names, x["u"][spread])]
        t = _drawn(x["u"][at], w, x["c"], t, total[at], _without_own(p, t, customers, all_tables, known), 1, sweep)
        new = np.bincount(at, t, size).astype(np.int64)
        sample = sweep >= BURN_IN
        return _rows(_PAIRS, bucket=table.column("bucket")[0].as_py(), u=x["u"], once=x["once"], totals=np.append(x["totals"], new) if sample else x["totals"], w=w, c=x["c"], t=t, sum=x["sum"] + t if sample else x["sum"], hot=x["u"][spread], hot_t=new[spread], at=at)

    return pairs.groupBy("bucket").cogroup(predictions.groupBy("bucket")).applyInArrow(run, _PAIRS)


def _hot_tables(pairs: DataFrame, singles: dict[int, int]) -> dict[int, int]:
    """Tables of the contexts that are spread over buckets; singles: those of their pairs of one customer."""
    rows = pairs.select(F.explode(F.arrays_zip("hot", "hot_t")).alias("x")).groupBy("x.hot").agg(F.sum("x.hot_t").alias("t")).collect() if singles else []
    return {r.hot: int(r.t) + singles[r.hot] for r in rows}


def _sampled(counts: DataFrame, hot: list[int], buckets: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Buckets of pairs and of words after all sweeps, the number of known words and that of training tokens. A sweep sends the tables of pairs to the words'
    buckets in lists, draws the parent's tables there, and sends its predictions back. Words that occur once have one
    customer at one table throughout and are only counted."""
    words, pairs = _kept(_first_words(counts), "parents"), _kept(_first_pairs(counts, np.array(hot, np.int64)), "seats")
    known, once, N = (int(x or 0) for x in words.agg(F.sum(F.octet_length("w") / 8), F.sum("sum_t"), F.sum("sum_c")).first())
    alone = counts.select(F.explode(F.arrays_zip("hot", "hot_ones")).alias("x")).groupBy("x.hot").agg(F.sum("x.hot_ones").alias("n"))
    singles = {r.hot: int(r.n) for r in alone.collect()} if hot else {}
    old, all_tables = [], known
    for sweep in range(BURN_IN + SAMPLES + 1):
        last = sweep == BURN_IN + SAMPLES
        old += [words]
        words = _kept(_parents(words, _sent(pairs, buckets, last), sweep, all_tables, known), "parents")
        old = _dropped(old)
        if not last:
            customers, all_tables = (int(x or 0) + once for x in words.agg(F.sum("sum_c"), F.sum("sum_t")).first())
            old = [pairs]
            pairs = _kept(_seated(pairs, _predictions(words, customers, all_tables, known), sweep, _hot_tables(pairs, singles), customers, all_tables, known), "seats")
            old = _dropped(old)
    return pairs, words, known, N


def _kept(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A saved table of lists: they are nearly all different, so the values of a file are not looked up among each other."""
    return saved(df, name, "zstd", by, {"parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"})


def _dropped(tables: list[DataFrame]) -> list[DataFrame]:
    """Delete saved tables that no later plan reads."""
    for df in tables:
        jvm, files = df.sparkSession._jvm, df.inputFiles()
        if files:
            folder = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0].split("/round=")[0])
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    return []


def score_texts(docs: DataFrame, train, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """keep (default: all columns), n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text) and
    perplexity (per token).

    train: condition of the rows to learn from. Null texts are empty, so their one token is the end. Repeated rows each
    get their row; rows of equal id and text are scored alike. Without training rows the known words are none and every
    token has the one unknown word's probability, 1. An empty table gives no rows. A text's words are held whole, in some
    50 bytes each; one whose words take 2 GiB as numbers is an error. An input column named like a result gives way to it.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")]
    row = F.struct(F.lit(True).alias("any"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    blocks = _kept(_blocks(docs.select(row.alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))), "blocks")
    tokens = int(blocks.select(F.sum("n_tokens").alias("n")).first().n or 0)
    buckets = 1 + tokens // BUCKET
    often = blocks.select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy("x.often").agg(F.sum("x.times").alias("n"))
    hot = sorted(r.often for r in often.where(F.col("n") >= HOT_SHARE / 2 * tokens).collect())
    counts = _kept(_counts(_pair_requests(blocks, buckets, hot), buckets, hot), "counts")
    pairs, words, known, N = _sampled(counts, hot, buckets)
    totals = [float(x or 0) for x in words.agg(*(F.sum(F.get("sums", F.lit(i))) for i in range(2 * SAMPLES))).first()]
    turn = F.pmod(F.xxhash64("block"), F.lit(ROUNDS)).cast("int")
    seats = _kept(_seats(counts.where("kind = 3").select("bucket", "block", "code"), pairs.select("bucket", "c", "sum")).withColumn("round", turn), "answers", by=("round",))
    _dropped([counts, pairs])
    word_answers = _kept(_word_answers(blocks, words.select("bucket", "w", "n", "cs", "ts", "of"), buckets).withColumn("round", turn), "answers", by=("round",))
    _dropped([words])
    answers, out = word_answers.union(seats), None
    for i in range(ROUNDS):  # counts are whole by now; a round has its blocks' answers moved to them
        part = _kept(_scored(blocks.where(turn == i), answers.where(F.col("round") == i).drop("round"), buckets, hot, known, N, totals), "scores")
        out = part if out is None else out.union(part)
    _dropped([blocks, word_answers, seats])
    return out.select(*(F.col(f"row.keep_{i}").alias(c) for i, c in enumerate(keep)), F.col("m").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(N).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("m")).alias("perplexity"))


def op5_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 5) == 1
    return score_texts(table(spark, sf_dir, "documents"), ~held, keep=["doc_id"]).withColumn("held_out", held)
