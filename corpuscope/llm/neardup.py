"""Near-duplicate detection with HyperMinHash.

A document's set of word shingles is hashed into buckets; each bucket keeps its smallest hash as the count of leading
zeros and a few mantissa bits. Bands of these compressed registers give candidate buckets. In a bucket all members are
held against one hub, never all pairs. A candidate's similarity is estimated from the registers, with the collisions
that compression causes taken out, and what passes is confirmed on the full sets. Members of one bucket that are then
still in different components are held against each other in blocks inside tasks, so that no link between components is
lost to the choice of hubs and no pair becomes a row unless it links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, Words, grams, list_array, map_texts, mix, ranges, saved, sql_lower, table

BUCKET_BITS, MANTISSA_BITS, ROWS = 7, 10, 4
BUCKETS = 1 << BUCKET_BITS
#: Standard errors under the threshold at which an estimate still goes to the full comparison.
SLACK = 6.0
#: Members of a bucket, and shingles of them, that are compared at a time; larger buckets are cut into blocks, and every two blocks meet.
BLOCK, BLOCK_SHINGLES = 1_000, 2_000_000
SKETCH = [T.StructField("n_shingles", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("registers", T.BinaryType())]
SETS = [T.StructField("shingles", T.ArrayType(T.LongType(), False))]


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, and where each text's start. A text of fewer words
    has one shingle, the whole sequence; one without words has none."""
    w = Words(column, NOT_SPACE)
    counts = w.counts
    n = len(w.hashes)
    left = np.repeat(w.offsets[1:], counts) - np.arange(n)
    full = np.flatnonzero(left[: max(0, n - words + 1)] >= words)
    owner, values = [w.doc[full]], [grams(w.hashes, words)[full]]
    for k in range(1, words):
        own = np.flatnonzero(counts == k)
        if len(own):
            owner.append(own)
            values.append(grams(w.hashes, k)[w.offsets[own]])
    owner, values = np.concatenate(owner), np.concatenate(values)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[new], values[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of BUCKETS 16-bit registers for each text: 1 + (leading zeros, inverted mantissa) of the bucket's smallest
    hash, 0 where the bucket is empty."""
    out = np.zeros((len(offsets) - 1, BUCKETS), np.uint16)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bucket = (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    place = owner * BUCKETS + bucket
    first = np.ones(len(values), bool)
    first[1:] = place[1:] != place[:-1]
    rest = values[first] << np.uint64(BUCKET_BITS) | np.uint64((1 << BUCKET_BITS) - 1)
    high = rest >> np.uint64(11)  # 53 bits, exact as floats
    zeros = 52 - (np.frexp(np.maximum(high, np.uint64(1)).astype(np.float64))[1] - 1)
    mantissa = ((rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)).astype(np.int64)
    out.ravel()[place[first]] = 1 + (np.minimum(zeros, 62) << MANTISSA_BITS | ((1 << MANTISSA_BITS) - 1 - mantissa))
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """BUCKETS / ROWS keys of each row. Empty registers borrow from the next that is not, so that small sets have whole bands."""
    n = len(regs)
    twice = np.concatenate([regs, regs], axis=1)
    at = np.where(twice > 0, np.arange(2 * BUCKETS), 2 * BUCKETS - 1)
    at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :BUCKETS]
    dense = np.ascontiguousarray(np.take_along_axis(twice, at, axis=1))
    bands = dense.view(np.uint64).reshape(n, BUCKETS // ROWS)  # four registers of 16 bits
    return mix(bands ^ mix(np.arange(1, BUCKETS // ROWS + 1, dtype=np.uint64))[None, :])


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How likely different smallest hashes of a bucket agree after compression, for sets of n and m shingles."""
    level = 2.0 ** -np.arange(0, 63)[None, :]
    p = lambda x: np.diff(-np.exp(-(x[:, None] / BUCKETS) * level), axis=1)  # noqa: E731  (leading zeros of the smallest)
    return np.abs(p(n.astype(float)) * p(m.astype(float))).sum(1) / (1 << MANTISSA_BITS)


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected similarity of register rows, and its standard error at the edge of a set bias-free match."""
    used = ((a > 0) | (b > 0)).sum(1)
    share = ((a == b) & (a > 0)).sum(1) / np.maximum(used, 1)
    c = expected_collisions(n, m)
    return (share - c) / (1 - c), 0.5 / np.sqrt(np.maximum(used, 1))


def sketches(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    def start():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            values, offsets = shingle_sets(batch.column(text), words)
            regs = registers(values, offsets)
            n = np.diff(offsets)
            salted = np.stack([values, mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))])
            sums = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(salted, axis=1, dtype=np.uint64)], axis=1)
            f = mix(sums[:, offsets[1:]] - sums[:, offsets[:-1]] + n.astype(np.uint64)[None, :])
            return [pa.array(n), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), pa.array([r.tobytes() for r in regs], pa.binary())]

        return step

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias(text)), SKETCH, start, ["doc_id"], text)


def _bands(nodes: DataFrame) -> DataFrame:
    """(key, node, n): one row for each band of each distinct set."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType())])
    per = BUCKETS // ROWS

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), per))
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(regs).ravel().view(np.int64)), batch.column("node").take(rows), batch.column("n").take(rows)], schema.names)

    return nodes.select("node", "n", "registers").mapInArrow(run, schema)


def _promising(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose registers (ra, rb) don't speak against the threshold."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
                n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
                estimate, error = estimates(ra, rb, n, m)
                yield batch.select(["a", "b"]).filter(pa.array(estimate >= threshold - SLACK * error))

    return pairs.mapInArrow(run, "a long, b long")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (a, b): the smallest node that can be reached. Each round takes the least
    label of the neighbours and then that label's own label, until nothing changes."""
    edges = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        new = saved(lower.join(far, "component").select("node", "old", F.least("component", "beyond").alias("component")), "labels")
        if new.where("old != component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: documents whose shingle sets have a Jaccard similarity of
    at least percent / 100 are linked; a component is named by its smallest doc_id, which alone is kept.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing. Equal sets are one
    node, however many documents have them. Rows of equal doc_id are one document, linked through any of their texts.
    Rows without doc_id take no part: their component_id is null and kept is false. Further input columns don't matter.
    An empty table gives no rows. Ties don't arise: components are named by ids. A text of up to 2 GiB, Spark's own limit,
    is held whole in a task, in some 40 bytes for each of its own.
    """
    base = saved(sketches(docs, doc_id, text, words), "sketches")
    used = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = saved(used.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), "sets")
    bands = _bands(sets)
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    members = saved(bands.join(hubs, "key"), "members")  # of buckets with more than one
    wanted = members.select("node").distinct()
    full = saved(_sets(docs.select(F.col(doc_id).alias("node"), F.col(text).alias("text")).join(wanted, "node"), words), "full")
    regs = saved(sets.join(wanted, "node").select("node", "n", "registers"), "registers")
    confirm = lambda pairs: _confirmed(pairs, regs, full, percent)

    first = saved(members.where("hub != node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = saved(confirm(first), "links")
    components = connected_components(links)
    placed = members.join(components, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
    # buckets that still hold several components, those of equal members once, cut into blocks of bounded size
    mark = (F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x2"), F.count("*").alias("m"))
    open_ = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("n").alias("w"), *mark).where("lo < hi").groupBy("x1", "x2", "m").agg(F.min("key").alias("key"), F.first("w").alias("w"))
    open_ = open_.select("key", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rest = placed.join(open_, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "c").join(regs.select("node", "registers"), "node").join(full, "node")
    more = saved(_within(rest, percent).distinct(), "links")
    if not more.isEmpty():
        components = connected_components(links.union(more))
    labelled = sets.join(components, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component"))
    # repeated ids with different texts: a node's label may come through another row, hence the label of the id itself
    out = base.join(labelled, ["f1", "f2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _within(rest: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components inside each (key, i, j) of rest; a link whose ends are joined already,
    directly or through others of the group, is left out. Pairs never become rows: they are compared in the task."""

    def solve(rows: pa.Table) -> list[tuple[int, int]]:
        node, own, c = (rows.column(x).to_numpy() for x in ("node", "own", "c"))
        c, cross = c.copy(), rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        regs = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        lists = rows.column("shingles").combine_chunks()
        n, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        starts, out = np.cumsum(n) - n, []
        for a in range(len(node) - 1):
            b = np.arange(a + 1, len(node))
            b = b[(c[b] != c[a]) & (100 * np.minimum(n[b], n[a]) >= percent * np.maximum(n[b], n[a])) & ((own[b] != own[a]) | (not cross))]
            if len(b):
                estimate, error = estimates(regs[a][None], regs[b], np.full(len(b), n[a]), n[b])
                b = b[estimate >= percent / 100 - SLACK * error]
            if len(b):
                mine, (place, _) = flat[starts[a] : starts[a] + n[a]], ranges(starts[b], n[b])
                theirs = flat[place]
                same = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                i = np.add.reduceat(same.astype(np.int64), np.cumsum(n[b]) - n[b])
                for x in b[100 * i >= percent * (n[a] + n[b] - i)].tolist():
                    if c[x] != c[a]:
                        out.append((int(node[a]), int(node[x])))
                        c[c == c[x]] = c[a]
        return out

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done():
            found = solve(pa.Table.from_batches(held))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j = (batch.column(x).to_numpy() for x in ("key", "i", "j"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                now = (int(key[s]), int(i[s]), int(j[s]))
                if held and now != last:
                    yield done()
                    held.clear()
                last = now
                held.append(batch.slice(s, e - s))
        if held:
            yield done()

    return rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    def start():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            values, offsets = shingle_sets(batch.column("text"), words)
            return [list_array(pa.array(values.view(np.int64)), np.diff(offsets))]

        return step

    return map_texts(texts, SETS, start, ["node"], "text")


def _confirmed(pairs: DataFrame, regs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are as similar as asked."""
    side = lambda s: regs.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("registers").alias(f"r{s}"))
    near = _promising(pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"), percent / 100)
    sets = lambda s: full.select(F.col("node").alias(s), F.col("shingles").alias(f"s{s}"))
    both = near.join(sets("b"), "b").join(sets("a"), "a").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    return both.where(f"100 * i >= {percent} * (t - i)").select("a", "b").distinct()


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({sql_lower("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(t) = 1 THEN t[1] ELSE t[i] || ' ' || t[i + 1] END AS g
  FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t), 2))) AS i FROM w WHERE len(t) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
c AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component, w.doc_id) AS component_id, w.doc_id = coalesce(c.component, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""
