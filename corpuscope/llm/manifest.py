"""Merkle manifest of a dataset: a tree of hashes for each group of rows, one root over all, and a proof for each row.

Rows are placed in their group's order; blocks of 8^depth of them are reduced to one node each where they lie. What is
left, the top tree, is small: the driver builds it and broadcasts it, and the executors read from it the rest of every
proof and fold each row up to the root.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, sql_lower, table

#: Nodes that become one (a power of two: 2^3).
FAN = 8
#: Levels of a block (8^4 rows), more of them where there would be over TOP blocks.
DEPTH, TOP = 4, 1 << 18
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _joined(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def tree(nodes: list[str], depth: int | None = None) -> list[list[str]]:
    """Levels from nodes up to a lone one, each run of FAN nodes being one above; depth: exactly so many levels above."""
    levels = [nodes]
    while len(levels[-1]) > 1 if depth is None else len(levels) <= depth:
        low = levels[-1]
        levels.append([_joined(low[i : i + FAN]) for i in range(0, len(low), FAN)])
    return levels


def steps(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands before and after a node's way up in its run, level by level."""
    out = []
    for low in levels[:-1]:
        first = at - at % FAN
        out.append(("".join(low[first:at]), "".join(low[at + 1 : first + FAN])))
        at //= FAN
    return out


def fold(node: str, way: list[tuple[str, str]]) -> str:
    """The root that a node has by its proof."""
    for before, after in way:
        node = sha256((before + node + after).encode()).hexdigest()
    return node


class Top:
    """The tree above the blocks: for each group its levels from block nodes to its subroot, and the levels over subroots.
    A group of one block has levels inside that block alone, as many as it needs."""

    def __init__(self, blocks: dict[str, list[str]]):
        self.order = sorted(blocks, key=str.encode)
        self.groups = {g: tree(blocks[g]) for g in self.order}
        self.roots = tree([self.groups[g][-1][0] for g in self.order])
        self.place = {g: i for i, g in enumerate(self.order)}

    def suffix(self, group: str, block: int) -> list[tuple[str, str]]:
        return steps(self.groups[group], block) + steps(self.roots, self.place[group])

    def subroot(self, group: str) -> str:
        return self.groups[group][-1][0]

    @property
    def root(self) -> str | None:
        return self.roots[-1][0] if self.order else None


# ---------------------------------------------------------------- leaves
def leaf_hash(columns: list[Column]) -> Column:
    """sha256 of the values, each as `-` if null, else its number of UTF-8 bytes, a colon and the value as text."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text)), 256)


def group_key(group: Column) -> Column:
    """Text that orders groups bytewise, null first: empty for null, else the value after a sign."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), group.cast("string")))


# ---------------------------------------------------------------- places
def _placed(rows: DataFrame, order: str) -> DataFrame:
    """rows (_row, _group, _leaf, _changed and the id to order by) with _at, the place in the group. The rows are ranged by
    group and order; each file numbers its own rows, and counts of the files before are added. Rows alike in group, id
    and leaf are told apart by _row, so that they too are dealt out."""
    ranged = rows.repartitionByRange("_group", order, "_leaf", "_row").sortWithinPartitions("_group", order, "_leaf", "_row")
    schema = T.StructType([*ranged.schema, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])

    def run(batches):
        from pyspark import TaskContext

        part, group, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at = []
            for g, k in _runs(batch.column("_group")):
                n = n if g == group else 0
                group = g
                at.append(pa.array(range(n, n + k), pa.int64()))
                n += k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.concat_arrays(at)], schema.names)

    local = saved(ranged.mapInArrow(run, schema), "manifest-places")
    sizes = local.groupBy("_group", "_part").agg(F.count("*").alias("_n"))  # a row for each file and group in it
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # files + groups at most: files hold ranges
    return local.join(F.broadcast(sizes.select("_group", "_part", "_before")), ["_group", "_part"]).withColumn("_at", F.col("_before") + F.col("_local"))


def _runs(column: pa.Array):
    """(value, length) of each run of equal values."""
    ends = pc.run_end_encode(column)
    first = 0
    for value, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
        yield value, end - first
        first = end


# ---------------------------------------------------------------- manifest
def manifest(docs: DataFrame, leaf: Column, group: Column, doc_id: str = "doc_id", changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    leaf: the row's hash as hex text. group: the rows of one value make one tree, in ascending order of doc_id (null
    first), rows of equal id in the order of their leaves. changed: the hash that the row has now, if it may differ from
    the one that the manifest was made of; folded_root is worked out from it by the row's original proof, and verified
    says whether it is still the root. proof_sha256 is the hash of the proof's nodes, in order.

    Nulls are values like others; repeated rows have a leaf each; an empty table has no rows; other columns, whatever
    their names, take no part. Text of any length is read by Spark's own functions alone. The driver holds some 100 bytes
    for each 8^depth rows and for each group; of groups there should not be more than some hundred thousand.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("_id"), group_key(group).alias("_group"), F.unhex(leaf).alias("_leaf"), (F.unhex(changed) if changed is not None else F.lit(None).cast("binary")).alias("_changed"))
    rows = saved(rows, "manifest-leaves")
    depth, n = DEPTH, rows.count()
    while n > TOP * FAN**depth:
        depth += 1
    blocks = saved(_blocks(_placed(rows, "_id"), depth), "manifest-blocks")
    return _proved(blocks, docs.sparkSession.sparkContext.broadcast(_top(blocks)), depth, doc_id, docs.schema[doc_id].dataType)


def _blocks(placed: DataFrame, depth: int) -> DataFrame:
    """One row for each block: its group and number, its node, and its rows in order. A group of a single block is
    reduced until one node is left; else all blocks are reduced by as many levels."""
    of = placed.withColumn("_block", F.shiftright("_at", 3 * depth)).select("_group", "_block", "_at", "_id", "_leaf", "_changed")
    kind = placed.schema["_id"].dataType
    schema = T.StructType([T.StructField("group", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("lone", T.StringType()), T.StructField("full", T.StringType()),
                           T.StructField("ids", T.ArrayType(kind)), T.StructField("leaves", T.BinaryType()), T.StructField("changed", T.ArrayType(T.BinaryType()))])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        leaves = [x.hex() for x in rows.column("_leaf").to_pylist()]
        levels = tree(leaves, depth)
        lone = next(low[0] for low in levels if len(low) == 1)
        full = levels[-1][0]
        ids = rows.column("_id").combine_chunks()
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.Table.from_arrays([rows.column("_group")[:1], rows.column("_block")[:1], pa.array([len(leaves)], pa.int64()), pa.array([lone]), pa.array([full]),
                                     one(ids), pa.array([b"".join(rows.column("_leaf").to_pylist())]), one(rows.column("_changed").combine_chunks())], schema.names)

    return of.groupBy("_group", "_block").applyInArrow(run, schema)


def _top(blocks: DataFrame) -> Top:
    nodes: dict[str, dict[int, tuple[str, str]]] = {}
    for r in blocks.select("group", "block", "lone", "full").toLocalIterator():
        nodes.setdefault(r.group, {})[r.block] = (r.lone, r.full)
    return Top({g: [by[0][0]] if len(by) == 1 else [by[i][1] for i in range(len(by))] for g, by in nodes.items()})


def _proved(blocks: DataFrame, shared, depth: int, doc_id: str, kind: T.DataType) -> DataFrame:
    hexes = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    schema = T.StructType([T.StructField(doc_id, kind), *hexes, T.StructField("verified", T.BooleanType())])

    def run(batches):
        top: Top = shared.value
        root = top.root
        for batch in batches:
            for i in range(batch.num_rows):
                group, block, changed = batch.column("group")[i].as_py(), batch.column("block")[i].as_py(), batch.column("changed")[i].as_py()
                raw = batch.column("leaves")[i].as_py()
                leaves = [raw[j : j + 32].hex() for j in range(0, len(raw), 32)]
                levels = tree(leaves, None if len(top.groups[group][0]) == 1 else depth)
                suffix, subroot = top.suffix(group, block), top.subroot(group)
                tail = "".join(a + b for a, b in suffix).encode()
                proofs, folded = [], []
                for j, leaf in enumerate(leaves):
                    own = steps(levels, j)
                    proof = sha256("".join(a + b for a, b in own).encode())
                    proof.update(tail)
                    proofs.append(proof.hexdigest())
                    folded.append(fold(fold(leaf if changed[j] is None else changed[j].hex(), own), suffix))
                n = len(leaves)
                ids = batch.column("ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(leaves), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([x == root for x in folded])], schema.names)

    return blocks.mapInArrow(run, schema)


def tampered(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else changed."""
    return F.translate(text, UPPER, UPPER.lower())


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, leaf_hash(columns(F.col("text"))), F.col("lang"), changed=F.when(hit, leaf_hash(columns(tampered(F.col("text"))))))


_LEVELS, _GROUP_LEVELS = 8, 4  # the SQL holds for up to 8^8 rows of a group, and 8^4 groups


def _sql_leaf(text: str) -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _sql_levels(name: str, group: str, n: int) -> list[str]:
    """Tables name1 to name{n}, the levels over name0 (group, p, h); more{name}i has the groups whose level i has several."""
    return [f"""more{name}{i} AS MATERIALIZED (SELECT {group} FROM {name}{i} GROUP BY 1 HAVING count(*) > 1),
{name}{i + 1} AS MATERIALIZED (SELECT {group}, p // 8 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM {name}{i} JOIN more{name}{i} USING ({group}) GROUP BY 1, 2)""" for i in range(n)]  # fmt: skip


def _sql_ways(rows: str, name: str, group: str, n: int) -> list[str]:
    """Tables rows1 to rows{n}: each row's place, folded node and proof after so many levels."""
    return [f"""way{rows}{i} AS MATERIALIZED (SELECT s.r, string_agg(l.h, '' ORDER BY l.p) FILTER (l.p < s.p) AS b, string_agg(l.h, '' ORDER BY l.p) FILTER (l.p > s.p) AS a
FROM {rows}{i} s JOIN more{name}{i} USING ({group}) JOIN {name}{i} l ON l.{group} = s.{group} AND l.p // 8 = s.p // 8 GROUP BY 1),
{rows}{i + 1} AS MATERIALIZED (SELECT s.r, s.{group}, CASE WHEN w.r IS NULL THEN s.p ELSE s.p // 8 END AS p, CASE WHEN w.r IS NULL THEN s.f ELSE sha256(coalesce(b, '') || s.f || coalesce(a, '')) END AS f,
s.proof || coalesce(b, '') || coalesce(a, '') AS proof FROM {rows}{i} s LEFT JOIN way{rows}{i} w ON w.r = s.r)""" for i in range(n)]  # fmt: skip


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
_TABLES = [
    f"""d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS k, {_sql_leaf("text")} AS leaf,
CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN {_sql_leaf(sql_lower("text"))} END AS now FROM documents)""",
    "n0 AS MATERIALIZED (SELECT r, k, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS h, coalesce(now, leaf) AS f, '' AS proof FROM d)",
    *_sql_levels("n", "k", _LEVELS),
    "sub AS MATERIALIZED (SELECT k, arg_max(h, i) AS subroot FROM (" + " UNION ALL ".join(f"SELECT k, h, {i} AS i FROM n{i} WHERE p = 0" for i in range(_LEVELS + 1)) + ") GROUP BY 1)",
    "g0 AS MATERIALIZED (SELECT 1 AS one, k, row_number() OVER (ORDER BY k) - 1 AS p, subroot AS h FROM sub)",
    *_sql_levels("g", "one", _GROUP_LEVELS),
    "top AS MATERIALIZED (SELECT arg_max(h, i) AS root FROM (" + " UNION ALL ".join(f"SELECT h, {i} AS i FROM g{i} WHERE p = 0" for i in range(_GROUP_LEVELS + 1)) + "))",
    "s0 AS MATERIALIZED (SELECT r, k, p, f, proof FROM n0)",
    *_sql_ways("s", "n", "k", _LEVELS),
    f"t0 AS MATERIALIZED (SELECT r, 1 AS one, g0.p AS p, f, proof FROM s{_LEVELS} JOIN g0 USING (k))",
    *_sql_ways("t", "g", "one", _GROUP_LEVELS),
]
OP12_SQL = f"""WITH {", ".join(_TABLES)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM d JOIN t{_GROUP_LEVELS} USING (r) JOIN sub USING (k), top
"""
