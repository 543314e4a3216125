"""Stored tables that several writers change together.

A root folder holds data files and numbered commits. A commit is a small JSON file that says which files each table
consists of; it is put in place only if its number is free, so of two writers one has to look again at what is there
now. Readers take the last commit and see all of it or none. Files are never changed, only left out by later commits.

    <root>/commits/00000000000000000003.json    number, id, tables, batches
    <root>/lists/<id>/<table>                    (file, schema) of a table, as Parquet
    <root>/data/<table>/<id>/...                 its files
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIST = "file string, schema int"


# ---------------------------------------------------------------- files
def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where it is unset, a temporary one, but
    only if all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corpuscope-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """df as Parquet in the shared folder: what is drawn or numbered in it stays as it is, also if executors are lost."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return sorted_join(df.sparkSession.read.schema(df.schema).parquet(path))


def sorted_join(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting, not by a broadcast: Spark judges files by their size on disk, and rows of ids and JSON
    that take 10 MB there may take a driver's whole memory. F.broadcast() of the other side goes before it; a union drops it."""
    return df.hint("merge")


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one of this name; says whether it was written. The text is written aside and
    given its name in one step, which fails if the name is taken: by a rename that does not overwrite, or on a local
    disk, where that rename looks first and moves then, by a link."""
    fs, target = _files(spark, path)
    hadoop, aside = spark._jvm.org.apache.hadoop.fs, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    fs.mkdirs(target.getParent())
    temporary = hadoop.Path(aside)
    out = fs.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(temporary.toUri().getPath(), target.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
            context.rename(temporary, target, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(temporary, False)


# ---------------------------------------------------------------- versions
@dataclass
class Version:
    """A commit: for each table the list of its files and its schemas, the last one being the current; for each stream the
    last batch that it brought."""

    number: int = 0
    id: str = ""
    tables: dict[str, dict] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self.tables[name]["schemas"][-1])


def _name(root: str, number: int) -> str:
    return f"{root}/commits/{number:020d}.json"


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _files(spark, f"{root}/commits")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def latest(spark: SparkSession, root: str) -> Version:
    """The last commit; without any an empty one of number 0."""
    found = versions(spark, root)
    return at_version(spark, root, found[-1]) if found else Version()


def at_version(spark: SparkSession, root: str, number: int) -> Version:
    x = json.loads(_text(spark, _name(root, number)))
    return Version(x["number"], x["id"], x["tables"], x["batches"])


class Conflict(Exception):
    """Other writers were faster too often."""


def commit(spark: SparkSession, root: str, make: Callable[[Version, str], dict[str, dict] | None], stream: str | None = None, batch: int | None = None, attempts: int = 50) -> Version:
    """Put a new commit in place. make(version, id) gives the tables that change, as append(), replace(), update() and
    alter() give them, from what is there; it is asked again if another writer's commit came first, so its checks hold
    for what its commit follows. None: nothing changes, and there is no commit.

    stream and batch: the batch of a stream that the commit brings. A batch that the stream has brought, or an earlier
    one, changes nothing, so a batch that is run again after a failure counts once.
    """
    for _ in range(attempts):
        now = latest(spark, root)
        if stream is not None and batch <= now.batches.get(stream, -1):
            return now
        own = uuid.uuid4().hex
        tables = make(now, own)
        if tables is None and stream is None:
            return now
        batches = now.batches | ({stream: batch} if stream is not None else {})
        new = Version(now.number + 1, own, now.tables | (tables or {}), batches)
        if put_if_absent(spark, _name(root, new.number), json.dumps(new.__dict__)):
            return new
    raise Conflict(f"{attempts} commits of other writers came first: {root}")


# ---------------------------------------------------------------- reading
def file_list(spark: SparkSession, root: str, version: Version, name: str) -> list[tuple[str, int]]:
    """(file, schema) of a table: a name for each file, as Spark's own listing holds them."""
    rows = spark.read.schema(LIST).parquet(f"{root}/{version.tables[name]['list']}").collect()
    return sorted((r.file, r.schema) for r in rows)


#: The column of rows_of() that names a row's file.
FILE = "_file"


def rows_of(spark: SparkSession, root: str, version: Version, name: str, files: list[tuple[str, int]]) -> DataFrame:
    """Rows of some of a table's files, each with its file's name."""
    return _read_files(spark, root, version, name, files, True)


def _short(path):
    """The last two parts of a path, folder and file, which tell a table's files apart."""
    return F.substring_index(path, "/", -2)


def _read_files(spark: SparkSession, root: str, version: Version, name: str, files: list[tuple[str, int]], named: bool = False) -> DataFrame:
    """Rows of some of a table's files in its current schema: columns that a file's schema did not have are null, and
    those that are there no more are left out. Files of one schema are read by one scan."""
    more = [F.concat(F.lit(f"data/{name}/"), _short(F.col("_metadata.file_path"))).alias(FILE)] if named else []
    schemas = [T.StructType.fromJson(s) for s in version.tables[name]["schemas"]]
    out = None
    for i, own in enumerate(schemas):
        paths = [f"{root}/{f}" for f, s in files if s == i]
        if paths:
            rows = spark.read.schema(own).parquet(*paths)
            kept = _carried(schemas, i)
            rows = rows.select(*((F.col(c.name) if c.name in kept else F.lit(None)).cast(c.dataType).alias(c.name) for c in schemas[-1]), *more)
            out = rows if out is None else out.unionByName(rows)
    empty = T.StructType([*schemas[-1], *([T.StructField(FILE, T.StringType())] if named else [])])
    return spark.createDataFrame([], empty) if out is None else out


def _carried(schemas: list[T.StructType], first: int) -> set[str]:
    """Columns of a schema that every later one has: a column that was dropped and added again starts anew."""
    kept = set(schemas[first].names)
    for later in schemas[first + 1 :]:
        kept &= set(later.names)
    return kept


def read(spark: SparkSession, root: str, name: str, version: Version | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """A table as a version (the last one, if none is given) has it. columns: what must be there."""
    version = latest(spark, root) if version is None else version
    if name not in version.tables:
        raise ValueError(f"no table {name} in {root}")
    missing = [c for c in columns if c not in version.schema(name).names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return _read_files(spark, root, version, name, file_list(spark, root, version, name))


# ---------------------------------------------------------------- changes
def _state(spark: SparkSession, root: str, name: str, own: str, files: list[tuple[str, int]], schemas: list[dict]) -> dict:
    path = f"lists/{own}/{name}"
    spark.createDataFrame(files, LIST).coalesce(1).write.mode("overwrite").parquet(f"{root}/{path}")
    return {"list": path, "schemas": schemas}


def _added(df: DataFrame, root: str, name: str) -> list[str]:
    """df as files of a folder of their own; their names from root on."""
    folder = f"data/{name}/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    return sorted(f"{folder}/{p.rsplit('/', 1)[1]}" for p in df.sparkSession.read.schema(df.schema).parquet(f"{root}/{folder}").inputFiles())


def _nullable(schema: T.StructType) -> dict:
    """A schema as it is stored: everything may be null, at any depth."""

    def wide(t: T.DataType) -> T.DataType:
        if isinstance(t, T.ArrayType):
            return T.ArrayType(wide(t.elementType))
        if isinstance(t, T.MapType):
            return T.MapType(wide(t.keyType), wide(t.valueType))
        return T.StructType([T.StructField(f.name, wide(f.dataType)) for f in t]) if isinstance(t, T.StructType) else t

    return wide(schema).jsonValue()


def replace(df: DataFrame, root: str, name: str, own: str) -> dict:
    """The table consists of df alone."""
    return _state(df.sparkSession, root, name, own, [(f, 0) for f in _added(df, root, name)], [_nullable(df.schema)])


def append(df: DataFrame, root: str, name: str, version: Version, own: str) -> dict:
    """df's rows besides those that are there; a table that is not there is made. Columns go by name: a missing one is
    null, one that the table does not have is an error."""
    spark = df.sparkSession
    if name not in version.tables:
        return replace(df, root, name, own)
    schema, schemas = version.schema(name), version.tables[name]["schemas"]
    more = [c for c in df.columns if c not in schema.names]
    if more:
        raise ValueError(f"unknown columns: {', '.join(more)}")
    rows = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    return _state(spark, root, name, own, file_list(spark, root, version, name) + [(f, len(schemas) - 1) for f in _added(rows, root, name)], schemas)


def update(changes: DataFrame, root: str, name: str, key: str, version: Version, own: str) -> dict | None:
    """The rows of the keys in changes (key, and the columns to set) get the new values. Only files that hold such a row
    are written anew; all others stay as they are, under their names. Keys that are not there change nothing, a key that
    stands in changes twice is an error, and None means that no file is touched. Null keys take no part."""
    return _merge(changes, root, name, key, version, own, (), False)


def upsert(changes: DataFrame, root: str, name: str, key: str, version: Version, own: str, keep: tuple[str, ...] = ()) -> dict | None:
    """As update(), but rows of keys that are not there are added, with null for columns that changes do not have. keep:
    columns that only added rows take from changes. A table that is not there is made."""
    if name not in version.tables:
        return replace(_once(changes, key), root, name, own)
    return _merge(changes, root, name, key, version, own, keep, True)


def _once(changes: DataFrame, key: str) -> DataFrame:
    changes = written(changes.where(F.col(key).isNotNull()), "changes")
    if not changes.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"a {key} stands among the changes twice")
    return changes


def _merge(changes: DataFrame, root: str, name: str, key: str, version: Version, own: str, keep: tuple[str, ...], add: bool) -> dict | None:
    spark, schema = changes.sparkSession, version.schema(name)
    changes = _once(changes, key)
    given = [c for c in changes.columns if c != key]
    unknown = [c for c in given if c not in schema.names]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    files = file_list(spark, root, version, name)
    touched = _holding(spark, root, version, name, files, changes.select(key), key)
    old = _read_files(spark, root, version, name, [f for f in files if f[0] in touched])
    new = changes.select(F.col(key).alias("_key"), F.struct(*given, F.lit(True).alias("_set")).alias("_new"))
    value = lambda c: F.col(f"_new.{c.name}").cast(c.dataType)
    one = lambda c: F.when(F.col("_new._set"), value(c)).otherwise(F.col(c.name)) if c.name in given and c.name not in keep else F.col(c.name)
    rows = old.join(new, F.col(key) == F.col("_key"), "left").select(*(one(c).alias(c.name) for c in schema))
    fresh = new.join(old.select(key), F.col(key) == F.col("_key"), "left_anti") if add else None
    if fresh is not None and not fresh.isEmpty():
        made = lambda c: F.col("_key").cast(c.dataType) if c.name == key else value(c) if c.name in given else F.lit(None).cast(c.dataType)
        fresh = fresh.select(*(made(c).alias(c.name) for c in schema))
        rows = rows.unionByName(fresh) if touched else fresh
    elif not touched:
        return None
    return rewritten(spark, root, name, version, own, touched, rows)[0]


def _holding(spark: SparkSession, root: str, version: Version, name: str, files: list[tuple[str, int]], keys: DataFrame, key: str) -> set[str]:
    """Which files hold a row of these keys: only the key column is read, and a name for each such file comes back."""
    found: set[str] = set()
    schemas = [T.StructType.fromJson(s) for s in version.tables[name]["schemas"]]
    for i, own in enumerate(schemas):
        paths = [f"{root}/{f}" for f, s in files if s == i]
        if paths and key in _carried(schemas, i):
            rows = spark.read.schema(own).parquet(*paths).select(F.col(key), F.concat(F.lit(f"data/{name}/"), _short(F.col("_metadata.file_path"))).alias(FILE))
            found |= {r[0] for r in rows.join(keys.distinct(), key, "left_semi").select(FILE).distinct().collect()}
    return found


def rewritten(spark: SparkSession, root: str, name: str, version: Version, own: str, without: set[str], rows: DataFrame | None) -> tuple[dict, list[str]]:
    """The table without some files and with rows (in its current schema) in new ones; the new files' names."""
    schemas, files = version.tables[name]["schemas"], file_list(spark, root, version, name)
    made = [] if rows is None else _added(rows, root, name)
    if not made and not without:
        return version.tables[name], []
    return _state(spark, root, name, own, [f for f in files if f[0] not in without] + [(f, len(schemas) - 1) for f in made], schemas), made


def alter(spark: SparkSession, root: str, name: str, version: Version, own: str, add: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> dict | None:
    """Other columns from now on (add: name and type), without writing a file anew: old files are read as what they were
    and filled up. Columns that are there, or are not there, are left as they are; None: nothing changes."""
    now = version.schema(name)
    fields = [f for f in now if f.name not in drop] + [T.StructField(c, T.DataType.fromDDL(t)) for c, t in (add or {}).items() if c not in now.names]
    if not fields:
        raise ValueError("a table needs a column")
    if [f.name for f in fields] == now.names:
        return None
    return {"list": version.tables[name]["list"], "schemas": version.tables[name]["schemas"] + [_nullable(T.StructType(fields))]}


# ---------------------------------------------------------------- upkeep
def compact(spark: SparkSession, root: str, name: str, version: Version, own: str, size: int = 128 << 20) -> dict | None:
    """The table with its small files, as many commits of few rows leave them, written together as files of about size
    bytes; files of half that and more stay as they are. None: there are no two small ones."""
    files = file_list(spark, root, version, name)
    if len(files) < 2:
        return None
    listed = spark.read.format("binaryFile").load([f"{root}/{f}" for f, _ in files]).select(F.concat(F.lit(f"data/{name}/"), _short(F.col("path"))).alias("f"), "length")
    small = {r.f: r.length for r in listed.where(F.col("length") < size // 2).collect()}
    if len(small) < 2:
        return None
    rows = _read_files(spark, root, version, name, [f for f in files if f[0] in small])
    return rewritten(spark, root, name, version, own, set(small), rows.repartition(max(1, -(-sum(small.values()) // size))))[0]


def vacuum(spark: SparkSession, root: str, keep: int = 10, hours: float = 24.0) -> int:
    """Delete data files and lists that none of the last keep commits has, and these commits' forerunners; how many data
    files went. What is younger than hours stays, since a writer may be about to commit it: no commit, and no reader of an
    older version, should take longer."""
    numbers = versions(spark, root)
    if not numbers:
        return 0
    kept = [at_version(spark, root, n) for n in numbers[-keep:]]
    lists = {t["list"] for v in kept for t in v.tables.values()}
    used = {r.file for r in spark.read.schema(LIST).parquet(*(f"{root}/{x}" for x in lists)).select("file").distinct().collect()} if lists else set()
    fs, _ = _files(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    before, gone = (time.time() - 3600 * hours) * 1000, 0
    for n in numbers[:-keep]:
        fs.delete(path(_name(root, n)), False)
    for table in _below(fs, path(f"{root}/data")):
        for folder in _below(fs, table.getPath()):
            own = [f for f in _below(fs, folder.getPath()) if not f.getPath().getName().startswith((".", "_"))]
            names = {f"data/{table.getPath().getName()}/{folder.getPath().getName()}/{f.getPath().getName()}" for f in own}
            if own and not names & used and all(f.getModificationTime() < before for f in own):
                fs.delete(folder.getPath(), True)
                gone += len(own)
    for commit_lists in _below(fs, path(f"{root}/lists")):
        for x in _below(fs, commit_lists.getPath()):
            if f"lists/{commit_lists.getPath().getName()}/{x.getPath().getName()}" not in lists and x.getModificationTime() < before:
                fs.delete(x.getPath(), True)
    return gone


def _below(fs, folder) -> list:
    return list(fs.listStatus(folder)) if fs.exists(folder) else []
