"""Tables that are committed together.

A store is a folder with data files, dealt to buckets of a key, and manifests. A manifest names the files of every
table; it is written last and under a new number, so a commit of several tables is seen whole or not at all. Readers are bound to
the manifest that they began with. An upsert rewrites only the buckets that its keys touch, an append adds files.

Writers that begin from the same manifest conflict: the first one wins, the other raises ``Conflict`` and can begin again from the newer
manifest. Data files of a commit that failed are named by no manifest and are never read; ``unnamed`` lists their folders.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own where it is unset on a local master."""
    path, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not path:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_folder(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, which is read as often as needed."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(RuntimeError):
    """Another commit came first."""


@dataclass(frozen=True)
class Table:
    """What a manifest says of a table: its schema, key, number of buckets, and (bucket, folder) of its files."""

    schema: str
    key: tuple[str, ...]
    buckets: int
    files: tuple[tuple[int, str], ...]


@dataclass(frozen=True)
class Change:
    """Rows for a table. ``append`` adds them, ``upsert`` also removes rows of equal keys (nulls are equal), ``replace`` removes all, ``delete`` only removes equal keys.

    ``order``: columns that files are sorted by, so that filters on them skip parts of files. ``as_dealt``: rows are written by the tasks that make them, not
    first brought together by buckets; for tables of one bucket.
    """

    table: str
    rows: DataFrame
    key: tuple[str, ...]
    mode: str = "upsert"
    order: tuple[str, ...] = ()
    buckets: int = BUCKETS
    as_dealt: bool = False


@dataclass(frozen=True)
class Snapshot:
    """All tables as of one manifest, and the facts committed with it."""

    spark: SparkSession
    root: str
    version: int = 0
    tables: Mapping[str, Table] = field(default_factory=dict)
    facts: Mapping[str, object] = field(default_factory=dict)

    def table(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        t = self.tables[name]
        wanted = [f"{self.root}/{folder}" for bucket, folder in t.files if buckets is None or bucket in set(buckets)]
        schema = StructType.fromJson(json.loads(t.schema))
        return self.spark.read.schema(schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], schema)


def bucket_of(key: Sequence[str | Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest commit, or that of a number."""
        versions = [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith(".")]
        if version is None:
            version = max(versions, default=0)
        if not version:
            return Snapshot(self.spark, self.root)
        said = json.loads(self.spark.read.text(f"{self.root}/manifests/{version:012d}.json", wholetext=True).first()[0])
        tables = {n: Table(t["schema"], tuple(t["key"]), t["buckets"], tuple((b, f) for b, f in t["files"])) for n, t in said["tables"].items()}
        return Snapshot(self.spark, self.root, version, tables, said["facts"])

    def commit(self, base: Snapshot, changes: Sequence[Change], facts: Callable[[Snapshot], Mapping[str, object]] | None = None) -> Snapshot:
        """The snapshot after ``changes``. ``facts`` makes what is added to the facts of ``base`` from the tables as written. Nothing is seen before all is written."""
        tables = dict(base.tables)
        for change in changes:
            tables[change.table] = self._changed(replace(base, tables=tables), change)
        after = replace(base, version=base.version + 1, tables=tables)
        after = replace(after, facts={**base.facts, **(facts(after) if facts else {})})
        self._publish(after)
        return after

    def _changed(self, base: Snapshot, change: Change) -> Table:
        old = base.tables.get(change.table)
        n = old.buckets if old else change.buckets
        key = old.key if old else change.key
        rows, kept = change.rows, list(old.files) if old and change.mode != "replace" else []
        if old and change.mode in ("upsert", "delete"):
            keys = rows.select(*key).distinct()
            touched = {r["b"] for r in keys.select(bucket_of(key, n).alias("b")).distinct().collect()}  # at most a row a bucket
            held, fresh = base.table(change.table, sorted(touched)), keys.select(*[F.col(k).alias(f"_{k}") for k in key])
            stay = held.join(fresh, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left_anti")
            rows = stay if change.mode == "delete" else stay.unionByName(rows.select(*held.columns))
            kept = [(b, f) for b, f in kept if b not in touched]
        elif change.mode == "delete":
            rows = rows.limit(0)
        if old and change.mode not in ("replace",):
            rows = rows.select(*StructType.fromJson(json.loads(old.schema)).fieldNames()) if change.mode != "delete" else rows
        folder = f"data/{change.table}/{uuid.uuid4().hex}"
        schema = old.schema if old and change.mode != "replace" else change.rows.schema.json()
        # buckets stay together as far as files of a good size allow; large ones are split
        dealt = rows.withColumn("_bucket", bucket_of(key, n))
        dealt = dealt if change.as_dealt else dealt.hint("rebalance", "_bucket")
        dealt.sortWithinPartitions("_bucket", *change.order).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        made = [(int(x.split("=")[1]), f"{folder}/{x}") for x in self._names(folder) if x.startswith("_bucket=")]
        return Table(schema, tuple(key), n, tuple(sorted(kept + made)))

    def _publish(self, after: Snapshot) -> None:
        """Writes the manifest beside its place and moves it there, which fails if there is one."""
        said = {"tables": {n: {"schema": t.schema, "key": t.key, "buckets": t.buckets, "files": t.files} for n, t in after.tables.items()}, "facts": dict(after.facts)}
        name = f"{after.version:012d}.json"
        beside, place = (self._path(f"{self.root}/manifests/{x}") for x in (f".{uuid.uuid4().hex}.tmp", name))
        self._fs.mkdirs(place.getParent())
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        fs = self.spark._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(place.toUri(), self._conf)
        try:
            context.rename(beside, place, self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
        except Exception as error:
            self._fs.delete(beside, False)
            if self._fs.exists(place):
                raise Conflict(f"commit {after.version} of {self.root} was made by another writer") from error
            raise

    def retried(self, change: Callable[[Snapshot], tuple[Sequence[Change], Callable[[Snapshot], Mapping[str, object]] | None]], times: int = 5) -> Snapshot:
        """Commits what ``change`` makes of the newest snapshot, again from the newer one if another writer came first."""
        for left in reversed(range(times)):
            base = self.snapshot()
            try:
                return self.commit(base, *change(base))
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def unnamed(self) -> list[str]:
        """Folders of data that no manifest names: what failed commits left."""
        named = set()
        for n in self._names("manifests"):
            if n.endswith(".json") and not n.startswith("."):
                for t in self.snapshot(int(n.removesuffix(".json"))).tables.values():
                    named |= {"/".join(f.split("/")[:3]) for _, f in t.files}
        folders = [f"data/{t}/{x}" for t in self._names("data") for x in self._names(f"data/{t}")]
        return [f for f in folders if f not in named]
