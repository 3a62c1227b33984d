"""Sharded storage with size-tiered compaction and an atomically committed, versioned manifest.

A store is a folder in shared storage: ``data/`` holds immutable Parquet shards, ``manifest/`` one
small JSON file for each version and the segments that versions name. An arrival is appended as small
shards. When a tier (shards within a factor of ``fanout`` in size) holds at least ``fanout`` of them,
they are merged by a Spark job into files of about ``target_bytes``, and the next version lists the new
shards instead of the merged ones. Shards of target size are final; ``SEGMENT`` of them at a time move
into an immutable segment file, so that a version lists few shards itself however large the store is.

A version is committed by creating its manifest file without overwriting. Of two writers one fails,
reads the new version and commits its change to that; a compaction whose shards another one has merged
gives up and deletes what it wrote. Every version holds the store's columns, so that a store can be reopened
by its path alone and rows with other columns are refused. Readers hold on to the version they have read. ``vacuum`` removes
old versions, and shards and segments that no kept version lists, those of failed writers too.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SEGMENT = 1000


class CommitConflict(Exception):
    """Another writer has committed this version."""


class SchemaMismatch(ValueError):
    """Rows whose columns are not those of the store."""


@dataclass(frozen=True)
class Shard:
    path: str  # relative to the store
    bytes: int
    rows: int


@dataclass(frozen=True)
class Version:
    number: int
    segments: tuple[str, ...] = ()  # files of final shards
    shards: tuple[Shard, ...] = ()  # all others
    schema: str | None = None  # the columns of every shard, as JSON


def _nullable(schema: StructType) -> StructType:
    """A schema as Parquet files are read: every column may be null."""
    return StructType([StructField(f.name, f.dataType, True) for f in schema])


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: StructType | str | None = None, target_bytes: int = 128 << 20, fanout: int = 4, retries: int = 20):
        """A store at ``root``; ``schema`` is only needed to read a new store before its first append."""
        self.spark, self.root, self.target_bytes, self.fanout, self.retries = spark, root.rstrip("/"), target_bytes, fanout, retries
        self.given = spark.createDataFrame([], schema).schema if schema else None
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifest

    def _names(self, folder: str) -> list[tuple[str, int, float]]:
        """Name, size and age in seconds of what a folder holds."""
        path = self._path(f"{self.root}/{folder}")
        if not self._fs.exists(path):
            return []
        return [(str(x.getPath().getName()), x.getLen(), time.time() - x.getModificationTime() / 1000) for x in self._fs.listStatus(path)]

    def _text(self, file: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{file}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, file: str, content: dict) -> None:
        stream = self._fs.create(self._path(f"{self.root}/{file}"), False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n, _, _ in self._names("manifest") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, number: int | None = None) -> Version:
        """A version, by default the last; number 0 and nothing if there is none."""
        number = number if number is not None else max(self.versions(), default=0)
        if number == 0:
            return Version(0)
        found = json.loads(self._text(self._manifest_file(number)))
        return Version(number, tuple(found["segments"]), tuple(Shard(**x) for x in found["shards"]), found["schema"])

    def schema(self) -> StructType | None:
        """The columns of the store; None before its first append, unless they were given."""
        found = self.manifest().schema
        return StructType.fromJson(json.loads(found)) if found else self.given

    def _fitted(self, rows: DataFrame) -> DataFrame:
        """Rows in the order of the store's columns, which must be theirs too."""
        known = self.schema()
        if known is None:
            return rows
        if sorted((f.name, f.dataType.simpleString()) for f in rows.schema) != sorted((f.name, f.dataType.simpleString()) for f in known):
            raise SchemaMismatch(f"{rows.schema.simpleString()} is not {known.simpleString()}")
        return rows.select(*[F.col(f"`{f.name}`") for f in known])

    def shards(self, number: int | None = None) -> list[Shard]:
        """All shards of a version, those of its segments too."""
        version = self.manifest(number)
        return [Shard(**x) for s in version.segments for x in json.loads(self._text(f"manifest/{s}"))["shards"]] + list(version.shards)

    def _manifest_file(self, number: int) -> str:
        return f"manifest/v{number:010d}.json"

    def commit(self, version: Version) -> int:
        """Publishes a version: written under another name, then renamed, which fails if it is there."""
        draft = f"manifest/draft-{uuid.uuid4().hex}"
        self._create(draft, {"version": version.number, "segments": list(version.segments), "shards": [asdict(s) for s in version.shards], "schema": version.schema})
        jvm = self.spark.sparkContext._jvm
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(f"{self.root}/{draft}"), self._path(f"{self.root}/{self._manifest_file(version.number)}"), options)
        except Exception as e:
            self._fs.delete(self._path(f"{self.root}/{draft}"), False)
            if "AlreadyExists" in str(e):
                raise CommitConflict(version.number) from e
            raise
        return version.number

    def _update(self, change: Callable[[tuple[Shard, ...]], list[Shard] | None], schema: StructType | None = None) -> int | None:
        """Commits ``change`` of the last version's own shards, again on the next one if another writer was first. None: given up.

        With ``schema``, the columns of new shards, which must be those of the version that is changed.
        """
        own = json.dumps(_nullable(schema).jsonValue()) if schema else None
        for _ in range(self.retries):
            last = self.manifest()
            if own and last.schema and own != last.schema:
                raise SchemaMismatch("another writer has made a store of other columns")
            shards = change(last.shards)
            if shards is None:
                return None
            segments, final = last.segments, [s for s in shards if self.tier(s) < 0]
            if len(final) >= SEGMENT:
                name = f"segment-{uuid.uuid4().hex}.json"
                self._create(f"manifest/{name}", {"shards": [asdict(s) for s in final]})
                segments, shards = (*segments, name), [s for s in shards if self.tier(s) >= 0]
            try:
                return self.commit(Version(last.number + 1, segments, tuple(shards), last.schema or own))
            except CommitConflict:
                continue
        raise CommitConflict(f"not committed in {self.retries} attempts")

    # Data

    def _listed(self, folder: str) -> list[Shard]:
        """The shards that one job has written, with rows counted from the files' footers."""
        files = [(n, size) for n, size, _ in self._names(folder) if n.endswith(".parquet")]
        if not files:
            return []
        counted = self.spark.read.parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_name").alias("f")).count().collect()  # a row for each file of the job
        rows = {r["f"]: r["count"] for r in counted}
        return sorted((Shard(f"{folder}/{n}", size, rows.get(n, 0)) for n, size in files if rows.get(n, 0)), key=lambda s: s.path)

    def append(self, arrival: DataFrame) -> int | None:
        """Appends the rows as shards of their own; the new version, or None where there are no rows.

        Rows are kept as they are: nulls, repeated rows and texts of any length. The first append sets the
        columns of the store, whatever their names; later ones must have the same names and types, in any
        order, or are refused before anything is written.
        """
        arrival = self._fitted(arrival)
        self.given = self.given or arrival.schema
        run = f"data/run-{uuid.uuid4().hex}"
        arrival.write.parquet(f"{self.root}/{run}")
        new = self._listed(run)
        return self._update(lambda shards: [*shards, *new], arrival.schema) if new else None

    def append_all(self, arrivals: DataFrame, arrival_col: str) -> list[int]:
        """Appends every arrival of ``arrivals`` in the order of ``arrival_col``, each as a version of its own.

        The rows are read and written once, by arrival; then the arrivals are committed one by one.
        Rows with a null arrival come first; rows of one arrival come as one version, in no order.
        ``arrival_col`` itself isn't stored; the other columns must be those of the store.
        """
        run, label = f"data/run-{uuid.uuid4().hex}", f"arrival_{uuid.uuid4().hex}"
        rows = self._fitted(arrivals.drop(arrival_col))
        self.given = self.given or rows.schema
        numbered = arrivals.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(F.col(arrival_col).cast("long"), F.lit(-1)).alias(label))
        numbered.write.partitionBy(label).parquet(f"{self.root}/{run}")
        out = []
        for _, name in sorted((int(n.split("=")[1]), n) for n, _, _ in self._names(run) if n.startswith(label)):
            new = self._listed(f"{run}/{name}")
            out.append(self._update(lambda shards, new=new: [*shards, *new], rows.schema))
        return out

    def tier(self, shard: Shard) -> int:
        """0 for the smallest; each tier is ``fanout`` times larger; target-sized shards have -1 and stay."""
        if shard.bytes >= self.target_bytes * 3 // 4:
            return -1
        return max(0, int(math.log(max(1, shard.bytes), self.fanout)))

    def full_tiers(self) -> dict[int, list[Shard]]:
        """The tiers of the last version that have enough shards to be merged."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.manifest().shards:
            tiers.setdefault(self.tier(s), []).append(s)
        return {t: own for t, own in tiers.items() if t >= 0 and len(own) >= self.fanout}

    def compact_once(self) -> bool:
        """Merges the lowest tier that is full; False if none is, or another writer has merged those shards."""
        full = self.full_tiers()
        if not full:
            return False
        old = full[min(full)]
        files = max(1, round(sum(s.bytes for s in old) / self.target_bytes))
        run = f"data/run-{uuid.uuid4().hex}"
        merged = self.spark.read.schema(self.schema()).parquet(*[f"{self.root}/{s.path}" for s in old])
        merged.coalesce(files).write.parquet(f"{self.root}/{run}")  # shards of one tier are alike in size, so no shuffle is needed
        new, gone = self._listed(run), set(old)
        done = self._update(lambda shards: [*[s for s in shards if s not in gone], *new] if gone <= set(shards) else None)
        if done is None:
            self._fs.delete(self._path(f"{self.root}/{run}"), True)
        return done is not None

    def compact(self) -> int:
        """Compacts until no tier is full; the number of merges."""
        merges = 0
        while self.compact_once():
            merges += 1
        return merges

    def vacuum(self, keep: int = 1, min_age: float = 86_400) -> int:
        """Deletes all but the last ``keep`` versions, and what no kept version lists; the number of deleted shards.

        Files that no version has ever listed may be those of a writer at work; they go once they are
        ``min_age`` seconds old.
        """
        versions = self.versions()
        kept, old = versions[-keep:], versions[:-keep]
        live = {s.path for v in kept for s in self.shards(v)}
        listed = {s.path for v in old for s in self.shards(v)}
        segments = {s for v in kept for s in self.manifest(v).segments}
        gone = listed - live
        for run, _, _ in self._names("data"):
            folders = [f"data/{run}", *[f"data/{run}/{n}" for n, _, _ in self._names(f"data/{run}") if "=" in n]]
            gone |= {f"{f}/{n}" for f in folders for n, _, age in self._names(f) if n.endswith(".parquet") and age >= min_age and f"{f}/{n}" not in live}
        for path in gone:
            self._fs.delete(self._path(f"{self.root}/{path}"), False)
        for v in old:
            self._fs.delete(self._path(f"{self.root}/{self._manifest_file(v)}"), False)
        for n, _, age in self._names("manifest"):
            if (n.startswith("segment-") and n not in segments or n.startswith("draft-")) and age >= min_age:
                self._fs.delete(self._path(f"{self.root}/manifest/{n}"), False)
        return len(gone)

    def read(self, number: int | None = None, shard_col: str | None = None) -> DataFrame:
        """The rows of a version; with ``shard_col`` the path of each row's shard under that name. An empty store has none."""
        shards, schema = self.shards(number), self.schema()
        if schema is None:
            raise SchemaMismatch("a store without columns: append rows, or open it with a schema")
        if not shards:
            rows = self.spark.createDataFrame([], schema)
            return rows.withColumn(shard_col, F.lit("")) if shard_col else rows
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in shards])
        return rows.withColumn(shard_col, F.col("_metadata.file_path")) if shard_col else rows
