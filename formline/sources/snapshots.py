"""Tables whose rows are replaced atomically.

A table is a folder of data folders that are never changed, and a numbered manifest for each snapshot. A manifest names
one data folder for every partition value and the last batch applied from every stream. Writing a new snapshot is one
rename to the next number: before it readers see the old rows, after it the new ones, and of two writers one fails and
begins again. A batch that a manifest already lists is not applied again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folder column beside the partition column itself, which stays in the files.
PART = "__part"
#: Tasks, and so files, that one partition is dealt to.
SPREAD = 8


class Overtaken(RuntimeError):
    """Another writer committed the next snapshot first."""


@dataclass
class Manifest:
    version: int = 0
    schema: dict | None = None
    #: Partition value as text: data folder below the table.
    folders: dict[str, str] = field(default_factory=dict)
    #: Stream name: last batch applied.
    applied: dict[str, int] = field(default_factory=dict)


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, partition: str) -> None:
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._fs_path(f"{self.path}/{name}")

    def _files(self):
        return self._at("").getFileSystem(self._conf)

    def manifest(self) -> Manifest:
        """The newest snapshot; an empty one if there is no table yet."""
        files, folder = self._files(), self._at("snapshots")
        if not files.exists(folder):
            return Manifest()
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        last = max((n for n in names if n.endswith(".json") and not n.startswith("_")), default=None)
        if last is None:
            return Manifest()
        stream = files.open(self._at(f"snapshots/{last}"))
        try:
            return Manifest(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def commit(self, new: Manifest) -> None:
        """The next snapshot by one rename that never replaces a file."""
        files, jvm = self._files(), self.spark.sparkContext._jvm
        draft, final = self._at(f"snapshots/_{uuid.uuid4().hex}"), self._at(f"snapshots/{new.version:012d}.json")
        files.mkdirs(self._at("snapshots"))
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, options)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            files.delete(draft, False)
            raise Overtaken(f"snapshot {new.version} exists already") from e

    def read(self, partitions: Sequence[str] | None = None, manifest: Manifest | None = None) -> DataFrame:
        """The rows of the newest snapshot, or of a few of its partitions (values as text)."""
        m = manifest or self.manifest()
        if m.schema is None:
            raise FileNotFoundError(f"no snapshot in {self.path}")
        folders = [f"{self.path}/{f}" for v, f in sorted(m.folders.items()) if partitions is None or v in partitions]
        schema = StructType.fromJson(m.schema)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def replace(self, new: DataFrame, key: Sequence[str], order: Sequence[str] = (), batch: tuple[str, int] | None = None, attempts: int = 5) -> bool:
        """Put rows in by key; only the partitions they are in, or were in, are written anew. Says whether the batch
        (stream, number) was applied; one that was applied before changes nothing.

        Of several rows with one key, stored ones too, the last in `order` (then by all columns) stays; without `order` new
        rows replace stored ones. A key that moves to another partition leaves its old one. A null partition value is a
        partition of its own. If another writer commits first, all is done again on its snapshot.
        """
        for _ in range(attempts):
            old = self.manifest()
            if batch and old.applied.get(batch[0], -1) >= batch[1]:
                return False
            try:
                self.commit(self.replaced(old, new, key, order, batch))
                return True
            except Overtaken:
                continue
        raise Overtaken(f"{attempts} other writers were first")

    def replaced(self, old: Manifest, new: DataFrame, key: Sequence[str], order: Sequence[str], batch: tuple[str, int] | None) -> Manifest:
        """Writes the data of the next snapshot and gives its manifest; nothing of it shows before the commit."""
        schema = StructType.fromJson(old.schema) if old.schema else new.schema
        kinds = {f.name: f.dataType for f in schema}
        new = new.select(*[F.col(c).cast(kinds[c]).alias(c) for c in schema.names])
        rest = [c for c in schema.names if c not in key]

        def last(rows: DataFrame) -> DataFrame:
            return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("__row")).select(*key, "__row.*").select(*schema.names)

        def part(rows: DataFrame) -> DataFrame:
            return rows.withColumn(PART, F.coalesce(F.col(self.partition).cast("string"), F.lit("__null")))

        folder = f"data/{uuid.uuid4().hex[:12]}"
        incoming = self._written(last(new), f"{folder}-in")
        folders = dict(old.folders)
        touched = {r[0] for r in part(incoming).select(PART).distinct().collect()}
        result = incoming
        if old.folders:
            stored = self.read(manifest=old)
            # Of all partitions only the keys are read; rows of those that are touched follow.
            touched |= {r[0] for r in part(stored.select(*dict.fromkeys([*key, self.partition])).join(incoming.select(*key), list(key), "left_semi")).select(PART).distinct().collect()}
            near = self.read([v for v in touched if v in old.folders], old)
            kept = near.join(incoming.select(*key), list(key), "left_anti")
            result = kept.unionByName(last(near.join(incoming.select(*key), list(key), "left_semi").unionByName(incoming)) if order else incoming)
        part(result).repartition(PART, F.pmod(F.hash(*key), F.lit(SPREAD))).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        self._files().delete(self._at(f"{folder}-in"), True)
        for value in touched:
            folders.pop(value, None)
        for status in self._files().listStatus(self._at(folder)):
            name = status.getPath().getName()
            if name.startswith(f"{PART}="):
                value = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name.removeprefix(f"{PART}="))
                folders[value] = f"{folder}/{name}"
        applied = old.applied | ({batch[0]: batch[1]} if batch else {})
        return Manifest(old.version + 1, schema.jsonValue(), folders, applied)

    def _written(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def expire(self, keep: int = 2) -> int:
        """Delete all snapshots but the newest `keep`, and data folders that none of those names (no writer may be at
        work). Gives the number of data folders deleted."""
        files = self._files()
        names = sorted(s.getPath().getName() for s in files.listStatus(self._at("snapshots")))
        kept = [n for n in names if not n.startswith("_")][-keep:]
        used: set[str] = set()
        for name in kept:
            stream = files.open(self._at(f"snapshots/{name}"))
            used |= {f.rsplit("/", 1)[0] for f in json.loads(bytes(stream.readAllBytes()).decode())["folders"].values()}
            stream.close()
        for name in names:
            if name not in kept:
                files.delete(self._at(f"snapshots/{name}"), False)
        gone = [f"data/{s.getPath().getName()}" for s in files.listStatus(self._at("data"))]
        gone = [g for g in gone if g not in used]
        for g in gone:
            files.delete(self._at(g), True)
        return len(gone)


def upsert_stream(stream: DataFrame, table: SnapshotTable, key: Sequence[str], name: str, checkpoint: str, order: Sequence[str] = (), fail: Callable[[int], None] | None = None) -> None:
    """Results of a stream into a table: rows with a known key replace the old ones. The batch's number is committed with
    its rows, so a batch that is sent again after a failure changes nothing. `fail` is called with the number before."""

    def merge(batch: DataFrame, number: int) -> None:
        if fail:
            fail(number)
        table.replace(batch, key, order, (name, number))

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
