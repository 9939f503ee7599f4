"""Written tables that outlive a query: versions of shards, and scans that are reused.

Both keep a commit apart from the data: rows are written first, under names that nothing reads, and
become visible by one small file or one rename. A job that fails leaves what was there.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korridor.sources.files import complete, patched


class _Files:
    """Listing, creating and deleting on whatever file system a path is on."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder and when each was last written."""
        return [(x.getPath().getName(), x.getModificationTime()) for x in self.fs.listStatus(self.path(folder))] if self.fs.exists(self.path(folder)) else []

    def create(self, name: str, text: str) -> None:
        """A file that must not be there yet."""
        stream = self.fs.create(self.path(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self.path(folder)).getLength() if self.fs.exists(self.path(folder)) else 0


class Stale(RuntimeError):
    """Another writer has committed since the version that a patch was made for."""


class Shards:
    """A table in ``shards`` parts, of which a patch rewrites only those that it touches.

    A version is a list of shards, each with the version that wrote it: a reader of a version reads
    the same files whatever is committed later. Committing is creating the list's file; who comes
    second fails and has changed nothing. The driver holds a number a shard, at most ``MOST``.
    """

    MOST = 10_000

    def __init__(self, spark: SparkSession, root: str, keys: list[str], shards: int = 64) -> None:
        if not 0 < shards <= self.MOST:
            raise ValueError(f"1 to {self.MOST} shards")
        self.spark, self.root, self.keys, self.shards, self.files = spark, root, keys, shards, _Files(spark, root)

    def _shard(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.shards)).cast("int")

    def latest(self) -> int | None:
        return max((int(name.removesuffix(".json")) for name, _ in self.files.names(f"{self.root}/versions") if name.endswith(".json")), default=None)

    def _written_by(self, version: int) -> dict[int, str]:
        return {int(k): v for k, v in json.loads(self.files.text(f"{self.root}/versions/{version}.json"))["shards"].items()}

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.repartition("_shard").write.partitionBy("_shard").parquet(f"{self.root}/data/{name}")
        return name

    def _commit(self, version: int, shards: dict[int, str], schema: str) -> int:
        try:
            self.files.create(f"{self.root}/versions/{version}.json", json.dumps({"shards": shards, "schema": schema}))
        except Exception as e:  # the file system's own error for a name that is taken
            if self.latest() is not None and self.latest() >= version:
                raise Stale(f"version {version} is committed already") from e
            raise
        return version

    def _present(self, name: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n, _ in self.files.names(f"{self.root}/data/{name}") if n.startswith("_shard="))

    def create(self, rows: DataFrame) -> int:
        name = self._write(rows.withColumn("_shard", self._shard()))
        return self._commit(0, {k: name for k in self._present(name)}, rows.schema.json())

    def _read(self, version: int, some: set[int] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(json.loads(self.files.text(f"{self.root}/versions/{version}.json"))["schema"]))
        paths = [f"{self.root}/data/{name}/_shard={k}" for k, name in sorted(self._written_by(version).items()) if some is None or k in some]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is named."""
        version = self.latest() if version is None else version
        if version is None:
            raise FileNotFoundError(self.root)
        return self._read(version)

    def patch(self, patch: DataFrame, of: int | None = None) -> int:
        """The next version: rows with a patch's values in place of their own, by ``keys``; only shards with such a row are read and written."""
        of = self.latest() if of is None else of
        touched = {r[0] for r in patch.select(self._shard()).distinct().collect()} & set(self._written_by(of))
        rows = patched(self._read(of, touched), patch, self.keys)
        name = self._write(rows.withColumn("_shard", self._shard())) if touched else ""
        return self._commit(of + 1, self._written_by(of) | {k: name for k in touched}, rows.schema.json())

    def bytes_written(self, version: int) -> int:
        """Bytes of the shards that a version wrote itself."""
        mine = set(self._written_by(version).values()) - (set(self._written_by(version - 1).values()) if version else set())
        return sum(self.files.size(f"{self.root}/data/{name}") for name in mine)


class Scans:
    """Tables made of a source, written once for each state of the source and each variant, and read from then on.

    The state of a source is its files' names, sizes and times. At most ``most`` tables are kept; that
    which was asked for longest ago goes first.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = 8) -> None:
        self.spark, self.root, self.most, self.files = spark, root, most, _Files(spark, root)
        self.built = self.reused = 0

    def fingerprint(self, source: str, variant: str) -> str:
        found, it = [], self.files.path(source).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listFiles(self.files.path(source), True)
        while it.hasNext():
            x = it.next()
            found.append(f"{x.getPath()}|{x.getLen()}|{x.getModificationTime()}")
        return hashlib.sha256("\n".join([variant, *sorted(found)]).encode()).hexdigest()

    def get(self, source: str, variant: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``build`` of the source, from the store if it is there for the source as it is now."""
        name = self.fingerprint(source, variant)
        path = f"{self.root}/tables/{name}"
        if complete(self.spark, path):
            self.reused += 1
        else:
            apart = f"{self.root}/making/{uuid.uuid4().hex}"
            build(self.spark.read.parquet(source)).write.parquet(apart)
            self.files.fs.mkdirs(self.files.path(f"{self.root}/tables"))
            if not self.files.fs.rename(self.files.path(apart), self.files.path(path)):
                self.files.fs.delete(self.files.path(apart), True)  # another run was faster
            self.built += 1
        self.files.create(f"{self.root}/asked/{name}.{uuid.uuid4().hex}", "")
        self._evict(name)
        return self.spark.read.parquet(path)

    def _evict(self, asked: str) -> None:
        when: dict[str, int] = {}
        marks = self.files.names(f"{self.root}/asked")
        for name, at in marks:
            when[name.split(".")[0]] = max(at, when.get(name.split(".")[0], 0))
        kept = sorted((n for n, _ in self.files.names(f"{self.root}/tables")), key=lambda n: (n == asked, when.get(n, 0)))
        gone = set(kept[: max(0, len(kept) - self.most)])
        for name in gone:
            self.files.fs.delete(self.files.path(f"{self.root}/tables/{name}"), True)
        for name, at in marks:
            if name.split(".")[0] in gone or at < when[name.split(".")[0]]:
                self.files.fs.delete(self.files.path(f"{self.root}/asked/{name}"), False)
