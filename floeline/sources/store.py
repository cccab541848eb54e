"""The state as versioned tables: every commit adds patches and one manifest, readers pin a version.

A patch holds whole new rows, or keys that are gone. A manifest names the patches of each table; it is created
exclusively, so of two writers that start from one version one fails. A snapshot takes the latest row of each key.
Every ``COMPACT`` commits a table's patches are folded into one, so that reads do not grow with the history.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floeline.sources.tables import KEYS, SCHEMAS

COMPACT = 16
#: Of the format; a store that is newer is refused.
FORMAT = 1


class CommitConflict(RuntimeError):
    """Another writer committed first."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = self.manifest()
        if found["format"] > FORMAT:
            raise ValueError(f"the store has format {found['format']}, this build reads {FORMAT}")

    def version(self) -> int:
        """The largest committed version, 0 for none."""
        folder = self._path(f"{self.path}/_commits")
        if not self._files.exists(folder):
            return 0
        return max((int(s.getPath().getName()[:-5]) for s in self._files.listStatus(folder) if s.getPath().getName().endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"format": FORMAT, "version": 0, "tables": {}}
        text = self.spark.read.text(f"{self.path}/_commits/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _read(self, name: str, patches: list) -> DataFrame:
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        frames = [self.spark.read.schema(f"{SCHEMAS[name]}, _gone boolean").parquet(p).withColumn("_v", F.lit(v)) for v, p in patches]
        if not frames:
            return empty
        every = frames[0]
        for f in frames[1:]:
            every = every.unionByName(f)
        columns = [c for c in empty.columns]
        if len(frames) > 1:
            every = every.groupBy(*KEYS[name]).agg(F.max_by(F.struct(*columns, "_gone"), "_v").alias("r")).select("r.*")
        return every.filter(~F.col("_gone")).select(*columns)

    def snapshot(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables as of a version (None: the latest), lazily."""
        at = self.manifest(version)
        return {name: self._read(name, at["tables"].get(name, [])) for name in SCHEMAS}

    def commit(self, changed: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None, base: int | None = None) -> int:
        """Writes rows that are new or changed, and keys that are gone, as the version after ``base``."""
        base = self.version() if base is None else base
        before, version, gone = self.manifest(base), base + 1, gone or {}
        tables = dict(before["tables"])
        for name in sorted({*changed, *gone}):
            put = changed[name].select(*[F.col(c).cast(t) for c, t in self.spark.createDataFrame([], SCHEMAS[name]).dtypes]).withColumn("_gone", F.lit(False)) if name in changed else None
            if name in gone:
                keys = gone[name].select(*KEYS[name]).distinct()
                drop = self.spark.createDataFrame([], SCHEMAS[name]).drop(*KEYS[name])
                drop = keys.select(*KEYS[name], *[F.lit(None).cast(t).alias(c) for c, t in drop.dtypes], F.lit(True).alias("_gone"))
                put = drop if put is None else put.unionByName(drop)
            path = f"{self.path}/{name}/{version:012d}-{uuid.uuid4().hex}"
            put.write.parquet(path)
            tables[name] = [*tables.get(name, []), [version, path]]
            if len(tables[name]) > COMPACT:
                folded = f"{self.path}/{name}/{version:012d}-{uuid.uuid4().hex}"
                self._read(name, tables[name]).withColumn("_gone", F.lit(False)).write.parquet(folded)
                tables[name] = [[version, folded]]
        text = json.dumps({"format": FORMAT, "version": version, "tables": tables})
        target = self._path(f"{self.path}/_commits/{version:012d}.json")
        part = self._path(f"{self.path}/_commits/.{version:012d}-{uuid.uuid4().hex}")
        out = self._files.create(part, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        # Whole or not at all; a name that is taken means that another writer was first.
        if self._files.exists(target) or not self._files.rename(part, target):
            self._files.delete(part, False)
            raise CommitConflict(f"version {version} exists")
        return version
