"""Tables as versioned snapshots with an atomically renamed pointer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.delta import merge


class Pointer:
    """The file ``CURRENT`` of a folder, replaced by one rename: readers see the old or the new name, never half."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf, self._base = spark.sparkContext._jsc.hadoopConfiguration(), path.rstrip("/")
        self.files = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._base}/{name}" if name else self._base)

    def get(self) -> str | None:
        if not self.files.exists(self.path("CURRENT")):
            return None
        stream = self.files.open(self.path("CURRENT"))
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def set(self, name: str) -> None:
        new, pointer = self.path(f".CURRENT-{name}"), self.path("CURRENT")
        stream = self.files.create(new, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), self._conf).rename(new, pointer, options)


class Versions:
    """Published versions under one folder, each holding only the parts of the table that its run changed.

    A version's ``manifest`` names for each part (a bucket, a range of keys) the version whose ``rows`` hold it,
    with the rows' schema and what else the table keeps (``settings``). Parts are bounded in number by their
    maker, so the manifest is small. The pointer moves last: readers see whole versions, one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.pointer = Pointer(spark, self.path)

    def current(self) -> str | None:
        return self.pointer.get()

    @staticmethod
    def new() -> str:
        return f"v-{uuid.uuid4().hex}"

    def base(self, version: str) -> str:
        return f"{self.path}/{version}"

    def manifest(self) -> tuple[dict[str, str], str | None, dict]:
        """(part to version, the rows' schema, settings) of the published version; empty before the first."""
        at = self.current()
        if at is None:
            return {}, None, {}
        rows = self.spark.read.parquet(f"{self.base(at)}/manifest").collect()
        held = {r["part"]: r["version"] for r in rows if r["part"] is not None}
        return held, rows[0]["schema"], json.loads(rows[0]["settings"])

    def rows(self, held: dict[str, str], schema: StructType, only: Collection[str] | None = None) -> DataFrame:
        """The rows of the parts ``held``, of ``only`` some if given."""
        paths = [f"{self.base(v)}/rows/__part={p}" for p, v in sorted(held.items()) if only is None or p in only]
        paths = [p for p in paths if self.pointer.files.exists(self.pointer.path(p[len(self.path) + 1 :]))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write_rows(self, version: str, rows: DataFrame, part: Column) -> None:
        """Write ``rows`` under ``version`` in folders by ``part``, one task a part."""
        rows.withColumn("__part", part).repartition("__part").write.partitionBy("__part").parquet(f"{self.base(version)}/rows")

    def publish(self, version: str, held: dict[str, str], schema: StructType, settings: dict) -> None:
        entries = [(p, v, schema.json(), json.dumps(settings)) for p, v in sorted(held.items())] or [(None, None, schema.json(), json.dumps(settings))]
        self.spark.createDataFrame(entries, "part string, version string, schema string, settings string").coalesce(1).write.parquet(f"{self.base(version)}/manifest")
        self.pointer.set(version)

    def drop_old(self) -> list[str]:
        """Remove what no reader of the published version needs; returns the versions that went whole."""
        current, (held, _, _), gone, files = self.current(), self.manifest(), [], self.pointer.files
        for status in files.listStatus(self.pointer.path("")):
            name = status.getPath().getName()
            if not name.startswith("v-") or name == current:
                continue
            if name not in held.values():
                files.delete(status.getPath(), True)
                gone.append(name)
                continue
            for part in files.listStatus(status.getPath()):
                if part.getPath().getName() != "rows":
                    files.delete(part.getPath(), True)
            for part in files.listStatus(self.pointer.path(f"{name}/rows")):
                if part.isDirectory() and held.get(part.getPath().getName().removeprefix("__part=")) != name:
                    files.delete(part.getPath(), True)
        return gone

    def drop(self) -> None:
        self.pointer.files.delete(self.pointer.path(""), True)


class StateTable:
    """``<root>/<name>``: a table in versions. With a ``key`` its rows lie in buckets by a hash of it, and a merge
    reads and writes the buckets of the merged keys alone; ``buckets`` is that of the first version ever after.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, key: str | None = None, buckets: int = 64) -> None:
        self.spark, self.key, self.buckets = spark, key, buckets
        self._versions = Versions(spark, f"{root.rstrip('/')}/{name}")
        self.path = self._versions.path
        #: Buckets that the last merge has read or written.
        self.touched: list[str] = []

    def version(self) -> str | None:
        return self._versions.current()

    def read(self) -> DataFrame | None:
        held, schema, _ = self._versions.manifest()
        return None if schema is None else self._versions.rows(held, StructType.fromJson(json.loads(schema)))

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("string") if self.key else F.lit("0")

    def write(self, rows: DataFrame) -> DataFrame:
        """Write all rows as a new version and point to it; the old one stays until ``drop_old``."""
        version = self._versions.new()
        if self.key:
            self._versions.write_rows(version, rows, self._bucket(self.buckets))
            parts = [str(k) for k in range(self.buckets)]
        else:
            rows.write.parquet(f"{self._versions.base(version)}/rows/__part=0")
            parts = ["0"]
        self._versions.publish(version, dict.fromkeys(parts, version), rows.schema, {"key": self.key, "buckets": self.buckets})
        return self.read()

    def merge(self, batch: DataFrame) -> DataFrame:
        """Replace the rows of the batch's keys; ``batch`` is read several times, so it must be written down (``cut``)."""
        held, schema, settings = self._versions.manifest()
        if schema is None:
            return self.write(batch)
        if not self.key or settings["key"] != self.key:
            return self.write(merge(self.read(), batch, self.key) if self.key else batch)
        stored = StructType.fromJson(json.loads(schema))
        bucket, version = self._bucket(settings["buckets"]), self._versions.new()
        # Names of buckets, no more than there are.
        self.touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())
        if not self.touched:
            return self.read()
        merged = merge(self._versions.rows(held, stored, self.touched), batch, self.key)
        self._versions.write_rows(version, merged, bucket)
        self._versions.publish(version, held | dict.fromkeys(self.touched, version), merged.schema, settings)
        return self.read()

    def drop_old(self) -> list[str]:
        """Remove what the current version does not need; returns the names of versions that went whole."""
        return self._versions.drop_old()

    def drop(self) -> None:
        self._versions.drop()
