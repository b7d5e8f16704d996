"""Versioned folders of Parquet parts: a manifest a version, written once, names the parts that are the table then.

Parts are never changed.  A writer writes new parts, then one manifest under the next number; that file is created only if no
other writer has made it, so of two writers that began at one version one fails and may begin again.  Readers of an older
version keep their parts until `vacuum`; a write that fails before its manifest leaves nothing but unnamed parts.
All files go through the file system of the path, so any folder that Spark reaches will do.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has published this version."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); with a local master one is made where that is unset."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("corpuscle.shared", None)
    if not known:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        known = "file://" + tempfile.mkdtemp(prefix="corpuscle-")
        spark.conf.set("corpuscle.shared", known)
    return known.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/corpuscle-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


class Store:
    """The versions of one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.path}/_versions/{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self._fs_path(f"{self.path}/_versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> dict:
        """A version's manifest, the newest one's by default; {"version": 0} before the first."""
        found = self.versions()
        if version is None:
            version = found[-1] if found else 0
        if version == 0:
            return {"version": 0}
        if version not in found:
            raise ValueError(f"no version {version} of {self.path}")
        stream = self._fs.open(self._fs_path(self._manifest(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, manifest: dict, base: int) -> int:
        """manifest as the version after `base`; Conflict if there is one already.

        The whole text is written under another name first, so a manifest is there whole or not at all.
        """
        version = base + 1
        raw = json.dumps(manifest | {"version": version}).encode()
        temporary = self._fs_path(f"{self.path}/_versions/.{version:012d}-{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(raw))
        stream.close()
        try:
            self._rename(temporary, self._fs_path(self._manifest(version)))
        except Exception as e:  # noqa: BLE001
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} of {self.path} is there already") from None
            raise
        return version

    def _rename(self, source, target) -> None:
        """Rename that never replaces: one step in HDFS; local and object stores look first."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(source, target, options)

    def write(self, df: DataFrame, label: str, partition: list[str] | None = None, options: dict[str, str] | None = None) -> str:
        """A new part; its name, relative to the folder."""
        name = f"{label}/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd").options(**(options or {}))
        (writer.partitionBy(*partition) if partition else writer).parquet(f"{self.path}/{name}")
        return name

    def load(self, parts: list[str], schema) -> DataFrame:
        """Rows of parts by a known schema; without parts an empty frame."""
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def vacuum(self, keep: int, parts_of) -> list[str]:
        """Delete manifests but the newest `keep`, and parts that none of these names (parts_of: manifest to parts); what went.

        Not while others write: parts that are not named yet would go.
        """
        found = self.versions()
        kept = {p for v in found[-keep:] for p in parts_of(self.read(v))}
        gone = sorted({p for v in found[:-keep] for p in parts_of(self.read(v))} - kept)
        for p in gone:
            self._fs.delete(self._fs_path(f"{self.path}/{p}"), True)
        for v in found[:-keep]:
            self._fs.delete(self._fs_path(self._manifest(v)), False)
        return gone
