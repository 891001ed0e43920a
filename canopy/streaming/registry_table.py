"""The registry (#5) as a bucketed, versioned table that a stream merges into.

Records lie in buckets by a hash of their content hash.  A micro-batch rewrites the buckets it
touches and no others, as ``data/epoch=<id>/bucket=<n>``; a manifest per epoch says which
folder holds each bucket.  A manifest appears by renaming, after its data, so readers see whole
versions only.  A batch reads the manifest before its own epoch: repeated after a failure, it
replaces its own folder and manifest.  Folders and manifests that the last ``KEEP`` versions do
not name are removed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators.registry import registry_upsert
from canopy.session import delete_folder
from canopy.streaming.streams import for_each_batch

BUCKETS = 64
KEEP = 2  # versions whose folders stay, for readers of the one before


def bucket_of(content_hash: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(content_hash), F.lit(buckets)).cast("int")


class RegistryTable:
    """``path`` holds ``data`` and ``manifests``; ``buckets`` must not change."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _epochs(self) -> list[int]:
        folder = self._path(self.path + "/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _manifest_path(self, epoch: int) -> str:
        return f"{self.path}/manifests/{epoch:012d}.json"

    def manifest(self, before: int | None = None) -> dict[str, str]:
        """Bucket -> folder of the newest version (of an earlier epoch than ``before``)."""
        epochs = [e for e in self._epochs() if before is None or e < before]
        if not epochs:
            return {}
        lines = self.spark.read.text(self._manifest_path(epochs[-1]), wholetext=True)
        return json.loads(lines.first()[0])

    def _commit(self, epoch: int, manifest: dict[str, str]) -> None:
        target = self._path(self._manifest_path(epoch))
        draft = self._path(f"{self.path}/manifests/_{epoch:012d}.draft")
        stream = self._fs.create(draft, True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if self._fs.exists(target):
            self._fs.delete(target, False)
        self._fs.rename(draft, target)

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """Records of the newest version, or those of the buckets ``only``."""
        manifest = self.manifest(before)
        folders = [f for b, f in manifest.items() if only is None or int(b) in only]
        if not folders:
            return None
        return self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in sorted(folders)])

    def merge(self, sections: DataFrame, epoch: int) -> list[int]:
        """Upsert a batch of valid replies as version ``epoch``; the buckets it touched."""
        latest, _ = registry_upsert(None, sections)  # one row per hash before anything is read
        latest = latest.withColumn("bucket", bucket_of("content_hash", self.buckets)).persist()
        try:
            touched = sorted(r[0] for r in latest.select("bucket").distinct().collect())
            held = self.read(before=epoch, only=touched)
            merged, _ = registry_upsert(held, latest.drop("bucket"))
            folder = f"epoch={epoch:012d}"
            merged.withColumn("bucket", bucket_of("content_hash", self.buckets)) \
                .repartition(max(1, len(touched)), "bucket") \
                .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        finally:
            latest.unpersist()
        manifest = self.manifest(before=epoch) | {
            str(b): f"{folder}/bucket={b}" for b in touched}
        self._commit(epoch, manifest)
        self._clean()
        return touched

    def _clean(self) -> None:
        """Remove what no kept manifest names."""
        epochs = self._epochs()
        kept = epochs[-KEEP:]
        named = set()
        for e in kept:
            lines = self.spark.read.text(self._manifest_path(e), wholetext=True)
            named |= set(json.loads(lines.first()[0]).values())
        for e in epochs[:-KEEP]:
            self._fs.delete(self._path(self._manifest_path(e)), False)
        for version in self._fs.listStatus(self._path(self.path + "/data")):
            name = version.getPath().getName()
            if int(name.split("=")[1]) > kept[-1]:
                continue  # a batch that has not committed yet
            folders = [s.getPath().getName() for s in self._fs.listStatus(version.getPath())
                       if s.isDirectory()]
            for f in folders:
                if f"{name}/{f}" not in named:
                    delete_folder(self.spark, f"{self.path}/data/{name}/{f}")
            if not any(f"{name}/{f}" in named for f in folders):
                delete_folder(self.spark, f"{self.path}/data/{name}")


def stream_registry_upsert(sections_stream: DataFrame, path: str,
                           buckets: int = BUCKETS) -> RegistryTable:
    """Merge all available micro-batches of valid replies into the table."""
    table = RegistryTable(sections_stream.sparkSession, path, buckets)
    for_each_batch(sections_stream, path + "/_checkpoint",
                   lambda batch, epoch: table.merge(batch, epoch) and None)
    return table
