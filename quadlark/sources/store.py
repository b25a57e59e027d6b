"""Datasets on disk: Parquet partitioned by level and archive, versions behind a manifest, and a catalogue of stacks.

A dataset is a folder with one folder of Parquet files for each version and a manifest that names the current one. A writer stages a new
version and then replaces the manifest in one rename, so readers see the old version or the new one, and an old version can be
opened by number. A lock file keeps a second writer out. All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.tiles import shr

MANIFEST, LOCK, TEMPORARY = "manifest.json", "lock", "manifest.next"


class Dataset:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def manifest(self) -> dict:
        if not self._fs.exists(self._at(MANIFEST)):
            return {"current": 0, "versions": []}
        rows = self.spark.read.text(f"{self.path}/{MANIFEST}", wholetext=True).collect()
        return json.loads(rows[0].value)

    def _replace_manifest(self, content: dict) -> None:
        out = self._fs.create(self._at(TEMPORARY), True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), self.spark._jsc.hadoopConfiguration())
        flags = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        flags[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._at(TEMPORARY), self._at(MANIFEST), flags)

    @contextlib.contextmanager
    def locked(self) -> Iterator[None]:
        """One writer at a time: the lock file is created only if it is not there."""
        try:
            self._fs.create(self._at(LOCK), False).close()
        except Exception as e:
            raise RuntimeError(f"{self.path} is being written") from e
        try:
            yield
        finally:
            self._fs.delete(self._at(LOCK), False)

    def write(self, tiles: DataFrame, properties: dict | None = None, order: int = 5) -> int:
        """A new version of the tiles (lod, x, y, ...), partitioned by level and archive column; gives its revision.

        Rows are dealt by archive, so each archive's files come from one task, and AQE splits archives that hold many tiles.
        """
        with self.locked():
            m = self.manifest()
            revision = m["current"] + 1
            name = f"v{revision}-{uuid.uuid4().hex[:8]}"
            rows = tiles.withColumn("arch_x", shr("x", order)).withColumn("arch_y", shr("y", order))
            try:
                rows.hint("rebalance", "lod", "arch_x").write.partitionBy("lod", "arch_x").parquet(f"{self.path}/{name}")
            except Exception:
                self._fs.delete(self._at(name), True)
                raise
            m["versions"].append({"revision": revision, "folder": name, "properties": properties or {}})
            self._replace_manifest(m | {"current": revision})
            return revision

    def read(self, revision: int | None = None) -> DataFrame:
        """The tiles of a version, the current one by default; filters on lod and arch_x prune folders."""
        m = self.manifest()
        wanted = m["current"] if revision is None else revision
        found = [v for v in m["versions"] if v["revision"] == wanted]
        if not found:
            raise FileNotFoundError(f"{self.path} has no version {wanted}")
        return self.spark.read.parquet(f"{self.path}/{found[0]['folder']}").withColumn("lod", F.col("lod").cast("int"))

    def properties(self) -> dict:
        m = self.manifest()
        return next((v["properties"] for v in m["versions"] if v["revision"] == m["current"]), {})

    def update(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Copy on write: the next version is a function of this one."""
        return self.write(change(self.read()).drop("arch_x", "arch_y"), self.properties())

    def drop_old(self, keep: int = 2) -> None:
        with self.locked():
            m = self.manifest()
            for v in m["versions"][:-keep]:
                self._fs.delete(self._at(v["folder"]), True)
            self._replace_manifest(m | {"versions": m["versions"][-keep:]})


def sniff(spark: SparkSession, path: str) -> str:
    """What a path holds: dataset, storage, tileindex or unknown."""
    from .binary import INDEX_MAGIC

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return "unknown"
    if fs.getFileStatus(p).isFile():
        head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 2).alias("h")).first()
        return "tileindex" if head and bytes(head.h) == INDEX_MAGIC else "unknown"
    there = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, n))
    return "dataset" if there(MANIFEST) else "storage" if there("storage.json") else "unknown"
