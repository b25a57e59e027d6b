"""Helpers that the training-data operators share: hash folds, shared-folder tables, Arrow mapping."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words: runs of anything but the six ASCII blanks.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


#: Bytes of an Arrow batch on its way to Python. Texts are long, and each executor keeps several batches and workers at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit for Arrow batches to BATCH_BYTES, if it is higher."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"\d+", spark.conf.get(key))[0]) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or, on a local master alone, one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _path(spark: SparkSession, at: str):
    return spark._jvm.org.apache.hadoop.fs.Path(at)


def drop_table(spark: SparkSession, at: str) -> None:
    p = _path(spark, at)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _drop_quietly(spark: SparkSession, at: str) -> None:
    try:
        drop_table(spark, at)
    except Exception:  # the session has ended; its shared folder goes with it
        pass


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Cut the lineage: write to the shared folder and read back. Also gives the path, to drop it when it is spent."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/quadlark-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(at)
    atexit.register(_drop_quietly, spark, at)
    return spark.read.schema(schema).parquet(at), at


_HELD: list = [None, None]


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """One large object for each worker process. Workers serve one operator after another, so what the last one left is let go first."""
    if _HELD[0] != key:
        _HELD[:] = [None, None]
        gc.collect()
        _HELD[:] = [key, make()]
    return _HELD[1]


def let_go() -> None:
    held(None, lambda: None)


_IDLE: list = [None]


@contextlib.contextmanager
def working(idle_s: float = 3.0) -> Iterator[None]:
    """Around a task with a held object: once the worker has had no such task for a while, the object goes and its memory with it."""
    if _IDLE[0]:
        _IDLE[0].cancel()
    try:
        yield
    finally:
        _IDLE[0] = threading.Timer(idle_s, lambda: (let_go(), trim()))
        _IDLE[0].daemon = True
        _IDLE[0].start()


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: many small strings leave their heap in pieces."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
