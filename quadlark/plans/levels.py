"""Level-by-level plans: cutting the lineage between levels."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="levels-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _drop(spark: SparkSession, at: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended; its shared folder goes with it
        p = spark._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes to the shared folder and reads back, so what follows starts from files that outlive executors. They go when the driver ends."""
    at = f"{shared_dir(df.sparkSession)}/level-{uuid.uuid4().hex}"
    df.write.parquet(at)
    atexit.register(_drop, df.sparkSession, at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bottom_up(finest: DataFrame, low: int, high: int, step: Callable[[DataFrame, int], DataFrame], every: int = 4) -> DataFrame:
    """finest is level `high`; step(below, lod) gives level lod from the one below. All levels' rows, lineage cut every few levels."""
    now = cut(finest)
    out = now
    for n, lod in enumerate(range(high - 1, low - 1, -1), 1):
        now = step(now, lod)
        if n % every == 0 or lod == low:
            now = cut(now)
        out = out.unionByName(now)
    return out
