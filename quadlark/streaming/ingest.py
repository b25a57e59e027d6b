"""Tile writes as a stream: micro-batches upserted into a dataset, each batch one revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import KEY
from ..sources.store import Dataset


def latest(writes: DataFrame) -> DataFrame:
    """Of each tile the write with the greatest version; flags 0 removes the tile."""
    return writes.groupBy(*KEY).agg(F.max_by("flags", "version").alias("flags"), F.max("version").alias("version"))


def upsert(dataset: Dataset, writes: DataFrame, batch: int) -> bool:
    """Applies one batch of writes (lod, x, y, flags, version). A batch whose number is recorded already is skipped, so replays after a
    failure change nothing."""
    done = dataset.properties().get("batch", -1)
    if batch <= done:
        return False
    new = latest(writes)
    if dataset.manifest()["current"]:
        old = dataset.read().select(*KEY, F.col("flags").alias("old_flags"), F.col("version").alias("old_version"))
        both = old.join(new, KEY, "full")
        fresh = F.col("version").isNotNull() & (F.col("old_version").isNull() | (F.col("version") >= F.col("old_version")))
        new = both.select(*KEY, F.when(fresh, F.col("flags")).otherwise(F.col("old_flags")).alias("flags"), F.when(fresh, F.col("version")).otherwise(F.col("old_version")).alias("version"))
    dataset.write(new.where("flags <> 0"), dataset.properties() | {"batch": batch})
    return True


def ingest(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts the query: a streaming frame of writes into the dataset at the path."""

    def apply(batch: DataFrame, number: int) -> None:
        upsert(Dataset(batch.sparkSession, path), batch, number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
