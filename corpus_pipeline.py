"""The corpus pipeline: toxicity, line dedup, near-dedup, source mixing, encoding; each stage works on all that the one before kept."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from quadlark.llm.common import drop_table, table, written
from quadlark.ship import ship


def _stage(module: str, name: str):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return getattr(importlib.import_module(f"quadlark.llm.{module}"), name)(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _stage("toxicity", "stage")),
    ("line_dedup", _stage("linededup", "stage")),
    ("simhash_near_dedup", _stage("simhash", "stage")),
    ("source_mixing", _stage("mixing", "stage")),
    ("byte_bpe", _stage("bpe", "stage")),
]

#: No stage of a learned score, a fingerprint or an encoder can be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes once the next one is written.

    Null and empty texts, repeated rows, ties, empty tables, long texts and further columns are treated as each stage's function states.
    """
    docs, spent = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, at = written(stage(spark, docs, sf_dir))
        if spent:
            drop_table(spark, spent)
        spent = at
    return docs
