"""Registries and configurations as JSON documents: to rows and back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

FRAME = "lod int, x bigint, y bigint, srs string, llx double, lly double, urx double, ury double, mode string, child_flags int, external_texture boolean"


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def reference_frames(spark: SparkSession, path: str) -> DataFrame:
    """Division nodes of all frames in a file, one row each; a registry is small, so the driver reads it."""
    content = json.loads(_text(spark, path))
    rows = []
    for frame in content if isinstance(content, list) else [content]:
        for node in frame.get("division", {}).get("nodes", []):
            at, box = node["id"], node.get("extents") or {}
            part = node.get("partitioning", "none")
            mode = part if isinstance(part, str) else "manual"
            kids = 0 if isinstance(part, str) else sum(1 << (int(k[0]) * 2 + int(k[1])) for k in part)
            ll, ur = box.get("ll", [None, None]), box.get("ur", [None, None])
            rows.append((frame.get("id", ""), at["lod"], at["position"][0], at["position"][1], node.get("srs", ""), *(None if v is None else float(v) for v in (*ll[:2], *ur[:2])), mode, kids, bool(node.get("externalTexture", False))))
    return spark.createDataFrame(rows, "frame string, " + FRAME)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A document of named entries as (id, body), the body being its JSON text: credits, bound layers, bodies, systems."""
    content = json.loads(_text(spark, path))
    entries = content.items() if isinstance(content, dict) else ((e.get("id"), e) for e in content)
    return spark.createDataFrame([(str(k), json.dumps(v, sort_keys=True)) for k, v in entries], "id string, body string")


def configuration(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, json): each row's columns as one document, for configurations to be written as text."""
    return df.select(key, F.to_json(F.struct(*columns)).alias("json"))
