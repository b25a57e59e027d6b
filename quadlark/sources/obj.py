"""Meshes as OBJ text: v, vt and f lines with numbers from 1; a usemtl line with a number begins a submesh."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.mesh import COORDS, indexed
from ..ship import ship

FACES = "file string, sm int, f int, " + ", ".join(f"{c} double" for c in COORDS)


def parse(text: str) -> pd.DataFrame:
    """Faces of one file; polygons become fans, negative numbers count from the end."""
    points, rows, sm, f = [], [], 0, {}
    for line in text.splitlines():
        word, *rest = line.split() or [""]
        if word == "v":
            points.append([float(v) for v in rest[:3]])
        elif word == "usemtl" and rest and rest[0].isdigit():
            sm = int(rest[0])
        elif word == "f":
            at = [int(v.split("/")[0]) for v in rest]
            at = [i - 1 if i > 0 else len(points) + i for i in at]
            for k in range(1, len(at) - 1):
                rows.append((sm, f.setdefault(sm, 0), *np.array([points[i] for i in (at[0], at[k], at[k + 1])]).ravel()))
                f[sm] += 1
    return pd.DataFrame(rows, columns=["sm", "f", *COORDS])


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """Face rows of every file at the path, each parsed where it is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                out = parse(bytes(content).decode())
                out.insert(0, "file", name)
                yield out

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, FACES)


def obj_lines(faces: DataFrame) -> DataFrame:
    """(mesh, kind, at, line): a mesh's lines, to be sorted by kind and place; equal vertices are written once."""
    i = indexed(faces)
    v = i.select("mesh", "v", F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("line")).distinct()
    corners = F.transform(F.array_sort(F.collect_list(F.struct("corner", "v"))), lambda s: (s["v"] + 1).cast("string"))
    f = i.groupBy("mesh", "f").agg(F.concat_ws(" ", F.lit("f"), corners).alias("line"))
    return v.select("mesh", F.lit(0).alias("kind"), F.col("v").alias("at"), "line").unionByName(f.select("mesh", F.lit(1).alias("kind"), F.col("f").alias("at"), "line"))


def obj_texts(faces: DataFrame) -> DataFrame:
    """(mesh, text): one text for each mesh."""
    g = obj_lines(faces).groupBy("mesh").agg(F.array_sort(F.collect_list(F.struct("kind", "at", "line"))).alias("l"))
    return g.select("mesh", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("text"))
