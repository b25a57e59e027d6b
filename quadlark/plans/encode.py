"""Constrained generation of tiles by a user's function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators import index as ix


def encode(valid: DataFrame, lods: tuple[int, int], generate: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: int = 5) -> DataFrame:
    """Runs `generate` over every tile of the valid tree within the levels.

    Candidates are all tiles at or above a valid one. They are dealt by metatile, so the function gets a bounded frame of neighbouring
    tiles (4^order at most) and returns the rows that it makes for them.
    """
    from ..functions.tiles import shr

    tiles = ix.valid_subtrees(valid).where(F.col("lod").between(*lods))
    return tiles.withColumn("mx", shr("x", order)).withColumn("my", shr("y", order)).groupBy("lod", "mx", "my").applyInPandas(lambda pdf: generate(pdf[["lod", "x", "y"]].reset_index(drop=True)), schema)
