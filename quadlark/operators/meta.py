"""Metadata trees: rows of metanodes (lod, x, y, flags, texel, credit, zmin, zmax)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import flags as fl
from ..functions.tiles import child_index, children, shl, shr
from ..plans.levels import bottom_up
from . import index as ix

KEY = ["lod", "x", "y"]


def child_nodes(nodes: DataFrame) -> DataFrame:
    """The children whose flag is set."""
    each = nodes.select(*KEY, "flags", F.explode(children(*KEY)).alias("c"))
    return each.where(F.col("flags").bitwiseAND(shl(fl.M_UL, "c.child")) != 0).select(*KEY, F.col("c.lod").alias("clod"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), "c.child")


def tree(nodes: DataFrame) -> DataFrame:
    """Every node and every ancestor with child flags and the height range of all beneath.

    One explode to ancestors and one aggregation that combines before its shuffle: no loop over levels.
    """
    up = ix.ancestors(nodes.select(*KEY, "zmin", "zmax"))
    d = F.col("own_lod") - F.col("lod") - 1
    bit = F.when(d >= 0, shl(fl.M_UL, child_index(shr("own_x", F.greatest(d, F.lit(0))), shr("own_y", F.greatest(d, F.lit(0)))))).otherwise(0)
    return up.groupBy(*KEY).agg(F.bit_or(bit.cast("bigint")).alias("child_flags"), F.min("zmin").alias("zmin"), F.max("zmax").alias("zmax"))


def texel_average(nodes: DataFrame) -> DataFrame:
    """Mean texel size of each level's nodes that apply it, 0 where none does."""
    return nodes.groupBy("lod").agg(F.coalesce(F.avg(F.when(fl.has("flags", fl.M_TEXEL), F.col("texel"))), F.lit(0.0)).alias("texel"))


def propagate_texel(nodes: DataFrame, high: int, real: int = fl.M_GEOMETRY) -> DataFrame:
    """Bottom-up: a node without geometry gets twice the mean of its children's defined sizes; other nodes keep theirs.

    A mean of means needs each level's result, so levels follow each other; each is a quarter of the one below, and nodes missing
    above others are added.
    """
    own = nodes.where(fl.has("flags", real)).select(*KEY, "texel")

    def step(below: DataFrame, lod: int) -> DataFrame:
        mean = below.groupBy(shr("x", 1).alias("x"), shr("y", 1).alias("y")).agg((F.avg("texel") * 2).alias("up"))
        both = mean.join(own.where(F.col("lod") == lod).select("x", "y", "texel"), ["x", "y"], "full")
        return both.select(F.lit(lod).alias("lod"), "x", "y", F.coalesce("texel", "up").alias("texel"))

    return bottom_up(own.where(F.col("lod") == high), 0, high, step)


def merge_by_reference(sources: list[DataFrame]) -> DataFrame:
    """Nodes of several sources into one: the first source with geometry gives the node; all add child flags and extents."""
    every = None
    for i, s in enumerate(sources, 1):
        s = s.select(*KEY, "flags", "texel", "zmin", "zmax", F.lit(i).alias("source"))
        every = s if every is None else every.unionByName(s)
    real = F.col("flags").bitwiseAND(fl.M_GEOMETRY) != 0
    pick = lambda c: F.min_by(F.when(real, F.col(c)), F.when(real, F.col("source")))
    kids = fl.M_UL | fl.M_UR | fl.M_LL | fl.M_LR
    both = every.groupBy(*KEY).agg(
        F.coalesce(F.min(F.when(real, F.col("source"))), F.lit(0)).alias("reference"), F.coalesce(pick("flags"), F.lit(0).cast("bigint")).alias("own"), pick("texel").alias("texel"),
        F.bit_or(F.col("flags").bitwiseAND(kids)).alias("kids"), F.min("zmin").alias("zmin"), F.max("zmax").alias("zmax"),
    )
    return both.select(*KEY, "reference", F.col("own").bitwiseAND(F.lit(~fl.M_ALIEN).cast("bigint")).bitwiseOR(F.col("kids")).alias("flags"), "texel", "zmin", "zmax")


def inconsistencies(tiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tiles whose index flags and metanode disagree on mesh or navtile."""
    both = tiles.select(*KEY, F.col("flags").alias("t")).join(nodes.select(*KEY, F.col("flags").alias("n")), KEY, "full")
    t, n = F.coalesce("t", F.lit(0).cast("bigint")), F.coalesce("n", F.lit(0).cast("bigint"))
    mesh = fl.has(t, fl.MESH) != fl.has(n, fl.M_GEOMETRY)
    nav = fl.has(t, fl.NAVTILE) != fl.has(n, fl.M_NAVTILE)
    return both.select(*KEY, mesh.alias("mesh"), nav.alias("navtile")).where("mesh or navtile")


def credit_tiles(nodes: DataFrame, order: int = 8) -> DataFrame:
    return nodes.groupBy("lod", shr("x", order).alias("cx"), shr("y", order).alias("cy")).agg(F.array_sort(F.collect_set("credit")).alias("credits"))


def sanity(tiles: DataFrame, submeshes: DataFrame) -> DataFrame:
    """Tiles that may not be written, and the first reason why.

    tiles: (lod, x, y, textures, external): how many textures the atlas has, null without an atlas, and whether the frame's node allows external
    textures. submeshes: (lod, x, y, i, tc, etc, mode): internal and external texture coordinates and the texture mode; a tile without
    submeshes has no mesh. The first `textures` submeshes are internally textured, the others externally.
    """
    met = tiles.join(submeshes, KEY, "left")
    textured = F.col("i") < F.coalesce("textures", F.lit(0))
    inside = F.when(F.col("tc") == 0, "internal texture without coordinates").when((F.col("mode") == "external") & (F.col("etc") == 0), "external mode without external coordinates")
    outside = F.when(F.col("etc") == 0, "no external coordinates").when(F.col("mode") == "internal", "internal mode without texture").when(F.col("tc") > 0, "internal coordinates without texture").when(~F.col("external"), "external texture not allowed")
    one = F.when(F.col("i").isNotNull(), F.when(textured, inside).otherwise(outside))
    g = met.groupBy(*KEY, "textures").agg(F.count("i").alias("n"), F.min_by(one, F.when(one.isNotNull(), F.col("i"))).alias("why"))
    whole = F.when((F.col("n") == 0) & F.col("textures").isNotNull(), "atlas without mesh").when((F.col("n") > 0) & (F.col("textures") == 0), "empty atlas").when((F.col("n") > 0) & (F.col("textures") > F.col("n")), "more textures than submeshes")
    return g.select(*KEY, F.coalesce(whole, "why").alias("problem")).where("problem is not null")


def extra_flags(masks: DataFrame, submeshes: DataFrame, pixels: int) -> DataFrame:
    """Flags that a tile's mesh adds: watertight if its coverage mask has all its pixels, multimesh with more than one submesh.

    masks: the covered pixels (lod, x, y, px, py), once each; submeshes: (lod, x, y, ...), a row for each.
    """
    full = masks.groupBy(*KEY).agg(F.count("*").alias("covered"))
    many = submeshes.groupBy(*KEY).agg(F.count("*").alias("n"))
    extra = F.when(F.col("covered") == pixels, fl.WATERTIGHT).otherwise(0) + F.when(F.col("n") > 1, fl.MULTIMESH).otherwise(0)
    return many.join(full, KEY, "left").select(*KEY, extra.cast("int").alias("extra"))
