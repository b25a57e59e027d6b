"""Reference frames and space: which subtree a tile or point lies in, validity, and tile mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import coords as cd
from ..functions.tiles import shl, shr
from . import index as ix

KEY = ["lod", "x", "y"]
BOX = ("llx", "lly", "urx", "ury")


def subtree_roots(tiles: DataFrame, frame: DataFrame) -> DataFrame:
    """Each tile with the deepest real frame node at or above it: (root_lod, root_x, root_y, srs and extents).

    The frame is a registry of a few nodes; it is joined on the ancestor's key at each of its levels.
    """
    real = frame.where(F.col("mode").isin("manual", "bisection")).select(F.col("lod").alias("root_lod"), F.col("x").alias("root_x"), F.col("y").alias("root_y"), "srs", "mode", *BOX, "c_llx", "c_lly", "c_urx", "c_ury")
    levels = F.broadcast(real.select("root_lod").distinct())
    up = tiles.join(levels, F.col("lod") >= F.col("root_lod"))
    d = F.col("lod") - F.col("root_lod")
    up = up.withColumn("root_x", shr("x", d)).withColumn("root_y", shr("y", d))
    found = up.join(F.broadcast(real), ["root_lod", "root_x", "root_y"])
    rest = [c for c in found.columns if c not in tiles.columns and c != "root_lod"]
    best = found.groupBy(*tiles.columns).agg(F.max_by(F.struct(*rest), "root_lod").alias("r"), F.max("root_lod").alias("root_lod"))
    return best.select(*tiles.columns, "root_lod", "r.*")


def extents(rooted: DataFrame) -> DataFrame:
    """Tiles with roots to tiles with their own extents e_llx to e_ury."""
    d = F.col("lod") - F.col("root_lod")
    lx, ly = F.col("x") - shl("root_x", d), F.col("y") - shl("root_y", d)
    e = cd.node_extents("lod", lx, ly, "root_lod", BOX)
    return rooted.select("*", *(c.alias(f"e_{n}") for c, n in zip(e, BOX)))


def validity(nodes: DataFrame) -> DataFrame:
    """valid: true, false or null (in part): nine sample points of each node against the constraint extents."""
    inside = []
    for i in range(3):
        for j in range(3):
            x = F.col("e_llx") + (F.col("e_urx") - F.col("e_llx")) * (i / 2)
            y = F.col("e_lly") + (F.col("e_ury") - F.col("e_lly")) * (j / 2)
            inside.append(F.when(x.between(F.col("c_llx"), F.col("c_urx")) & y.between(F.col("c_lly"), F.col("c_ury")), 1).otherwise(0))
    n = sum(inside[1:], inside[0])
    return nodes.withColumn("valid", F.when(F.col("c_llx").isNull() | (n == 9), True).when(n == 0, False))


def point_inside(x: Column, y: Column) -> Column:
    """In the node's extents, and where it is valid only in part, in the constraints too."""
    here = x.between(F.col("e_llx"), F.col("e_urx")) & y.between(F.col("e_lly"), F.col("e_ury"))
    fine = x.between(F.col("c_llx"), F.col("c_urx")) & y.between(F.col("c_lly"), F.col("c_ury"))
    return here & F.when(F.col("valid").isNull(), fine).otherwise(F.col("valid"))


def point_tiles(points: DataFrame, lod: int, box: tuple[float, float, float, float]) -> DataFrame:
    """Points (px, py) with the tile of one level that holds them; points outside the box have none."""
    n = float(1 << lod)
    inside = points.where(F.col("px").between(box[0], box[2]) & F.col("py").between(box[1], box[3]))
    at = lambda v: F.least(F.floor(v * n), F.lit((1 << lod) - 1)).cast("bigint")
    return inside.select("*", F.lit(lod).alias("lod"), at((F.col("px") - box[0]) / (box[2] - box[0])).alias("x"), at((box[3] - F.col("py")) / (box[3] - box[1])).alias("y"))


def deepest(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """Each point's deepest existing tile: its ancestor chain met by key, the deepest kept."""
    up = ix.ancestors(points.select("id", *KEY))
    return up.join(tiles.select(*KEY, "flags"), KEY).groupBy("id").agg(F.max("lod").alias("lod"), F.max_by(F.struct("x", "y", "flags"), "lod").alias("t")).select("id", "lod", "t.*")


def tile_mapping(sources: DataFrame, lod: Column, box: tuple[float, float, float, float], margin: float = 0.0) -> DataFrame:
    """Source tiles with converted extents (e_llx..e_ury) to the target tiles that they cover at the given level. Each row is exploded
    only to the tiles that it touches."""
    n = shl(1, lod).cast("double")
    w, h = (box[2] - box[0]) / n, (box[3] - box[1]) / n
    dx, dy = (F.col("e_urx") - F.col("e_llx")) * margin, (F.col("e_ury") - F.col("e_lly")) * margin
    last = shl(1, lod) - 1
    clip = lambda v: F.greatest(F.lit(0).cast("bigint"), F.least(last, v.cast("bigint")))
    x0, x1 = clip(F.floor((F.col("e_llx") - dx - box[0]) / w)), clip(F.ceil((F.col("e_urx") + dx - box[0]) / w) - 1)
    y0, y1 = clip(F.floor((box[3] - F.col("e_ury") - dy) / h)), clip(F.ceil((box[3] - F.col("e_lly") + dy) / h) - 1)
    out = sources.withColumn("to_lod", lod).withColumn("to_x", F.explode(F.sequence(x0, F.greatest(x0, x1))))
    return out.withColumn("to_y", F.explode(F.sequence(y0, F.greatest(y0, y1))))


def sanitized_frame(frame: DataFrame, parts: DataFrame) -> DataFrame:
    """Frame nodes linked up: every node's ancestors exist (barren where none was given), child flags follow the nodes, and bisection nodes
    with children are marked. parts: partition extents of manual nodes by child (lod, x, y, c_llx .. c_ury, in the parent's system); they
    become the child's constraints, and a child that has none of its own rows is put in as an invalid one."""
    listed = frame.select(*KEY, "srs", "mode")
    listed = listed.unionByName(parts.join(listed, KEY, "left_anti").select(*KEY, F.lit("").alias("srs"), F.lit("invalid").alias("mode")))
    up = ix.ancestors(listed.select(*KEY)).select(*KEY).distinct()
    kids = up.where("lod > 0").groupBy((F.col("lod") - 1).cast("int").alias("lod"), shr("x", 1).alias("x"), shr("y", 1).alias("y")).agg(F.bit_or(shl(1, F.col("x").bitwiseAND(1) + F.col("y").bitwiseAND(1) * 2)).alias("kids"))
    out = up.join(listed, KEY, "left").join(kids, KEY, "left").join(parts, KEY, "left")
    mode = F.coalesce("mode", F.lit("barren"))
    return out.select(*KEY, F.coalesce("srs", F.lit("")).alias("srs"), mode.alias("mode"), F.coalesce("kids", F.lit(0).cast("bigint")).alias("kids"), ((mode == "bisection") & F.col("kids").isNotNull()).alias("broken"), "c_llx", "c_lly", "c_urx", "c_ury")


def root_levels(frame: DataFrame) -> DataFrame:
    """The level range of the real nodes."""
    return frame.where(F.col("mode").isin("manual", "bisection")).agg(F.min("lod").alias("low"), F.max("lod").alias("high"))


def checked_masks(nodes: DataFrame, valid: DataFrame, masks: DataFrame) -> DataFrame:
    """How much of each node's valid area a coverage mask covers: whole, some or none.

    nodes: (lod, x, y, partial, size), size pixels wide and high; masks: the covered pixels (lod, x, y, px, py), once each; valid: the valid
    pixels of nodes that are valid in part only. An empty mask covers none. A whole node is covered by a full mask; of a partial one
    the mask is taken away from the valid pixels, and what is left decides.
    """
    pixel = [*KEY, "px", "py"]
    full = masks.groupBy(*KEY).agg(F.count("*").alias("covered"))
    left = valid.join(masks.select(*pixel, F.lit(1).alias("hit")), pixel, "left").groupBy(*KEY).agg(F.count("*").alias("total"), F.count("hit").alias("hits"))
    met = nodes.join(full, KEY, "left").join(left, KEY, "left").fillna(0, ["covered", "total", "hits"])
    whole = F.when(F.col("covered") == F.col("size") * F.col("size"), "whole").otherwise("some")
    part = F.when(F.col("hits") == F.col("total"), "whole").when(F.col("hits") == 0, "none").otherwise("some")
    return met.select(*KEY, F.when(F.col("covered") == 0, "none").when(~F.col("partial"), whole).otherwise(part).alias("cover"))


def _to_tile(x: Column, outwards: bool) -> Column:
    """A place in tiles as a tile number: very nearly whole numbers are whole, others go down, or up for the far end; below zero the other way."""
    near = F.when(F.abs(x - F.round(x)) <= 1e-15, F.round(x)).otherwise(x)
    down, up = F.floor(near), F.ceil(near)
    return F.when(near < 0, down if outwards else up).otherwise(up if outwards else down).cast("bigint")


def found_subtrees(frame: DataFrame, samples: DataFrame, lod: int) -> DataFrame:
    """Which tiles of a level a dataset covers, by samples (px, py) of its extents in the nodes' own coordinates.

    (node_lod, node_x, node_y, x0, y0, x1, y1): the tile range under each real node that has samples in its valid area, and that is still the
    subtree of its first tile of that level; a row with null nodes holds the overall range. The frame, a registry, is broadcast.
    """
    d = F.lit(lod) - F.col("node_lod")
    nodes = frame.where(F.col("mode").isin("manual", "bisection") & (F.col("lod") <= lod)).select(*(F.col(c).alias(f"node_{c}") for c in KEY), *BOX, *(f"c_{c}" for c in BOX))
    corners = nodes.select("node_lod", "node_x", "node_y", F.lit(lod).alias("lod"), shl("node_x", d).alias("x"), shl("node_y", d).alias("y"))
    own = subtree_roots(corners, frame).where("root_lod = node_lod and root_x = node_x and root_y = node_y").select("node_lod", "node_x", "node_y")
    nodes = F.broadcast(nodes.join(own, ["node_lod", "node_x", "node_y"]))
    x, y = F.col("px"), F.col("py")
    fine = F.col("c_llx").isNull() | x.between(F.col("c_llx"), F.col("c_urx")) & y.between(F.col("c_lly"), F.col("c_ury"))
    met = samples.join(nodes, x.between(F.col("llx"), F.col("urx")) & y.between(F.col("lly"), F.col("ury")) & fine)
    e = met.groupBy("node_lod", "node_x", "node_y", *BOX).agg(F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"))
    n = F.pow(F.lit(2.0), d)
    width, height = (F.col("urx") - F.col("llx")) / n, (F.col("ury") - F.col("lly")) / n
    near = [_to_tile((F.col("x0") - F.col("llx")) / width, False), _to_tile((F.col("ury") - F.col("y1")) / height, False)]
    far = [_to_tile((F.col("x1") - F.col("llx")) / width, True), _to_tile((F.col("ury") - F.col("y0")) / height, True)]
    first = [shl("node_x", d), shl("node_y", d)] * 2
    ranges = e.select("node_lod", "node_x", "node_y", *((a + b).alias(c) for a, b, c in zip(first, near + far, ("x0", "y0", "x1", "y1"))))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("node_lod", "int"), ("node_x", "bigint"), ("node_y", "bigint"))]
    whole = ranges.groupBy().agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).where("x0 is not null")
    return ranges.unionByName(whole.select(*none, "x0", "y0", "x1", "y1"))
