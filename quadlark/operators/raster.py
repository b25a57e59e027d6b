"""Rasters as pixel rows (px, py, value): neighbourhood filters, composition, pyramids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tiles import shl


def _pass(r: DataFrame, across: str, along: str, radius: int, f) -> DataFrame:
    w = Window.partitionBy(across).orderBy(along).rangeBetween(-radius, radius)
    return r.withColumn("h", f("h").over(w))


def opening(r: DataFrame, radius: int) -> DataFrame:
    """Terrain from a surface: erosion then dilation over a square, column by column and row by row; invalid pixels are absent.

    A row or column is a window; rasters larger than a task are cut into tiles with a margin of twice the radius first (tiled)."""
    for f, across, along in ((F.min, "px", "py"), (F.min, "py", "px"), (F.max, "px", "py"), (F.max, "py", "px")):
        r = _pass(r, across, along, radius, f)
    return r


def tiled(r: DataFrame, size: int, margin: int) -> DataFrame:
    """Pixels with the tile (tx, ty) they belong to, and copies in every tile whose margin they lie in; own tells the two apart."""
    reach = lambda c: F.sequence(F.floor((F.col(c) - margin) / size), F.floor((F.col(c) + margin) / size))
    out = r.withColumn("tx", F.explode(reach("px"))).withColumn("ty", F.explode(reach("py")))
    return out.withColumn("own", (F.floor(F.col("px") / size) == F.col("tx")) & (F.floor(F.col("py") / size) == F.col("ty")))


def opening_tiled(r: DataFrame, radius: int, size: int = 1024) -> DataFrame:
    """The same opening in tiles: no window is longer than a tile with its margins, however large the raster."""
    t = tiled(r, size, 4 * radius)
    for f, across, along in ((F.min, "px", "py"), (F.min, "py", "px"), (F.max, "px", "py"), (F.max, "py", "px")):
        w = Window.partitionBy("tx", "ty", across).orderBy(along).rangeBetween(-radius, radius)
        t = t.withColumn("h", f("h").over(w))
    return t.where("own").drop("tx", "ty", "own")


def around(r: DataFrame, radius: int = 1) -> DataFrame:
    """Every pixel sent to its neighbours within a square; (qx, qy) is where it goes."""
    step = F.sequence(F.lit(-radius), F.lit(radius))
    return r.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumn("qx", F.col("px") + F.col("dx")).withColumn("qy", F.col("py") + F.col("dy")).drop("dx", "dy")


def dilate_ranges(r: DataFrame) -> DataFrame:
    """3 x 3 minimum and maximum of (lo, hi), at pixels that exist. Neighbours are added up where they meet, combined before the shuffle."""
    met = around(r).groupBy(F.col("qx").alias("px"), F.col("qy").alias("py")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return met.join(r.select("px", "py"), ["px", "py"], "left_semi")


def dilate_mask(r: DataFrame, size: int, radius: int = 1) -> DataFrame:
    inside = F.col("qx").between(0, size - 1) & F.col("qy").between(0, size - 1)
    return around(r.select("px", "py"), radius).where(inside).select(F.col("qx").alias("px"), F.col("qy").alias("py")).distinct()


def paint(sources: DataFrame) -> DataFrame:
    """Sources (prio, watertight) painted bottom to top: of each pixel the highest wins; sources below the first watertight one don't count."""
    floor = sources.where("watertight").groupBy("tile").agg(F.max("prio").alias("floor"))
    seen = sources.join(floor, "tile", "left").where(F.col("floor").isNull() | (F.col("prio") >= F.col("floor")))
    return seen.groupBy("tile", "px", "py").agg(F.max("prio").alias("source"))


def analyse(painted: DataFrame, pixels: int) -> DataFrame:
    """Of each tile: holes, the sources seen, the topmost, and whether it is the only one."""
    g = painted.groupBy("tile")
    return g.agg((F.count("*") < pixels).alias("holes"), F.array_sort(F.collect_set("source")).alias("present"), F.max("source").alias("topmost"), (F.count_distinct("source") == 1).alias("single"))


def height_range(r: DataFrame) -> DataFrame:
    return r.agg(F.floor(F.min("h")).alias("low"), F.ceil(F.max("h")).alias("high"))


def quantize(h: Column, low: Column, high: Column) -> Column:
    """Heights to one byte over their range; a flat range gives 0."""
    return F.when(high > low, F.round((h - low) / (high - low) * 255)).otherwise(0).cast("int")


def dequantize(q: Column, low: Column, high: Column) -> Column:
    return low + q * (high - low) / 255.0


def bilinear(points: DataFrame, r: DataFrame) -> DataFrame:
    """Heights at points (id, sx, sy) from the four pixels around; pixels that are missing don't weigh. Four keyed look-ups."""
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    p = points.withColumn("fx", F.col("sx") - F.floor("sx")).withColumn("fy", F.col("sy") - F.floor("sy")).withColumn("c", corner)
    p = p.withColumn("px", F.floor("sx") + F.col("c.i")).withColumn("py", F.floor("sy") + F.col("c.j"))
    weight = F.when(F.col("c.i") == 1, F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.col("c.j") == 1, F.col("fy")).otherwise(1 - F.col("fy"))
    met = p.withColumn("w", weight).join(r, ["px", "py"])
    return met.groupBy("id").agg((F.sum(F.col("w") * F.col("h")) / F.sum("w")).alias("h"), F.sum("w").alias("weight")).where("weight > 0")


def mosaic(tiles: DataFrame, size: int) -> DataFrame:
    """Tile rasters (x, y, px, py, h) in one grid; `size` pixels a tile, edges shared, the larger height where they differ."""
    return tiles.groupBy((F.col("x") * size + F.col("px")).alias("px"), (F.col("y") * size + F.col("py")).alias("py")).agg(F.max("h").alias("h"))


def halve(r: DataFrame) -> DataFrame:
    """Half resolution: the mean of the valid pixels of each 2 x 2 block."""
    return r.groupBy(F.shiftright("px", 1).alias("px"), F.shiftright("py", 1).alias("py")).agg(F.avg("h").alias("h"))


def cut(r: DataFrame, size: int) -> DataFrame:
    """A mosaic back into tile rasters, edges in both tiles."""
    reach = lambda c: F.sequence(F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col(c) - size) / size)), F.floor(F.col(c) / size))
    out = r.withColumn("x", F.explode(reach("px"))).withColumn("y", F.explode(reach("py")))
    return out.select("x", "y", (F.col("px") - F.col("x") * size).alias("px"), (F.col("py") - F.col("y") * size).alias("py"), "h")


def merge_navtiles(layers: DataFrame) -> DataFrame:
    """Of each pixel the last source that covers it; a source from `up` levels above is scaled: each of its pixels covers 2^up x 2^up."""
    span = lambda c: F.sequence(shl(c, "up"), shl(F.col(c) + 1, "up") - 1)
    near = layers.where("up = 0").select("px", "py", "h", "prio")
    far = layers.where("up > 0").withColumn("px", F.explode(span("px"))).withColumn("py", F.explode(span("py"))).select("px", "py", "h", "prio")
    return near.unionByName(far).groupBy("px", "py").agg(F.max_by("h", "prio").alias("h"), F.max("prio").alias("prio"))


def best_position(r: DataFrame) -> DataFrame:
    """The centroid of the valid pixels, the height of the valid pixel nearest to it, and the vertical extent."""
    c = r.agg(F.avg("px").alias("cx"), F.avg("py").alias("cy"), (F.max("h") - F.min("h")).alias("extent"))
    near = F.struct(F.abs(F.col("px") - F.col("cx")) + F.abs(F.col("py") - F.col("cy")), "px", "py")
    return r.join(F.broadcast(c), F.lit(True)).groupBy("cx", "cy", "extent").agg(F.min_by("h", near).alias("h"))
