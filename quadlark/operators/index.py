"""Tile-set algebra over rows (lod, x, y, flags).

A tile set is sparse: absent means 0. Dense results (inversion, all descendants) are linear-quadtree rows
(lod, qlod, qx, qy, flags), one row for all 4^(lod - qlod) tiles of `lod` under the tile (qlod, qx, qy); `expand` turns them into tiles
for the levels asked for. Where two operands overlap, the first one's value stands, tile by tile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tiles import shl, shr
from ..plans.levels import cut

KEY = ["lod", "x", "y"]
QUAD = ["lod", "qlod", "qx", "qy"]


def tiles(df: DataFrame) -> DataFrame:
    return df.select(F.col("lod").cast("int").alias("lod"), F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), F.col("flags").cast("bigint").alias("flags"))


def translate(a: DataFrame, op: Callable[[Column], Column]) -> DataFrame:
    """Maps every value; tiles that become 0 vanish."""
    return a.withColumn("flags", op(F.col("flags"))).where("flags <> 0")


def matching(a: DataFrame, mask: int, value: int | None = None) -> DataFrame:
    m = F.col("flags").bitwiseAND(mask)
    return a.where(m != 0 if value is None else m == value)


def simplify(a: DataFrame, mask: int = 0xFF, value: int | None = None) -> DataFrame:
    return matching(a, mask, value).withColumn("flags", F.lit(1).cast("bigint"))


def unset(a: DataFrame, mask: int) -> DataFrame:
    return translate(a, lambda f: f.bitwiseAND(F.lit(~mask).cast("bigint")))


def clamp(a: DataFrame, low: int, high: int) -> DataFrame:
    return a.where(F.col("lod").between(low, high))


def first_wins(*sets: DataFrame) -> DataFrame:
    """Union: each tile has the value of the first set that holds it."""
    parts = [s.select(*KEY, "flags").withColumn("p", F.lit(i)) for i, s in enumerate(sets)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*KEY).agg(F.min_by("flags", "p").alias("flags"))


def fill(a: DataFrame, b: DataFrame, mask: int = 0xFF) -> DataFrame:
    """a, and where it has nothing, b's matching tiles at levels within a's range. The range is one row, read once."""
    lods = a.agg(F.min("lod").alias("lo"), F.max("lod").alias("hi"))
    there = matching(b, mask).join(F.broadcast(lods), F.col("lod").between(F.col("lo"), F.col("hi"))).select(*KEY, "flags")
    return first_wins(a, there)


def unite(sets: list[DataFrame], mask: int = 0xFF) -> DataFrame:
    return simplify(first_wins(*(matching(s, mask) for s in sets)))


def intersect(a: DataFrame, b: DataFrame, mask: int = 0xFF) -> DataFrame:
    """a's matching tiles that b matches too; levels that b does not have at all stay as they are in a."""
    b = matching(b, mask)
    common = matching(a, mask).join(b.select(*KEY), KEY, "left_semi")
    return common.unionByName(a.join(F.broadcast(b.select("lod").distinct()), "lod", "left_anti").select(*a.columns))


def subtract(a: DataFrame, b: DataFrame, mask: int = 0xFF) -> DataFrame:
    return a.join(matching(b, mask).select(*KEY), KEY, "left_anti")


def not_overlaps(a: DataFrame, b: DataFrame, mask: int = 0xFF) -> DataFrame:
    """One row: true if the level ranges differ or, at any level, no tile is in both."""
    level = lambda s, n: matching(s, mask).groupBy("lod").agg(F.count("*").alias(n))
    shared = matching(a, mask).join(matching(b, mask).select(*KEY), KEY, "left_semi").groupBy("lod").agg(F.count("*").alias("n"))
    every = level(a, "na").join(level(b, "nb"), "lod", "full").join(shared, "lod", "left")
    return every.agg(F.coalesce(F.bool_or(F.col("na").isNull() | F.col("nb").isNull() | F.col("n").isNull()), F.lit(False)).alias("not_overlaps"))


def combine(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column], lods: tuple[int, int] | None = None) -> DataFrame:
    """op(old, new) for all tiles of either set (missing is 0) at b's levels; a's other levels stay."""
    if lods:
        b = b.where(F.col("lod").between(*lods))
    levels = F.broadcast(b.select("lod").distinct().withColumn("there", F.lit(True)))
    both = a.select(*KEY, F.col("flags").alias("old")).join(b.select(*KEY, F.col("flags").alias("new")), KEY, "full").join(levels, "lod", "left")
    old, new = F.coalesce("old", F.lit(0).cast("bigint")), F.coalesce("new", F.lit(0).cast("bigint"))
    return both.select(*KEY, F.when(F.col("there"), op(old, new)).otherwise(old).alias("flags")).where("flags <> 0")


def identical(a: DataFrame, b: DataFrame, same: Callable[[Column, Column], Column] = lambda x, y: x == y) -> DataFrame:
    """One row: whether all cells compare the same, missing ones being 0."""
    both = a.select(*KEY, F.col("flags").alias("l")).join(b.select(*KEY, F.col("flags").alias("r")), KEY, "full")
    zero = F.lit(0).cast("bigint")
    return both.agg((F.count_if(~same(F.coalesce("l", zero), F.coalesce("r", zero))) == 0).alias("identical"))


def set_masked(a: DataFrame, writes: DataFrame) -> DataFrame:
    """Masked writes (lod, x, y, mask, value): (old & ~mask) | (value & mask). One write for each tile."""
    both = a.join(writes.select(*KEY, "mask", "value"), KEY, "full")
    old, mask = F.coalesce("flags", F.lit(0).cast("bigint")), F.coalesce("mask", F.lit(0).cast("bigint"))
    new = old.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(F.coalesce("value", F.lit(0).cast("bigint")).bitwiseAND(mask))
    return both.select(*KEY, new.alias("flags")).where("flags <> 0")


def box_tiles(boxes: DataFrame) -> DataFrame:
    """All tiles of boxes (x0, y0, x1, y1), other columns kept."""
    return boxes.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1"))).drop("x0", "y0", "x1", "y1")


def ancestors(a: DataFrame, ceiling: int = 0) -> DataFrame:
    """Every row once for each level from its own up to the ceiling: (lod, x, y) is the ancestor, own_lod the tile's level.

    Aggregations over these rows combine before the shuffle, so upper levels, where all tiles meet, stay small.
    """
    up = a.withColumnsRenamed({"lod": "own_lod", "x": "own_x", "y": "own_y"})
    up = up.withColumn("lod", F.explode(F.sequence(F.least(F.lit(ceiling), F.col("own_lod")), F.col("own_lod"))))
    d = F.col("own_lod") - F.col("lod")
    return up.withColumn("x", shr("own_x", d)).withColumn("y", shr("own_y", d))


def complete(a: DataFrame, mask: int = 0xFF, ceiling: int = 0) -> DataFrame:
    """Adds, with value 1, all ancestors of matching tiles down to the ceiling level; a's own values stand."""
    up = ancestors(matching(a, mask).select(*KEY), ceiling).select(*KEY).distinct().withColumn("flags", F.lit(1).cast("bigint"))
    return first_wins(a, up)


def round_up(a: DataFrame, mask: int = 0xFF, forced: bool = False) -> DataFrame:
    """2 x 2 closure: blocks with a matching tile become uniform with the first matching child's value in the order ul, ur, ll, lr;
    forced: blocks without one take the last child's value. Other blocks stay as they are."""
    z = F.lit(0).cast("bigint")
    cell = [F.coalesce(F.max(F.when(F.col("c") == i, F.col("flags"))), z) for i in range(4)]
    block = a.select("lod", shr("x", 1).alias("bx"), shr("y", 1).alias("by"), (F.col("x").bitwiseAND(1) + F.col("y").bitwiseAND(1) * 2).alias("c"), "flags")
    block = block.groupBy("lod", "bx", "by").agg(*(v.alias(f"v{i}") for i, v in enumerate(cell)))
    first = F.coalesce(*(F.when(F.col(f"v{i}").bitwiseAND(mask) != 0, F.col(f"v{i}")) for i in range(4)))
    block = block.withColumn("value", F.coalesce(first, F.col("v3")) if forced else first)
    child = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.coalesce("value", F.col(f"v{i}")).alias("flags")) for i in range(4))))
    out = block.select("lod", "bx", "by", child.alias("e"))
    x, y = F.col("bx") * 2 + F.col("e.c").bitwiseAND(1), F.col("by") * 2 + F.shiftright("e.c", 1)
    return out.select("lod", x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.col("e.flags").alias("flags")).where("flags <> 0 and (lod > 0 or (x = 0 and y = 0))")


def round_tiles(a: DataFrame, mask: int = 0xFF) -> DataFrame:
    return round_up(matching(a, mask), mask)


def quads(a: DataFrame) -> DataFrame:
    return a.select("lod", F.col("lod").alias("qlod"), F.col("x").alias("qx"), F.col("y").alias("qy"), "flags")


def expand(q: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Quad rows to tiles, for the levels asked for; overlapping quads take the finest quad's value."""
    if low is not None:
        q = q.where(F.col("lod") >= low)
    if high is not None:
        q = q.where(F.col("lod") <= high)
    d = F.col("lod") - F.col("qlod")
    span = lambda c: F.sequence(shl(c, d), shl(F.col(c) + 1, d) - 1)
    out = q.withColumn("x", F.explode(span("qx"))).withColumn("y", F.explode(span("qy")))
    return out.groupBy(*KEY).agg(F.max_by("flags", "qlod").alias("flags"))


def invert(a: DataFrame, lods: tuple[int, int], mask: int = 0xFF) -> DataFrame:
    """Quads of all tiles within the levels that do not match: siblings of the matching tiles' ancestors that hold no match. Grows with the
    matching tiles, not with the grid."""
    hit = matching(a, mask).where(F.col("lod").between(*lods)).select(*KEY)
    spark = a.sparkSession
    levels = spark.range(lods[0], lods[1] + 1).select(F.col("id").cast("int").alias("lod"))
    up = ancestors(hit.withColumn("level", F.col("lod"))).select("level", *KEY).distinct()
    inner = up.where("lod < level")
    child = F.explode(F.array(*(F.struct((F.col("x") * 2 + (i & 1)).alias("x"), (F.col("y") * 2 + (i >> 1)).alias("y")) for i in range(4))))
    below = inner.select("level", (F.col("lod") + 1).cast("int").alias("lod"), child.alias("e")).select("level", "lod", "e.x", "e.y")
    gaps = below.join(up, ["level", *KEY], "left_anti").select(F.col("level").alias("lod"), F.col("lod").alias("qlod"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    empty = levels.join(hit.select("lod").distinct(), "lod", "left_anti").select("lod", F.lit(0).alias("qlod"), F.lit(0).cast("bigint").alias("qx"), F.lit(0).cast("bigint").alias("qy"))
    return gaps.unionByName(empty).withColumn("flags", F.lit(1).cast("bigint"))


def complete_down(a: DataFrame, high: int, mask: int = 0xFF, from_bottom: bool = False) -> DataFrame:
    """Quads of a with, to the level `high`, all descendants of matching tiles. from_bottom: only those of the finest level that has any."""
    seed = matching(a, mask)
    if from_bottom:
        finest = seed.agg(F.max("lod").alias("m"))
        seed = seed.join(F.broadcast(finest), F.col("lod") == F.col("m")).drop("m")
    seed = seed.where(F.col("lod") < high)
    down = seed.withColumn("to", F.explode(F.sequence(F.col("lod") + 1, F.lit(high))))
    down = down.select(F.col("to").cast("int").alias("lod"), F.col("lod").alias("qlod"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.lit(1).cast("bigint").alias("flags"))
    return quads(a).unionByName(down)


def _ancestor_keys(q: DataFrame, held: DataFrame, strictly: bool) -> DataFrame:
    """Distinct quads with their ancestors' keys (lod, u, ux, uy) at the depths u that `held` has for their level: a few numbers for each level,
    so they are broadcast."""
    depths = F.broadcast(held.select("lod", F.col("qlod").alias("u")).distinct())
    above = F.col("u") < F.col("qlod") if strictly else F.col("u") <= F.col("qlod")
    up = q.select(*QUAD).distinct().join(depths, "lod").where(above)
    return up.select(*QUAD, "u", shr("qx", F.col("qlod") - F.col("u")).alias("ux"), shr("qy", F.col("qlod") - F.col("u")).alias("uy"))


def _as_keys(q: DataFrame) -> DataFrame:
    return q.select("lod", F.col("qlod").alias("u"), F.col("qx").alias("ux"), F.col("qy").alias("uy"))


def prune(q: DataFrame) -> DataFrame:
    """Drops quads that lie within another quad of the same level set (values aside)."""
    inside = _ancestor_keys(q, q, True).join(_as_keys(q), ["lod", "u", "ux", "uy"], "left_semi").select(*QUAD)
    return q.join(inside, QUAD, "left_anti")


def quad_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Quads in both sets: of each meeting pair, the finer one. Two equi-joins over ancestor keys, no cross join."""

    def finer(f: DataFrame, c: DataFrame) -> DataFrame:
        return _ancestor_keys(f, c, False).join(_as_keys(c), ["lod", "u", "ux", "uy"], "left_semi").select(*QUAD)

    return finer(a, b).unionByName(finer(b, a)).distinct().withColumn("flags", F.lit(1).cast("bigint"))


def grow_up(a: DataFrame, low: int, mask: int = 0xFF) -> DataFrame:
    """Matching tiles with their siblings and, level by level down to `low`, the parents with theirs: the ancestors, closed by 2 x 2."""
    return round_tiles(complete(simplify(a, mask), 1, low), 1)


def sphere_of_influence(a: DataFrame, low: int, high: int, mask: int = 0xFF) -> DataFrame:
    """Quads of the grown set: descendants of the matching tiles down to `high`, then ancestors and siblings up to `low`.

    Descendants' ancestors below a tile are its descendants, and they bring no siblings of their own: 2 x 2 blocks under a tile are
    whole. So siblings are closed over the tiles and their ancestors, and the blocks' descendants follow as quads. Pruning reads
    them several times, so they are written once.
    """
    seed = clamp(simplify(a, mask), low, high)
    whole = grow_up(seed, low, 1)
    down = complete_down(seed, high, 1).where("lod > qlod")
    return prune(cut(quads(clamp(whole, low, high)).unionByName(down)))


def distribute(a: DataFrame, mask: int, high: int) -> DataFrame:
    """Quads: the masked bits of every tile ORed into all descendants down to `high`, existing or not."""
    top = a.where(F.col("flags").bitwiseAND(mask) != 0).select(*KEY, F.col("flags").bitwiseAND(mask).alias("bits"))
    given = top.withColumn("to", F.explode(F.sequence(F.col("lod"), F.lit(high)))).select(F.col("to").cast("int").alias("lod"), F.col("lod").alias("qlod"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("bits").alias("flags"))
    return quads(a).unionByName(given.where("lod > qlod"))


def expand_or(q: DataFrame) -> DataFrame:
    """Quads to tiles, values of overlapping quads ORed."""
    d = F.col("lod") - F.col("qlod")
    out = q.withColumn("x", F.explode(F.sequence(shl("qx", d), shl(F.col("qx") + 1, d) - 1))).withColumn("y", F.explode(F.sequence(shl("qy", d), shl(F.col("qy") + 1, d) - 1)))
    return out.groupBy(*KEY).agg(F.bit_or("flags").alias("flags"))


def shrink_and_complete(a: DataFrame, trim: int) -> DataFrame:
    """Which metatiles exist: ids shifted right by min(trim, lod) within their level, then ancestors' shifted ids too. As a shift of an ancestor's
    id is the ancestor of the shifted id, the second step is one more explode."""
    by = F.least(F.lit(trim), F.col("lod"))
    own = a.select("lod", shr("x", by).alias("x"), shr("y", by).alias("y")).distinct()
    up = own.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("lod"))))
    shown = F.least(F.lit(trim), F.col("lod"))
    wide, high = shl("x", shown), shl("y", shown)
    to_by = F.least(F.lit(trim), F.col("to"))
    out = up.select(F.col("to").cast("int").alias("lod"), shr(shr(wide, F.col("lod") - F.col("to")), to_by).alias("x"), shr(shr(high, F.col("lod") - F.col("to")), to_by).alias("y"))
    return out.distinct().withColumn("flags", F.lit(1).cast("bigint"))


def subtree(a: DataFrame, lod: int, x: int, y: int) -> DataFrame:
    """Tiles under one tile, with ids within its subtree."""
    d = F.col("lod") - lod
    inside = a.where((F.col("lod") >= lod) & (shr("x", F.greatest(d, F.lit(0))) == x) & (shr("y", F.greatest(d, F.lit(0))) == y))
    return inside.select(d.cast("int").alias("lod"), (F.col("x") - shl(F.lit(x), d)).alias("x"), (F.col("y") - shl(F.lit(y), d)).alias("y"), "flags")


def statistics(a: DataFrame, mask: int = 0xFF, value: int | None = None) -> DataFrame:
    """Box and count of the matching tiles of each level."""
    return matching(a, mask, value).groupBy("lod").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("tiles"))


def tile_ranges(a: DataFrame, mask: int = 0xFF) -> DataFrame:
    """One row: level range and, at its top level, the box over all matching tiles' ancestors there."""
    s = statistics(a, mask)
    low = s.agg(F.min("lod").alias("lod_min"), F.max("lod").alias("lod_max"))
    d = F.col("lod") - F.col("lod_min")
    up = s.join(F.broadcast(low), F.lit(True)).groupBy("lod_min", "lod_max")
    return up.agg(F.min(shr("x0", d)).alias("x0"), F.min(shr("y0", d)).alias("y0"), F.max(shr("x1", d)).alias("x1"), F.max(shr("y1", d)).alias("y1"))


def valid_subtrees(a: DataFrame) -> DataFrame:
    """All tiles beneath which, or at which, something is set."""
    return ancestors(a.where("flags <> 0").select(*KEY)).select(*KEY).distinct()
