"""Tile arithmetic as columns: all of it stays in whole-stage code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

Tile = tuple[Column, Column, Column]
Box = tuple[Column, Column, Column, Column]


def col(c: Column | str | int) -> Column:
    return F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c


def shl(a, n) -> Column:
    """a * 2^n for column shifts; bigint."""
    return F.call_function("shiftleft", col(a).cast("bigint"), col(n).cast("int"))


def shr(a, n) -> Column:
    return F.call_function("shiftright", col(a).cast("bigint"), col(n).cast("int"))


def parent(lod, x, y, by) -> Tile:
    """The ancestor `by` levels up; above the root everything is (0, 0, 0)."""
    lod, x, y, by = map(col, (lod, x, y, by))
    out = by > lod
    return F.when(out, 0).otherwise(lod - by).cast("int"), F.when(out, 0).otherwise(shr(x, by)).cast("bigint"), F.when(out, 0).otherwise(shr(y, by)).cast("bigint")


def children(lod, x, y) -> Column:
    """Array of the four children in the order upper left, upper right, lower left, lower right."""
    lod, x, y = map(col, (lod, x, y))
    return F.array(*(F.struct((lod + 1).cast("int").alias("lod"), (x * 2 + (i & 1)).alias("x"), (y * 2 + (i >> 1)).alias("y"), F.lit(i).alias("child")) for i in range(4)))


def child_index(x, y) -> Column:
    return (col(x).bitwiseAND(1) + col(y).bitwiseAND(1) * 2).cast("int")


def box_parent(box: Box, by) -> Box:
    return tuple(shr(c, by) for c in box)


def box_child(box: Box, by) -> Box:
    """All descendants `by` levels down."""
    x0, y0, x1, y1 = map(col, box)
    return shl(x0, by), shl(y0, by), shl(x1 + 1, by) - 1, shl(y1 + 1, by) - 1


def box_shift(box: Box, from_lod, to_lod) -> Box:
    """The box at another level: ancestors, descendants or itself."""
    a, b = col(from_lod), col(to_lod)
    down, up = box_child(box, F.greatest(b - a, F.lit(0))), box_parent(box, F.greatest(a - b, F.lit(0)))
    return tuple(F.when(b >= a, d).otherwise(u) for d, u in zip(down, up))


def local(lod, x, y, root_lod) -> Tile:
    """The tile's id within the subtree of its ancestor at root_lod; at or above it (0, 0, 0)."""
    lod, x, y, r = map(col, (lod, x, y, root_lod))
    d = F.greatest(lod - r, F.lit(0))
    mask = shl(1, d) - 1
    return d.cast("int"), x.bitwiseAND(mask), y.bitwiseAND(mask)


def global_id(root: Tile, tile: Tile) -> Tile:
    """The id in the whole tree of a tile known within a root's subtree."""
    (rl, rx, ry), (lod, x, y) = (tuple(map(col, t)) for t in (root, tile))
    return (rl + lod).cast("int"), shl(rx, lod) + x, shl(ry, lod) + y


def meta_id(x, y, order: int = 5) -> tuple[Column, Column]:
    """Origin of the metatile that holds the tile."""
    return tuple(shl(shr(c, order), order) for c in (x, y))


def vertical_flip(lod, y) -> Column:
    return shl(1, lod) - 1 - col(y)


def tile_count(lod) -> Column:
    return shl(1, lod)


def tile_size(extent: Column, lod) -> Column:
    return extent / shl(1, lod).cast("double")


def inside(lod, x, y, lods: tuple, box: Box) -> Column:
    return col(lod).between(*map(col, lods)) & col(x).between(col(box[0]), col(box[2])) & col(y).between(col(box[1]), col(box[3]))


def under(lod, x, y, at_lod, box: Box) -> Column:
    """Whether the tile's ancestor at a level lies in a box of that level; a tile above it does not."""
    d = F.greatest(col(lod) - col(at_lod), F.lit(0))
    return (col(lod) >= col(at_lod)) & shr(x, d).between(col(box[0]), col(box[2])) & shr(y, d).between(col(box[1]), col(box[3]))


def box_intersect(a: Box, b: Box) -> Box:
    """The common box; null columns where there is none."""
    x0, y0 = F.greatest(col(a[0]), col(b[0])), F.greatest(col(a[1]), col(b[1]))
    x1, y1 = F.least(col(a[2]), col(b[2])), F.least(col(a[3]), col(b[3]))
    fine = (x0 <= x1) & (y0 <= y1)
    return tuple(F.when(fine, c) for c in (x0, y0, x1, y1))


def box_overlaps(a: Box, b: Box) -> Column:
    return (col(a[0]) <= col(b[2])) & (col(b[0]) <= col(a[2])) & (col(a[1]) <= col(b[3])) & (col(b[1]) <= col(a[3]))


def common_ancestor(lod, box: Box) -> Tile:
    """The deepest tile above both corners of a box: as many levels up as the corners' differing bits are long."""
    x0, y0, x1, y1 = map(col, box)
    differ = x0.bitwiseXOR(x1).bitwiseOR(y0.bitwiseXOR(y1))
    up = F.when(differ == 0, 0).otherwise(F.length(F.bin(differ))).cast("int")
    return parent(lod, x0, y0, up)


#: Border bits: top, bottom, left, right and inside, spaced by a hex digit each.
TOP, BOTTOM, LEFT, RIGHT, INSIDE = 0x1, 0x10, 0x100, 0x1000, 0x10000


def border(lod, x, y, at_lod, box: Box) -> Column:
    """Inside flag and the borders of the box that the tile touches; the box is carried to the tile's level. 0 outside."""
    x0, y0, x1, y1 = box_shift(box, at_lod, lod)
    x, y = col(x), col(y)
    bit = lambda c, v: F.when(c, v).otherwise(0)
    bits = bit(y == y0, TOP) + bit(y == y1, BOTTOM) + bit(x == x0, LEFT) + bit(x == x1, RIGHT)
    return F.when(x.between(x0, x1) & y.between(y0, y1), bits + INSIDE).otherwise(0).cast("int")


def inflate(box: Box, margin: Column, borders: Column | None = None) -> Box:
    """Extents grown by a share of their size, or by an absolute amount if negative; with border flags only on those sides."""
    llx, lly, urx, ury = map(col, box)
    dx = F.when(margin < 0, -margin).otherwise(margin * (urx - llx))
    dy = F.when(margin < 0, -margin).otherwise(margin * (ury - lly))
    on = lambda bit, d: d if borders is None else F.when(borders.bitwiseAND(bit) != 0, d).otherwise(0.0)
    return llx - on(LEFT, dx), lly - on(BOTTOM, dy), urx + on(RIGHT, dx), ury + on(TOP, dy)


def quadkey(lod, x, y) -> Column:
    """One digit 0 to 3 for each level, the root's child first."""
    lod, x, y = map(col, (lod, x, y))
    digits = F.transform(F.sequence(F.lit(1), F.greatest(lod, F.lit(1))), lambda i: (shr(x, lod - i).bitwiseAND(1) + shr(y, lod - i).bitwiseAND(1) * 2).cast("string"))
    return F.when(lod > 0, F.array_join(digits, "")).otherwise("")


def union_range(a: tuple, b: tuple) -> tuple[Column, Column]:
    return F.least(col(a[0]), col(b[0])), F.greatest(col(a[1]), col(b[1]))


def grow_range(a: tuple, by) -> tuple[Column, Column]:
    """One range wider on both sides; the lower end stops at 0."""
    return F.greatest(col(a[0]) - col(by), F.lit(0)), col(a[1]) + col(by)


def clamp(v, a: tuple) -> Column:
    return F.greatest(col(a[0]), F.least(col(a[1]), col(v)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
