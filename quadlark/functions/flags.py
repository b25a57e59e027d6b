"""Bit masks of tiles and metanodes: predicates and text forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .tiles import col

#: Tile flags (fixed values).
MESH, WATERTIGHT, ATLAS, NAVTILE, ALIEN, MULTIMESH, ANY = 0x1, 0x2, 0x4, 0x8, 0x20, 0x40, 0xFF
#: Metanode flags (fixed values).
M_GEOMETRY, M_NAVTILE, M_TEXEL, M_DISPLAY, M_UL, M_UR, M_LL, M_LR, M_ALIEN = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x40, 0x80, 0x100
#: Names in the order they are written (fixed values).
TILE_NAMES = [("mesh", MESH), ("alien", ALIEN), ("watertight", WATERTIGHT), ("atlas", ATLAS), ("navtile", NAVTILE)]
META_NAMES = [("geometry", M_GEOMETRY), ("navtile", M_NAVTILE), ("applyTexelSize", M_TEXEL), ("applyDisplaySize", M_DISPLAY), ("ulChild", M_UL), ("urChild", M_UR), ("llChild", M_LL), ("lrChild", M_LR), ("alien", M_ALIEN)]


def has(flags, mask: int) -> Column:
    return col(flags).bitwiseAND(mask) != 0


def check(flags, mask: int, value: int | None = None) -> Column:
    """Some bit of the mask, or exactly the value under the mask."""
    return has(flags, mask) if value is None else col(flags).bitwiseAND(mask) == value


def real(flags) -> Column:
    return has(flags, MESH)


def watertight(flags) -> Column:
    return has(flags, WATERTIGHT)


def alien(flags) -> Column:
    """Has a mesh that comes from elsewhere."""
    return check(flags, MESH | ALIEN, MESH | ALIEN)


def influenced(flags) -> Column:
    return col(flags) == ALIEN


def reference(flags) -> Column:
    """The source reference in the upper 16 bits."""
    return F.shiftright(col(flags).cast("bigint"), 16)


def source_reference(flags) -> Column:
    """0 for a tile that is not real, its reference if it has one, 1 otherwise."""
    ref = reference(flags)
    return F.when(~real(flags), 0).when(ref > 0, ref).otherwise(1)


def allow_deny(flags, allow: int, deny: int) -> Column:
    """Some allowed bit, and some bit outside the denied ones."""
    return has(flags, allow) & (col(flags).bitwiseAND(F.lit(~deny).cast("bigint")) != 0)


def names(flags, table: list[tuple[str, int]]) -> Column:
    return F.array_compact(F.array(*(F.when(has(flags, bit), F.lit(name)) for name, bit in table)))


def tile_text(flags) -> Column:
    """Names of the set bits; an influenced tile is named so, and a source reference follows."""
    words = F.when(influenced(flags), F.array(F.lit("influenced"))).otherwise(names(flags, TILE_NAMES))
    ref = F.when(reference(flags) > 0, F.array(F.concat(F.lit("reference="), reference(flags).cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(words, ref), ",")


def meta_text(flags) -> Column:
    return F.array_join(names(flags, META_NAMES), ",")


def parse_text(text: Column, table: list[tuple[str, int]]) -> Column:
    """The mask of a list of names; unknown names add nothing."""
    words = F.split(text, ",")
    return sum((F.when(F.array_contains(words, name), bit).otherwise(0) for name, bit in table), F.lit(0)).cast("bigint")
