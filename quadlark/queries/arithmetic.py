"""Tile arithmetic, ranges and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixtures as fx
from ..functions import flags as fl, tiles as t
from . import query

TILE = ("lod", "x", "y")
BOX = ("x0", "y0", "x1", "y1")


def tiles_a(spark, d: str) -> DataFrame:
    return fx.sql(spark, d, fx.A)


def boxes(spark, d: str) -> DataFrame:
    return fx.sql(spark, d, fx.BOXES)


def named(columns, names) -> list:
    return [c.alias(n) for c, n in zip(columns, names)]


@query("tile_parent", f"select lod, x, y, cast(case when 6 > lod then 0 else lod - 6 end as int) as plod, cast(case when 6 > lod then 0 else x >> 6 end as bigint) as px, cast(case when 6 > lod then 0 else y >> 6 end as bigint) as py from ({fx.A}) a")
def tile_parent(spark, d):
    return tiles_a(spark, d).select(*TILE, *named(t.parent(*TILE, 6), ("plod", "px", "py")))


@query("range_parent", f"select id, x0 >> 2 as x0, y0 >> 2 as y0, x1 >> 2 as x1, y1 >> 2 as y1 from ({fx.BOXES}) b")
def range_parent(spark, d):
    return boxes(spark, d).select("id", *named(t.box_parent(BOX, 2), BOX))


@query("tile_children", f"select lod, x, y, cast(lod + 1 as int) as clod, x * 2 + (i & 1) as cx, y * 2 + (i >> 1) as cy, cast(i as int) as child from ({fx.A}) a, (values (0), (1), (2), (3)) c(i)")
def tile_children(spark, d):
    return tiles_a(spark, d).select(*TILE, F.explode(t.children(*TILE)).alias("c")).select(*TILE, F.col("c.lod").alias("clod"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), "c.child")


@query("tile_child_index", f"select lod, x, y, cast((x & 1) + ((y & 1) << 1) as int) as child from ({fx.A}) a")
def tile_child_index(spark, d):
    return tiles_a(spark, d).select(*TILE, t.child_index("x", "y").alias("child"))


@query("range_child", f"select id, x0 << 3 as x0, y0 << 3 as y0, ((x1 + 1) << 3) - 1 as x1, ((y1 + 1) << 3) - 1 as y1 from ({fx.BOXES}) b")
def range_child(spark, d):
    return boxes(spark, d).select("id", *named(t.box_child(BOX, 3), BOX))


_TO = "cast(4 + id % 5 as int)"


@query("range_shift", f"select id, {_TO} as to_lod, " + ", ".join(f"cast(case when {_TO} >= lod then (({c} + {k}) << greatest({_TO} - lod, 0)) - {k} else {c} >> greatest(lod - {_TO}, 0) end as bigint) as {c}" for c, k in zip(BOX, (0, 0, 1, 1))) + f" from ({fx.BOXES}) b")
def range_shift(spark, d):
    to = (F.col("id") % 5 + 4).cast("int")
    return boxes(spark, d).select("id", to.alias("to_lod"), *named(t.box_shift(BOX, "lod", to), BOX))


@query("tile_local_global", f"select lod, x, y, cast(lod - 3 as int) as llod, x & ((cast(1 as bigint) << (lod - 3)) - 1) as lx, y & ((cast(1 as bigint) << (lod - 3)) - 1) as ly, lod as glod, x as gx, y as gy from ({fx.A}) a")
def tile_local_global(spark, d):
    inner = t.local(*TILE, 3)
    return tiles_a(spark, d).select(*TILE, *named(inner, ("llod", "lx", "ly")), *named(t.global_id(t.parent(*TILE, F.col("lod") - 3), inner), ("glod", "gx", "gy")))


@query("tile_meta_id", f"select lod, x, y, x & ~cast(31 as bigint) as mx, y & ~cast(31 as bigint) as my from ({fx.A}) a")
def tile_meta_id(spark, d):
    return tiles_a(spark, d).select(*TILE, *named(t.meta_id("x", "y"), ("mx", "my")))


@query("archive_index", f"select lod, x >> 5 as arch_x, y >> 5 as arch_y, cast(count(*) as bigint) as tiles, cast(min((x & 31) + 32 * (y & 31)) as bigint) as first_slot, cast(max((x & 31) + 32 * (y & 31)) as bigint) as last_slot from ({fx.A}) a group by 1, 2, 3")
def archive_index(spark, d):
    slot = F.col("x").bitwiseAND(31) + F.col("y").bitwiseAND(31) * 32
    return tiles_a(spark, d).groupBy("lod", t.shr("x", 5).alias("arch_x"), t.shr("y", 5).alias("arch_y")).agg(F.count("*").alias("tiles"), F.min(slot).alias("first_slot"), F.max(slot).alias("last_slot"))


@query("tile_vflip", f"select lod, x, (cast(1 as bigint) << lod) - 1 - y as y from ({fx.A}) a")
def tile_vflip(spark, d):
    return tiles_a(spark, d).select("lod", "x", t.vertical_flip("lod", "y").alias("y"))


@query("tile_size", f"select lod, cast(1 as bigint) << lod as tiles, 360.0e0 / (cast(1 as bigint) << lod) as width from ({fx.A}) a group by lod")
def tile_size(spark, d):
    return tiles_a(spark, d).select("lod").distinct().select("lod", t.tile_count("lod").alias("tiles"), t.tile_size(F.lit(360.0), "lod").alias("width"))


@query("tile_under", f"select lod, x, y, (lod >= 6 and (x >> greatest(lod - 6, 0)) between 8 and 40 and (y >> greatest(lod - 6, 0)) between 3 and 50) as is_under, (lod between 6 and 7 and x between 8 and 40 and y between 3 and 50) as is_inside from ({fx.A}) a")
def tile_under(spark, d):
    box = (8, 3, 40, 50)
    return tiles_a(spark, d).select(*TILE, t.under(*TILE, 6, box).alias("is_under"), t.inside(*TILE, (6, 7), box).alias("is_inside"))


@query("range_intersect", f"select id, case when f then a0 end as x0, case when f then b0 end as y0, case when f then a1 end as x1, case when f then b1 end as y1, case when f then (a1 - a0 + 1) * (b1 - b0 + 1) end as tiles from (select id, greatest(x0, 8) as a0, greatest(y0, 4) as b0, least(x1, 20) as a1, least(y1, 24) as b1, greatest(x0, 8) <= least(x1, 20) and greatest(y0, 4) <= least(y1, 24) as f from ({fx.BOXES}) b) c")
def range_intersect(spark, d):
    x0, y0, x1, y1 = t.box_intersect(BOX, (8, 4, 20, 24))
    return boxes(spark, d).select("id", *named((x0, y0, x1, y1), BOX), ((x1 - x0 + 1) * (y1 - y0 + 1)).alias("tiles"))


@query("range_overlaps", f"select b.id, s.lod, s.bx0, s.bx1 from ({fx.BOXES}) b join (select lod, min(x) as bx0, max(x) as bx1, min(y) as by0, max(y) as by1 from ({fx.A}) a where flags & 2 = 2 and x > 8 group by lod) s on b.lod = s.lod and b.x0 <= s.bx1 and s.bx0 <= b.x1 and b.y0 <= s.by1 and s.by0 <= b.y1")
def range_overlaps(spark, d):
    """Boxes whose level has a box of its own that they meet; one row for each level is broadcast."""
    own = tiles_a(spark, d).where(fl.check("flags", 2) & (F.col("x") > 8)).groupBy("lod").agg(F.min("x").alias("bx0"), F.max("x").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1"))
    return boxes(spark, d).join(F.broadcast(own), "lod").where(t.box_overlaps(BOX, ("bx0", "by0", "bx1", "by1"))).select("id", "lod", "bx0", "bx1")


_UP = "cast(length(ltrim(bin(xor(x0, x1) | xor(y0, y1)), '0')) as int)"


@query("common_ancestor", f"select id, cast(case when u > lod then 0 else lod - u end as int) as alod, cast(case when u > lod then 0 else x0 >> u end as bigint) as ax, cast(case when u > lod then 0 else y0 >> u end as bigint) as ay from (select *, {_UP} as u from ({fx.BOXES}) b) c")
def common_ancestor(spark, d):
    return boxes(spark, d).select("id", *named(t.common_ancestor("lod", BOX), ("alod", "ax", "ay")))


_B = {c: (f"cast(case when a.lod >= 6 then (({v} + {k}) << greatest(a.lod - 6, 0)) - {k} else {v} >> greatest(6 - a.lod, 0) end as bigint)") for c, v, k in (("x0", "cast(8 as bigint)", 0), ("y0", "cast(3 as bigint)", 0), ("x1", "cast(40 as bigint)", 1), ("y1", "cast(50 as bigint)", 1))}


@query("tile_border", f"select lod, x, y, cast(case when x between x0 and x1 and y between y0 and y1 then 65536 + case when y = y0 then 1 else 0 end + case when y = y1 then 16 else 0 end + case when x = x0 then 256 else 0 end + case when x = x1 then 4096 else 0 end else 0 end as int) as border from (select a.*, {', '.join(f'{v} as {c}' for c, v in _B.items())} from ({fx.A}) a) b")
def tile_border(spark, d):
    return tiles_a(spark, d).select(*TILE, t.border(*TILE, 6, (8, 3, 40, 50)).alias("border"))


@query("inflate_extents", f"select id, cast(x0 as double) - 0.25 * (x1 - x0) as llx, cast(y0 as double) - 0.25 * (y1 - y0) as lly, cast(x1 as double) + 3.0 as urx, cast(y1 as double) as ury from ({fx.BOXES}) b")
def inflate_extents(spark, d):
    box = tuple(F.col(c).cast("double") for c in BOX)
    low, high = t.inflate(box, F.lit(0.25), F.lit(t.LEFT | t.BOTTOM)), t.inflate(box, F.lit(-3.0), F.lit(t.RIGHT))
    return boxes(spark, d).select("id", *named((low[0], low[1], high[2], high[3]), ("llx", "lly", "urx", "ury")))


@query("range_ops", f"select id, least(x0, y0) as ulo, greatest(x1, y1) as uhi, greatest(x0 - 3, 0) as glo, x1 + 3 as ghi, greatest(x0, least(x1, cast(16 as bigint))) as clamped, (16 between x0 and x1) as has from ({fx.BOXES}) b")
def range_ops(spark, d):
    a, b = ("x0", "x1"), ("y0", "y1")
    return boxes(spark, d).select("id", *named(t.union_range(a, b), ("ulo", "uhi")), *named(t.grow_range(a, 3), ("glo", "ghi")), t.clamp(F.lit(16).cast("bigint"), a).alias("clamped"), F.lit(16).between(F.col("x0"), F.col("x1")).alias("has"))


@query("ranges_pyramid", f"select id, cast(6 - k as int) as lod, x0 >> k as x0, y0 >> k as y0, x1 >> k as x1, y1 >> k as y1 from ({fx.BOXES}) b, (values (0), (1), (2), (3), (4), (5), (6)) s(k)")
def ranges_pyramid(spark, d):
    """Each box with its ancestors up to the root level."""
    up = boxes(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("lod"))))
    return up.select("id", (F.col("lod") - F.col("k")).cast("int").alias("lod"), *named(t.box_parent(BOX, "k"), BOX))


@query("flag_filter", f"select lod, x, y, flags, (flags & 2) <> 0 as watertight, ((flags & 5) <> 0 and (flags & ~cast(3 as bigint)) <> 0) as allowed, flags >> 16 as reference, cast(case when flags & 1 = 0 then 0 when flags >> 16 > 0 then flags >> 16 else 1 end as bigint) as source from ({fx.A}) a where (flags & 1) <> 0 and (flags & 12) = 4")
def flag_filter(spark, d):
    f = tiles_a(spark, d).where(fl.real("flags") & fl.check("flags", 12, 4))
    return f.select(*TILE, "flags", fl.watertight("flags").alias("watertight"), fl.allow_deny("flags", 5, 3).alias("allowed"), fl.reference("flags").alias("reference"), fl.source_reference("flags").cast("bigint").alias("source"))


def _names_sql(table, column="flags") -> str:
    return "concat_ws(',', " + ", ".join(f"case when {column} & {bit} <> 0 then '{name}' end" for name, bit in table) + ")"


@query("tileflags_text", f"select pos, x, y, flags, case when flags = 32 then 'influenced' else {_names_sql(fl.TILE_NAMES)} end || case when pos > 0 then ',reference=' || pos else '' end as names from ({fx.C}) c")
def tileflags_text(spark, d):
    both = F.col("flags") + t.shl("pos", 16)
    return fx.sql(spark, d, fx.C).select("pos", "x", "y", "flags", fl.tile_text(both).alias("names"))


@query("metaflags_text", f"select lod, x, y, {_names_sql(fl.META_NAMES, '(flags + 16 * (x & 15) + 256 * (y & 1))')} as names, flags + 16 * (x & 15) + 256 * (y & 1) as parsed from ({fx.F}) f")
def metaflags_text(spark, d):
    m = F.col("flags") + F.col("x").bitwiseAND(15) * 16 + F.col("y").bitwiseAND(1) * 256
    out = fx.sql(spark, d, fx.F).select(*TILE, fl.meta_text(m).alias("names"))
    return out.withColumn("parsed", fl.parse_text(F.col("names"), fl.META_NAMES))
