"""Reference frames, coordinates and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import coords as cd
from ..operators import space as sp
from . import query
from .index import _A, _B, KEY, UP, a, b

_G = f"({fx.G})"
_H = f"({fx.H})"
WORLD = (-180.0, -90.0, 180.0, 90.0)
_ROOT = f"(select t.*, g.lod as root_lod, g.x as root_x, g.y as root_y, g.srs, g.llx, g.lly, g.urx, g.ury, g.c_llx, g.c_lly, g.c_urx, g.c_ury from {_A} t join {_G} g on g.mode = 'bisection' and t.x >> (t.lod - 1) = g.x and t.y >> (t.lod - 1) = g.y)"
_N = "(cast(1 as bigint) << (lod - root_lod))"
_EXT = f"(select r.*, llx + (x - (root_x << (lod - root_lod))) * ((urx - llx) / {_N}) as e_llx, ury - (y - (root_y << (lod - root_lod)) + 1) * ((ury - lly) / {_N}) as e_lly, llx + (x - (root_x << (lod - root_lod)) + 1) * ((urx - llx) / {_N}) as e_urx, ury - (y - (root_y << (lod - root_lod))) * ((ury - lly) / {_N}) as e_ury from {_ROOT} r)"
_HITS = " + ".join(f"case when e_llx + (e_urx - e_llx) * {i / 2} between c_llx and c_urx and e_lly + (e_ury - e_lly) * {j / 2} between c_lly and c_ury then 1 else 0 end" for i in range(3) for j in range(3))
_VALID = f"(select e.*, case when n = 9 then true when n = 0 then false end as valid from (select *, {_HITS} as n from {_EXT} q) e)"


def frame(spark, d):
    return fx.sql(spark, d, fx.G)


def rooted(spark, d):
    """Tiles with their real subtree; those above the manual root alone have no bisection root and drop out."""
    return sp.subtree_roots(a(spark, d), frame(spark, d)).where("mode = 'bisection'")


@query("subtree_root", f"select lod, x, y, srs, root_lod, root_x, root_y from {_ROOT} r")
def subtree_root(spark, d):
    return rooted(spark, d).select(*KEY, "srs", "root_lod", "root_x", "root_y")


@query("node_extents", f"select lod, x, y, round(e_llx, 6) as llx, round(e_lly, 6) as lly, round(e_urx, 6) as urx, round(e_ury, 6) as ury from {_EXT} e")
def node_extents(spark, d):
    e = sp.extents(rooted(spark, d))
    return e.select(*KEY, *(F.round(f"e_{c}", 6).alias(c) for c in sp.BOX))


@query("node_valid", f"select lod, x, y, valid from {_VALID} v")
def node_valid(spark, d):
    return sp.validity(sp.extents(rooted(spark, d))).select(*KEY, "valid")


@query("node_inside", f"select p.id, v.lod, v.x, v.y from {_H} p join (select * from {_VALID} w where lod = 5) v on p.px between e_llx and e_urx and p.py between e_lly and e_ury and coalesce(v.valid, p.px between c_llx and c_urx and p.py between c_lly and c_ury)")
def node_inside(spark, d):
    """Points with the level-5 nodes that hold them: an equi-join on the point's tile and its neighbours at the edges, then the exact test."""
    nodes = sp.validity(sp.extents(rooted(spark, d).where("lod = 5")))
    pts = sp.point_tiles(fx.sql(spark, d, fx.H), 6, (-180.0, -270.0, 180.0, 90.0)).withColumnRenamed("lod", "plod")
    return _near(pts, nodes)


def _near(pts, nodes):
    """Tiles of roots at level 1 are 180 / 16 wide and high at level 5: points meet their cell and the one before it, for shared edges."""
    size = 180.0 / 16
    cells = pts.drop("x", "y", "plod")
    cells = cells.withColumn("cx", F.explode(F.array_distinct(F.array(F.floor((F.col("px") + 180) / size), F.ceil((F.col("px") + 180) / size) - 1))))
    cells = cells.withColumn("cy", F.explode(F.array_distinct(F.array(F.floor((90 - F.col("py")) / size), F.ceil((90 - F.col("py")) / size) - 1))))
    keyed = nodes.withColumn("cx", F.round((F.col("e_llx") + 180) / size).cast("bigint")).withColumn("cy", F.round((90 - F.col("e_ury")) / size).cast("bigint"))
    return cells.join(keyed, ["cx", "cy"]).where(sp.point_inside(F.col("px"), F.col("py"))).select("id", *KEY)


@query("rf_leaves", f"select g.lod, g.x, g.y, g.mode in ('manual', 'bisection') as real, g.mode in ('manual', 'bisection') and not exists (select 1 from {_G} c where c.lod = g.lod + 1 and c.x >> 1 = g.x and c.y >> 1 = g.y and c.mode in ('manual', 'bisection')) as leaf from {_G} g")
def rf_leaves(spark, d):
    g = frame(spark, d)
    real = F.col("mode").isin("manual", "bisection")
    kids = g.where(real & (F.col("lod") > 0)).select((F.col("lod") - 1).alias("lod"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), F.lit(True).alias("kid")).distinct()
    return g.join(F.broadcast(kids), KEY, "left").select(*KEY, real.alias("real"), (real & F.col("kid").isNull()).alias("leaf"))


_LOOSE = f"(select lod, x, y, srs, mode from {_G} g where lod > 0 and srs <> 'b' union all select cast(3 as int), cast(5 as bigint), cast(2 as bigint), 'z', 'bisection')"
_PARTS = f"(select lod, x, y, c_llx, c_lly, c_urx, c_ury from {_G} g where c_llx is not null)"
_LISTED = f"(select * from {_LOOSE} l union all select lod, x, y, '' as srs, 'invalid' as mode from {_PARTS} p where not exists (select 1 from {_LOOSE} l where l.lod = p.lod and l.x = p.x and l.y = p.y))"
_UPS = f"(select distinct cast(lod - k as int) as lod, x >> k as x, y >> k as y from {_LISTED} l, {UP} where k <= lod)"


@query("rf_sanitize", f"select u.lod, u.x, u.y, coalesce(l.srs, '') as srs, coalesce(l.mode, 'barren') as mode, coalesce(c.kids, 0) as kids, coalesce(l.mode, 'barren') = 'bisection' and c.kids is not null as broken, c_llx, c_lly, c_urx, c_ury from {_UPS} u left join {_LISTED} l using (lod, x, y) left join (select cast(lod - 1 as int) as lod, x >> 1 as x, y >> 1 as y, cast(bit_or(cast(1 as bigint) << cast((x & 1) + 2 * (y & 1) as int)) as bigint) as kids from {_UPS} q where lod > 0 group by 1, 2, 3) c using (lod, x, y) left join {_PARTS} p using (lod, x, y)")
def rf_sanitize(spark, d):
    """A frame without its root, without one manual child and with a far node: ancestors come in as barren nodes, the child as an invalid one."""
    parts = fx.sql(spark, d, f"select * from {_PARTS} p")
    return sp.sanitized_frame(fx.sql(spark, d, f"select * from {_LOOSE} l"), parts)


@query("deepest_navtile", f"select id, cast(max(lod) as int) as lod, arg_max(x, lod) as x, arg_max(y, lod) as y, arg_max(flags, lod) as flags from (select p.id, t.* from (select id, cast(least(floor((px + 180) / 360.0e0 * 256), 255) as bigint) as x8, cast(least(floor((90 - py) / 180.0e0 * 256), 255) as bigint) as y8 from {_H} h where px between -180 and 180 and py between -90 and 90) p, {UP} join {_A} t on t.lod = 8 - k and t.x = p.x8 >> k and t.y = p.y8 >> k) q group by id")
def deepest_navtile(spark, d):
    return sp.deepest(sp.point_tiles(fx.sql(spark, d, fx.H), 8, WORLD), a(spark, d))


_W = f"(cast(1 as bigint) << (lod - 1))"


_MAP = (
    f"select lod, x, y, cast(lod - 1 as int) as to_lod, tx.i as to_x, ty.j as to_y from (select lod, x, y, cast(greatest(0, least({_W} - 1, floor((e_llx + 45 + 180) / (360.0e0 / {_W})))) as bigint) as x0, cast(greatest(0, least({_W} - 1, ceil((e_urx + 45 + 180) / (360.0e0 / {_W})) - 1)) as bigint) as x1, cast(greatest(0, least({_W} - 1, floor((90 - e_ury) / (180.0e0 / {_W})))) as bigint) as y0, cast(greatest(0, least({_W} - 1, ceil((90 - e_lly) / (180.0e0 / {_W})) - 1)) as bigint) as y1 from {_EXT} e) m, lateral (select unnest(range(x0, greatest(x0, x1) + 1)) as i) tx, lateral (select unnest(range(y0, greatest(y0, y1) + 1)) as j) ty"
)


@query("tile_mapping", _MAP)
def tile_mapping(spark, d):
    """Source tiles, moved by 45 degrees, to the target tiles that they cover one level up."""
    e = sp.extents(rooted(spark, d))
    move = cd.affine(bx=45.0)
    for c in ("llx", "urx"):
        e = e.withColumn(f"e_{c}", move(F.col(f"e_{c}"), F.lit(0.0))[0])
    found = sp.tile_mapping(e, (F.col("lod") - 1).cast("int"), WORLD)
    return found.select(*KEY, "to_lod", "to_x", "to_y")


@query("reproject", f"select to_lod, to_x, to_y, cast(count(*) as bigint) as sources, cast(bit_or(a.flags) as bigint) as flags from ({_MAP}) m join {_A} a using (lod, x, y) group by 1, 2, 3")
def reproject(spark, d):
    """Target tiles with the merged flags and the number of the source tiles that the mapping gives them."""
    m = tile_mapping(spark, d).join(a(spark, d), KEY)
    return m.groupBy("to_lod", "to_x", "to_y").agg(F.count("*").alias("sources"), F.bit_or("flags").alias("flags"))


_REAL = f"(select * from {_G} g where mode in ('manual', 'bisection') and lod <= 6 and not exists (select 1 from {_G} c where c.mode in ('manual', 'bisection') and c.lod > g.lod and c.lod <= 6 and c.x = (g.x << (6 - g.lod)) >> (6 - c.lod) and c.y = (g.y << (6 - g.lod)) >> (6 - c.lod)))"
_SPAN = f"(select g.lod, g.x, g.y, llx, ury, (urx - llx) / (1 << (6 - g.lod)) as w, (ury - lly) / (1 << (6 - g.lod)) as h, min(px) as x0, min(py) as y0, max(px) as x1, max(py) as y1 from {_H} p join {_REAL} g on px between llx and urx and py between lly and ury and (c_llx is null or px between c_llx and c_urx and py between c_lly and c_ury) group by all)"
_RANGE = f"(select lod as node_lod, x as node_x, y as node_y, (x << (6 - lod)) + cast(floor((x0 - llx) / w) as bigint) as x0, (y << (6 - lod)) + cast(floor((ury - y1) / h) as bigint) as y0, (x << (6 - lod)) + cast(ceil((x1 - llx) / w) as bigint) as x1, (y << (6 - lod)) + cast(ceil((ury - y0) / h) as bigint) as y1 from {_SPAN} s)"


@query("find_subtrees", f"select * from {_RANGE} r union all select null, null, null, min(x0), min(y0), max(x1), max(y1) from {_RANGE} q")
def find_subtrees(spark, d):
    """Samples of a dataset against the frame's few nodes: the tiles of level 6 under each, and overall."""
    return sp.found_subtrees(frame(spark, d), fx.sql(spark, d, fx.H), 6)

@query("srs_convert", f"select id, px + 180 as bx, py as by_, round(radians(px) * 6378137, 3) as mx, round(ln(tan(pi() / 4 + radians(py) / 2)) * 6378137, 3) as my, round(px, 6) as back from {_H} h where py between -85 and 85")
def srs_convert(spark, d):
    p = fx.sql(spark, d, fx.H).where("py between -85 and 85")
    x, y = F.col("px"), F.col("py")
    bx, by = cd.convert("a", "b", x, y)
    mx, my = cd.convert("r", "m", x, y)
    return p.select("id", bx.alias("bx"), by.alias("by_"), F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"), F.round(cd.convert("m", "r", mx, my)[0], 6).alias("back"))


@query("norm_extents", f"select id, (px + 180) / 360.0e0 as nx0, (py + 90) / 180.0e0 as ny0, (px + 11 + 180) / 360.0e0 as nx1, round(-180 + (px + 180) / 360.0e0 * 360, 6) as back from {_H} h")
def norm_extents(spark, d):
    outer = tuple(map(F.lit, WORLD))
    box = (F.col("px"), F.col("py"), F.col("px") + 11, F.col("py") + 7)
    n = cd.normalized(box, outer)
    return fx.sql(spark, d, fx.H).select("id", n[0].alias("nx0"), n[1].alias("ny0"), n[2].alias("nx1"), F.round(cd.denormalized(n, outer)[0], 6).alias("back"))


@query("geo2mask", f"select id, round((px + 180) / 360.0e0 * 256 - 0.5, 6) as mx, round((90 - py) / 180.0e0 * 256 - 0.5, 6) as my, round(px, 6) as back from {_H} h")
def geo2mask(spark, d):
    outer = tuple(map(F.lit, WORLD))
    mx, my = cd.geo_to_mask("px", "py", outer)
    return fx.sql(spark, d, fx.H).select("id", F.round(mx, 6).alias("mx"), F.round(my, 6).alias("my"), F.round(cd.mask_to_geo(mx, my, outer)[0], 6).alias("back"))


@query("generate_etc", f"select id, round((px + 180) / 360.0e0, 9) as u, round((py + 90) / 180.0e0, 9) as v from {_H} h")
def generate_etc(spark, d):
    u, v = cd.external_texture("px", "py", tuple(map(F.lit, WORLD)))
    return fx.sql(spark, d, fx.H).select("id", F.round(u, 9).alias("u"), F.round(v, 9).alias("v"))


_BLOCKS = f"(select lod, x >> 2 as x, y >> 2 as y from {_A} p union select lod, x >> 2, y >> 2 from {_B} q)"
_PIXELS = f"(select lod, x >> 2 as x, y >> 2 as y, x & 3 as px, y & 3 as py from {_A} p)"
_PART = f"(select n.*, px, py from {_BLOCKS} n, (select unnest(range(4)) as px) i, (select unnest(range(4)) as py) j where (x + y) & 1 = 1 and px + py <= 3)"
_COVERED = f"(select lod, x, y, count(*) as covered from {_PIXELS} m group by all)"
_LEFT = f"(select v.lod, v.x, v.y, count(*) as total, count(m.covered) as hits from {_PART} v left join (select *, 1 as covered from {_PIXELS} k) m using (lod, x, y, px, py) group by all)"


@query("check_mask", f"select n.lod, n.x, n.y, case when covered is null then 'none' when (n.x + n.y) & 1 = 0 then case when covered = 16 then 'whole' else 'some' end when hits = total then 'whole' when hits = 0 then 'none' else 'some' end as cover from {_BLOCKS} n left join {_COVERED} c using (lod, x, y) left join {_LEFT} h using (lod, x, y)")
def check_mask(spark, d):
    """Blocks of sixteen cells as nodes, every other one valid in its upper left half only, against the cells that a set has."""
    block = [F.col("lod"), F.shiftright("x", 2).alias("x"), F.shiftright("y", 2).alias("y")]
    partial = (F.col("x") + F.col("y")).bitwiseAND(1) == 1
    n = a(spark, d).select(*block).unionByName(b(spark, d).select(*block)).distinct().select(*KEY, partial.alias("partial"), F.lit(4).alias("size"))
    i = F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))
    valid = n.where("partial").select(*KEY, F.explode(i).alias("px")).select("*", F.explode(i).alias("py")).where("px + py <= 3")
    masks = a(spark, d).select(*block, F.col("x").bitwiseAND(3).alias("px"), F.col("y").bitwiseAND(3).alias("py"))
    return sp.checked_masks(n, valid, masks)
