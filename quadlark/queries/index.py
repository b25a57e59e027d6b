"""Tile-set algebra and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.tiles import shr
from ..operators import index as ix
from . import query

KEY = ["lod", "x", "y"]


def a(spark, d):
    return fx.sql(spark, d, fx.A)


def b(spark, d):
    return fx.sql(spark, d, fx.B)


_A, _B = f"({fx.A})", f"({fx.B})"
ONE = "cast(1 as bigint)"
UP = "(values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) u(k)"


def up_sql(source: str, ceiling: int = 0) -> str:
    """All tiles of a source with their ancestors, as distinct (lod, x, y)."""
    return f"(select distinct cast(lod - k as int) as lod, x >> k as x, y >> k as y from {source} s, {UP} where k <= lod - {ceiling})"


def round_sql(source: str) -> str:
    """2 x 2 closure of a source's tiles (all of them match): the first child's value."""
    return f"(select p.lod, p.bx * 2 + (i & 1) as x, p.by_ * 2 + (i >> 1) as y, p.flags from (select lod, x >> 1 as bx, y >> 1 as by_, arg_min(flags, (x & 1) + 2 * (y & 1)) as flags from {source} s group by 1, 2, 3) p, (values (0),(1),(2),(3)) c(i) where p.lod > 0 or i = 0)"


@query("ti_count", f"select lod, cast(count(*) as bigint) as tiles from {_A} a where flags <> 0 and lod between 6 and 7 group by lod")
def ti_count(spark, d):
    return ix.clamp(a(spark, d), 6, 7).groupBy("lod").agg(F.count("*").alias("tiles"))


_STAT = "min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, cast(count(*) as bigint) as tiles"


@query("ti_stat", f"select lod, {_STAT} from {_A} a where (flags & 3) = 3 group by lod")
def ti_stat(spark, d):
    return ix.statistics(a(spark, d), 3, 3)


@query("ti_ranges", f"select m.lo as lod_min, m.hi as lod_max, min(s.x >> (s.lod - m.lo)) as x0, min(s.y >> (s.lod - m.lo)) as y0, max(s.x >> (s.lod - m.lo)) as x1, max(s.y >> (s.lod - m.lo)) as y1 from {_A} s, (select min(lod) as lo, max(lod) as hi from {_A} q where flags & 2 <> 0) m where s.flags & 2 <> 0 group by 1, 2")
def ti_ranges(spark, d):
    return ix.tile_ranges(a(spark, d), 2)


@query("ti_valid_subtree", f"select * from {up_sql(_A)} v")
def ti_valid_subtree(spark, d):
    return ix.valid_subtrees(a(spark, d))


@query("ti_all_flags", f"select cast(bit_or(flags) as bigint) as flags from {_A} a")
def ti_all_flags(spark, d):
    return a(spark, d).agg(F.bit_or("flags").alias("flags"))


_META = f"(select distinct cast(t.lod as int) as lod, (((a.x >> least(3, a.lod)) << least(3, a.lod)) >> (a.lod - t.lod)) >> least(3, t.lod) as x, (((a.y >> least(3, a.lod)) << least(3, a.lod)) >> (a.lod - t.lod)) >> least(3, t.lod) as y from {_A} a, (values (0),(1),(2),(3),(4),(5),(6),(7),(8)) t(lod) where t.lod <= a.lod)"


@query("ti_shrinked_count", f"select cast(count(*) as bigint) as metatiles from {_META} m")
def ti_shrinked_count(spark, d):
    return ix.shrink_and_complete(a(spark, d), 3).agg(F.count("*").alias("metatiles"))


@query("meta_index", f"select lod, x, y, {ONE} as flags from {_META} m")
def meta_index(spark, d):
    return ix.shrink_and_complete(a(spark, d), 3)


_CASES = [("real", 1, 1), ("watertight", 3, 3), ("atlas", 4, 4), ("navtile", 8, 8), ("plain", 15, 1)]


@query("ti_info", " union all ".join(f"select '{n}' as kind, lod, {_STAT} from {_A} a where flags & {m} = {v} group by lod" for n, m, v in _CASES))
def ti_info(spark, d):
    """All standard statistics in one scan: each tile is exploded to the kinds that it matches."""
    kinds = F.array_compact(F.array(*(F.when(F.col("flags").bitwiseAND(m) == v, F.lit(n)) for n, m, v in _CASES)))
    return a(spark, d).withColumn("kind", F.explode(kinds)).groupBy("kind", "lod").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("tiles"))


@query("ti_ranges_srs", f"select g.srs, a.lod, {_STAT.replace('(x)', '(a.x)').replace('(y)', '(a.y)')} from {_A} a join ({fx.G}) g on g.mode = 'bisection' and a.x >> (a.lod - g.lod) = g.x and a.y >> (a.lod - g.lod) = g.y group by 1, 2")
def ti_ranges_srs(spark, d):
    roots = fx.sql(spark, d, fx.G).where("mode = 'bisection'").select("srs", F.col("lod").alias("rlod"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    tiles = a(spark, d).withColumn("rlod", F.lit(1))
    tiles = tiles.withColumn("rx", shr("x", F.col("lod") - 1)).withColumn("ry", shr("y", F.col("lod") - 1))
    return tiles.join(F.broadcast(roots), ["rlod", "rx", "ry"]).groupBy("srs", "lod").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("tiles"))


@query("ti_intersect", f"select a.* from {_A} a where a.flags & 2 <> 0 and exists (select 1 from {_B} b where b.flags & 2 <> 0 and b.lod = a.lod and b.x = a.x and b.y = a.y) union all select a.* from {_A} a where a.lod not in (select lod from {_B} b where b.flags & 2 <> 0)")
def ti_intersect(spark, d):
    return ix.intersect(a(spark, d), b(spark, d), 2)


@query("ti_notoverlaps", f"select coalesce(bool_or(na is null or nb is null or n is null), false) as not_overlaps from (select lod, count(*) as na from {_A} a group by 1) p full join (select lod, count(*) as nb from {_B} b group by 1) q using (lod) left join (select lod, count(*) as n from {_A} a join {_B} b using (lod, x, y) group by 1) r using (lod)")
def ti_notoverlaps(spark, d):
    return ix.not_overlaps(a(spark, d), b(spark, d))


@query("ti_combine", f"select * from (select lod, x, y, cast(case when lod in (select lod from {_B} c where lod between 5 and 6) then xor(coalesce(a.flags, 0), coalesce(b.flags, 0)) | 16 else coalesce(a.flags, 0) end as bigint) as flags from {_A} a full join (select * from {_B} c where lod between 5 and 6) b using (lod, x, y)) t where flags <> 0")
def ti_combine(spark, d):
    return ix.combine(a(spark, d), b(spark, d), lambda o, n: o.bitwiseXOR(n).bitwiseOR(16), (5, 6))


@query("ti_identical", f"select count(*) filter (where (coalesce(a.flags, 0) & 1) <> (coalesce(b.flags, 0) & 1)) = 0 as identical from {_A} a full join {_B} b using (lod, x, y)")
def ti_identical(spark, d):
    return ix.identical(a(spark, d), b(spark, d), lambda l, r: l.bitwiseAND(1) == r.bitwiseAND(1))


@query("ti_fill", f"select lod, x, y, cast(coalesce(a.flags, b.flags) as bigint) as flags from {_A} a full join (select * from {_B} q where flags & 2 <> 0 and lod between (select min(lod) from {_A} m) and (select max(lod) from {_A} m)) b using (lod, x, y)")
def ti_fill(spark, d):
    return ix.fill(a(spark, d), b(spark, d), 2)


@query("ti_unite", f"select distinct lod, x, y, {ONE} as flags from (select lod, x, y from {_A} a where flags & 2 <> 0 union all select lod, x, y from {_B} b where flags & 2 <> 0) u")
def ti_unite(spark, d):
    return ix.unite([a(spark, d), b(spark, d)], 2)


def _grid(lods: str) -> str:
    return f"(select l.lod, x.i as x, y.i as y from (values {lods}) l(lod), (select unnest(range(256)) as i) x, (select unnest(range(256)) as i) y where x.i < (1 << l.lod) and y.i < (1 << l.lod))"


@query("ti_invert", f"select cast(g.lod as int) as lod, cast(g.x as bigint) as x, cast(g.y as bigint) as y, {ONE} as flags from {_grid('(4),(5),(6),(7),(8)')} g where not exists (select 1 from {_A} a where a.flags & 2 <> 0 and a.lod = g.lod and a.x = g.x and a.y = g.y)")
def ti_invert(spark, d):
    return ix.expand(ix.invert(a(spark, d), (4, 8), 2))


@query("ti_simplify", f"select lod, x, y, {ONE} as flags from {_A} a where flags & 3 = 1")
def ti_simplify(spark, d):
    return ix.simplify(a(spark, d), 3, 1)


@query("ti_unset", f"select lod, x, y, flags & ~cast(5 as bigint) as flags from {_A} a where flags & ~cast(5 as bigint) <> 0")
def ti_unset(spark, d):
    return ix.unset(a(spark, d), 5)


_BOXES6 = f"(select distinct cast(6 as int) as lod, x, y from (select x0, y0, unnest(range(x0, x1 + 1)) as x, y1 from ({fx.BOXES}) q) r, lateral (select unnest(range(y0, y1 + 1)) as y) s)"


@query("ti_setmask", f"select * from (select lod, x, y, (coalesce(a.flags, 0) & ~cast(case when w.one is null then 0 else 6 end as bigint)) | cast(case when w.one is null then 0 else 4 end as bigint) as flags from {_A} a full join (select *, 1 as one from {_BOXES6} b) w using (lod, x, y)) t where flags <> 0")
def ti_setmask(spark, d):
    """Rectangles written under a mask: every order's box."""
    writes = ix.box_tiles(fx.sql(spark, d, fx.BOXES).drop("id")).distinct()
    return ix.set_masked(a(spark, d), writes.select(*KEY, F.lit(6).cast("bigint").alias("mask"), F.lit(4).cast("bigint").alias("value")))


@query("ti_clamp", f"select * from {_A} a where lod between 3 and 6")
def ti_clamp(spark, d):
    return ix.clamp(a(spark, d), 3, 6)


@query("ti_complete", f"select lod, x, y, cast(coalesce(a.flags, 1) as bigint) as flags from {up_sql(f'(select * from {_A} z where flags & 2 <> 0)', 2)} u full join {_A} a using (lod, x, y)")
def ti_complete(spark, d):
    return ix.complete(a(spark, d), 2, 2)


_DOWN = f"(select cast(s.lod + k as int) as lod, (s.x << k) + i as x, (s.y << k) + j as y from (select * from {_A} z where flags & 2 <> 0) s, (values (1), (2), (3)) u(k), (select unnest(range(8)) as i) a1, (select unnest(range(8)) as j) a2 where i < (1 << k) and j < (1 << k) and s.lod + k <= 8)"


@query("ti_complete_down", f"select lod, x, y, cast(max(f) as bigint) as flags from (select lod, x, y, flags as f from {_A} a union all select p.lod, p.x, p.y, 1 as f from {_DOWN} p where not exists (select 1 from {_A} a where a.lod = p.lod and a.x = p.x and a.y = p.y)) t group by 1, 2, 3")
def ti_complete_down(spark, d):
    return ix.expand(ix.complete_down(a(spark, d), 8, 2))


_SEED = f"(select lod, x, y, {ONE} as flags from {_A} z where flags & 2 <> 0 and lod between 4 and 8)"
_GROW = f"(select distinct lod, x, y from {round_sql(f'(select u.*, {ONE} as flags from {up_sql(_SEED, 4)} u)')} g)"


@query("ti_grow", f"select lod, x, y, {ONE} as flags from {_GROW} g")
def ti_grow(spark, d):
    return ix.grow_up(a(spark, d), 4, 2)


@query("ti_soi", f"select lod, x, y, {ONE} as flags from (select lod, x, y from {_GROW} g union select lod, x, y from {_DOWN} d) t")
def ti_soi(spark, d):
    return ix.expand(ix.sphere_of_influence(a(spark, d), 4, 8, 2))


@query("ti_round", f"select lod, x, y, cast(flags as bigint) as flags from {round_sql(f'(select * from {_A} z where flags & 2 <> 0)')} r")
def ti_round(spark, d):
    return ix.round_tiles(a(spark, d), 2)


_ALL4 = f"(select b.lod, b.bx, b.by_, i, coalesce(a.flags, 0) as flags from (select distinct lod, x >> 1 as bx, y >> 1 as by_ from {_A} z) b cross join (values (0),(1),(2),(3)) c(i) left join {_A} a on a.lod = b.lod and a.x = b.bx * 2 + (i & 1) and a.y = b.by_ * 2 + (i >> 1))"


@query("ti_round_conditional", f"select lod, bx * 2 + (i & 1) as x, by_ * 2 + (i >> 1) as y, cast(case when v is not null then v else flags end as bigint) as flags from (select *, arg_min(flags, i) filter (where flags & 2 <> 0) over (partition by lod, bx, by_) as v from {_ALL4} q) t where case when v is not null then v else flags end <> 0")
def ti_round_conditional(spark, d):
    return ix.round_up(a(spark, d), 2)


@query("ti_distribute", f"select lod, x, y, cast(bit_or(f) as bigint) as flags from (select lod, x, y, flags as f from {_A} a union all select cast(s.lod + k as int), (s.x << k) + i, (s.y << k) + j, s.flags & 2 from (select * from {_A} z where flags & 2 <> 0) s, (values (1), (2), (3)) u(k), (select unnest(range(8)) as i) a1, (select unnest(range(8)) as j) a2 where i < (1 << k) and j < (1 << k) and s.lod + k <= 8) t group by 1, 2, 3")
def ti_distribute(spark, d):
    return ix.expand_or(ix.distribute(a(spark, d), 2, 8))


@query("qt_subtree", f"select cast(lod - 2 as int) as lod, x - (cast(1 as bigint) << (lod - 2)) as x, y - (cast(2 as bigint) << (lod - 2)) as y, flags from {_A} a where x >> (lod - 2) = 1 and y >> (lod - 2) = 2")
def qt_subtree(spark, d):
    return ix.subtree(a(spark, d), 2, 1, 2)


@query("ti_traverse", f"select lod, x, y, cast(bit_or(flags) as bigint) as flags from (select cast(b.lod + 2 as int) as lod, b.x * 4 + i as x, b.y * 4 + j as y, flags from (select * from {_B} q where lod <= 6) b, (select unnest(range(4)) as i) a1, (select unnest(range(4)) as j) a2) t group by 1, 2, 3")
def ti_traverse(spark, d):
    """Quads two levels above their tiles, rasterised."""
    q = b(spark, d).where("lod <= 6").select((F.col("lod") + 2).cast("int").alias("lod"), F.col("lod").alias("qlod"), F.col("x").alias("qx"), F.col("y").alias("qy"), "flags")
    return ix.expand(q)


@query("qt_force", f"select lod, x, y, cast(9 as bigint) as flags from {_A} a where flags <> 0")
def qt_force(spark, d):
    return ix.translate(a(spark, d), lambda f: F.when(f != 0, F.lit(9).cast("bigint")).otherwise(f))


@query("ti_check_file", f"select lod, x, y, flags & 1 <> 0 as mesh, flags & 4 <> 0 as atlas, flags & 8 <> 0 as navtile, exists (select 1 from {_META} m where m.lod = a.lod and m.x = a.x >> least(3, a.lod) and m.y = a.y >> least(3, a.lod)) as meta from {_B} a")
def ti_check_file(spark, d):
    """Which files each of the second set's tiles has, its metatile looked up in the first set's meta index."""
    meta = ix.shrink_and_complete(a(spark, d), 3).select("lod", F.col("x").alias("mx"), F.col("y").alias("my"), F.lit(True).alias("m"))
    by = F.least(F.lit(3), F.col("lod"))
    tiles = b(spark, d).withColumn("mx", shr("x", by)).withColumn("my", shr("y", by))
    bit = lambda v: F.col("flags").bitwiseAND(v) != 0
    return tiles.join(meta, ["lod", "mx", "my"], "left").select(*KEY, bit(1).alias("mesh"), bit(4).alias("atlas"), bit(8).alias("navtile"), F.coalesce("m", F.lit(False)).alias("meta"))


_COND = f"(select lod, bx * 2 + (i & 1) as x, by_ * 2 + (i >> 1) as y, cast(case when v is not null then v else flags end as bigint) as flags from (select *, arg_min(flags, i) filter (where flags & 3 = 1) over (partition by lod, bx, by_) as v from {_ALL4} q) t where case when v is not null then v else flags end <> 0)"


@query("derive_tree", f"select lod, x, y, cast(coalesce(c.flags, 1) as bigint) as flags from {up_sql(_COND)} u full join {_COND} c using (lod, x, y)")
def derive_tree(spark, d):
    """Blocks with a mesh that is not watertight are closed, then all ancestors are added."""
    tiles = a(spark, d).withColumn("flags", F.when(F.col("flags").bitwiseAND(3) == 1, F.col("flags").bitwiseOR(F.lit(1 << 20).cast("bigint"))).otherwise(F.col("flags")))
    closed = ix.round_up(tiles, 1 << 20).withColumn("flags", F.col("flags").bitwiseAND(F.lit((1 << 20) - 1).cast("bigint")))
    return ix.complete(closed)


@query("index_dump", f"select lod, y, string_agg(case when flags & 2 <> 0 then '#' else '+' end || x, ' ' order by x) as cells from {_A} a where lod = 5 group by lod, y")
def index_dump(spark, d):
    """A level's raster as text, a line for each row with set cells."""
    cell = F.concat(F.when(F.col("flags").bitwiseAND(2) != 0, "#").otherwise("+"), F.col("x").cast("string"))
    rows = a(spark, d).where("lod = 5").groupBy("lod", "y").agg(F.array_sort(F.collect_list(F.struct("x", cell.alias("c")))).alias("cells"))
    return rows.select("lod", "y", F.array_join(F.transform("cells", lambda c: c["c"]), " ").alias("cells"))
