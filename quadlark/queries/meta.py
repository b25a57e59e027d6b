"""Metadata trees and dataset verbs over tiles."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .. import fixtures as fx
from ..functions import flags as fl
from ..functions.tiles import col, shl, shr
from ..operators import index as ix, meta as mt
from . import query
from .index import _A, _B, _META, KEY, a, b

_F = f"({fx.F})"
#: Metanodes with child flags and a navtile bit made up from the coordinates.
_N = f"(select lod, x, y, cast((flags & 5) + 2 * ((flags >> 3) & 1) + 16 * (x & 15) + 256 * (y & 1) as bigint) as flags, texel, credit, zmin, zmax from {_F} f)"


def nodes(spark, d):
    return fx.sql(spark, d, fx.F)


def full_nodes(spark, d):
    return fx.sql(spark, d, f"select * from {_N} n")


@query("meta_children", f"select lod, x, y, cast(lod + 1 as int) as clod, x * 2 + (i & 1) as cx, y * 2 + (i >> 1) as cy, cast(i as int) as child from {_N} n, (values (0),(1),(2),(3)) c(i) where flags & (16 << i) <> 0")
def meta_children(spark, d):
    return mt.child_nodes(full_nodes(spark, d))


@query("metatile_dump", f"select n.lod, n.x, n.y, n.flags, g.srs from {_N} n join ({fx.G}) g on g.lod = 1 and n.x >> (n.lod - 1) = g.x and n.y >> (n.lod - 1) = g.y where n.flags <> 0 and n.flags & 5 <> 0 and g.srs = 'a'")
def metatile_dump(spark, d):
    srs = F.broadcast(fx.sql(spark, d, fx.G).where("lod = 1 and srs = 'a'").select(F.col("x").alias("rx"), F.col("y").alias("ry"), "srs"))
    n = full_nodes(spark, d).where("flags <> 0").where(fl.has("flags", 5))
    n = n.withColumn("rx", shr("x", F.col("lod") - 1)).withColumn("ry", shr("y", F.col("lod") - 1))
    return n.join(srs, ["rx", "ry"]).select(*KEY, "flags", "srs")


@query("clone_lodrange", f"select lod, x, y, cast(flags & 7 as bigint) as flags, texel * 2 as texel from {_F} f where lod between 6 and 7")
def clone_lodrange(spark, d):
    """A copy of some levels, each metanode mapped on the way."""
    return ix.clamp(nodes(spark, d), 6, 7).select(*KEY, F.col("flags").bitwiseAND(7).alias("flags"), (F.col("texel") * 2).alias("texel"))


@query("texel_size", f"select lod, coalesce(avg(case when flags & 4 <> 0 then texel end), 0.0e0) as texel from {_F} f group by lod")
def texel_size(spark, d):
    return mt.texel_average(nodes(spark, d))


def _texel_sql() -> str:
    parts = [f"own as (select lod, x, y, texel from {_F} f where flags & 2 <> 0)", "l8 as (select x, y, texel from own where lod = 8)"]
    for lod in range(7, -1, -1):
        parts.append(f"l{lod} as (select x, y, coalesce(o.texel, m.up) as texel from (select x >> 1 as x, y >> 1 as y, avg(texel) * 2 as up from l{lod + 1} group by 1, 2) m full join (select x, y, texel from own where lod = {lod}) o using (x, y))")
    return "with " + ", ".join(parts) + " " + " union all ".join(f"select cast({i} as int) as lod, x, y, round(texel, 4) as texel from l{i}" for i in range(9))


@query("texel_propagate", _texel_sql())
def texel_propagate(spark, d):
    return mt.propagate_texel(nodes(spark, d), 8, real=2).withColumn("texel", F.round("texel", 4))


@query("meta_tree_build", f"select cast(lod - k as int) as lod, x >> k as x, y >> k as y, cast(bit_or(case when k = 0 then 0 else 16 << cast(((x >> greatest(k - 1, 0)) & 1) + 2 * ((y >> greatest(k - 1, 0)) & 1) as int) end) as bigint) as child_flags, min(zmin) as zmin, max(zmax) as zmax from {_F} f, (values (0),(1),(2),(3),(4),(5),(6),(7),(8)) u(k) where k <= lod group by 1, 2, 3")
def meta_tree_build(spark, d):
    return mt.tree(nodes(spark, d))


_NB = f"(select lod, x, y, cast((flags & 3) + 16 * (y & 15) as bigint) as flags, cast(flags as double) as texel, cast(y as double) as zmin, cast(x + y + 1 as double) as zmax from {_B} q)"
_NA = f"(select lod, x, y, cast(((flags >> 1) & 1) + 16 * (x & 15) as bigint) as flags, texel, zmin, zmax from {_F} q)"


@query("meta_merge", f"select lod, x, y, cast(coalesce(min(case when flags & 1 <> 0 then s end), 0) as int) as reference, cast((coalesce(arg_min(flags, s) filter (where flags & 1 <> 0), 0) & ~256) | bit_or(flags & 240) as bigint) as flags, arg_min(texel, s) filter (where flags & 1 <> 0) as texel, min(zmin) as zmin, max(zmax) as zmax from (select *, 1 as s from {_NA} a union all select *, 2 as s from {_NB} b) t group by 1, 2, 3")
def meta_merge(spark, d):
    return mt.merge_by_reference([fx.sql(spark, d, f"select * from {_NA} a"), fx.sql(spark, d, f"select * from {_NB} b")])


@query("check_meta_tree", f"select * from (select lod, x, y, (coalesce(t.flags, 0) & 1 <> 0) <> (coalesce(n.flags, 0) & 1 <> 0) as mesh, (coalesce(t.flags, 0) & 8 <> 0) <> (coalesce(n.flags, 0) & 2 <> 0) as navtile from {_A} t full join {_NB} n using (lod, x, y)) q where mesh or navtile")
def check_meta_tree(spark, d):
    return mt.inconsistencies(a(spark, d), fx.sql(spark, d, f"select * from {_NB} n"))


@query("distinct_credits", f"select distinct credit from {_F} f")
def distinct_credits(spark, d):
    return nodes(spark, d).select("credit").distinct()


@query("credit_tile", f"select lod, x >> 3 as cx, y >> 3 as cy, string_agg(distinct cast(credit as varchar), ',' order by cast(credit as varchar)) as credits from {_F} f group by 1, 2, 3")
def credit_tile(spark, d):
    return mt.credit_tiles(nodes(spark, d), 3).select("lod", "cx", "cy", F.array_join("credits", ",").alias("credits"))


@query("credits_dict", f"select r.r_name as id, r.r_regionkey + 1 as numeric_id, cast(count(*) as bigint) as nodes from {_F} f join region r on r.r_regionkey = f.credit where r.r_name like 'A%' group by 1, 2")
def credits_dict(spark, d):
    """Nodes for each credit of a dictionary with text and numeric ids; ids that it does not know are skipped."""
    known = spark.read.parquet(f"{d}/region.parquet").where("r_name like 'A%'").select(F.col("r_regionkey").alias("credit"), F.col("r_name").alias("id"), (F.col("r_regionkey") + 1).alias("numeric_id"))
    counts = nodes(spark, d).groupBy("credit").agg(F.count("*").alias("nodes"))
    return counts.join(known, "credit").select("id", "numeric_id", "nodes")


@query("meta2d", f"select pos, x, y, cast(case when flags & 1 <> 0 then 128 else 0 end + case when flags & 2 <> 0 then 64 else 0 end + case when flags & 33 = 33 then 16 else 0 end as int) as meta from ({fx.C}) c")
def meta2d(spark, d):
    """One byte for each tile: geometry 0x80, not masked 0x40, alien 0x10."""
    bit = lambda c, v: F.when(c, v).otherwise(0)
    return fx.sql(spark, d, fx.C).select("pos", "x", "y", (bit(fl.real("flags"), 0x80) + bit(fl.watertight("flags"), 0x40) + bit(fl.alien("flags"), 0x10)).cast("int").alias("meta"))


@query("texel_saturate", f"select lod, x, y, least(texel * 20000, 65000.0e0) as texel, cast(least(x * 3, 255) as bigint) as textures from {_F} f")
def texel_saturate(spark, d):
    return nodes(spark, d).select(*KEY, F.least(F.col("texel") * 20000, F.lit(65000.0)).alias("texel"), F.least(F.col("x") * 3, F.lit(255).cast("bigint")).alias("textures"))


_TILES = f"(select lod, x, y, case when flags & 4 <> 0 then cast(x % 4 as int) end as textures, y % 2 = 0 as external from {_F} f)"
_SUBS = f"(select lod, x, y, i, cast((x + i) % 3 as int) as tc, cast((y + i) % 4 as int) as etc, case when (x + y + i) % 2 = 0 then 'internal' else 'external' end as mode from {_F} f, (values (0), (1), (2)) s(i) where (x + y) % 7 <> 0 and i <= (x + 2 * y) % 3)"
_WHY = "case when i < coalesce(textures, 0) then case when tc = 0 then 'internal texture without coordinates' when mode = 'external' and etc = 0 then 'external mode without external coordinates' end else case when etc = 0 then 'no external coordinates' when mode = 'internal' then 'internal mode without texture' when tc > 0 then 'internal coordinates without texture' when not external then 'external texture not allowed' end end"


@query("tile_sanity", f"select * from (select t.lod, t.x, t.y, case when n is null and textures is not null then 'atlas without mesh' when n > 0 and textures = 0 then 'empty atlas' when n > 0 and textures > n then 'more textures than submeshes' else why end as problem from {_TILES} t left join (select s.lod, s.x, s.y, count(*) as n, arg_min(why, i) filter (why is not null) as why from (select u.*, {_WHY} as why from {_SUBS} u join {_TILES} v using (lod, x, y)) s group by all) g using (lod, x, y)) z where problem is not null")
def tile_sanity(spark, d):
    """Tiles that may not be written, and why."""
    return mt.sanity(fx.sql(spark, d, f"select * from {_TILES} t"), fx.sql(spark, d, f"select * from {_SUBS} s"))

@query("mark_influenced", f"select lod, x, y, cast(case when b.flags is not null and coalesce(a.flags, 0) & 1 = 0 then 32 else a.flags end as bigint) as flags from {_A} a full join (select * from {_B} q where lod = 7) b using (lod, x, y)")
def mark_influenced(spark, d):
    """Keyed updates: tiles of another set without a mesh here become influenced."""
    other = b(spark, d).where("lod = 7").select(*KEY, F.lit(True).alias("there"))
    mark = F.col("there").isNotNull() & (F.coalesce("flags", F.lit(0).cast("bigint")).bitwiseAND(1) == 0)
    return a(spark, d).join(other, KEY, "full").select(*KEY, F.when(mark, F.lit(fl.ALIEN).cast("bigint")).otherwise(F.col("flags")).alias("flags"))


@query("tile_lookup", f"select b.lod, b.x, b.y, f.flags, f.texel, f.flags is not null as found from (select lod, x, y from {_B} q where lod >= 5) b left join {_F} f using (lod, x, y)")
def tile_lookup(spark, d):
    """Keyed reads of many tiles; found tells which there are."""
    n = nodes(spark, d).select(*KEY, "flags", "texel")
    return b(spark, d).where("lod >= 5").select(*KEY).join(n, KEY, "left").select(*KEY, "flags", "texel", F.col("flags").isNotNull().alias("found"))


@query("flush_props", f"select min(lod) as lod_min, max(lod) as lod_max, cast(count(*) as bigint) as tiles, cast(bit_or(flags) as bigint) as flags, (select coalesce(avg(case when flags & 4 <> 0 then texel end), 0.0e0) from {_F} g where lod = (select max(lod) from {_F} h)) as nominal_texel from {_F} f")
def flush_props(spark, d):
    """What a dataset's properties record when it is closed."""
    n = nodes(spark, d)
    top = n.agg(F.min("lod").alias("lod_min"), F.max("lod").alias("lod_max"), F.count("*").alias("tiles"), F.bit_or("flags").alias("flags"))
    fine = mt.texel_average(n).agg(F.max_by("texel", "lod").alias("nominal_texel"))
    return top.crossJoin(fine)


@query("concat", f"select lod, x, y, cast(coalesce(b.flags, a.flags) as bigint) as flags, cast(case when b.flags is null then 1 else 2 end as int) as source from (select * from {_A} p where flags & 1 <> 0) a full join (select * from {_B} q where flags & 1 <> 0) b using (lod, x, y)")
def concat(spark, d):
    """Datasets pasted one over the other: of each tile the last real one stands."""
    both = a(spark, d).withColumn("source", F.lit(1)).unionByName(b(spark, d).withColumn("source", F.lit(2))).where(fl.real("flags"))
    return both.groupBy(*KEY).agg(F.max_by("flags", "source").alias("flags"), F.max("source").alias("source"))


@query("tile_pick", f"select a.* from {_A} a where exists (select 1 from (select * from {_B} q where flags & 2 <> 0) b where b.lod = a.lod and b.x = a.x and b.y = a.y)")
def tile_pick(spark, d):
    return a(spark, d).join(b(spark, d).where(fl.has("flags", 2)).select(*KEY), KEY, "left_semi")


@query("tile_info", f"select f.lod, f.x, f.y, f.flags, texel, m.x as meta_x, m.y as meta_y, 100.0e0 * (zmax - zmin) / (zmax + 1) as spread from {_F} f join {_META} m on m.lod = f.lod and m.x = f.x >> least(3, f.lod) and m.y = f.y >> least(3, f.lod)")
def tile_info(spark, d):
    by = F.least(F.lit(3), F.col("lod"))
    meta = ix.shrink_and_complete(a(spark, d), 3).select("lod", F.col("x").alias("meta_x"), F.col("y").alias("meta_y"))
    n = nodes(spark, d).withColumn("meta_x", shr("x", by)).withColumn("meta_y", shr("y", by))
    return n.join(meta, ["lod", "meta_x", "meta_y"]).select(*KEY, "flags", "texel", "meta_x", "meta_y", (100.0 * (F.col("zmax") - F.col("zmin")) / (F.col("zmax") + 1)).alias("spread"))


@query("extra_flags", f"select lod, x >> 2 as x, y >> 2 as y, cast(case when count(*) = 16 then 2 else 0 end + case when count(distinct credit) > 1 then 64 else 0 end as int) as extra, string_agg(distinct cast(credit as varchar), ',' order by cast(credit as varchar)) as credits from {_F} f group by 1, 2, 3")
def extra_flags(spark, d):
    """Blocks of sixteen cells as tiles: the cells there are as the mask, a submesh for each credit, and the credits united."""
    cells = nodes(spark, d).select("lod", shr("x", 2).alias("x"), shr("y", 2).alias("y"), F.col("x").bitwiseAND(3).alias("px"), F.col("y").bitwiseAND(3).alias("py"), "credit")
    subs = cells.select(*KEY, "credit").distinct()
    united = subs.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("credit")), ",").alias("credits"))
    return mt.extra_flags(cells.drop("credit"), subs, 16).join(united, KEY)

_EV = "(select event_id, cast(5 as int) as lod, user_id & 31 as x, event_id & 31 as y, cast(1 as bigint) << cast(event_id % 4 as int) as flags from events)"


@query("tmp_slices", f"select lod, x, y, cast(count(*) as bigint) as slices, cast(bit_or(flags) as bigint) as flags, string_agg(cast(event_id as varchar), ',' order by event_id) as parts from {_EV} e group by 1, 2, 3")
def tmp_slices(spark, d):
    """Writes of a temporary dataset: the n-th write of a tile goes to slice n; reading joins the slices in order and ORs their flags."""
    e = fx.sql(spark, d, f"select * from {_EV} e")
    w = e.withColumn("slice", F.row_number().over(Window.partitionBy(*KEY).orderBy("event_id")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("slice", "event_id"))), lambda s: s["event_id"].cast("string"))
    return w.groupBy(*KEY).agg(F.max("slice").cast("bigint").alias("slices"), F.bit_or("flags").alias("flags"), F.array_join(parts, ",").alias("parts"))


_FLAG_LIST = "'[' || concat_ws(',', " + ", ".join(f"case when flags & {bit} <> 0 then '\"{name}\"' end" for name, bit in fl.META_NAMES) + ") || ']'"


@query("debug_json", f"select lod, x, y, '{{{{\"tile\":\"' || lod || '-' || x || '-' || y || '\",\"flags\":' || {_FLAG_LIST} || ',\"geomExtents\":{{{{\"zmin\":' || cast(zmin as varchar) || ',\"zmax\":' || cast(zmax as varchar) || '}}}},\"texel\":' || cast(texel as varchar) || ',\"credits\":[' || credit || ']}}}}' as json from {_N} n".replace("{{", "{").replace("}}", "}"))
def debug_json(spark, d):
    """The debug document of every node, as JSON text."""
    n = full_nodes(spark, d)
    doc = F.struct(F.concat_ws("-", *KEY).alias("tile"), fl.names("flags", fl.META_NAMES).alias("flags"), F.struct("zmin", "zmax").alias("geomExtents"), "texel", F.array("credit").alias("credits"))
    return n.select(*KEY, F.to_json(doc).alias("json"))


@query("encode_candidates", f"select c.lod, c.x, c.y, c.x * 360.0e0 / (cast(1 as bigint) << c.lod) - 180 as llx from (select distinct cast(lod - k as int) as lod, x >> k as x, y >> k as y from {_A} s, (values (0),(1),(2),(3),(4),(5),(6),(7),(8)) u(k) where k <= lod) c where c.lod between 3 and 7 and (c.x + 1) * 360.0e0 / (cast(1 as bigint) << c.lod) - 180 > -90 and c.x * 360.0e0 / (cast(1 as bigint) << c.lod) - 180 < 45")
def encode_candidates(spark, d):
    """Tiles that a constrained top-down generation visits: in the valid tree, the level range and the extents."""
    tree = ix.valid_subtrees(a(spark, d)).where("lod between 3 and 7")
    w = 360.0 / shl(1, "lod").cast("double")
    llx = F.col("x") * w - 180
    return tree.where(((F.col("x") + 1) * w - 180 > -90) & (llx < 45)).select(*KEY, llx.alias("llx"))
