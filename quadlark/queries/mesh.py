"""Meshes: measures, codecs, kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import mesh as me
from ..sources.obj import obj_lines
from . import query

_E = f"({fx.FACES})"
_AREA = "sqrt(pow((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0), 2) + pow((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0), 2) + pow((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0), 2)) / 2"


def faces(spark, d):
    return fx.faces(spark, d)


def _minmax(a: str) -> str:
    return f"min(least({a}0, {a}1, {a}2)) as {a}min, max(greatest({a}0, {a}1, {a}2)) as {a}max"


_EXT = f"(select mesh, {_minmax('x')}, {_minmax('y')}, {_minmax('z')} from {_E} e group by mesh)"


@query("geom_extents", f"select * from {_EXT} q")
def geom_extents(spark, d):
    return me.extents(faces(spark, d))


@query("mesh_area", f"select surface, round(sum({_AREA}), 6) as area, round(sum({_AREA} * 0.5), 6) as texture, cast(count(*) as bigint) as faces from {_E} e group by surface")
def mesh_area(spark, d):
    a = me.area()
    return faces(spark, d).groupBy("surface").agg(F.round(F.sum(a), 6).alias("area"), F.round(F.sum(a * 0.5), 6).alias("texture"), F.count("*").alias("faces"))


_TEXEL = f"(select mesh & 15 as x, (mesh >> 4) & 15 as y, sum({_AREA}) as area, cast(count(*) as bigint) as faces from {_E} e group by 1, 2)"


@query("tile_texel_size", f"select x, y, round(sqrt(area / (faces * 65536.0e0)), 9) as texel from {_TEXEL} t")
def tile_texel_size(spark, d):
    """Square root of mesh area over texture area, 256 x 256 texels for each face."""
    t = faces(spark, d).groupBy(F.col("mesh").bitwiseAND(15).alias("x"), F.shiftright("mesh", 4).bitwiseAND(15).alias("y")).agg(F.sum(me.area()).alias("area"), F.count("*").alias("faces"))
    return t.select("x", "y", F.round(F.sqrt(F.col("area") / (F.col("faces") * 65536.0)), 9).alias("texel"))


@query("surrogate", f"select x, y, case when sum(w) > 0 then round(sum(w * z) / sum(w), 6) end as surrogate from (select mesh & 15 as x, (mesh >> 4) & 15 as y, {_AREA} as w, (z0 + z1 + z2) / 3 as z from {_E} e) t group by 1, 2")
def surrogate(spark, d):
    """Area-weighted mean of heights; null without area."""
    t = faces(spark, d).select(F.col("mesh").bitwiseAND(15).alias("x"), F.shiftright("mesh", 4).bitwiseAND(15).alias("y"), me.area().alias("w"), ((F.col("z0") + F.col("z1") + F.col("z2")) / 3).alias("z"))
    g = t.groupBy("x", "y").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("z")).alias("wz"))
    return g.select("x", "y", F.when(F.col("w") > 0, F.round(F.col("wz") / F.col("w"), 6)).alias("surrogate"))


@query("best_lod", f"select mesh, round(0.5 * log2(4.0 / sum({_AREA})), 6) as lod, cast(round(0.5 * log2(4.0 / sum({_AREA}))) as int) as near from {_E} e group by mesh having sum({_AREA}) > 0")
def best_lod(spark, d):
    """Half the binary logarithm of node area over mesh area."""
    a = faces(spark, d).groupBy("mesh").agg(F.sum(me.area()).alias("area")).where("area > 0")
    lod = 0.5 * F.log2(4.0 / F.col("area"))
    return a.select("mesh", F.round(lod, 6).alias("lod"), F.round(lod).cast("int").alias("near"))


def _q(c: str) -> str:
    a = c[0]
    return f"cast(case when side > 0 then round(({c} - ({a}min + {a}max) / 2) / side * 1024) else 0 end as int) as {c}"


@query("mesh_quantize", f"select e.mesh, f, {', '.join(map(_q, me.COORDS))} from {_E} e join (select *, greatest(xmax - xmin, ymax - ymin, zmax - zmin) as side from {_EXT} x) b on b.mesh = e.mesh")
def mesh_quantize(spark, d):
    return me.quantized(faces(spark, d))


def _coarse(c: str) -> str:
    return f"cast(round({c} * 5) as int) as {c}"


#: Faces on a coarse whole-number grid, where corners meet and faces degenerate.
_K = f"(select mesh & 31 as mesh, cast((mesh >> 5) * 7 + f as int) as f, {', '.join(map(_coarse, me.COORDS))} from {_E} e)"


def coarse(spark, d):
    e = faces(spark, d)
    return e.select(F.col("mesh").bitwiseAND(31).alias("mesh"), (F.shiftright("mesh", 5) * 7 + F.col("f")).cast("int").alias("f"), *(F.round(F.col(c) * 5).cast("int").alias(c) for c in me.COORDS))


_KV = " union all ".join(f"select mesh, f, {i} as corner, x{i} as x, y{i} as y, z{i} as z, f * 3 + {i} as place from {_K} k{i}" for i in range(3))
_KI = f"(select *, cast(dense_rank() over (partition by mesh order by first) - 1 as int) as v from (select *, min(place) over (partition by mesh, x, y, z) as first from ({_KV}) c) q)"


@query("mesh_dedupe", f"select mesh, f, max(case when corner = 0 then v end) as a, max(case when corner = 1 then v end) as b, max(case when corner = 2 then v end) as c from {_KI} i group by mesh, f")
def mesh_dedupe(spark, d):
    return me.index_faces(coarse(spark, d))


@query("mesh_cleanup", f"select mesh, cast(row_number() over (partition by mesh order by f) - 1 as int) as f, round({_AREA}, 6) as area from {_K} k where {_AREA} > 0")
def mesh_cleanup(spark, d):
    return me.cleaned(coarse(spark, d)).select("mesh", "f", F.round(me.area(), 6).alias("area"))


@query("obj_export", f"select mesh, cast(sum(case when n = 1 then 1 else 0 end) as bigint) as vertices, arg_min('v ' || x || ' ' || y || ' ' || z, first) as first_line, cast(count(distinct f) as bigint) as faces from (select *, row_number() over (partition by mesh, v order by place) as n from {_KI} i) t group by mesh")
def obj_export(spark, d):
    """A mesh as text: v lines by index, then f lines with numbers from 1; here their counts and the first line."""
    lines = obj_lines(coarse(spark, d))
    return lines.groupBy("mesh").agg(F.count_if(F.col("kind") == 0).alias("vertices"), F.min_by("line", F.struct("kind", "at")).alias("first_line"), F.count_if(F.col("kind") == 1).alias("faces"))


_IN = " + ".join(f"case when z{i} >= 0 then 1 else 0 end" for i in range(3))


def _share(i: int) -> str:
    j, k = (i + 1) % 3, (i + 2) % 3
    return f"(z{i} / (z{i} - z{j})) * (z{i} / (z{i} - z{k}))"


_PART = "case n when 3 then 1.0e0 when 0 then 0.0e0 when 1 then " + "case " + " ".join(f"when z{i} >= 0 then {_share(i)}" for i in range(3)) + " end else 1 - case " + " ".join(f"when z{i} < 0 then {_share(i)}" for i in range(3)) + " end end"


@query("clip_plane", f"select mesh, cast(sum(case n when 0 then 0 when 2 then 2 else 1 end) as bigint) as faces, round(sum({_AREA} * {_PART}), 6) as area from (select *, {_IN} as n from {_E} e) t group by mesh having sum(n) > 0")
def clip_plane(spark, d):
    """What is left of each mesh above z = 0."""
    c = me.clip(faces(spark, d), "z", 0.0)
    return c.groupBy("mesh").agg(F.count("*").alias("faces"), F.round(F.sum(me.area()), 6).alias("area"))


_EDGE = " union all ".join(f"select mesh, x{i} || ',' || y{i} || ',' || z{i} as a, x{j} || ',' || y{j} || ',' || z{j} as b from {_K} k{i}" for i, j in ((0, 1), (1, 2), (2, 0)))


@query("border_edges", f"select e.mesh, e.a, e.b from (select * from ({_EDGE}) z where a <> b) e where not exists (select 1 from ({_EDGE}) o where o.mesh = e.mesh and o.a = e.b and o.b = e.a)")
def border_edges(spark, d):
    return me.border_edges(coarse(spark, d))


@query("add_skirt", f"select e.mesh, cast(2 * count(*) as bigint) as faces from (select * from ({_EDGE}) z) e where not exists (select 1 from ({_EDGE}) o where o.mesh = e.mesh and o.a = e.b and o.b = e.a) group by e.mesh")
def add_skirt(spark, d):
    return me.skirt(coarse(spark, d), 2.0).groupBy("mesh").agg(F.count("*").alias("faces"))


_SM = "(select vec_id & 15 as tile, vec_id as sm, label + 1 as surface, cast(vec_id % 2 as int) as z_index, cast(vec_id % 3 as double) as uv_scale, vec_id % 4 <> 0 as textured, 10 + vec_id % 7 as vertices, 3 * (vec_id % 5) as tc, 5 + vec_id % 11 as faces from embeddings)"
_BEGINS = "s.surface <> u.surface or s.z_index <> u.z_index or s.uv_scale <> u.uv_scale or s.textured <> u.textured or u.v + s.vertices > 40 or u.t + s.tc > 20 or u.n + s.faces > 25"


@query(
    "group_submeshes",
    f"""with recursive s as (select *, row_number() over (partition by tile order by textured desc, surface, z_index, uv_scale, sm) as k from {_SM} q),
    up as (select tile, sm, k, surface, z_index, uv_scale, textured, vertices as v, tc as t, faces as n, 0 as part from s where k = 1 union all
      select s.tile, s.sm, s.k, s.surface, s.z_index, s.uv_scale, s.textured, case when {_BEGINS} then s.vertices else u.v + s.vertices end, case when {_BEGINS} then s.tc else u.t + s.tc end,
        case when {_BEGINS} then s.faces else u.n + s.faces end, u.part + case when {_BEGINS} then 1 else 0 end from up u join s on s.tile = u.tile and s.k = u.k + 1)
    select tile, sm, cast(part as int) as part from up""",
)
def group_submeshes(spark, d):
    return me.grouped(fx.sql(spark, d, f"select * from {_SM} s"), 40, 20, 25)


SIZE = 16


def _u(i: int) -> str:
    return f"((x{i} + 1) * {SIZE / 2} - 0.5)"


def _w(i: int) -> str:
    return f"((y{i} + 1) * {SIZE / 2} - 0.5)"


_EF = [f"(({_u(j)} - {_u(i)}) * (py - {_w(i)}) - ({_w(j)} - {_w(i)}) * (px - {_u(i)}))" for i, j in ((0, 1), (1, 2), (2, 0))]
_PIX = f"(select mesh, f, surface, px, py, ({_EF[1]} * z0 + {_EF[2]} * z1 + {_EF[0]} * z2) / ({' + '.join(_EF)}) as z from {_E} e, (select unnest(range({SIZE})) as px) a, (select unnest(range({SIZE})) as py) b where (({' and '.join(f'{x} >= 0' for x in _EF)}) or ({' and '.join(f'{x} <= 0' for x in _EF)})) and {' + '.join(_EF)} <> 0)"


def pix(spark, d):
    return me.pixels(faces(spark, d), SIZE)


@query("mesh_mask", f"select mesh, px, py, cast(max(f) + 1 as int) as value from {_PIX} p group by 1, 2, 3")
def mesh_mask(spark, d):
    """Scan conversion: of each pixel the last face, counted from 1."""
    return pix(spark, d).groupBy("mesh", "px", "py").agg((F.max("f") + 1).alias("value"))


_TOP = f"(select mesh & 15 as tile, px, py, max(mesh) as owner from {_PIX} p group by 1, 2, 3)"
_COVER = f"(select p.mesh, p.f, cast(count(*) as bigint) as pixels, cast(sum(case when t.owner = p.mesh then 1 else 0 end) as bigint) as hits from {_PIX} p join {_TOP} t on t.tile = p.mesh & 15 and t.px = p.px and t.py = p.py group by 1, 2)"


def covered(spark, d):
    p = pix(spark, d).withColumn("tile", F.col("mesh").bitwiseAND(15))
    top = p.groupBy("tile", "px", "py").agg(F.max("mesh").alias("owner"))
    return p.join(top, ["tile", "px", "py"]).groupBy("mesh", "f").agg(F.count("*").alias("pixels"), F.count_if(F.col("owner") == F.col("mesh")).alias("hits"))


@query("face_cover", f"select mesh, f, pixels, hits, case when hits = pixels then true when hits = 0 then false end as covered from {_COVER} c")
def face_cover(spark, d):
    """Whether a face is seen: wholly, not at all, or in part (null)."""
    return covered(spark, d).withColumn("covered", F.when(F.col("hits") == F.col("pixels"), True).when(F.col("hits") == 0, False))


@query("simple_clip", f"select e.mesh, e.f, e.surface from {_E} e where exists (select 1 from {_COVER} c where c.mesh = e.mesh and c.f = e.f and c.hits > 0)")
def simple_clip(spark, d):
    """Faces with a pixel of their own are kept whole."""
    return faces(spark, d).join(covered(spark, d).where("hits > 0").select("mesh", "f"), ["mesh", "f"], "left_semi").select("mesh", "f", "surface")


def _clip_sql(source: str, axis: str, above: bool) -> str:
    """The faces of `source` cut by a plane through 0, as the union of the cases by how many corners are inside."""
    d = [f"({'' if above else '-'}{axis}{i})" for i in range(3)]
    n = " + ".join(f"(case when {x} >= 0 then 1 else 0 end)" for x in d)

    def corner(i):
        return [f"{a}{i}" for a in "xyz"]

    def cross(i, j):
        return [f"{a}{i} + ({a}{j} - {a}{i}) * ({d[i]} / ({d[i]} - {d[j]}))" for a in "xyz"]

    def rows(test, *points):
        names = [f"{a}{i}" for i in range(3) for a in "xyz"]
        return f"select mesh, {', '.join(f'{v} as {c}' for v, c in zip([v for p in points for v in p], names))} from ({source}) z where {test}"

    out = [rows(f"{n} = 3", *(corner(i) for i in range(3)))]
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        out += [rows(f"{n} = 1 and {d[i]} >= 0", corner(i), cross(i, j), cross(i, k))]
        out += [rows(f"{n} = 2 and {d[i]} < 0", *p) for p in ((corner(j), corner(k), cross(k, i)), (corner(j), cross(k, i), cross(j, i)))]
    return " union all ".join(out)


_CHILD = [_clip_sql(_clip_sql(f"select * from {_E} e", "x", bool(i & 1)), "y", not i & 2) for i in range(4)]


@query("derive_subtile", " union all ".join(f"select mesh, cast(count(*) as bigint) as faces, round(sum({_AREA}), 6) as area, cast({i} as int) as child from ({c}) q group by mesh" for i, c in enumerate(_CHILD)))
def derive_subtile(spark, d):
    """Each mesh cut into its four children, with faces and area; the areas add up to the whole."""
    out = None
    for i in range(4):
        part = me.clip(me.clip(faces(spark, d), "x", 0.0, bool(i & 1)), "y", 0.0, not i & 2)
        part = part.groupBy("mesh").agg(F.count("*").alias("faces"), F.round(F.sum(me.area()), 6).alias("area")).withColumn("child", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


_KEPT = f"(select e.* from {_E} e where exists (select 1 from {_COVER} c where c.mesh = e.mesh and c.f = e.f and c.hits > 0))"
_KEDGE = " union all ".join(f"select mesh, x{i} || ',' || y{i} || ',' || z{i} as a, x{j} || ',' || y{j} || ',' || z{j} as b from {_KEPT} k{i}" for i, j in ((0, 1), (1, 2), (2, 0)))


@query("merge_tile", f"select * from (select mesh & 15 as tile, cast(count(*) as bigint) as faces, cast(count(distinct mesh) as bigint) as sources, round(sum({_AREA} * (z0 + z1 + z2) / 3) / sum({_AREA}), 6) as surrogate from {_KEPT} k group by 1) g left join (select e.mesh & 15 as tile, cast(2 * count(*) as bigint) as skirt from ({_KEDGE}) e where not exists (select 1 from ({_KEDGE}) o where o.mesh = e.mesh and o.a = e.b and o.b = e.a) group by 1) s using (tile)")
def merge_tile(spark, d):
    """Tiles merged from their sources: coverage painted, faces that are seen kept, a skirt put below them, and a surrogate height."""
    kept = faces(spark, d).join(covered(spark, d).where("hits > 0").select("mesh", "f"), ["mesh", "f"], "left_semi").withColumn("tile", F.col("mesh").bitwiseAND(15))
    low = me.skirt(kept, 0.1).withColumn("tile", F.col("mesh").bitwiseAND(15)).groupBy("tile").agg(F.count("*").alias("skirt"))
    z = (F.col("z0") + F.col("z1") + F.col("z2")) / 3
    g = kept.groupBy("tile").agg(F.count("*").alias("faces"), F.count_distinct("mesh").alias("sources"), F.round(F.sum(me.area() * z) / F.sum(me.area()), 6).alias("surrogate"))
    return g.join(low, "tile", "left")


@query("refine_mesh", f"select mesh, cast(20 as bigint) as faces, round(sum({_AREA}), 6) as area from {_E} e group by mesh")
def refine_mesh(spark, d):
    """Twenty faces for each mesh; the area stays."""
    return me.refined(faces(spark, d), 20).groupBy("mesh").agg(F.count("*").alias("faces"), F.round(F.sum(me.area()), 6).alias("area"))
