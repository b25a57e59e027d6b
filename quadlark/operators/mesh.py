"""Triangle meshes as face rows (mesh, f, x0 .. z2): measures, clipping, clean-up, rasterisation, refinement.

Rasterising needs no Python: a face is exploded to the pixels of its own bounding box and edge functions keep those whose centre it covers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..ship import ship

CORNERS = [(f"x{i}", f"y{i}", f"z{i}") for i in range(3)]
COORDS = [c for p in CORNERS for c in p]


def area(p: list[tuple] = CORNERS) -> Column:
    """Area of a triangle in space."""
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = ([F.col(c) if isinstance(c, str) else c for c in q] for q in p)
    ux, uy, uz, vx, vy, vz = bx - ax, by - ay, bz - az, cx - ax, cy - ay, cz - az
    return F.sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2) / 2


def extents(faces: DataFrame, key: str = "mesh") -> DataFrame:
    lo = lambda a: F.min(F.least(*(f"{a}{i}" for i in range(3))))
    hi = lambda a: F.max(F.greatest(*(f"{a}{i}" for i in range(3))))
    return faces.groupBy(key).agg(*(f(a).alias(f"{a}{n}") for a in "xyz" for f, n in ((lo, "min"), (hi, "max"))))


def quantized(faces: DataFrame, steps: int = 1024) -> DataFrame:
    """Vertices as whole numbers: moved to the centre of the mesh's box, divided by its largest side, times steps, rounded."""
    e = extents(faces).withColumn("side", F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.col("zmax") - F.col("zmin")))
    met = faces.join(e, "mesh")
    q = lambda c: F.when(F.col("side") > 0, F.round((F.col(c) - (F.col(f"{c[0]}min") + F.col(f"{c[0]}max")) / 2) / F.col("side") * steps)).otherwise(0.0).cast("int")
    return met.select("mesh", "f", *(q(c).alias(c) for c in COORDS))


def clip(faces: DataFrame, axis: str, at: float, keep_above: bool = True) -> DataFrame:
    """The part of every face on one side of an axis plane: none, one or two faces for each. Corners on the plane are inside."""
    d = [(F.col(f"{axis}{i}") - at) * (1 if keep_above else -1) for i in range(3)]
    inside = [x >= 0 for x in d]
    n = sum((F.when(i, 1).otherwise(0) for i in inside), F.lit(0))

    def cross(i: int, j: int) -> list[Column]:
        t = d[i] / (d[i] - d[j])
        return [F.col(f"{a}{i}") + (F.col(f"{a}{j}") - F.col(f"{a}{i}")) * t for a in "xyz"]

    def corner(i: int) -> list[Column]:
        return [F.col(f"{a}{i}") for a in "xyz"]

    def face(*points: list[Column]) -> Column:
        return F.struct(*(v.alias(c) for v, c in zip([v for p in points for v in p], COORDS)))

    out = F.when(n == 3, F.array(face(*(corner(i) for i in range(3)))))
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        out = out.when((n == 1) & inside[i], F.array(face(corner(i), cross(i, j), cross(i, k))))
        out = out.when((n == 2) & ~inside[i], F.array(face(corner(j), corner(k), cross(k, i)), face(corner(j), cross(k, i), cross(j, i))))
    rest = [c for c in faces.columns if c not in COORDS]
    return faces.select(*rest, F.explode(out).alias("p")).select(*rest, "p.*")


def vertices(faces: DataFrame) -> DataFrame:
    """(mesh, f, corner, x, y, z): a row for each corner, in order."""
    each = F.posexplode(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z")) for x, y, z in CORNERS)))
    return faces.select("mesh", "f", each.alias("corner", "v")).select("mesh", "f", "corner", "v.*")


def indexed(faces: DataFrame) -> DataFrame:
    """Corners with the index (from 0) of their vertex, equal vertices sharing one, numbered by first occurrence within the mesh."""
    v = vertices(faces).withColumn("place", F.col("f") * 3 + F.col("corner"))
    first = v.withColumn("first", F.min("place").over(Window.partitionBy("mesh", "x", "y", "z")))
    return first.withColumn("v", (F.dense_rank().over(Window.partitionBy("mesh").orderBy("first")) - 1).cast("int"))


def index_faces(faces: DataFrame) -> DataFrame:
    """(mesh, f, a, b, c): faces by vertex index."""
    at = lambda i: F.max(F.when(F.col("corner") == i, F.col("v")))
    return indexed(faces).groupBy("mesh", "f").agg(at(0).alias("a"), at(1).alias("b"), at(2).alias("c"))


def cleaned(faces: DataFrame) -> DataFrame:
    """Without degenerate faces, faces renumbered and vertices counted anew."""
    fine = faces.where(area() > 0)
    return fine.withColumn("f", (F.row_number().over(Window.partitionBy("mesh").orderBy("f")) - 1).cast("int"))


def border_edges(faces: DataFrame) -> DataFrame:
    """Directed edges (by vertex) that no face runs along the other way."""
    point = lambda i: F.concat_ws(",", *(F.col(c).cast("string") for c in CORNERS[i]))
    e = faces.select("mesh", F.explode(F.array(*(F.struct(point(i).alias("a"), point((i + 1) % 3).alias("b")) for i in range(3)))).alias("e")).select("mesh", "e.*").where("a <> b")
    flip = e.select("mesh", F.col("a").alias("b"), F.col("b").alias("a"))
    return e.join(flip.distinct(), ["mesh", "a", "b"], "left_anti")


def skirt(faces: DataFrame, down: float) -> DataFrame:
    """Two faces below each border edge: the edge moved down along z."""
    point = lambda i: F.struct(*(F.col(c).alias(a) for c, a in zip(CORNERS[i], "xyz")))
    e = faces.select("mesh", F.explode(F.array(*(F.struct(point(i).alias("a"), point((i + 1) % 3).alias("b")) for i in range(3)))).alias("e")).select("mesh", "e.a", "e.b")
    flip = e.select("mesh", F.col("a").alias("b"), F.col("b").alias("a")).distinct()
    edge = e.join(flip, ["mesh", "a", "b"], "left_anti")
    a, b = F.col("a"), F.col("b")
    low = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["z"] - down).alias("z"))
    face = lambda *p: F.struct(*(q[c].alias(f"{c}{i}") for i, q in enumerate(p) for c in "xyz"))
    return edge.select("mesh", F.explode(F.array(face(b, a, low(a)), face(b, low(a), low(b)))).alias("p")).select("mesh", "p.*")


def pixels(faces: DataFrame, size: int, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """(columns of the face, px, py, z): the pixels whose centre a face covers seen from above, on a size x size grid over [low, high]."""
    scale = size / (high - low)
    px = lambda c: (F.col(c) - low) * scale - 0.5
    p = faces
    for i in range(3):
        p = p.withColumn(f"u{i}", px(f"x{i}")).withColumn(f"w{i}", px(f"y{i}"))
    span = lambda a: F.sequence(F.greatest(F.lit(0).cast("bigint"), F.ceil(F.least(*(f"{a}{i}" for i in range(3))))), F.greatest(F.greatest(F.lit(0).cast("bigint"), F.ceil(F.least(*(f"{a}{i}" for i in range(3))))), F.least(F.lit(size - 1).cast("bigint"), F.floor(F.greatest(*(f"{a}{i}" for i in range(3)))))))
    p = p.withColumn("px", F.explode(span("u"))).withColumn("py", F.explode(span("w")))
    x, y = F.col("px"), F.col("py")
    e = [(F.col(f"u{j}") - F.col(f"u{i}")) * (y - F.col(f"w{i}")) - (F.col(f"w{j}") - F.col(f"w{i}")) * (x - F.col(f"u{i}")) for i, j in ((0, 1), (1, 2), (2, 0))]
    whole = e[0] + e[1] + e[2]
    same = reduce(lambda a, b: a & b, [v >= 0 for v in e]) | reduce(lambda a, b: a & b, [v <= 0 for v in e])
    inside = (whole != 0) & same & x.between(0, size - 1) & y.between(0, size - 1)
    z = (e[1] * F.col("z0") + e[2] * F.col("z1") + e[0] * F.col("z2")) / whole
    drop = [f"{a}{i}" for i in range(3) for a in "uw"]
    return p.where(inside).withColumn("z", z).drop(*drop)


#: Faces that one step of refining holds at once, those that have been halved included.
HELD_FACES = 1 << 16


def _longest(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of triangles (..., corner, axis) the squared length of the longest edge and which it is, the first of equals. Without length if a corner is unknown."""
    d = (t[..., [1, 2, 0], :] - t) ** 2
    e = d[..., 0] + d[..., 1] + d[..., 2]
    size = e.max(-1)
    return np.where(np.isnan(size), 0.0, size), e.argmax(-1)


def _halved(t: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Meshes of equally many faces (mesh, face, corner, axis), fewer than wanted, refined side by side: their faces in order of making, and which of them stand.
    Every step halves each mesh's longest edge, of equal ones the oldest face's; a mesh whose edges have no length is done."""
    n, total = t.shape[1], 2 * wanted - t.shape[1]
    p = np.empty((len(t), total, 3, 3))
    p[:, :n] = t
    size, edge = np.full((len(t), total), -1.0), np.zeros((len(t), total), np.int8)
    size[:, :n], edge[:, :n] = _longest(t)
    for at in range(n, total, 2):
        k = size.argmax(1)
        on = np.flatnonzero(size[np.arange(len(t)), k] > 0)
        if not len(on):
            break
        k = k[on]
        one, i, r = p[on, k], edge[on, k].astype(int), np.arange(len(on))
        a, b, c = one[r, i], one[r, (i + 1) % 3], one[r, (i + 2) % 3]
        m = (a + b) / 2
        new = np.stack([np.stack([a, m, c], 1), np.stack([m, b, c], 1)], 1)
        p[on, at : at + 2] = new
        size[on, k] = -1.0
        size[on, at : at + 2], edge[on, at : at + 2] = _longest(new)
    return p, size >= 0


def _refine_batches(batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.RecordBatch]:
    """Faces in order of mesh and place. The last mesh of a batch is held back while it has fewer faces than wanted; larger ones go out as they come."""
    nulls = lambda c: np.asarray(c.is_null())

    def out(mesh, none, f, xyz, void):
        columns = [pa.array(mesh, pa.int64(), mask=none), pa.array(f, pa.int32())]
        return pa.RecordBatch.from_arrays(columns + [pa.array(xyz[:, i], pa.float64(), mask=void[:, i]) for i in range(9)], names=["mesh", "f", *COORDS])

    def done(rows, at, before, whole):
        mesh, none, xyz, void = rows
        size = np.diff(at)
        ready = np.repeat(whole, size)
        if ready.any():
            f = np.arange(len(ready)) - np.repeat(at[:-1] - before, size)
            yield out(mesh[ready], none[ready], f[ready], xyz[ready], void[ready])
        for n in np.unique(size[~whole]):
            first = at[:-1][~whole & (size == n)]
            step = max(1, HELD_FACES // (2 * wanted - n))
            for some in (first[i : i + step] for i in range(0, len(first), step)):
                each = some[:, None] + np.arange(n)
                p, live = _halved(xyz[each].reshape(-1, n, 3, 3), wanted)
                gaps = np.zeros((*live.shape, 9), bool)
                gaps[:, :n] = void[each]
                m = np.repeat(some, live.sum(1))
                yield out(mesh[m], none[m], (live.cumsum(1) - 1)[live], p[live].reshape(-1, 9), gaps[live])

    rows, last, seen = None, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        coords = [b.column(c) for c in COORDS]
        xyz = np.stack([np.asarray(c.fill_null(np.nan)) for c in coords], 1)
        new = np.asarray(b.column("mesh").fill_null(0)), nulls(b.column("mesh")), xyz, np.stack([nulls(c) for c in coords], 1)
        rows = new if rows is None else tuple(map(np.concatenate, zip(rows, new)))
        mesh, none = rows[:2]
        at = np.r_[0, np.flatnonzero((mesh[1:] != mesh[:-1]) | (none[1:] != none[:-1])) + 1, len(mesh)]
        before = np.zeros(len(at) - 1, int)
        before[0] = seen if last == (mesh[0], none[0]) else 0
        whole = before + np.diff(at) >= wanted
        last, seen = (mesh[-1], none[-1]), int(before[-1] + at[-1] - at[-2]) if whole[-1] else 0
        k = len(at) if whole[-1] else len(at) - 1
        if k > 1:
            yield from done(tuple(v[: at[k - 1]] for v in rows), at[:k], before[: k - 1], whole[: k - 1])
        rows = tuple(v[at[k - 1] :] for v in rows) if k < len(at) else None
    if rows is not None:
        n = len(rows[0])
        yield from done(rows, np.array([0, n]), np.array([0]), np.array([False]))


def refined(faces: DataFrame, wanted: int) -> DataFrame:
    """Each mesh with at least `wanted` faces: the longest edge of all faces is halved again and again. Each step depends on the last, so a kernel
    does them, for many meshes at once; meshes lie whole and in order in its partitions."""
    ship(faces.sparkSession)
    schema = "mesh long, f int, " + ", ".join(f"{c} double" for c in COORDS)
    rows = faces.select(F.col("mesh").cast("long").alias("mesh"), "f", *(F.col(c).cast("double").alias(c) for c in COORDS))
    rows = rows.repartition("mesh").sortWithinPartitions("mesh", F.asc_nulls_last("f"))
    return rows.mapInArrow(partial(_refine_batches, wanted=wanted), schema)


def grouped(submeshes: DataFrame, vertices: int, coordinates: int, faces: int) -> DataFrame:
    """Each tile's submeshes in ranges to be joined: (tile, sm, part), parts counted from 0 in each tile.

    submeshes: (tile, sm, textured, surface, z_index, uv_scale, vertices, tc, faces). Internally textured ones go first and stay apart; within
    both kinds they are ordered by surface, z-index and texture scale, ties by sm. A range ends where one of the three changes, or where the
    next submesh would take its vertices, texture coordinates or faces beyond the limits; it holds one submesh at least. One tile's
    submeshes are few, so they are folded in one row, whatever the number of tiles.
    """
    limits = {"vertices": vertices, "tc": coordinates, "faces": faces}
    key = F.struct(~F.col("textured"), "surface", "z_index", "uv_scale")
    one = F.struct(key.alias("key"), "sm", *(F.col(c).cast("long").alias(c) for c in limits))
    tiles = submeshes.groupBy("tile").agg(F.array_sort(F.collect_list(one)).alias("all"))

    def step(s, x):
        begins = s["key"].isNull() | ~s["key"].eqNullSafe(x["key"])
        for c, most in limits.items():
            begins = begins | (s[c] + x[c] > most)
        part = s["part"] + F.when(begins, 1).otherwise(0)
        sums = [F.when(begins, x[c]).otherwise(s[c] + x[c]).alias(c) for c in limits]
        return F.struct(x["key"].alias("key"), part.alias("part"), *sums, F.concat(s["out"], F.array(F.struct(x["sm"].alias("sm"), part.alias("part")))).alias("out"))

    kinds = {f.name: f.dataType.simpleString() for f in tiles.schema["all"].dataType.elementType.fields}
    start = F.struct(F.lit(None).cast(kinds["key"]).alias("key"), F.lit(-1).alias("part"), *(F.lit(0).cast("long").alias(c) for c in limits), F.array().cast(f"array<struct<sm:{kinds['sm']},part:int>>").alias("out"))
    return tiles.select("tile", F.explode(F.aggregate("all", start, step)["out"]).alias("r")).select("tile", "r.sm", "r.part")
