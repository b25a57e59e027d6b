"""Operators with rules of their own against plain Python models."""

import heapq
import random

import duckdb
import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
from quadlark.operators import mesh as me, meta as mt, space as sp


def test_ranges_of_submeshes(spark):
    """Folded one by one: order, kinds apart, limits for each range, one submesh at least."""
    rng = random.Random(1)
    rows = [(t, i, rng.random() < 0.5, rng.randint(1, 2), rng.randint(0, 1), float(rng.randint(1, 2)), rng.randint(1, 30), rng.randint(0, 30), rng.randint(1, 30)) for t in range(5) for i in range(40)]
    want = {}
    for t in range(5):
        part, key, sums = -1, None, [0, 0, 0]
        for r in sorted((x for x in rows if x[0] == t), key=lambda x: (not x[2], *x[3:6], x[1])):
            more = [a + b for a, b in zip(sums, r[6:])]
            if r[2:6] != key or any(a > 50 for a in more):
                part, key, more = part + 1, r[2:6], list(r[6:])
            sums = more
            want[t, r[1]] = part
    df = spark.createDataFrame(rows, "tile long, sm long, textured boolean, surface int, z_index int, uv_scale double, vertices int, tc int, faces int")
    assert {(r.tile, r.sm): r.part for r in me.grouped(df, 50, 50, 50).collect()} == want


def test_masks_against_nodes(spark):
    """Whole nodes by the mask alone; of partial ones only the valid pixels count; an empty mask covers none."""
    rng = random.Random(2)
    nodes, valid, masks, want = [], [], [], {}
    for x in range(60):
        partial = x % 2 == 1
        cells = [(i, j) for i in range(3) for j in range(3)]
        ok = {c for c in cells if rng.random() < 0.4} if partial else set(cells)
        share = rng.choice([0, 0.2, 0.5, 1])
        mask = {c for c in cells if rng.random() < share} | (ok if rng.random() < 0.2 else set())
        nodes.append((6, x, 0, partial, 3))
        valid += [(6, x, 0, *c) for c in ok if partial]
        masks += [(6, x, 0, *c) for c in mask]
        left = ok - mask
        if not mask:
            want[x] = "none"
        elif not partial:
            want[x] = "whole" if len(mask) == 9 else "some"
        else:
            want[x] = "whole" if not left else "none" if left == ok else "some"
    assert len(set(want.values())) == 3
    kind = "lod int, x long, y long, px int, py int"
    got = sp.checked_masks(spark.createDataFrame(nodes, "lod int, x long, y long, partial boolean, size int"), spark.createDataFrame(valid, kind), spark.createDataFrame(masks, kind))
    assert {r.x: r.cover for r in got.collect()} == want


def test_tiles_that_may_not_be_written(spark):
    tiles = spark.createDataFrame([(1, x, 0, n, e) for x, (n, e) in enumerate([(None, True), (1, True), (0, True), (3, True), (1, True), (1, True), (None, False), (2, True)])], "lod int, x long, y long, textures int, external boolean")
    subs = [(2, 0, 1, 1, "internal"), (3, 0, 1, 1, "internal"), (4, 0, 1, 0, "external"), (5, 0, 1, 0, "internal"), (5, 1, 0, 2, "external"), (6, 0, 0, 2, "external"), (7, 0, 1, 0, "internal"), (7, 1, 0, 0, "internal")]
    df = spark.createDataFrame([(1, x, 0, *r) for x, *r in subs], "lod int, x long, y long, i int, tc int, etc int, mode string")
    assert {r.x: r.problem for r in mt.sanity(tiles, df).collect()} == {1: "atlas without mesh", 2: "empty atlas", 3: "more textures than submeshes", 4: "external mode without external coordinates", 6: "external texture not allowed", 7: "internal texture without coordinates"}


def test_extra_flags(spark):
    pixels = [(1, x, 0, i, 0) for x, n in ((0, 4), (1, 4), (2, 3)) for i in range(n)]
    subs = [(1, x, 0, i) for x, n in ((0, 1), (1, 2), (2, 2), (3, 1)) for i in range(n)]
    got = mt.extra_flags(spark.createDataFrame(pixels, "lod int, x long, y long, px int, py int"), spark.createDataFrame(subs, "lod int, x long, y long, i int"), 4)
    assert {r.x: r.extra for r in got.collect()} == {0: 2, 1: 66, 2: 64, 3: 0}


def against_sql(spark, folder, name, table, rows, schema):
    """Rows of a query over one small table, and of its SQL."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    rel = c.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, str(folder)).select(*rel.columns).collect()
    return sorted(map(tuple, got), key=str), sorted(rel.fetchall(), key=str)


def test_colours_that_outweigh_heights(spark, tmp_path):
    """From 1,000 on a colour counts more than a cent of height; rows without a height or a colour have no say."""
    rows = [(0, 0, 100.01, 7), (0, 0, 100.0, 2007), (1, 0, 100.01, 7), (1, 0, 100.0, 900), (2, 0, None, 5), (3, 0, 1.0, 4), (3, 0, None, 9), (3, 0, 2.0, None), (4, 0, 1.0, None), (4, 0, None, 3)]
    got, want = against_sql(spark, tmp_path, "zbuffer", "lineitem", rows, "l_partkey long, l_orderkey long, l_extendedprice double, l_suppkey long")
    assert got == want
    assert [r[3] for r in got] == [2007, 7, None, 4, None]


def test_places_that_outweigh_versions(spark, tmp_path):
    """From 1,000,000 on a place counts more than a version; rows without a place have no say."""
    rows = [("a", 4, 7), ("a", 2, 2000008), ("b", 4, 7), ("b", 2, 2000006), ("b", 3, 9000000), ("c", 2, 1), ("c", 8, None)]
    got, want = against_sql(spark, tmp_path, "unique_versions", "part", rows, "p_brand string, p_size int, p_partkey long")
    assert got == want
    assert [r[2] for r in got] == ["a@2000008", "b@7", "c@1"]


def refined_one(faces, wanted):
    """One mesh refined face by face: the longest edge, of equal ones the oldest face's, is halved."""
    tris = [np.array(x).reshape(3, 3) for x in faces]
    longest = lambda t: max((float(np.sum((t[(i + 1) % 3] - t[i]) ** 2)), -i) for i in range(3))
    heap = [(-longest(t)[0], k) for k, t in enumerate(tris)]
    heapq.heapify(heap)
    while len(heap) < wanted and heap[0][0] < 0:
        t = tris[heapq.heappop(heap)[1]]
        i = -longest(t)[1]
        a, b, c = t[i], t[(i + 1) % 3], t[(i + 2) % 3]
        for new in ([a, (a + b) / 2, c], [(a + b) / 2, b, c]):
            heapq.heappush(heap, (-longest(np.array(new))[0], len(tris)))
            tris.append(np.array(new))
    return [tuple(tris[k].ravel()) for k in sorted(k for _, k in heap)]


def meshes(rng, count):
    """Small and large ones, on coarse grids with equal and no edges too."""
    out = {}
    for m in range(count):
        one = lambda: rng.choice([rng.random(), float(rng.randint(0, 2))]) if m % 2 else float(rng.randint(0, 1))
        out[m] = [tuple(1.5 if m % 20 == 0 else one() for _ in range(9)) for _ in range(rng.randint(1, 30))]
    return out


def face_rows(of):
    return [(m, f, *x) for m, faces in of.items() for f, x in enumerate(faces)]


def test_refinement_of_many_meshes(spark):
    """The same faces to the bit as face by face, however rows fall in batches; a kernel for many meshes, no call for each."""
    of = meshes(random.Random(4), 120)
    want = sorted(r for m, faces in of.items() for r in face_rows({m: refined_one(faces, 20)}))
    schema = "mesh long, f int, " + ", ".join(f"{c} double" for c in me.COORDS)
    rows = face_rows(of)
    df = me.refined(spark.createDataFrame(random.Random(5).sample(rows, len(rows)), schema), 20)
    assert sorted(map(tuple, df.collect())) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["mesh", "f", *me.COORDS])
    for size in (1, 3, 50, len(rows)):
        parts = (whole.slice(i, size) for i in range(0, len(rows), size))
        assert sorted(tuple(r.values()) for b in me._refine_batches(parts, 20) for r in b.to_pylist()) == want


def test_refinement_of_unknown_corners(spark):
    """Faces with an unknown corner stay as they are, the rest of their mesh is halved; a mesh without a key is one mesh."""
    fine, gap = (0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 3.0, 0.0), (None, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 3.0, float("nan"))
    rows = [(1, 0, *gap), (1, 1, *fine), (None, 0, *fine), (None, 1, *fine), (2, 0, *gap)]
    schema = "mesh long, f int, " + ", ".join(f"{c} double" for c in me.COORDS)
    got = me.refined(spark.createDataFrame(rows, schema), 5).collect()
    assert sorted((r.mesh or 0, r.f) for r in got) == [(0, f) for f in range(5)] + [(1, f) for f in range(5)] + [(2, 0)]
    assert [(r.f, r.x0 is None, str(r.z2)) for r in got if None in r[2:]] == [(0, True, "nan")] * 2
    assert abs(sum(abs(r.x1 * r.y2 - r.x2 * r.y1 + r.x0 * (r.y1 - r.y2) + r.y0 * (r.x2 - r.x1)) / 2 for r in got if r.mesh == 1 and r.f) - 6) < 1e-12
