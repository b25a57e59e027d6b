"""Hand-checked cases and properties of tile arithmetic and the tile-set algebra, against an independent model."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quadlark.functions import flags as fl, text as tx, tiles as t
from quadlark.operators import index as ix, meta as mt, raster as ra, stack as st


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def lits(*v):
    return tuple(F.lit(x).cast("bigint") for x in v)


def tiles(spark, cells):
    return spark.createDataFrame([(l, x, y, f) for (l, x, y), f in cells.items()] or [(0, 0, 0, 0)], "lod int, x bigint, y bigint, flags bigint").where("flags <> 0")


def cells(df):
    return {(r.lod, r.x, r.y): r.flags for r in df.collect()}


def test_hand_checked(spark):
    tile = (F.lit(3), *lits(5, 2))
    assert one(spark, *t.parent(*tile, 1)) == (2, 2, 1)
    assert one(spark, *t.parent(*tile, 4)) == (0, 0, 0)
    assert one(spark, *t.meta_id(*lits(37, 70))) == (32, 64)
    assert one(spark, *t.box_child(lits(1, 1, 2, 1), 1)) == (2, 2, 5, 3)
    assert one(spark, *t.common_ancestor(F.lit(3), lits(4, 4, 6, 5))) == (1, 1, 1)
    assert one(spark, *t.local(*tile, 1)) == (2, 1, 2)
    assert one(spark, *t.global_id((F.lit(1), *lits(1, 0)), (F.lit(2), *lits(1, 2)))) == (3, 5, 2)
    assert one(spark, t.vertical_flip(F.lit(3), F.lit(2))) == (5,)
    assert one(spark, t.quadkey(*tile), tx.ppx(tile[0], tile[1]), tx.ppy(tile[0], tile[2])) == ("121", "a000000", "a000000")
    assert one(spark, tx.padded_filename(*tile, "mesh"), tx.filename(*tile, "mesh"), tx.filename(*tile, "atlas", F.lit(1))) == ("3-0000005-0000002.bin", "3-5-2.bin", "3-5-2-1.jpg")
    assert one(spark, t.border(F.lit(3), *lits(2, 5), F.lit(2), lits(1, 1, 2, 2))) == (0x10110,)
    assert one(spark, tx.id_hash(F.lit(5), *lits(5, 5)), tx.id_hash(F.lit(5), *lits(5, 5)) % 4) == (4042162429, 1)
    assert one(spark, ra.quantize(F.lit(10.0), F.lit(0.0), F.lit(100.0))) == (26,)


def test_sets_hand_checked(spark):
    assert cells(ix.complete(tiles(spark, {(2, 3, 1): 1}))) == {(2, 3, 1): 1, (1, 1, 0): 1, (0, 0, 0): 1}
    assert cells(ix.round_tiles(tiles(spark, {(2, 3, 1): 5}))) == {(2, x, y): 5 for x in (2, 3) for y in (0, 1)}
    down = ix.expand(ix.complete_down(tiles(spark, {(1, 1, 0): 1}), 2))
    assert cells(down) == {(1, 1, 0): 1, **{(2, x, y): 1 for x in (2, 3) for y in (0, 1)}}
    assert cells(ix.expand(ix.invert(tiles(spark, {(1, 0, 0): 1}), (1, 1)))) == {(1, 1, 0): 1, (1, 0, 1): 1, (1, 1, 1): 1}
    block = {(1, 1, 0): 4, (1, 0, 1): 1}
    assert set(cells(ix.round_up(tiles(spark, block), 255, forced=True)).values()) == {4}
    assert set(cells(ix.round_up(tiles(spark, block), 1, forced=True)).values()) == {1}
    assert set(cells(ix.round_up(tiles(spark, {(1, 0, 0): 8, (1, 1, 0): 4, (1, 0, 1): 16, (1, 1, 1): 2}), 1, forced=True)).values()) == {2}
    given = ix.expand_or(ix.distribute(tiles(spark, {(1, 0, 0): 3, (2, 0, 0): 1}), 2, 2))
    assert cells(given) == {(1, 0, 0): 3, (2, 0, 0): 3, (2, 1, 0): 2, (2, 0, 1): 2, (2, 1, 1): 2}
    assert cells(ix.shrink_and_complete(tiles(spark, {(2, 3, 1): 1}), 1)) == {(2, 1, 0): 1, (1, 0, 0): 1, (0, 0, 0): 1}
    stack = tiles(spark, {(2, 0, 0): 3}).withColumn("pos", F.lit(0)).unionByName(tiles(spark, {(2, 0, 0): 1, (2, 1, 0): 0x21}).withColumn("pos", F.lit(-1)))
    assert cells(st.aggregate(stack)) == {(2, 0, 0): 65539}


def test_texel_propagation(spark):
    nodes = spark.createDataFrame([(3, 0, 0, 1, 1.0), (3, 1, 0, 1, 3.0)], "lod int, x bigint, y bigint, flags bigint, texel double")
    found = {r.lod: r.texel for r in mt.propagate_texel(nodes, 3).collect()}
    assert found[2] == 4.0 and found[1] == 8.0


def dense(low, high):
    return [(l, x, y) for l in range(low, high + 1) for x in range(1 << l) for y in range(1 << l)]


@pytest.mark.parametrize("seed", range(3))
def test_algebra_against_model(spark, seed):
    rng = random.Random(seed)
    grid = dense(1, 4)
    a = {c: rng.choice((1, 3)) for c in rng.sample(grid, 25)}
    b = {c: rng.choice((1, 2, 3)) for c in rng.sample(grid, 40)}
    da, db = tiles(spark, a), tiles(spark, b)
    up = lambda c, k: (c[0] - k, c[1] >> k, c[2] >> k)
    assert cells(ix.complete(ix.complete(da))) == cells(ix.complete(da)) == {**{up(c, k): 1 for c in a for k in range(c[0] + 1)}, **a}
    rounded = ix.round_tiles(da)
    assert cells(ix.round_tiles(rounded)) == cells(rounded)
    assert set(cells(rounded)) == {(c[0], (c[1] & ~1) + i, (c[2] & ~1) + j) for c in a for i in (0, 1) for j in (0, 1)}
    inverse = cells(ix.expand(ix.invert(da, (1, 4))))
    assert set(inverse) == set(grid) - set(a)
    twice = ix.expand(ix.invert(ix.expand(ix.invert(da, (1, 4))), (1, 4)))
    assert cells(twice) == {c: 1 for c in a}
    below = {(c[0] + k, (c[1] << k) + i, (c[2] << k) + j) for c in a for k in range(5 - c[0]) for i in range(1 << k) for j in range(1 << k)}
    assert set(cells(ix.expand(ix.complete_down(da, 4)))) == below
    both = set(cells(ix.unite([da, db])))
    assert both == set(cells(ix.unite([db, da]))) == set(a) | set(b)
    assert set(cells(ix.intersect(da, da))) == set(a)
    quads = lambda s: ix.complete_down(s, 4)
    met = set(cells(ix.expand(ix.quad_intersect(quads(da), quads(db)))))
    other = {(c[0] + k, (c[1] << k) + i, (c[2] << k) + j) for c in b for k in range(5 - c[0]) for i in range(1 << k) for j in range(1 << k)}
    assert met == below & other
    assert set(cells(ix.expand(ix.prune(quads(da))))) == below
    grown = {(c[0], (c[1] & ~1) + i, (c[2] & ~1) + j) for c in {up(c, k) for c in a for k in range(c[0])} for i in (0, 1) for j in (0, 1)}
    assert set(cells(ix.expand(ix.sphere_of_influence(da, 1, 4)))) == grown | below


def test_opening_is_below(spark):
    r = spark.range(400).select((F.col("id") % 20).alias("px"), F.floor(F.col("id") / 20).alias("py"), F.abs(F.hash("id") % 100).cast("double").alias("h"))
    whole = {(x.px, x.py): x.h for x in ra.opening(r, 2).collect()}
    assert all(whole[x.px, x.py] <= x.h for x in r.collect())
    assert whole == {(x.px, x.py): x.h for x in ra.opening_tiled(r, 2, 7).collect()}


def test_rules_and_flags(spark):
    assert st.parse_rules("a(b) # c\n\n# d\ntag.no-glue(x y)") == [("a", "b"), ("tag.no-glue", "x y")]
    with pytest.raises(ValueError):
        st.parse_rules("broken")
    assert one(spark, fl.tile_text(F.lit(32).cast("bigint")), fl.tile_text(F.lit(0x10001 | 34).cast("bigint"))) == ("influenced", "mesh,alien,watertight,reference=1")


def test_glue_order(spark):
    glues = spark.createDataFrame([(3, [1, 3]), (3, [0, 3]), (3, [0, 1, 3]), (3, [2, 3, 4])], "top int, id array<int>")
    stack = spark.createDataFrame([(i, str(i)) for i in range(5)], "pos int, tileset string")
    found = sorted((r["rank"], r["id"]) for r in st.glue_order(glues, stack).collect())
    assert [g for _, g in found] == [[2, 3, 4], [0, 1, 3], [1, 3], [0, 3]]
    assert list(itertools.chain(*[[k] for k, _ in found])) == [1, 2, 3, 4]
