"""Stores, binary files and the stream of writes: round trips and failures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quadlark.operators import index as ix
from quadlark.sources import binary as bi, registry as rg
from quadlark.sources.store import Dataset, sniff
from quadlark.streaming.ingest import ingest, upsert

TILE = "lod int, x bigint, y bigint, flags bigint"


def cells(df):
    return {(r.lod, r.x, r.y): r.flags for r in df.collect()}


def test_tree_round_trip():
    rng = random.Random(1)
    for order in range(5):
        for _ in range(10):
            grid = [(x, y) for x in range(1 << order) for y in range(1 << order)]
            given = {c: rng.choice((1, 1, 1, 300, 70000)) for c in grid if rng.random() < 0.7}
            got_order, quads = bi.read_tree(bi.Reader(bi.write_tree(order, given)))
            dense = {}
            for depth, x, y, v in quads:
                s = order - depth
                dense.update({((x << s) + i, (y << s) + j): v for i in range(1 << s) for j in range(1 << s)})
            assert (got_order, dense) == (order, given)
    assert bi.read_tree(bi.Reader(b"QT" + bytes([1, 255, 5, 0, 7, 0])))[1] == [(1, 0, 0, 5), (1, 0, 1, 7)]
    with pytest.raises(ValueError):
        bi.read_tree(bi.Reader(b"xxxxx"))


def test_index_files(spark, tmp_path):
    given = {(2, 1, 3): 1, (4, 7, 9): 0x10005, (4, 7, 8): 1}
    tiles = spark.createDataFrame([(*k, v) for k, v in given.items()], TILE)
    row = bi.index_files(tiles.withColumn("tileset", F.lit("a"))).first()
    (tmp_path / "a.ti").write_bytes(bytes(row.content))
    back = bi.tile_indices(spark, f"file://{tmp_path}/a.ti").drop("file")
    assert cells(ix.expand(back)) == given
    assert sniff(spark, f"file://{tmp_path}/a.ti") == "tileindex"
    assert sniff(spark, f"file://{tmp_path}/none") == "unknown"


def test_reference_maps():
    lists = [[1, 2, 3], [], [65535]]
    assert bi.read_map(bi.write_map(lists)) == lists


def test_versions(spark, tmp_path):
    d = Dataset(spark, f"file://{tmp_path}/set")
    assert d.write(spark.createDataFrame([(5, 33, 1, 1)], TILE), {"id": "set"}) == 1
    assert d.update(lambda t: t.withColumn("flags", F.lit(7).cast("bigint"))) == 2
    assert cells(d.read()) == {(5, 33, 1): 7} and cells(d.read(1)) == {(5, 33, 1): 1}
    assert d.properties() == {"id": "set"} and sniff(spark, d.path) == "dataset"
    with d.locked(), pytest.raises(RuntimeError):
        d.write(d.read(1))
    d.drop_old(1)
    with pytest.raises(FileNotFoundError):
        d.read(1)


def test_stream_of_writes(spark, tmp_path):
    source, kind = tmp_path / "in", TILE + ", version bigint"
    write = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(source))
    write([(3, 1, 1, 1, 1), (3, 1, 1, 4, 2), (3, 2, 2, 1, 1)])
    path = f"file://{tmp_path}/set"
    for rows in ([], [(3, 2, 2, 0, 5), (3, 1, 1, 9, 1)]):
        if rows:
            write(rows)
        ingest(spark.readStream.schema(kind).parquet(str(source)), path, str(tmp_path / "cp")).awaitTermination()
    d = Dataset(spark, path)
    assert cells(d.read()) == {(3, 1, 1): 4}
    assert not upsert(d, spark.createDataFrame([(3, 9, 9, 1, 9)], kind), 0)


def test_registries(spark, tmp_path):
    doc = [{"id": "f", "division": {"nodes": [{"id": {"lod": 0, "position": [0, 0]}, "srs": "r", "extents": {"ll": [0, 0], "ur": [1, 2]}, "partitioning": {"00": {}, "01": {}}}, {"id": {"lod": 1, "position": [1, 0]}, "partitioning": "none"}]}}]
    (tmp_path / "f.json").write_text(json.dumps(doc))
    rows = rg.reference_frames(spark, f"file://{tmp_path}/f.json").orderBy("lod").collect()
    assert (rows[0].mode, rows[0].child_flags, rows[0].ury, rows[1].mode, rows[1].llx) == ("manual", 3, 2.0, "none", None)
    (tmp_path / "c.json").write_text(json.dumps({"a": {"id": 1}}))
    assert rg.dictionary(spark, f"file://{tmp_path}/c.json").first().id == "a"


def test_obj_round_trip(spark, tmp_path):
    from quadlark.operators.mesh import COORDS
    from quadlark.sources import obj

    rows = [(0, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.5), (0, 1, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.5)]
    faces = spark.createDataFrame(rows, "mesh int, f int, " + ", ".join(f"{c} double" for c in COORDS))
    text = obj.obj_texts(faces).first().text
    assert text.count("v ") == 4 and text.count("f ") == 2
    (tmp_path / "m.obj").write_text("usemtl 3\n" + text + "\nf 1 2 4 3\nf -1 -2 -3\n")
    back = obj.read_obj(spark, f"file://{tmp_path}/m.obj").orderBy("f").collect()
    assert [tuple(r[c] for c in COORDS) for r in back[:2]] == [r[2:] for r in rows]
    assert len(back) == 5 and {r.sm for r in back} == {3}


def test_metatiles(spark, tmp_path):
    import math

    import pandas as pd

    from quadlark.sources import metatile as mt

    rng = random.Random(4)
    rows = []
    for x in range(35, 41):
        for y in range(64, 67):
            box = [0.0, 0.25, 0.5, 1.0] if x % 2 else [math.nan] * 4
            rows.append((7, x, y, rng.choice((1, 3, 0x101)), -1.5, 2.0, 0.5, *box, 2, rng.choice((0.5, 2.0, 512.0)), 256, -3, 900, rng.choice((0, 7, 300)), sorted(rng.sample(range(1, 9), rng.randint(0, 3)))))
    nodes = pd.DataFrame(rows, columns=mt.NAMES)
    data = mt.write_metatile(nodes)
    assert mt.read_credits(data) == sorted({c for r in rows for c in r[-1]})
    (tmp_path / "a.meta").write_bytes(data)
    back_rows = [tuple(r) for r in mt.metatiles(spark, f"file://{tmp_path}/a.meta").collect()]
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    assert sorted(map(str, back_rows)) == sorted(map(str, (tuple(map(plain, r)) for r in rows)))
    with pytest.raises(ValueError):
        mt.read_metatile(b"xx" + data[2:])
