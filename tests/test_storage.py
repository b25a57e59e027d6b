"""The storage's verbs, generation by a function, and the command line."""

import json

import pandas as pd
import pytest

from quadlark import cli
from quadlark.plans.encode import encode
from quadlark.sources.storage import Storage
from quadlark.sources.store import Dataset

TILE = "lod int, x bigint, y bigint, flags bigint"


def test_storage(spark, tmp_path):
    tiles = lambda *c: spark.createDataFrame([(3, x, y, 1) for x, y in c], TILE)
    s = Storage(spark, f"file://{tmp_path}/st")
    assert s.add(tiles((1, 1), (2, 2)), "a", tags=["t1"]) == "a@1"
    assert s.add(tiles((2, 2), (5, 5)), "b", tags=["t2"]) == "b@1"
    assert s.add(tiles((5, 5)), "c", "-b@1") == "c@1"
    assert [x["id"] for x in s.document()["stack"]] == ["a@1", "c@1", "b@1"]
    assert s.pending() == [["a@1", "b@1"], ["c@1", "b@1"]]
    assert s.add(tiles((2, 2)), "a", tags=["t1"]) == "a@2"
    assert s.newest() == ["c@1", "b@1", "a@2"] and s.newest("t?") == ["b@1", "a@2"]
    assert ["b@1", "a@2"] in s.pending() and not any("a@1" in g and "a@2" in g for g in s.pending())
    assert s.add(tiles((2, 2)), "d", tags=["t1"], rules="tag.sole-occurrence(t1)") == "d@1"
    assert not any("a@2" in g["id"] and "d@1" in g["id"] for g in s.document()["glues"])
    assert {(r.x, r.y): r.flags >> 16 for r in s.flatten("t2").collect()} == {(2, 2): 3, (5, 5): 3}
    assert s.generate_glue(["a@1", "b@1"], 3) > 0
    assert {"id": ["a@1", "b@1"], "state": "valid"} in s.document()["glues"]
    assert s.create_surface("v", ["b@1", "a@1"]) == ["a@1", "b@1"]
    assert s.tags("b@1", ["new"], ["t2"]) == ["new"]
    s.remove(["b@1"])
    assert not any("b@1" in g["id"] for g in s.document()["glues"]) and s.document()["surfaces"] == {}
    for bad in (("x@1", "@TOP"), ("x", "+none")):
        with pytest.raises(ValueError):
            s.add(tiles((1, 1)), *bad)


def test_encode(spark):
    valid = spark.createDataFrame([(4, 3, 9, 1), (4, 15, 0, 1)], TILE)
    made = encode(valid, (2, 3), lambda p: pd.DataFrame({"lod": p.lod, "n": p.x + p.y}), "lod int, n long")
    assert sorted(map(tuple, made.collect())) == [(2, 2), (2, 3), (3, 5), (3, 7)]


def test_command_line(spark, tmp_path, capsys):
    at = f"file://{tmp_path}/"
    Dataset(spark, at + "a").write(spark.createDataFrame([(3, 1, 1, 1), (4, 2, 2, 3)], TILE))
    Dataset(spark, at + "b").write(spark.createDataFrame([(3, 1, 1, 7)], TILE))
    for args in (["clone", at + "a", at + "c", "--lods", "4"], ["concat", at + "d", at + "a", at + "b"], ["tile-pick", at + "a", at + "e", "--tiles", "3-1-1"], ["create", at + "s"], ["add", at + "s", at + "a", "x"], ["aggregate", at + "s", at + "f"]):
        assert cli.run(args, spark) == 0
    rows = lambda n: sorted((r.lod, r.flags) for r in Dataset(spark, at + n).read().collect())
    assert (rows("c"), rows("d"), rows("e"), rows("f")) == ([(4, 3)], [(3, 7), (4, 3)], [(3, 1)], [(3, 65537), (4, 65539)])
    capsys.readouterr()
    cli.run(["tileindex-info", at + "a", "--mask", "2"], spark)
    assert json.loads(capsys.readouterr().out)["tiles"] == 1
    cli.run(["info", at + "s"], spark)
    assert json.loads(capsys.readouterr().out)["kind"] == "storage"
