"""Command line: python -m quadlark.cli COMMAND ...; each command is a dataset or storage verb."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import index as ix, meta as mt
from .sources import binary as bi
from .sources.storage import Storage
from .sources.store import Dataset, sniff

KEY = ["lod", "x", "y"]


def _show(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True)))


def _tiles(spark: SparkSession, path: str) -> DataFrame:
    return ix.expand(bi.tile_indices(spark, path)) if sniff(spark, path) == "tileindex" else Dataset(spark, path).read()


def _span(text: str) -> tuple[int, int]:
    a, _, b = text.partition(",")
    return int(a), int(b or a)


def run(argv: list[str], spark: SparkSession) -> int:
    p = argparse.ArgumentParser("quadlark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        c = sub.add_parser(name)
        for names, more in options:
            c.add_argument(*names.split(), **more)

    path, to = ("path", {}), ("to", {})
    command("info", path)
    command("tileindex-info", path, ("--mask", {"type": int, "default": 0xFF}))
    command("tileindex-ranges", path, ("--mask", {"type": int, "default": 0xFF}))
    command("convert-tileindex", path, to)
    command("derive-metaindex", path, ("--order", {"type": int, "default": 5}))
    command("clone", path, to, ("--lods", {"type": _span}))
    command("concat", to, ("paths", {"nargs": "+"}))
    command("aggregate", path, to, ("--tag", {}))
    command("tile-pick", path, to, ("--tiles", {"required": True}))
    command("tile-info", path, ("tile", {}))
    command("check-metatile-tree", path, ("nodes", {}))
    command("create", path)
    command("add", path, ("tileset", {}), ("base", {}), ("--where", {"default": "@TOP"}), ("--tag", {"action": "append", "default": []}), ("--rules", {"default": ""}))
    command("remove", path, ("ids", {"nargs": "+"}))
    command("tags", path, ("id", {}), ("--add", {"action": "append", "default": []}), ("--remove", {"action": "append", "default": []}))
    command("list-pending-glues", path, ("--tag", {}))
    command("glue-generate", path, ("ids", {"nargs": "+"}), ("--high", {"type": int, "default": 20}))
    command("vs-create", path, ("name", {}), ("ids", {"nargs": "+"}))
    a = p.parse_args(argv)
    c = a.command
    if c == "info":
        kind = sniff(spark, a.path)
        found = {"kind": kind}
        if kind == "dataset":
            found |= Dataset(spark, a.path).manifest()
        elif kind == "storage":
            found |= Storage(spark, a.path).document()
        print(json.dumps(found))
    elif c == "tileindex-info":
        _show(ix.statistics(_tiles(spark, a.path), a.mask).orderBy("lod"))
    elif c == "tileindex-ranges":
        _show(ix.tile_ranges(_tiles(spark, a.path), a.mask))
    elif c == "convert-tileindex":
        Dataset(spark, a.to).write(_tiles(spark, a.path))
    elif c == "derive-metaindex":
        _show(ix.shrink_and_complete(_tiles(spark, a.path), a.order).orderBy(*KEY))
    elif c == "clone":
        t = _tiles(spark, a.path).drop("arch_x", "arch_y")
        Dataset(spark, a.to).write(ix.clamp(t, *a.lods) if a.lods else t, Dataset(spark, a.path).properties() if sniff(spark, a.path) == "dataset" else {})
    elif c == "concat":
        Dataset(spark, a.to).write(ix.first_wins(*(_tiles(spark, x) for x in reversed(a.paths))))
    elif c == "aggregate":
        Dataset(spark, a.to).write(Storage(spark, a.path).flatten(a.tag))
    elif c == "tile-pick":
        wanted = [tuple(map(int, t.split("-"))) for t in a.tiles.split(",")]
        listed = spark.createDataFrame(wanted, "lod int, x bigint, y bigint")
        Dataset(spark, a.to).write(_tiles(spark, a.path).drop("arch_x", "arch_y").join(F.broadcast(listed), KEY, "left_semi"))
    elif c == "tile-info":
        lod, x, y = map(int, a.tile.split("-"))
        _show(_tiles(spark, a.path).where((F.col("lod") == lod) & (F.col("x") == x) & (F.col("y") == y)))
    elif c == "check-metatile-tree":
        _show(mt.inconsistencies(_tiles(spark, a.path), _tiles(spark, a.nodes)))
    elif c == "create":
        with Storage(spark, a.path)._change():
            pass
    elif c == "add":
        print(Storage(spark, a.path).add(_tiles(spark, a.tileset).drop("arch_x", "arch_y"), a.base, a.where, a.tag, a.rules))
    elif c == "remove":
        Storage(spark, a.path).remove(a.ids)
    elif c == "tags":
        print(json.dumps(Storage(spark, a.path).tags(a.id, a.add, a.remove)))
    elif c == "list-pending-glues":
        print(json.dumps(Storage(spark, a.path).pending(a.tag)))
    elif c == "glue-generate":
        print(Storage(spark, a.path).generate_glue(a.ids, a.high))
    elif c == "vs-create":
        print(json.dumps(Storage(spark, a.path).create_surface(a.name, a.ids)))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:], SparkSession.builder.getOrCreate()))
