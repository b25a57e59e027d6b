"""A storage: a stack of versioned, tagged datasets with the glues between them, kept as one JSON document beside the datasets.

Every change rewrites the document under the storage's lock, through a temporary file and one rename.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import glob_pattern
from ..operators import stack as st
from .store import Dataset

CATALOGUE = "storage.json"


class Storage:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = Dataset(spark, self.path)  # its lock and renames

    def document(self) -> dict:
        if not self._files._fs.exists(self._files._at(CATALOGUE)):
            return {"stack": [], "glues": [], "surfaces": {}, "revision": 0}
        return json.loads(self.spark.read.text(f"{self.path}/{CATALOGUE}", wholetext=True).first().value)

    @contextlib.contextmanager
    def _change(self) -> Iterator[dict]:
        with self._files.locked():
            doc = self.document()
            yield doc
            doc["revision"] += 1
            out = self._files._fs.create(self._files._at(CATALOGUE + ".next"), True)
            out.write(bytearray(json.dumps(doc).encode()))
            out.close()
            self._files._fs.delete(self._files._at(CATALOGUE), False)
            if not self._files._fs.rename(self._files._at(CATALOGUE + ".next"), self._files._at(CATALOGUE)):
                raise OSError(f"{self.path}: the catalogue could not be replaced")

    def dataset(self, name: str) -> Dataset:
        return Dataset(self.spark, f"{self.path}/tilesets/{name}")

    def add(self, tiles: DataFrame, base: str, where: str = "@TOP", tags: list[str] = (), rules: str = "") -> str:
        """Stores the tiles as a new version of `base` at a place in the stack, and notes the glues that it needs as pending.

        where: @TOP, @BOTTOM, -id (below it) or +id (above it). Names with @ are refused: they are versions' names.
        """
        if "@" in base:
            raise ValueError("a name must not have @ in it")
        with self._change() as doc:
            known = [s["version"] for s in doc["stack"] if s["base"] == base]
            name = f"{base}@{max(known, default=0) + 1}"
            ids = [s["id"] for s in doc["stack"]]
            if where in ("@TOP", "@BOTTOM"):
                at = len(ids) if where == "@TOP" else 0
            elif where[:1] in "+-" and where[1:] in ids:
                at = ids.index(where[1:]) + (where[0] == "+")
            else:
                raise ValueError(f"no such place: {where}")
            self.dataset(name).write(tiles, {"id": name})
            doc["stack"].insert(at, {"id": name, "base": base, "version": max(known, default=0) + 1, "tags": sorted(tags)})
            doc["glues"] += [{"id": g, "state": "pending"} for g in self._needed(doc, name, rules)]
        return name

    def _needed(self, doc: dict, name: str, rules: str) -> list[list[str]]:
        """Cliques of overlapping layers that hold the new one, of unlike bases, that break no rule."""
        if len(doc["stack"]) < 2:
            return []
        ids = [s["id"] for s in doc["stack"]]
        layers = self._layers(doc)
        cliques = st.cliques(st.incidence(layers), ids.index(name), most=len(ids)).withColumn("id", F.array_sort("id"))
        if parsed := st.parse_rules(rules):
            tags = [(i, t) for i, s in enumerate(doc["stack"]) for t in s["tags"]]
            if tags:
                broken = st.rule_breaks(cliques, self.spark.createDataFrame(tags, "pos int, tag string"), parsed).select("id").distinct()
                cliques = cliques.join(broken, "id", "left_anti")
        bases = [s["base"] for s in doc["stack"]]
        found = sorted([list(r.id) for r in cliques.collect()])
        return [[ids[p] for p in g] for g in found if len({bases[p] for p in g}) == len(g)]

    def _layers(self, doc: dict, keep: set[str] | None = None) -> DataFrame:
        parts = [self.dataset(s["id"]).read().select("lod", "x", "y", "flags", F.lit(i).alias("pos")) for i, s in enumerate(doc["stack"]) if keep is None or s["id"] in keep]
        return reduce(DataFrame.unionByName, parts)

    def remove(self, names: list[str]) -> None:
        """Drops datasets with the glues and surfaces that depend on them; their files go last."""
        gone = set(names)
        with self._change() as doc:
            doc["stack"] = [s for s in doc["stack"] if s["id"] not in gone]
            doc["glues"] = [g for g in doc["glues"] if not gone & set(g["id"])]
            doc["surfaces"] = {k: v for k, v in doc["surfaces"].items() if not gone & set(v)}
        for n in gone:
            d = self.dataset(n)
            d._fs.delete(d._root, True)

    def tags(self, name: str, add: list[str] = (), remove: list[str] = ()) -> list[str]:
        with self._change() as doc:
            entry = next(s for s in doc["stack"] if s["id"] == name)
            entry["tags"] = sorted((set(entry["tags"]) | set(add)) - set(remove))
        return entry["tags"]

    def newest(self, tag: str | None = None) -> list[str]:
        """Of each base the newest version, among those with a tag that matches, in stack order."""
        import re

        fits = lambda s: tag is None or any(re.match(glob_pattern(tag), t) for t in s["tags"])
        best: dict[str, dict] = {}
        stack = self.document()["stack"]
        for s in filter(fits, stack):
            if s["base"] not in best or best[s["base"]]["version"] < s["version"]:
                best[s["base"]] = s
        return [s["id"] for s in stack if best.get(s["base"]) is s]

    def generate_glue(self, names: list[str], high: int) -> int:
        """Works out the tiles of a pending glue (ids bottom to top) and stores them; an empty result is remembered as such. Gives their number."""
        tiles = st.generate_set([self.dataset(n).read().select("lod", "x", "y", "flags") for n in names], high)
        d = Dataset(self.spark, f"{self.path}/glues/{'_'.join(names)}")
        d.write(tiles)
        n = d.read().count()
        with self._change() as doc:
            for g in doc["glues"]:
                if g["id"] == names:
                    g["state"] = "valid" if n else "empty"
        return n

    def pending(self, tag: str | None = None) -> list[list[str]]:
        """Pending glues whose members are all among the newest."""
        there = set(self.newest(tag))
        return [g["id"] for g in self.document()["glues"] if g["state"] == "pending" and set(g["id"]) <= there]

    def flatten(self, tag: str | None = None) -> DataFrame:
        """The newest versions as one tile set, the topmost mesh first."""
        return st.aggregate(self._layers(self.document(), set(self.newest(tag))))

    def create_surface(self, name: str, members: list[str]) -> list[str]:
        """A named subset, its members in stack order, once each."""
        with self._change() as doc:
            order = [s["id"] for s in doc["stack"]]
            if missing := set(members) - set(order):
                raise ValueError(f"not in the stack: {sorted(missing)}")
            doc["surfaces"][name] = [i for i in order if i in members]
        return doc["surfaces"][name]
