"""Stacks of datasets: priority flattening, overlap analysis, glue sets, and the storage catalogue.

Layers are rows (pos, tileset, lod, x, y, flags), a larger pos being nearer the top.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import flags as fl
from ..functions.text import glob_pattern
from ..plans.levels import cut
from . import index as ix

KEY = ["lod", "x", "y"]


def aggregate(layers: DataFrame, alien: bool = False, priority: str = "pos") -> DataFrame:
    """Flattens a stack: of each tile the topmost layer with a mesh of the wanted alien state stands; its value is its non-alien flags
    with the layer's reference (pos + 1) in the upper bits. One aggregation that combines before its shuffle."""
    fit = layers.where(fl.real("flags") & (fl.alien("flags") == F.lit(alien)))
    value = F.col("flags").bitwiseAND(F.lit(fl.ANY & ~fl.ALIEN).cast("bigint")) + F.shiftleft((F.col("pos") + 1).cast("bigint"), 16)
    return fit.groupBy(*KEY).agg(F.max_by(value, priority).alias("flags"))


def incidence(layers: DataFrame, least: int = 1) -> DataFrame:
    """Pairs (a, b) of layers, a below b, with at least so many common tiles: an equi-join on the tile, not a join of all pairs."""
    t = layers.select(*KEY, "pos").distinct()
    met = t.withColumnRenamed("pos", "a").join(t.withColumnRenamed("pos", "b"), KEY).where("a < b")
    return met.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def cliques(pairs: DataFrame, with_layer: int | None = None, most: int = 6) -> DataFrame:
    """Sets of two or more layers that all overlap pairwise, as sorted arrays; with a given layer in them, if wanted.

    Grown one layer a round: a clique (.., b) and an edge (b, c) give (.., b, c) if every other member has an edge to c. Rounds stop at
    `most` members or when nothing grows. Each is one join on the last member and one anti join, and is written once.
    """
    edges = cut(pairs.select("a", "b"))
    now = edges.select(F.array("a", "b").alias("id"))
    out = now
    for _ in range(most - 2):
        grown = now.withColumn("a", F.element_at("id", -1)).join(edges, "a").select(F.concat("id", F.array("b")).alias("id"), "b")
        need = grown.select("id", "b", F.explode(F.slice("id", 1, F.size("id") - 2)).alias("m"))
        missing = need.join(edges.select(F.col("a").alias("m"), "b"), ["m", "b"], "left_anti").select("id").distinct()
        now = cut(grown.join(missing, "id", "left_anti").select("id"))
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out if with_layer is None else out.where(F.array_contains("id", with_layer))


def rule_breaks(glues: DataFrame, tags: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Glue ids (id: array of positions) that break a rule, with the rule's text. tags: (pos, tag).

    tag.sole-occurrence(t): at most one member has t. tag.common-match(glob): all members' tags that match are the same.
    tag.no-glue(t): no member has t.
    """
    each = glues.select("id", F.explode("id").alias("pos")).join(tags, "pos")
    out = None
    for name, arg in rules:
        if name == "tag.sole-occurrence":
            hit = each.where(F.col("tag") == arg).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
        elif name == "tag.common-match":
            hit = each.where(F.col("tag").rlike(glob_pattern(arg))).groupBy("id").agg(F.count_distinct("tag").alias("n")).where("n > 1")
        elif name == "tag.no-glue":
            hit = each.where(F.col("tag") == arg).groupBy("id").agg(F.count("*").alias("n"))
        else:
            raise ValueError(f"unknown rule {name}")
        hit = hit.select("id", F.lit(f"{name}({arg})").alias("rule"))
        out = hit if out is None else out.unionByName(hit)
    return out


def parse_rules(text: str) -> list[tuple[str, str]]:
    """One rule a line, name(argument); # begins a comment."""
    out = []
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if line:
            name, _, arg = line.partition("(")
            if not arg.endswith(")"):
                raise ValueError(f"not a rule: {line}")
            out.append((name.strip(), arg[:-1].strip()))
    return out


def newest_versions(stored: DataFrame, tag: str | None = None) -> DataFrame:
    """Of each base id the newest version, among those with the tag if one is given."""
    if tag is not None:
        stored = stored.where(F.array_contains("tags", tag))
    return stored.groupBy("base_id").agg(F.max("version").alias("version"), F.max_by("tileset", "version").alias("tileset"), F.max_by("pos", "version").alias("pos"))


def generate_set(layers: list[DataFrame], high: int) -> DataFrame:
    """Tiles where layers (bottom to top) need a glue.

    Their spheres of influence meet: of tiles with a mesh or influenced ones, the finest level's descendants down to `high`, all
    ancestors, and 2 x 2 siblings. What upper layers cover for certain goes: the watertight tiles of the top, and those of the layers between,
    with their finest level's descendants; the bottom covers nothing. Ancestors and siblings of what is left come back in, so that
    every tile can be reached. Kept as quads until what is left is known; each sphere and meeting is used twice, so it is written once.
    """

    def sphere(s: DataFrame) -> DataFrame:
        seed = ix.simplify(s, fl.MESH | fl.ALIEN)
        return cut(ix.quads(ix.grow_up(seed, 0, 1)).unionByName(ix.complete_down(seed, high, 1, from_bottom=True).where("lod > qlod")))

    *_, top = layers
    met = sphere(top)
    for s in layers[:-1]:
        met = cut(ix.quad_intersect(met, sphere(s)))
    tiles = ix.expand(ix.prune(met), 0, high)
    tiles = ix.subtract(tiles, ix.simplify(top, fl.WATERTIGHT))
    for s in layers[1:-1]:
        sure = ix.complete_down(ix.simplify(s, fl.WATERTIGHT), high, 1, from_bottom=True)
        tiles = ix.subtract(tiles, ix.expand(sure, 0, high))
    return ix.grow_up(tiles, 0, 1)


def ancestor_asof(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """For each wanted tile and source, the deepest existing tile at or above it: ancestor keys, an equi-join, max_by level."""
    up = ix.ancestors(wanted.select(*KEY).distinct())
    found = up.join(sources.select("source", *KEY, "flags"), KEY)
    return found.groupBy("source", "own_lod", "own_x", "own_y").agg(F.max("lod").alias("from_lod"), F.max_by("flags", "lod").alias("flags"))


def merge_sources(current: DataFrame, parent: DataFrame, mergeable: Column) -> DataFrame:
    """Source lists (tile, id, ...) merged by id: the current source if there is one in mergeable range, the parent's otherwise."""
    c, p = current.select("tile", "id", F.struct("*").alias("c")), parent.select("tile", "id", F.struct("*").alias("p"))
    both = c.join(p, ["tile", "id"], "full")
    return both.select("tile", "id", F.when(F.col("c").isNotNull() & (mergeable | F.col("p").isNull()), "current").otherwise("parent").alias("taken"), F.coalesce(F.when(mergeable | F.col("p").isNull(), F.col("c.lod")), F.col("p.lod")).alias("from_lod"))


def glue_order(glues: DataFrame, stack: DataFrame) -> DataFrame:
    """Ranks each layer's glues: by ids read from the top, a layer nearer the top first; of prefixes the longer first. A glue whose top
    member is another layer is alien: it is compared from its next member on.

    stack: (pos, tileset). glues: (top, id array of positions, bottom to top). The alphabet is pos counted from the top.
    """
    size = stack.agg(F.max("pos").alias("last"))
    met = glues.crossJoin(F.broadcast(size)).withColumn("rev", F.reverse("id"))
    alien = F.element_at("rev", 1) != F.col("top")
    body = F.when(alien, F.slice("rev", 2, F.size("rev"))).otherwise(F.col("rev"))
    key = F.concat(F.transform(body, lambda p: F.col("last") - p), F.array(F.lit(1 << 30)))
    w = Window.partitionBy("top").orderBy("key", "id")
    return met.withColumn("key", key).select("top", "id", F.row_number().over(w).alias("rank"))


def pending_glues(glues: DataFrame, unique: DataFrame) -> DataFrame:
    """Pending glues whose members are all in the subset, counted by their top member."""
    pending = glues.where("state = 'pending'")
    gone = pending.select("id", F.explode("id").alias("pos")).join(unique.select("pos"), "pos", "left_anti").select("id").distinct()
    return pending.join(gone, "id", "left_anti").groupBy(F.element_at("id", -1).alias("top")).agg(F.count("*").alias("pending"))


def normalized_id(stack: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids (name, member) as arrays in stack order, once each."""
    return ids.join(stack, "member").groupBy("name").agg(F.array_sort(F.collect_set(F.struct("pos", "member"))).alias("m")).select("name", F.transform("m", lambda s: s["member"]).alias("id"))


def ancestry(links: DataFrame) -> DataFrame:
    """(id, parent, depth) over links (id, parent): each body's parent, its parent's parent and so on; a null parent ends the chain."""
    text = """with recursive up(id, parent, depth) as (select id, parent, 0 from {links} where parent is not null
      union all select up.id, l.parent, up.depth + 1 from up join {links} l on l.id = up.parent where l.parent is not null)
    select id, parent, depth from up"""
    return links.sparkSession.sql(text, links=links)
