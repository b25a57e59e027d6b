"""Mixing sources to target weights by Pfair scheduling.

Each source is a task with a weight of share / period. Its i-th block (from 1) is released at slot (i-1)/w, rounded down, and due by slot
i/w, rounded up. In every slot the released block with the earliest deadline goes next. After any number t of slots each
source has then been given less than one block more or less than t * w, where w is the exact weight, a fraction.

Each slot depends on those before, so one task runs through the schedule, a step for each block, and gives its slots out as rows as it goes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import count, islice
from math import ceil, floor, gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from .common import small_batches, table

BLOCK, PERIOD, MOST_SOURCES = 16, 2000, 100_000


def whole_shares(weights: dict, period: int = PERIOD) -> dict:
    """Weights as whole shares of at least 1 that sum to about `period` (by largest remainder), in lowest terms."""
    total = sum(map(Fraction, weights.values()))
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {k: Fraction(w) * max(period, len(weights)) / total for k, w in weights.items()}
    shares = {k: max(1, floor(x)) for k, x in exact.items()}
    left = max(period, len(weights)) - sum(shares.values())
    for k in sorted(exact, key=lambda k: (floor(exact[k]) - exact[k], str(k)))[: max(0, left)]:
        shares[k] += 1
    by = reduce(gcd, shares.values(), 0) or 1
    return {k: s // by for k, s in shares.items()}


def in_order(keys) -> list:
    return sorted(keys, key=lambda k: (k is None, str(k)))


def turns(shares: list[int]) -> Iterator[tuple[int, int]]:
    """(source, block), both from 0, of slot after slot without end; shares in the order of sources. Ties of deadlines go to the earlier release, then to the order of sources."""
    period, ready = sum(shares), []
    coming = [(0, n, 0) for n in range(len(shares))]
    for slot in count():
        while coming and coming[0][0] <= slot:
            release, n, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(i + 1) * period // shares[n]), release, n, i))
        _, _, n, i = heapq.heappop(ready)
        yield n, i
        heapq.heappush(coming, ((i + 1) * period // shares[n], n, i + 1))


def schedule(shares: dict) -> list:
    """Which source each slot of one period gets."""
    names = in_order(shares)
    return [names[n] for n, _ in islice(turns([shares[k] for k in names]), sum(shares.values()))]


def exact_shares(weights: dict) -> dict:
    """Weights as whole shares in lowest terms, in exactly the proportions given."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    whole = lcm(*(w.denominator for w in exact.values()))
    shares = {k: int(w * whole) for k, w in exact.items()}
    by = gcd(*shares.values())
    return {k: s // by for k, s in shares.items()}


def slots(spark: SparkSession, shares: dict, blocks: dict) -> DataFrame:
    """(__source, __none, block, slot) of every block there is; a source that has run out leaves its slots empty."""
    names = in_order(shares)
    each, size = [shares[k] for k in names], [blocks[k] for k in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            there = ((n, i, slot) for slot, (n, i) in enumerate(turns(each)) if i < size[n])
            left = sum(size)
            while left:
                n, i, slot = zip(*islice(there, min(left, 65536)))
                left -= len(n)
                columns = [pa.array([names[x] or "" for x in n], pa.string()), pa.array([names[x] is None for x in n], pa.bool_()), pa.array(i, pa.int64()), pa.array(slot, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["__source", "__none", "block", "slot"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "__source string, __none boolean, block long, slot long")


def counted(docs: DataFrame) -> dict:
    """Documents of each source; one row for each source comes to the driver, and more than MOST_SOURCES are refused."""
    rows = docs.groupBy(F.col("source").cast("string").alias("source")).count().limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return {r["source"]: r["count"] for r in rows}


def targets(counts: dict) -> dict:
    """Default target weights: the square root of each source's size, which tempers large sources."""
    return {k: Fraction(round(1000 * n**0.5), 1000) for k, n in counts.items()}


def packed(docs: DataFrame) -> DataFrame:
    """(__row, __source, __none, __place, __tie): each row as one column, so that no name of its own clashes, and where it belongs.

    __place mixes by a hash of the id and of all that the row holds (maps apart), so rows of one id, or of none, are spread as well.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    held = [F.col(f"`{c}`") for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind]
    row, source = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.col("source").cast("string")
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *held)
    return docs.select(row.alias("__row"), F.coalesce(source, F.lit("")).alias("__source"), source.isNull().alias("__none"), place.alias("__place"), F.struct(F.col("doc_id").cast("string").alias("i"), F.hash(*held).alias("h")).alias("__tie"))


def ranked(docs: DataFrame, counts: dict, slots: DataFrame, per_bin: int = 1024, block: int = BLOCK) -> DataFrame:
    """(__row, __source, __none, __rank, __slot): each row's place (from 0) in its source, in an order mixed by hashes of the row, and the
    slot of its block. Rows of one place and id follow by another hash; those that are still tied are equal, but for a collision.

    A source may hold most rows, so no window spans one: its rows fall into bins by hash, about per_bin rows each, are numbered within a
    bin, and the bins' sizes, added up, give where each starts. How many bins a source has is a row for each source, so it is broadcast.
    A bin's start comes with the slots of the few blocks that the bin has rows of, so the texts are dealt out once.
    """
    rows = [(k or "", k is None, ceil(n / per_bin)) for k, n in counts.items()]
    bins = F.broadcast(docs.sparkSession.createDataFrame(rows, "__source string, __none boolean, __bins long"))
    binned = packed(docs).join(bins, ["__source", "__none"]).withColumn("__bin", F.pmod(F.shiftright("__place", 16), F.col("__bins"))).drop("__bins")
    # One exchange serves the window and the join: both go by the same three columns, none of them null.
    by = ["__source", "__none", "__bin"]
    inside = Window.partitionBy(*by).orderBy("__place", "__tie")
    before = Window.partitionBy("__source", "__none").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    start = binned.groupBy(*by).count().select(*by, "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    first, last = F.floor(F.col("__start") / block), F.floor((F.col("__start") + F.col("count") - 1) / block)
    wanted = start.select(*by, "__start", F.explode(F.sequence(first, last)).alias("block")).join(slots, ["__source", "__none", "block"])
    start = wanted.groupBy(*by).agg(F.first("__start").alias("__start"), F.min("block").alias("__first"), F.sort_array(F.collect_list(F.struct("block", "slot"))).alias("__slots"))
    met = binned.withColumn("__in", F.row_number().over(inside) - 1).join(start, by).withColumn("__rank", F.col("__start") + F.col("__in"))
    slot = F.element_at("__slots", (F.floor(F.col("__rank") / block) - F.col("__first") + 1).cast("int"))["slot"]
    return met.select("__row", F.when(~F.col("__none"), F.col("__source")).alias("__source"), "__rank", slot.alias("__slot"))


def scheduled(docs: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """(__row, __source, __rank, __slot) of every row."""
    counts = counted(docs)
    weights = targets(counts) if weights is None else {k: weights.get(k, min(weights.values())) for k in counts}
    shares = exact_shares(weights) if counts else {}
    given = slots(docs.sparkSession, shares, {k: ceil(n / block) for k, n in counts.items()})
    return ranked(docs, counts, given, block=block)


def interleave(docs: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """docs with __source, __rank, __block, __slot: the slot of the global schedule in which the row's block goes out.

    All rows are scheduled; a source that has run out leaves its slots empty, so the others keep their proportions. A null source is a
    source; sources without a weight get the least one given; an empty table gives an empty one. Rows of one slot follow by rank. Null and
    repeated ids are rows like others, equal rows get places next to each other. Further columns pass through whatever their names,
    but for columns of these four names, which are replaced. Texts are neither read nor cut.
    """
    own = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in ("__source", "__rank", "__block", "__slot")]
    return scheduled(docs, weights, block).select(*own, "__source", "__rank", F.floor(F.col("__rank") / block).alias("__block"), "__slot")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block (within the source), slot (of the whole schedule), rank (within the source)."""
    docs = table(spark, sf_dir, "documents").drop("text")
    return interleave(docs).select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__rank").alias("rank"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in scheduled order: files and their rows follow the slots."""
    small_batches(spark)
    found = scheduled(docs).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "__slot", "__rank").sortWithinPartitions("__slot", "__rank")
    return found.select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
