"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay code
[23, 12, 7]. Every word has one codeword within 3 bits; a word exactly 3 bits off has five more at 4 bits. The indices
of all codewords within 4 bits are the segment's keys (six or one). Two words at most 2 bits apart share a key: the word
halfway between them has a codeword within 3 bits, which is within 4 bits of both.

Four or fewer differing bits over three segments leave two cases. Either no segment differs in more than 2 bits, so
the triple of codeword keys meets; or one segment takes 3 or more, the others differ in at most 1 bit together, so one of them
is equal and the other shares a codeword key. Joining on these keys thus loses no link. Candidates are verified by counting bits.

Only distinct fingerprints are keyed, so exact copies cost nothing. Within a key, a breadth-first sweep emits a spanning
forest of the links, not all pairs; buckets beyond `cap` go on in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import neardup
from .common import held, let_go, small_batches, table, trim, written
from .components import components

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, width)
PIECE = 1 << 15


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit fingerprint of one text; 0 for a null text or one without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        part = w[at : min(at + PIECE, n) + words - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
        digests = b"".join(map(xxhash.xxh64_digest, grams, repeat(42)))
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
            trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def golay() -> np.ndarray:
    """The index of the nearest codeword for each of the 2^23 words."""
    return held("golay", _golay)


def _golay() -> np.ndarray:
    message = np.arange(4096, dtype=np.int64)
    rest = message << 11
    for bit in range(22, 10, -1):  # division by the generator x^11+x^9+x^7+x^6+x^5+x+1
        rest = np.where(rest >> bit & 1, rest ^ (0xAE3 << (bit - 11)), rest)
    code = message << 11 | rest
    one = 1 << np.arange(23)
    two = np.array([a | b for i, a in enumerate(one) for b in one[i + 1 :]])
    three = np.array([a | b | c for i, a in enumerate(one) for j, b in enumerate(one[i + 1 :], i + 1) for c in one[j + 1 :]])
    near = np.empty(1 << 23, np.int16)
    for e in np.concatenate([[0], one, two, three]):
        near[code ^ e] = message
    return near


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to six codeword indices for each word, and which of the six places hold one."""
    near = golay()
    flips = np.concatenate([[0], 1 << np.arange(23)])
    found = np.sort(near[words[:, None] ^ flips[None, :]], axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    place = np.cumsum(first, axis=1) - 1
    keys, there = np.zeros((len(words), 6), np.int64), np.zeros((len(words), 6), bool)
    row = np.nonzero(first)
    keys[row[0], place[row]] = found[row]
    there[row[0], place[row]] = True
    return keys, there


def all_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs; the top bits tell the seven kinds of key apart."""
    parts = [(fps >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    coded = [segment_keys(p) for p in parts]
    (a, ma), (b, mb), (c, mc) = coded
    triple = a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :]
    at = np.nonzero(ma[:, :, None, None] & mb[:, None, :, None] & mc[:, None, None, :])
    rows, keys = [at[0]], [triple[at]]
    kind = 1
    for i in range(3):
        for j in range(3):
            if i != j:
                k, m = coded[j]
                at = np.nonzero(m)
                rows.append(at[0])
                keys.append((kind << 40 | parts[i][:, None] << 12 | k)[at])
                kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def _distance(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def sweep(group: np.ndarray, bits: int, across: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints. across: a mark per row; only unlike marks need comparing."""
    edges, left = [], np.arange(len(group))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = _distance(group[left], group[at]) <= bits
            if across is not None:
                hit &= across[left] != across[at]
            if hit.any():
                edges += [(at, x) for x in left[hit]]
                queue += list(left[hit])
                left = left[~hit]
    return edges


def _out(u: list, v: list, parts: list) -> pa.RecordBatch:
    """Links have part -1; a row of an oversized bucket has its fingerprint, the bucket's key and the part it was in."""
    fps, key, part = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
    cat = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
    u, v = cat(u), cat(v)
    part = np.concatenate([np.full(len(u), -1), part]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, fps])), pa.array(np.concatenate([v, key])), pa.array(part)], ["u", "v", "part"])


def _link_runs(bits: int, cap: int):
    """Rows (key, fp) sorted by key to links. A bucket is held `cap` rows at a time; beyond one such part, its rows come out too, to pair off the parts."""

    def forest(group: np.ndarray, u: list, v: list) -> None:
        if len(group) > 1 and (found := sweep(group, bits)):
            e = np.array(found, np.int64)
            u.append(group[e[:, 0]])
            v.append(group[e[:, 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part = None, np.zeros(0, np.uint64), 0  # the bucket that may go on

        def end_part(u, v, parts, last):
            nonlocal held, part
            forest(held, u, v)
            if part or not last:
                parts.append((held.view(np.int64), np.full(len(held), now, np.int64), np.full(len(held), part, np.int64)))
            held, part = np.zeros(0, np.uint64), 0 if last else part + 1

        for b in batches:
            if not b.num_rows:
                continue
            key, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            u, v, parts = [], [], []
            start = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1])
            size = np.diff(np.concatenate([start, [len(key)]]))
            inner = size <= cap
            inner[0] = inner[-1] = False  # these may have begun before this batch or go on after it
            two = start[inner & (size == 2)]
            two = two[_distance(fps[two], fps[two + 1]) <= bits]
            u.append(fps[two])
            v.append(fps[two + 1])
            for k in np.nonzero(inner & (size > 2))[0]:
                forest(fps[start[k] : start[k] + size[k]], u, v)
            for k in np.nonzero(~inner)[0]:
                if key[start[k]] != now:
                    end_part(u, v, parts, True)
                    now = key[start[k]]
                rest = fps[start[k] : start[k] + size[k]]
                while len(rest):
                    if len(held) == cap:
                        end_part(u, v, parts, False)
                    take = cap - len(held)
                    held, rest = np.concatenate([held, rest[:take]]), rest[take:]
            yield _out(u, v, parts)
        u, v, parts = [], [], []
        end_part(u, v, parts, True)
        yield _out(u, v, parts)

    return run


def _pair_off(parts: DataFrame, bits: int) -> DataFrame:
    """Links between unlike parts of an oversized bucket: each two parts meet in one task, which holds two parts at most."""
    many = parts.groupBy("v").agg((F.max("part") + 1).alias("n"))
    met = parts.join(many, "v").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("other <> part")
    met = met.select("v", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "u")

    def run(t: pa.Table) -> pa.Table:
        fps, part = t.column("u").to_numpy(), t.column("part").to_numpy()
        e = np.array(sweep(fps.view(np.uint64), bits, part), np.int64).reshape(-1, 2)
        return pa.table({"u": fps[e[:, 0]], "v": fps[e[:, 1]]})

    return met.groupBy("v", "a", "b").applyInArrow(run, "u long, v long")


def links(fps: DataFrame, bits: int = 4, cap: int = 1 << 16) -> DataFrame:
    """Links (u, v) that connect every two distinct fingerprints at most `bits` (up to 4) apart, directly or over others."""
    if not 0 <= bits <= 4:
        raise ValueError("the keys are complete for at most 4 differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 2000):
                part = every[at : at + 2000]
                rows, keys = all_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], ["key", "fp"])

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each fingerprint makes some 180 rows: dealt anew, by a hash of its own, as the planner drops a second exchange by fp alone.
    rows = fps.select("fp").repartition(parts, F.xxhash64("fp")).mapInArrow(keyed, "key long, fp long").repartition("key").sortWithinPartitions("key")
    out, _ = written(rows.mapInArrow(_link_runs(bits, cap), "u long, v long, part int").distinct())
    more = out.where("part >= 0")
    near = out.where("part < 0").select("u", "v")
    return near if more.isEmpty() else near.unionByName(_pair_off(more, bits))


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of `docs` (doc_id, text; further columns are ignored).

    Texts that are null or have no words get fingerprint 0 and link like others. component_id is the least non-null doc_id
    that is reachable over links of at most `bits` differing bits, itself included; rows with equal ids stay apart as rows.
    An empty table gives an empty result.
    """
    each, _ = written(fingerprints(docs, words))
    distinct = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, bits))
    # Written apart, so that the join by root has exchanges of its own, which adaptive execution can split at a large group.
    grouped, _ = written(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named, _ = written(grouped.groupBy("root").agg(F.min("least").alias("component_id")))
    return each.join(grouped.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays, with all its columns: of the rows with the
    least doc_id those of the least text key, and of these the least text, then the least hash of all columns. Rows without an id stay
    only if no row with an id is in their group. Unlike texts stay, each for its own group, also if they share an id. Texts without words are
    one group; an empty table gives an empty one; further columns pass through whatever their names; long texts count whole."""
    group, _ = written(neardup.groups(docs.select("doc_id", "text")))
    stay = group.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("k"))
    stay = stay.select(F.col("k.t").alias("__t"), F.coalesce("k.doc_id", F.lit(0)).alias("__id"), F.col("k.none").alias("__none"))
    loose = {f.name for f in docs.schema.fields if any(k in f.dataType.simpleString() for k in ("map<", "variant", "interval"))}
    every = [F.col(f"`{c}`") for c in docs.columns if c not in loose]
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"))
    own = F.col("doc_id").cast("long")
    row = F.struct(F.col("text").alias("text"), F.xxhash64(*every).alias("hash"), rest.alias("rest")).alias("__row")
    rows = docs.select(row, neardup.text_keys(F.col("text")).alias("__t"), F.coalesce(own, F.lit(0)).alias("__id"), own.isNull().alias("__none"))
    # By text and id, as the join is, so that whole rows move once, with one copy of the text unless a column has no order; repeated rows are combined before.
    least = F.min_by("__row", F.struct("__row.text", "__row.hash")) if loose else F.min("__row")
    one = rows.groupBy("__t", "__id", "__none").agg(least.alias("__row")).join(stay, ["__t", "__id", "__none"], "left_semi")
    return one.select(*(F.col("__row.text" if c.lower() == "text" else f"__row.rest.`{c}`").alias(c) for c in docs.columns))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return deduplicate(docs)
