"""Near copies by the Jaccard similarity of five-word shingles: min-hash bands of a text propose, the shingles decide. Fingerprints within 4
bits (module simhash) find few texts of similarity 0.8, so they do not propose here.

A text's fingerprints are BANDS hashes of DEPTH least shingle values each, under as many orders of all shingles. Two texts of similarity s
have an equal one with chance 1 - (1 - s^DEPTH)^BANDS, which is 0.9999 at 0.8. Texts that hang together by shared fingerprints are
candidates, and are compared by their shingles, by a sweep that loses no link: a group of bounded size as a whole, a larger one fingerprint
by fingerprint. Where the texts of one fingerprint are too many for one task, they are cut into blocks, and each two blocks meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_table, let_go, trim, written
from .components import components

WORDS, BANDS, DEPTH = 5, 24, 5
#: Texts left in a sweep from which they are counted together.
SMALL = 16
#: Texts, and bytes of theirs or of their shingles, that may meet in one task.
GROUP, GROUP_BYTES = 4096, 16 << 20
#: Similarity from which texts are near copies, as a fraction.
LEAST = (4, 5)
PIECE = 1 << 12
_DRAWN = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * DEPTH, 1), dtype=np.uint64)
TIMES, PLUS = _DRAWN[0] << np.uint64(1) | np.uint64(1), _DRAWN[1]


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def text_key(words: list[bytes]) -> int:
    """Equal for texts of equal words; 0 without words."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) if words else 0


def text_keys(text: Column) -> Column:
    """text_key of a column."""

    @F.arrow_udf("long")
    def of(text: pa.Array) -> pa.Array:
        return _signed([text_key(text_words(t.as_py())) for t in text])

    return of(text.cast("string"))


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, in order; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(42))), ">u8").astype(np.uint64))


def bands(held: np.ndarray) -> list[int]:
    """The fingerprints of a text with these shingles."""
    least = np.full(BANDS * DEPTH, ~np.uint64(0))
    for at in range(0, len(held), PIECE):
        least = np.minimum(least, (held[None, at : at + PIECE] * TIMES + PLUS).min(axis=1))
    rows = least.reshape(BANDS, DEPTH)
    return [xxhash.xxh3_64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)]


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for b in batches:
        for s in range(0, b.num_rows, 256):
            part = b.slice(s, 256)
            keys, prints, count = [], [], []
            for t in part.column(1):
                words = text_words(t.as_py())
                keys.append(text_key(words))
                values = shingles(words)
                prints += bands(values) if words else []
                count.append(len(values))
            ends = np.cumsum([0, *(BANDS * bool(n) for n in count)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(prints))
            size = np.maximum(pc.fill_null(pc.binary_length(part.column(1)), 0).to_numpy(zero_copy_only=False), 8 * np.array(count, np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), _signed(keys), lists, pa.array(size, pa.int64())], ["doc_id", "t", "prints", "size"])
        trim()


def links(each: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(t, prints, size) and (t, text) of texts to links (u, v) between near copies; none if no two texts share a fingerprint.

    Texts that hang together by shared fingerprints are candidates. Candidate groups of up to GROUP texts and GROUP_BYTES meet in one task
    each, where every text arrives once and is shingled again, as shingles take more room than text; larger ones go on fingerprint by
    fingerprint, in one step however many unlike texts share one.
    """
    spark, spent = each.sparkSession, []

    def kept(df: DataFrame) -> DataFrame:
        df, at = written(df)
        spent.append(at)
        return df

    rows = each.groupBy("t").agg(F.first("prints").alias("prints"), F.first("size").alias("size"))
    keyed = kept(rows.select("t", F.explode("prints").alias("key")))
    least = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("t").alias("a")).where("n > 1").select("key", "a")
    candidates = kept(keyed.join(least, "key").where("t <> a").select("t", "a").distinct())
    found = None
    if not candidates.isEmpty():
        group = kept(components(candidates.select(F.col("t").alias("u"), F.col("a").alias("v"))).join(rows.select(F.col("t").alias("node"), "size"), "node"))
        sizes = group.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        sizes = kept(sizes.withColumn("fits", (F.col("n") <= GROUP) & (F.col("size") <= GROUP_BYTES)).select("root", "fits"))
        placed = kept(group.join(sizes, "root").select(F.col("node").alias("t"), "root", "size", "fits"))
        # The candidates grow with the documents, so they are not broadcast at any size.
        sets = texts.join(placed.where("fits").drop("size").hint("merge"), "t").groupBy("t", "root").agg(F.first("text").alias("text"))
        found, _ = written(sets.groupBy("root").applyInArrow(_swept, "u long, v long"))
        large = placed.where("not fits").select("t", "size")
        if not large.isEmpty():
            more, _ = written(bucketwise(keyed.join(large.hint("merge"), "t"), texts))
            found = found.unionByName(more)
    for at in spent:
        drop_table(spark, at)
    return found


def forest(sets: list[np.ndarray], across: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among texts by their shingles. across: a mark per text; only unlike marks need comparing.

    Texts are in the order of their sizes, so those that may be alike by their sizes are a run; a reached text is held against all in its
    run that are not yet reached, by one count.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    every, place = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    size = np.array([len(sets[k]) for k in order])
    begin = np.cumsum(size) - size
    edges, left = [], np.arange(len(sets))
    mark = np.zeros(len(every), bool)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            low, high = np.searchsorted(size[left], -(-LEAST[0] * size[at] // LEAST[1])), np.searchsorted(size[left], LEAST[1] * size[at] // LEAST[0], "right")
            met = left[low:high]
            if across is not None:
                met = met[across[order[met]] != across[order[at]]]
            if not len(met):
                continue
            mine = place[begin[at] : begin[at] + size[at]]
            mark[mine] = True
            if len(met) < SMALL:
                common = np.array([np.count_nonzero(mark[place[begin[k] : begin[k] + size[k]]]) for k in met])
            else:
                run = slice(met[0], met[-1] + 1)
                common = np.add.reduceat(mark[place[begin[met[0]] : begin[met[-1]] + size[met[-1]]]], begin[run] - begin[met[0]], dtype=np.int64)[met - met[0]]
            mark[mine] = False
            hit = met[LEAST[1] * common >= LEAST[0] * (size[at] + size[met] - common)]
            if len(hit):
                edges += [(order[at], order[k]) for k in hit]
                queue += list(hit)
                left = left[~np.isin(left, hit, assume_unique=True)]
    return edges


def _swept(t: pa.Table) -> pa.Table:
    """Links (u, v) among rows (t, text); of two blocks a and b, those between rows of unlike parts."""
    keys = t.column("t").to_numpy()
    order = np.argsort(keys)
    texts = t.column("text")
    part = t.column("part").to_numpy()[order] if "part" in t.column_names and t.column("a")[0] != t.column("b")[0] else None
    e = np.array(forest([shingles(text_words(texts[int(k)].as_py())) for k in order], part), np.int64).reshape(-1, 2)
    return pa.table({"u": keys[order][e[:, 0]], "v": keys[order][e[:, 1]]})


def bucketwise(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) among texts of large candidate groups, from (t, key, size) and (t, text): all texts of one key meet in one task if they
    are up to GROUP texts and GROUP_BYTES; else they are cut into blocks of about half of that by a hash, and each two blocks meet."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where("n > 1")
    fits = (F.col("n") <= GROUP) & (F.col("size") <= GROUP_BYTES)
    blocks = F.ceil(F.greatest(2 * F.col("n") / GROUP, 2 * F.col("size") / GROUP_BYTES))
    sizes = sizes.select("key", F.when(fits, F.lit(1)).otherwise(blocks).cast("long").alias("blocks"))
    met, _ = written(rows.select("t", "key").join(sizes.hint("merge"), "key").withColumn("part", F.pmod(F.xxhash64("t"), "blocks")))
    one = texts.join(met.select("t").distinct().hint("merge"), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("t", "key", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    return met.join(one.hint("merge"), "t").groupBy("key", "a", "b").applyInArrow(_swept, "u long, v long").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, t, root, component_id): one row for each row of docs (doc_id, text), with the least non-null doc_id of its group of near copies.

    t tells texts apart by their words; texts without words are equal. root tells groups apart, also where unlike texts share an id or have
    none. An empty table gives an empty result; further columns are ignored; texts count whole however long they are.
    """
    each, _ = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_described, "doc_id long, t long, prints array<long>, size long"))
    texts = each.groupBy("t").agg(F.min("doc_id").alias("least"))
    near = links(each.select("t", "prints", "size"), docs.select(text_keys(F.col("text")).alias("t"), F.col("text").cast("string").alias("text")))
    if near is None:
        rooted = texts.withColumn("root", F.col("t"))
    else:
        rooted = texts.join(components(near), F.col("t") == F.col("node"), "left").select("t", "least", F.coalesce("root", "t").alias("root"))
    # Written apart, so that the join has exchanges of its own, which adaptive execution can split at a large group.
    rooted, _ = written(rooted)
    named, _ = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return each.select("doc_id", "t").join(rooted.join(named, "root").select("t", "root", "component_id"), "t")
