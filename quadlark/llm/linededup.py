"""Line dedup with content-defined chunks.

A rolling hash runs over the hashes of a text's lines that hold words, WIDTH lines at a time. A place is a boundary if its value is the
least of some WINDOW consecutive places, or the first or last one; so boundaries depend on the lines around them alone, stand
wherever a passage stands, and any passage of WIDTH + WINDOW - 1 lines or more holds one. A chunk is the lines that the hash has rolled over at
a boundary, with the blank lines between them, or one line of LONG_LINE or more words. A chunk found in several places is repeated; its
first place (least doc_id, then position) keeps it. Everywhere else it is widened line by line, as far as the kept copy goes on alike, up
to where the next boundary must be; chunks that touch join to runs, and these are taken out.

Hashes only propose. The lines that may go and those of the kept copies are compared as bytes, hash by hash; chunks with a hash that
stands for unlike lines are grouped anew by their bytes. So nothing goes that doesn't stand, byte for byte, at an earlier place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import drop_table, let_go, small_batches, table, trim, written

WIDTH, WINDOW, LONG_LINE = 2, 2, 50
MASK, BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15 | 1
#: What a hash of a line is not: there is no such line.
NONE = 0


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) or 1


def rolled(hashes: list[int], width: int = WIDTH) -> list[int]:
    """The rolling hash over each `width` consecutive hashes."""
    out, value, oldest = [], 0, pow(BASE, width, 1 << 64)
    for k, h in enumerate(hashes):
        value = (value * BASE + h - (hashes[k - width] * oldest if k >= width else 0)) & MASK
        if k >= width - 1:
            out.append((value * BASE & MASK) >> 16)
    return out


def boundaries(values: list[int], window: int = WINDOW) -> list[int]:
    """The places whose value is the least of some `window` consecutive ones, and the first and the last."""
    found = {0, len(values) - 1} if values else set()
    for s in range(len(values) - window + 1):
        part = values[s : s + window]
        low = min(part)
        found.update(s + k for k, v in enumerate(part) if v == low)
    return sorted(found)


Chunk = tuple[int, int, int, int, int, int]


def chunks(lines: list[str], hash_of: Callable[[str], int] = line_hash, width: int = WIDTH, window: int = WINDOW, long_line: int = LONG_LINE) -> list[Chunk]:
    """(first line, number of lines, hash of the first line, hash of the others, hashes of the lines before and after) of each chunk."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    hashes = [hash_of(lines[i]) for i in full]
    around = [NONE, *hashes, NONE]
    out = []
    for k in boundaries(rolled(hashes, width), window):
        rest = hashes[k + 1] if width == 2 else rolled(hashes[k + 1 : k + width], width - 1)[0]
        out.append((full[k], full[k + width - 1] - full[k] + 1, hashes[k], rest, around[k], around[k + width + 1]))
    out += [(i, 1, h, NONE, around[k], around[k + 2]) for k, (i, h) in enumerate(zip(full, hashes)) if len(lines[i]) >= 2 * long_line - 1 and len(lines[i].split()) >= long_line]
    return out


def covered(lines: list[str], at: list[int], n: list[int], left: list[bool], right: list[bool]) -> np.ndarray:
    """Which lines the chunks cover, widened by a line where told; and blank lines between covered ones."""
    full = np.array([i for i, x in enumerate(lines) if x.strip()], int)
    place = np.searchsorted(full, np.array(at, int))
    last = np.searchsorted(full, np.array(at, int) + np.array(n, int) - 1)
    there = np.zeros(len(full), bool)
    for a, b, more, less in zip(place.tolist(), last.tolist(), left, right):
        there[max(0, a - bool(more)) : b + bool(less) + 1] = True
    out = np.zeros(len(lines), bool)
    out[full[there]] = True
    for a, b in zip(full[:-1][there[:-1] & there[1:]], full[1:][there[:-1] & there[1:]]):
        out[a:b] = True
    return out


def _key(text) -> F.Column:
    """Tells rows of one doc_id apart; equal rows are one document."""
    return F.xxhash64(text)


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _chunk_rows(hash_of: Callable[[str], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            row, found = [], []
            for k, t in enumerate(b.column(2)):
                text = t.as_py()
                here = chunks(text.split("\n"), hash_of) if text else []
                row += [k] * len(here)
                found += here
            take = pa.array(row, pa.int32())
            at, n, *hashes = zip(*found) if found else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(at, pa.int32()), pa.array(n, pa.int32()), *map(_signed, hashes)], ["id", "key", "at", "n", "h", "rest", "before", "after"])

    return run


_MARK = ("at", "n", "kept", "left", "right")


def marked(docs: DataFrame, hash_of: Callable[[str], int] = line_hash) -> DataFrame:
    """docs with __chunks, the repeated chunks of each row's text; null where there are none. `kept` marks the first places.

    Chunks travel as numbers, counted before the shuffle, so a chunk in a third of all texts is one row for each task. Joining
    the repeats back is a plain equi-join, whose hot keys adaptive execution splits.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), _key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    found, _ = written(rows.mapInArrow(_chunk_rows(hash_of), "id long, key long, at int, n int, h long, rest long, before long, after long").distinct())
    twice = found.groupBy("h", "rest").agg(F.count("*").alias("times"), F.min(F.struct("id", "key", "at", "before", "after")).alias("first")).where("times > 1")
    alike = [(F.col(c) == F.col(f"first.{c}")) & (F.col(c) != NONE) for c in ("before", "after")]
    kept = F.struct("id", "key", "at") == F.struct("first.id", "first.key", "first.at")
    again = found.join(twice.select("h", "rest", "first"), ["h", "rest"]).select("id", "key", "at", "n", kept.alias("kept"), alike[0].alias("left"), alike[1].alias("right"))
    by_text = again.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_list(F.struct(*_MARK)).alias("__chunks"))
    return docs.join(by_text, (F.col("doc_id") == F.col("__id")) & (_key(F.col("text")) == F.col("__key")), "left").drop("__id", "__key")


def _marks(places: list[dict], kept: bool | None = None) -> list[list]:
    those = [x for x in places if kept is None or x["kept"] == kept]
    return [[x[c] for x in those] for c in ("at", "n", "left", "right")]


def unlike_hashes(found: DataFrame, hash_of: Callable[[str], int] = line_hash) -> DataFrame:
    """(h): hashes that stand for unlike lines among those that may go and those of the kept copies: bytes compared within each hash,
    combined before the shuffle."""

    def lines_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, int] = {}
            for t, c in zip(b.column(0), b.column(1)):
                lines, places = t.as_py().split("\n"), c.as_py()
                at, n, _, _ = _marks(places, True)
                stays = covered(lines, at, n, [True] * len(at), [True] * len(at))
                for i in np.nonzero(stays | covered(lines, *_marks(places, False)))[0]:
                    if lines[i].strip():
                        seen[lines[i]] = 0
            yield pa.RecordBatch.from_arrays([_signed([hash_of(x) for x in seen]), pa.array(list(seen), pa.string())], ["h", "line"])

    lines = found.where("__chunks is not null").select(F.col("text").cast("string"), "__chunks").mapInArrow(lines_out, "h long, line string")
    return lines.groupBy("h").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("h")


def regrouped(found: DataFrame, bad: DataFrame, hash_of: Callable[[str], int]) -> DataFrame:
    """`found` anew where hashes stand for unlike lines: chunks with such a line are grouped by their bytes and not widened, others
    are not widened into such a line. All by joins on the hashes, however many there are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, k, t, c in zip(*(b.column(x).to_pylist() for x in range(4))):
                lines = t.split("\n")
                full = [x for x, line in enumerate(lines) if line.strip()]
                place = {x: y for y, x in enumerate(full)}
                around = [NONE, *(hash_of(lines[x]) for x in full), NONE]
                for m in c:
                    a, z = place[m["at"]], place[m["at"] + m["n"] - 1]
                    chunk = "\n".join(lines[x] for x in full[a : z + 1])
                    out.append((i, k, m["at"], m["n"], m["kept"], m["left"], m["right"], around[a], around[z + 2], around[a + 1 : z + 2], chunk))
            columns = list(zip(*out)) if out else [()] * 11
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()]
            hashes = pa.array([np.array(x, np.uint64).view(np.int64).tolist() for x in columns[9]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(columns, kinds)), _signed(columns[7]), _signed(columns[8]), hashes, pa.array(columns[10], pa.string())], names)

    names = ["id", "key", "at", "n", "kept", "left", "right", "before", "after", "hashes", "chunk"]
    kinds = "id long, key long, at int, n int, kept boolean, left boolean, right boolean, before long, after long, hashes array<long>, chunk string"
    given = found.where("__chunks is not null").select(F.col("doc_id").cast("long"), _key(F.col("text")), F.col("text").cast("string"), "__chunks")
    each, _ = written(given.mapInArrow(rows, kinds))
    place = ["id", "key", "at", "n"]
    inside = each.select(*place, F.explode("hashes").alias("h")).join(bad, "h").select(*place).distinct().withColumn("unlike", F.lit(True))
    each = each.join(inside, place, "left")
    for c, side in (("before", "left"), ("after", "right")):
        each = each.join(bad.select(F.col("h").alias(c), F.lit(True).alias("no")), c, "left").withColumn(side, F.col(side) & F.col("no").isNull()).drop("no")
    fine = each.where("unlike is null").select(*place, "kept", "left", "right")
    anew = each.where("unlike").distinct()
    first = anew.groupBy("chunk").agg(F.count("*").alias("times"), F.min(F.struct("id", "key", "at")).alias("first")).where("times > 1")
    never = F.lit(False)
    anew = anew.join(first, "chunk").select(*place, (F.struct("id", "key", "at") == F.col("first")).alias("kept"), never.alias("left"), never.alias("right"))
    by_text = fine.unionByName(anew).groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_list(F.struct(*_MARK)).alias("__chunks"))
    whole = found.drop("__chunks")
    return whole.join(by_text, (F.col("doc_id") == F.col("__id")) & (_key(F.col("text")) == F.col("__key")), "left").drop("__id", "__key")


def remove_repeats(docs: DataFrame, hash_of: Callable[[str], int] = line_hash, least_words: int = 0) -> DataFrame:
    """docs with the same columns, its text without repeated passages, and __removed, the numbers of the lines that went.

    Every row stays, with an empty text if all its lines were repeats. Null texts stay null, rows without an id stay as they are, equal
    rows are treated alike, rows of one id with unlike texts are documents of their own, texts are taken whole however long they are, an
    empty table gives an empty one, and further columns pass through. least_words, a caller's choice, spares runs of fewer words.
    """
    found, at = written(marked(docs, hash_of))
    bad, spent = written(unlike_hashes(found, hash_of))
    if not bad.isEmpty():
        found, _ = written(regrouped(found, bad, hash_of))
        drop_table(docs.sparkSession, at)
    drop_table(docs.sparkSession, spent)

    @F.arrow_udf("struct<text string, removed array<int>>")
    def without(text: pa.Array, places: pa.Array) -> pa.Array:
        left, gone = [], []
        for t, c in zip(text, places.to_pylist()):
            lines = t.as_py().split("\n")
            there = covered(lines, *_marks(c, False))
            if least_words:
                edges = np.nonzero(np.diff(np.concatenate([[0], there.astype(int), [0]])))[0].reshape(-1, 2)
                for a, b in edges.tolist():
                    if sum(len(x.split()) for x in lines[a:b]) < least_words:
                        there[a:b] = False
            gone.append(np.nonzero(there)[0].tolist())
            left.append("\n".join(x for x, out in zip(lines, there.tolist()) if not out))
        trim()
        return pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(gone, pa.list_(pa.int32()))], ["text", "removed"])

    some = F.exists("__chunks", lambda x: ~x["kept"])
    hit = found.where(some).withColumn("__new", without(F.col("text").cast("string"), F.col("__chunks")))
    hit = hit.withColumn("text", F.col("__new.text")).withColumn("__removed", F.col("__new.removed"))
    rest = found.where(~F.coalesce(some, F.lit(False))).withColumn("__removed", F.array().cast("array<int>"))
    names = [*docs.columns, "__removed"]
    return rest.select(*names).unionByName(hit.select(*names))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that stays, how many lines and which went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "text", F.size("__removed").cast("long").alias("n_removed"), F.col("__removed").alias("removed_lines"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text that stays."""
    small_batches(spark)
    out = remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("__removed")
