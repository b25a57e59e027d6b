"""Toxicity by the nearest labelled examples.

A bounded sample of labelled texts becomes TF-IDF vectors over all of its words. A word's idf counts how rare it is and how unlike its
shares of toxic and clean examples are (delta idf), so words that say nothing weigh little, but none is left out. An inverted index keeps the
postings of each word by blocks of examples, with the word's largest weight in each block; the commonest words' postings are full rows,
which give their exact part of a block's bound by one product. A text's blocks are visited in the order of their upper bounds until no bound
exceeds the k-th best cosine: the k nearest are exact. They vote with
their cosines, and the votes, taken leave-one-out over the sample, are calibrated to chances by isotonic regression, weighted back to the
classes' true sizes. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import drop_table, fold, let_go, table, trim, written

#: Bounds of the sample: examples and postings of each class. Examples in a block, neighbours, added to each count of a class.
EXAMPLES, POSTINGS, BLOCK, NEIGHBOURS, SMOOTH = 3000, 1_500_000, 32, 15, 5.0
#: Words whose postings are kept as full rows, and texts that are multiplied with these at once.
FULL_ROWS, TOGETHER = 512, 32
#: Blocks visited before the k-th best cosine so far decides which of the others are.
FIRST = 4
#: The least weight of a word, as a share of its idf.
FLOOR = 0.01
WORD = re.compile(r"[^\W\d_]+")
#: More than the rounding of a cosine.
MARGIN = 1e-5


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's words in order, and how often each stands there."""
    met = Counter(words(text))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in met), np.uint64, len(met))
    order = np.argsort(h)
    return h[order], np.fromiter(met.values(), np.int32, len(met))[order]


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of a text's words, as a vector of length 1."""
    w = (1 + np.log(counts)) * idf
    norm = np.linalg.norm(w)
    return w / norm if norm else w


def delta_idf(df: np.ndarray, toxic_df: np.ndarray, n: int, toxic: int) -> np.ndarray:
    """Positive for every word: its idf, times the size of the logarithm of how its shares of the two classes compare."""
    bad = (toxic_df + SMOOTH) / (toxic + 2 * SMOOTH)
    good = (df - toxic_df + SMOOTH) / (n - toxic + 2 * SMOOTH)
    return (np.log((1 + n) / (1 + df)) + FLOOR) * (np.abs(np.log(bad / good)) + FLOOR)


def spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the spans [begin, end), one after the other, and the spans' lengths."""
    size = end - begin
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - size - begin, size), size


@dataclass
class Index:
    """Unit vectors of the examples by words and blocks.

    Word t is a full row, rows[row_of[t]], or has row_of[t] = -1 and the entries entry_of[t] to entry_of[t + 1]; entry e is of block[e], has peak[e] as its largest weight, and the postings
    posting_of[e] to posting_of[e + 1], each an example and its weight.
    """

    names: np.ndarray
    idf: np.ndarray
    labels: np.ndarray
    ids: list[int]
    blocks: int
    entry_of: np.ndarray
    block: np.ndarray
    peak: np.ndarray
    posting_of: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    row_of: np.ndarray
    rows: np.ndarray
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))
    blank: float = 0.0

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and weights of a text, of length 1; empty if it shares no word with the examples."""
        h, n = counted(text)
        if not len(self.names) or not len(h):
            return np.zeros(0, int), np.zeros(0)
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        there = self.names[at] == h
        at = at[there]
        return at, weigh(n[there], self.idf[at])

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each vector the k examples of largest positive cosine as (cosine, example), ties to the smaller number. Exact: a block is left
        out only if its bound is below the k-th best."""
        out = []
        for s in range(0, len(vectors), TOGETHER):
            part = vectors[s : s + TOGETHER]
            common = np.zeros((len(part), len(self.rows)), np.float32)
            for i, (at, w) in enumerate(part):
                row = self.row_of[at]
                common[i, row[row >= 0]] = w[row >= 0]
            whole = np.zeros((len(part), self.blocks * BLOCK), np.float32)
            whole[:, : len(self.labels)] = common @ self.rows
            peaks = whole.reshape(len(part), self.blocks, BLOCK).max(axis=2)
            out += [self._nearest(at, w, whole[i, : len(self.labels)], peaks[i], k, without[s + i] if without else -1) for i, (at, w) in enumerate(part)]
        return out

    def _nearest(self, at: np.ndarray, w: np.ndarray, common: np.ndarray, peaks: np.ndarray, k: int, without: int) -> list[tuple[float, int]]:
        entries, size = spans(self.entry_of[at], self.entry_of[at + 1])
        block, w = self.block[entries], np.repeat(w, size)
        bound = np.bincount(block, w * self.peak[entries], self.blocks) + peaks
        order = np.argsort(-bound, kind="stable")
        near, cosine, least, begin, end = np.zeros(0, int), np.zeros(0), 0.0, 0, FIRST
        while begin < self.blocks:
            visit = order[begin:end]
            visit = visit[(bound[visit] > 0) & (bound[visit] >= least - MARGIN)]
            if not len(visit):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[visit] = True
            mine = np.nonzero(chosen[block])[0]
            postings, size = spans(self.posting_of[entries[mine]], self.posting_of[entries[mine] + 1])
            found = (visit[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            found = found[found < len(self.labels)]
            score = common[found] + np.bincount(self.example[postings], np.repeat(w[mine], size) * self.weight[postings], len(self.labels))[found]
            found, score = found[(score > 0) & (found != without)], score[(score > 0) & (found != without)]
            near, cosine = np.concatenate([near, found]), np.concatenate([cosine, score])
            best = np.lexsort((near, -cosine))[:k]
            near, cosine = near[best], cosine[best]
            least = cosine[-1] if len(near) == k else 0.0
            begin, end = end, self.blocks
        return list(zip(cosine.tolist(), near.tolist()))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The toxic neighbours' share of all cosines."""
        total = sum(s for s, _ in near)
        return sum(s for s, i in near if self.labels[i]) / total if total else 0.0

    def calibrated(self, vote: float) -> float:
        edges, values = self.steps
        return float(np.interp(vote, edges, values)) if len(edges) else vote

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        found = self.nearest([self.vector(t) for t in texts])
        return [(self.calibrated(self.vote(near)) if near else self.blank, near) for near in found]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators, equal positions first: mean position and mean value of each pool of rising values."""
    at, same = np.unique(np.round(x, 9), return_inverse=True)
    weights = np.bincount(same, w)
    pools: list[list[float]] = []
    for a, b, c in zip(at, np.bincount(same, w * y), weights):
        pools.append([a * c, b, c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, words, at, n) of up to EXAMPLES labelled texts of each class, drawn by a hash of the id, and how many there were. Of
    several labels of one id the largest counts, of several texts of one id the least."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES) for y in (0, 1)]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(drawn, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            found = [counted(t.as_py()) for t in b.column(2)]
            blobs = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x[0]) for x in found], pa.int64()), *blobs], ["doc_id", "toxic", "words", "at", "n"])

    return texts.select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, toxic int, words long, at binary, n binary"), sizes


def within(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """Of (id, words) in order, the ids that together stay within `most` words; one that would go beyond is passed over."""
    kept, used = [], 0
    for i, n in sizes:
        if used + n <= most:
            kept.append(i)
            used += n
    return kept


def learn(docs: DataFrame, labels: DataFrame) -> Index:
    """The index from labelled rows. At most 2 x EXAMPLES sparse vectors of 2 x POSTINGS numbers come to the driver; texts don't."""
    drawn, sizes = sampled(docs, labels)
    sample, at = written(drawn)
    light = sample.select("doc_id", "toxic", "words").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    kept = {i for y in (0, 1) for i in within([(r.doc_id, r.words) for r in light if r.toxic == y], POSTINGS)}
    whole = sample if len(kept) == len(light) else sample.where(F.col("doc_id").isin(sorted(kept)))
    rows = [(r.doc_id, r.toxic, np.frombuffer(r.at, np.uint64), np.frombuffer(r.n, np.int32)) for r in whole.collect()]
    index = build(rows)
    if len(index.names):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            place = {i: k for k, i in enumerate(index.ids)}
            for b in batches:
                vectors = []
                for h, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    words = np.searchsorted(index.names, np.frombuffer(h, np.uint64))
                    vectors.append((words, weigh(np.frombuffer(n, np.int32), index.idf[words])))
                found = index.nearest(vectors, without=[place[i] for i in b.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([index.vote(near) if near else -1.0 for near in found], pa.float64())], ["doc_id", "vote"])

        deal = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        votes = {r.doc_id: r.vote for r in whole.select("doc_id", "at", "n").repartition(deal, "doc_id").mapInArrow(voted, "doc_id long, vote double").collect()}
        shared.destroy()
        n = np.bincount(index.labels, minlength=2)
        calibrate(index, np.array([votes[i] for i in index.ids]), {y: sizes.get(y, 0) / max(1, n[y]) for y in (0, 1)})
    elif len(rows):
        calibrate(index, np.full(len(rows), -1.0), {0: 1.0, 1: 1.0})
    drop_table(docs.sparkSession, at)
    return index


def build(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Index:
    """rows: (doc_id, toxic, hashes of the words in order, counts) of the examples, of which both classes must be there for an index with words.

    Blocks hold examples of one class that share their weightiest word, as far as there are any, so that peaks are few and bounds tight.
    """
    given = sorted(rows, key=lambda r: (r[1], r[0]))
    n, toxic = len(given), sum(1 for r in given if r[1])
    every = np.concatenate([np.zeros(0, np.uint64), *(r[2] for r in given)]) if 0 < toxic < n else np.zeros(0, np.uint64)
    names, term = np.unique(every, return_inverse=True)
    lens = np.array([len(r[2]) for r in given] if len(names) else [0] * n, int)
    row = np.repeat(np.arange(n), lens)
    labels = np.array([r[1] for r in given], int)
    idf = delta_idf(np.bincount(term, minlength=len(names)).astype(float), np.bincount(term, labels[row], len(names)), n, toxic)
    counts = np.concatenate([np.zeros(0, np.int32), *(r[3] for r in given)]) if len(names) else np.zeros(0, np.int32)
    weight = (1 + np.log(counts)) * idf[term]
    weight = (weight / np.sqrt(np.bincount(row, weight**2, n))[row]).astype(np.float32) if len(row) else np.zeros(0, np.float32)
    leading = np.full(n, -1)
    rising = np.argsort(weight, kind="stable")
    leading[row[rising]] = term[rising]
    order = np.lexsort((np.arange(n), leading, labels))
    place = np.empty(n, int)
    place[order] = np.arange(n)
    example = place[row]
    df = np.bincount(term, minlength=len(names))
    common = np.sort(np.argsort(-df, kind="stable")[:FULL_ROWS])
    common = common[df[common] * 32 >= n]
    row_of = np.full(len(names), -1)
    row_of[common] = np.arange(len(common))
    rows = np.zeros((len(common), n), np.float32)
    full = row_of[term] >= 0
    rows[row_of[term[full]], example[full]] = weight[full]
    term, example, weight = term[~full], example[~full], weight[~full]
    sort = np.lexsort((example, term))
    term, example, weight = term[sort], example[sort].astype(np.int32), weight[sort]
    blocks = max(1, -(-n // BLOCK))
    key = term * blocks + example // BLOCK
    first = np.nonzero(np.diff(key, prepend=-1))[0]
    peak = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0, np.float32)
    entry_of = np.searchsorted(key[first] // blocks, np.arange(len(names) + 1))
    return Index(names, idf, labels[order], [given[i][0] for i in order], blocks, entry_of, (key[first] % blocks).astype(np.int32), peak, np.append(first, len(key)), example, weight, row_of, rows)


def calibrate(index: Index, votes: np.ndarray, lifted: dict[int, float]) -> None:
    """votes: leave-one-out, -1 where an example has no neighbour; lifted: how many labelled texts one example stands for, by class."""
    w, met = np.array([lifted[y] for y in index.labels.tolist()]), votes >= 0
    if met.any():
        index.steps = isotonic(votes[met], index.labels[met].astype(float), w[met])
    lone = ~met if (~met).any() else np.ones(len(votes), bool)
    index.blank = float((w * index.labels)[lone].sum() / (w[lone].sum() + 1))  # one more clean one: no words are no ground for a rejection


def scores(docs: DataFrame, index: Index, evidence: int = 3) -> DataFrame:
    """doc_id, score, predicted and evidence (the nearest examples' ids and cosines) of every row of (doc_id, text).

    Null and empty texts, and texts that share no word with any example, get the chance that such a text is toxic; without labels of both
    classes every score is that chance too, the sample's share of toxic texts with one more clean text, or 0. Equal texts get equal scores, whole texts count however long they are,
    further columns are ignored, an empty table gives an empty result. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        index = shared.value
        for b in batches:
            found = index.scores(b.column(1).to_pylist())
            shown = [[{"example": index.ids[i], "cosine": float(s)} for s, i in near[:evidence]] for _, near in found]
            kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64())]))
            s = [x for x, _ in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array(shown, kind)], ["doc_id", "score", "predicted", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<example: long, cosine: double>>")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = learn(docs, table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0))
    found = scores(docs, index)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "evidence")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; all others stay as they are."""
    shared = spark.sparkContext.broadcast(learn(docs, table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        let_go()
        trim()
        index = shared.value
        return pa.array([s for s, _ in index.scores(text.to_pylist())], pa.float64())

    return docs.withColumn("__score", score(F.col("text").cast("string"))).where("__score < 0.5").drop("__score")
