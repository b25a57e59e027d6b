"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector of its own, drawn from a hash of its code point. A trigram binds its letters' vectors, rolled by their
place, by multiplication; a text bundles (adds) its trigrams' vectors; a language's prototype bundles its training texts. A text gets the
language whose prototype has the largest cosine with the text's vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold, held, table

DIMENSIONS = 2048
#: Vectors of trigrams and of letters that a worker remembers at most; then it starts anew.
MOST, MOST_LETTERS = 1 << 15, 1 << 13
#: Texts whose vectors are summed in one multiplication, at most.
TOGETHER = 256


def letter_vector(point: int, dimensions: int, seed: int) -> np.ndarray:
    """+1/-1 numbers drawn for this code point alone; 0 stands for all that is no letter."""
    return np.random.Generator(np.random.Philox(key=[seed, point])).integers(0, 2, dimensions).astype(np.int8) * 2 - 1


class Space:
    """Vectors of trigrams, made when first met. A trigram is its three code points, 21 bits each, 0 for a space."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 17, most: int = MOST):
        self.dimensions, self.seed, self.most = dimensions, seed, most
        points = np.arange(0x110000)
        alpha = np.fromiter((chr(c).isalpha() for c in points), bool, len(points))
        self.letter = np.where(alpha, points, 0).astype(np.int64)
        self.letters: dict[int, np.ndarray] = {}
        self.reset()

    def reset(self) -> None:
        self.known, self.place, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.vectors = np.empty((256, self.dimensions), np.int8)

    def turned(self, point: int) -> np.ndarray:
        """The letter's vector, rolled for each of the three places."""
        found = self.letters.get(point)
        if found is None:
            if len(self.letters) >= MOST_LETTERS:
                self.letters.clear()
            v = letter_vector(point, self.dimensions, self.seed)
            found = self.letters[point] = np.stack([np.roll(v, 2 - k) for k in range(3)])
        return found

    def trigrams(self, text: str) -> np.ndarray:
        """Numbers of all letter trigrams, one space wherever other characters stand and around the text; none without a letter."""
        ids = self.letter[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        ids = np.concatenate([[0], ids, [0]])
        keep = ids > 0
        keep[1:] |= ids[:-1] > 0
        keep[0] = True
        ids = ids[keep]
        return ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:] if len(ids) > 2 else ids[:0]

    def vector(self, gram: int) -> np.ndarray:
        return self.turned(gram >> 42)[0] * self.turned(gram >> 21 & 0x1FFFFF)[1] * self.turned(gram & 0x1FFFFF)[2]

    def _learn(self, new: np.ndarray) -> None:
        if self.used + len(new) > len(self.vectors):
            more = np.empty((max(2 * len(self.vectors), self.used + len(new)), self.dimensions), np.int8)
            more[: self.used] = self.vectors[: self.used]
            self.vectors = more
        for k, g in enumerate(new.tolist(), self.used):
            self.vectors[k] = self.vector(g)
        known = np.concatenate([self.known, new])
        order = np.argsort(known)
        self.known, self.place = known[order], np.concatenate([self.place, np.arange(self.used, self.used + len(new))])[order]
        self.used += len(new)

    def bundles(self, grams: list[np.ndarray], rows: list[int] | None = None, weights: list[float] | None = None) -> np.ndarray:
        """The sum of each text's trigram vectors, times its weight; texts of one row number are added up. A bounded part of the distinct
        trigrams is multiplied at a time, once for all texts, in doubles where there are weights: counts alone are exact in singles."""
        rows = list(range(len(grams))) if rows is None else rows
        sizes, height = [len(g) for g in grams], max(rows, default=-1) + 1
        every = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        every, row = every[order], np.repeat(rows, sizes)[order]
        weight = None if weights is None else np.repeat(weights, sizes)[order]
        first = np.ones(len(every), bool)
        first[1:] = every[1:] != every[:-1]
        distinct, place = every[first], np.cumsum(first) - 1
        kind, total = np.float32 if weights is None else np.float64, np.zeros((height, self.dimensions))
        for s in range(0, len(distinct), 1024):
            part = distinct[s : s + 1024]
            lo, hi = np.searchsorted(place, [s, s + len(part)])
            at = row[lo:hi] * len(part) + place[lo:hi] - s
            n = np.bincount(at, None if weight is None else weight[lo:hi], height * len(part)).reshape(height, -1).astype(kind)
            new = part[~np.isin(part, self.known, assume_unique=True)]
            if len(new):
                if self.used + len(new) > self.most:
                    self.reset()
                    new = part
                self._learn(new)
            total += n @ self.vectors[self.place[np.searchsorted(self.known, part)]].astype(kind)
        return total

    def bundle(self, grams: np.ndarray) -> np.ndarray:
        """The sum of one text's trigram vectors."""
        return self.bundles([grams])[0]


def in_groups(grams: Iterator[np.ndarray], texts: int, most: int = 1 << 18) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(place, trigrams) of texts with any, in groups of at most `texts` texts, closed once they hold `most` trigrams."""
    group, held_now = [], 0
    for k, g in enumerate(grams):
        if len(g):
            group.append((k, g))
            held_now += len(g)
        if len(group) == texts or held_now >= most:
            yield group
            group, held_now = [], 0
    if group:
        yield group


def space(dimensions: int, seed: int) -> Space:
    return held(("space", dimensions, seed), lambda: Space(dimensions, seed))


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = 17) -> dict[str, np.ndarray]:
    """Each language's unit vector from (text, lang); texts count alike whatever their length. Rows without a language or letter add nothing,
    repeated rows count each time, further columns are ignored, an empty table teaches no language.

    Tasks bundle what they read into one vector for each language; these are added up in two steps. What comes to the
    driver is one vector of `dimensions` numbers for each language.
    """

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, total = space(dimensions, seed), {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for group in in_groups((s.trigrams(t.as_py() or "") for t in b.column(0)), b.num_rows):
                names = sorted({langs[k] for k, _ in group})
                sums = s.bundles([g for _, g in group], [names.index(langs[k]) for k, _ in group], [1.0 / len(g) for _, g in group])
                for lang, vector in zip(names, sums):
                    total[lang] = total.get(lang, 0.0) + vector
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([vector])], ["lang", "vector"])

    def added(t: pa.Table) -> pa.Table:
        return pa.table({"lang": t.column("lang")[:1], "vector": [np.sum([np.array(v) for v in t.column("vector").to_pylist()], axis=0)]})

    seen = docs.where("lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    parts = seen.mapInArrow(bundles, "lang string, vector array<double>").withColumn("part", F.spark_partition_id() % 256)
    parts = parts.groupBy("lang", "part").applyInArrow(added, "lang string, vector array<double>")
    found = parts.groupBy("lang").applyInArrow(added, "lang string, vector array<double>").collect()
    return {r.lang: np.array(r.vector) / (np.linalg.norm(r.vector) or 1.0) for r in sorted(found, key=lambda r: r.lang)}


def identify(docs: DataFrame, learned: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = 17, sharpness: float = 40.0) -> DataFrame:
    """doc_id, lang_pred, score of every row of (doc_id, text). `und` with score 0 if the text is null or has no letter, or if no
    language was learned. score: the softmax share of the winner among all cosines times `sharpness`; ties go to the first name.
    Equal texts get equal rows, whole texts count however long they are, further columns are ignored, an empty table gives an empty result."""
    names = list(learned)
    matrix = np.array([learned[n] for n in names]).reshape(len(names), dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space(dimensions, seed)
        for b in batches:
            pred, score = ["und"] * b.num_rows, [0.0] * b.num_rows
            for group in in_groups((s.trigrams(t.as_py() or "") for t in b.column(1)), TOGETHER) if names else ():
                for (k, _), v in zip(group, s.bundles([g for _, g in group])):
                    cosine = matrix @ v / (np.linalg.norm(v) or 1.0)
                    best = int(np.argmax(cosine))
                    pred[k] = names[best]
                    score[k] = float(1.0 / np.exp(sharpness * (cosine - cosine[best])).sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = prototypes(docs.where(fold(F.col("doc_id"), 4) != 2))
    found = identify(docs, learned)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
