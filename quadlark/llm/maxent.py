"""Language-model scoring with a hashed maximum-entropy model.

A token's probability factors into its class given the context and the token given class and context. The commonest
training words form classes of SLOTS words by falling count; all other words fall into surface classes by a hash of their first
bytes, and have there the add-one chance of their count, so unknown words are covered. Contexts are features: the word before,
skip features (the words two, three and four before), and a hashed n-gram: the very word before, if it has no class of its own, else the
two words before. The hashed rows grow with the square root of the training tokens, as vocabularies do. Weights start from the
counts and move by distributed gradient updates: in each round every task runs mini-batches over its part of the corpus
from the same weights, and the tasks' changes are averaged. Texts are scored in sparse numpy batches.

The corpus is tokenised once into pieces of about PIECE tokens, each with its own list of words. Only these lists travel to
be counted; the counts of a piece's words travel back to the piece. No task holds more than one piece and its list.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fold, table, written

#: Tokens of a piece; words with classes of their own; words of such a class; surface classes; the least number of rows for hashed n-grams.
PIECE, COMMON, SLOTS, SURFACE, HASHED = 1_000_000, 512, 32, 32, 1 << 12
#: The share of positions a round uses is 1 / THIN (other positions each round), rounds so that each position is used, tokens of a mini-batch, step.
THIN, BATCH, STEP = 4, 8192, 0.15
ROUNDS = THIN
FREQUENT = COMMON // SLOTS
CLASSES, CONTEXT = FREQUENT + SURFACE, COMMON + SURFACE + 1
SKIPS = 4
END = b""
PIECES = "piece long, ids binary, lens binary, held binary, tokens binary, words binary, train binary"


def hashed_rows(tokens: int) -> int:
    """Rows for hashed n-grams: a power of two, one to two times the square root of the training tokens."""
    return max(HASHED, 1 << int(tokens**0.5).bit_length())


def word_marks(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, which tells all words apart, common or not."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def surface(word: bytes) -> int:
    return zlib.crc32(word[:2]) % SURFACE


@functools.cache
def head_surfaces() -> np.ndarray:
    """Surface classes of all words of two bytes, then of one, then of none."""
    heads = itertools.chain(itertools.product(range(256), repeat=2), itertools.product(range(256)), [()])
    return np.fromiter((surface(bytes(h)) for h in heads), np.int64)


def surfaces(words: list[bytes]) -> np.ndarray:
    lens = np.fromiter(map(len, words), np.int64, len(words))
    at, text = np.cumsum(lens) - lens, np.frombuffer(b"".join(words) + b"\0\0", np.uint8)
    one, two = text[at].astype(np.int64), text[at + 1]
    return head_surfaces()[np.where(lens > 1, one << 8 | two, np.where(lens == 1, one + (1 << 16), (1 << 16) + 256))]


def empty_numbers() -> defaultdict[bytes, int]:
    """Numbers words in the order in which they are asked for; END comes first."""
    number = defaultdict(itertools.count().__next__)
    number[END]
    return number


def tokenised(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held) to pieces: documents' ids and lengths, tokens as numbers of the piece's words, and the words' training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, packed = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(3)
        number, ids, lens, held, tokens, size = empty_numbers(), [], [], [], [], 0

        def out() -> pa.RecordBatch:
            stream = np.concatenate(tokens)
            train = np.bincount(stream[np.repeat(~np.array(held, bool), lens)], minlength=len(number))
            blobs = (np.array(ids, np.int64), np.array(lens, np.int64), np.array(held, bool), stream)
            values = map(packed.compress, [*(x.tobytes() for x in blobs), b"\n".join(number), train.astype(np.int64).tobytes()])
            return pa.RecordBatch.from_arrays([pa.array([piece]), *(pa.array([v], pa.binary()) for v in values)], [c.split()[0] for c in PIECES.split(", ")])

        for b in batches:
            for i, t, h in zip(b.column(0), b.column(1), b.column(2)):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                words.append(END)
                tokens.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                ids.append(NO_ID if i.as_py() is None else i.as_py())
                lens.append(len(words))
                held.append(h.as_py())
                size += len(words)
                if size >= PIECE:
                    yield out()
                    piece += 1
                    number, ids, lens, held, tokens, size = empty_numbers(), [], [], [], [], 0
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "held").mapInArrow(run, PIECES)


NO_ID = -(1 << 63)


def plain(blob: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob.as_py())


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, words, train) to (piece, place, word, n)."""
    for b in batches:
        for p, w, n in zip(b.column(0), b.column(1), b.column(2)):
            words, n = plain(w).split(b"\n"), np.frombuffer(plain(n), np.int64)
            for at in range(0, len(words), 65536):
                part = words[at : at + 65536]
                place = np.arange(at, at + len(part), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), p.as_py())), pa.array(place), pa.array(part, pa.binary()), pa.array(n[at : at + len(part)])], ["piece", "place", "word", "n"])


@dataclass
class Model:
    """The common words, surface classes' totals, and weights; its size goes with the number of hashed rows."""

    place: dict[bytes, int]
    rare_total: np.ndarray  # tokens + distinct words + 1 of each surface class
    bias: np.ndarray  # (CLASSES,)
    slot_bias: np.ndarray  # (FREQUENT, SLOTS); -inf where a class has fewer words
    of_class: np.ndarray  # rows of context features x CLASSES
    of_slot: np.ndarray  # rows of (context, class) x SLOTS
    class_power: np.ndarray  # summed squared gradients by row
    slot_power: np.ndarray

    @classmethod
    def start(cls, common: list[tuple[bytes, int]], rare: dict[int, tuple[int, int]], hashed: int = HASHED) -> Model:
        tokens = np.array([rare.get(c, (0, 0))[0] for c in range(SURFACE)], float)
        kinds = np.array([rare.get(c, (0, 0))[1] for c in range(SURFACE)], float)
        n = np.array([x for _, x in common] + [0] * (COMMON - len(common)), float).reshape(FREQUENT, SLOTS)
        bias = np.log(np.concatenate([n.sum(axis=1), tokens + kinds + 1]) + 1e-9)
        with np.errstate(divide="ignore"):
            slot_bias = np.log(n / np.maximum(1, n.sum(axis=1, keepdims=True)))
        bias[:FREQUENT][n.sum(axis=1) == 0] = -np.inf
        rows = SKIPS * CONTEXT + hashed, CONTEXT * FREQUENT + hashed
        return cls({w: i for i, (w, _) in enumerate(common)}, tokens + kinds + 1, bias.astype(np.float32), slot_bias.astype(np.float32), np.zeros((rows[0], CLASSES), np.float32), np.zeros((rows[1], SLOTS), np.float32), np.full(rows[0], 1e-2, np.float32), np.full(rows[1], 1e-2, np.float32))

    def codes(self, words: list[bytes], marks: np.ndarray | None = None) -> np.ndarray:
        """Each word's number as a context: its place among the common words, or COMMON + its surface class.

        Only words whose marks (worked out unless given) end in the same 16 bits as a common word's are looked up.
        """
        marks = word_marks(words) if marks is None else marks
        out, near = COMMON + surfaces(words), np.zeros(1 << 16, bool)
        near[word_marks(list(self.place)).astype(np.uint16)] = True
        for i in np.nonzero(near[marks.astype(np.uint16)])[0].tolist():
            out[i] = self.place.get(words[i], out[i])
        return out


def contexts(codes: np.ndarray, begin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The codes 1 to SKIPS before each token at `at` (row by row), COMMON + SURFACE before the text's start. begin: where each token's text starts."""
    out = np.full((SKIPS, len(at)), COMMON + SURFACE, np.int64)
    first = begin[at]
    for k in range(1, SKIPS + 1):
        there = at - k >= first
        out[k - 1, there] = codes[at[there] - k]
    return out


def ngrams(codes: np.ndarray, marks: np.ndarray, begin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hashed n-gram before each token at `at`: the word before, if it is no common one, else the two words before; 0 stands before
    the text's start."""
    first = begin[at]
    one = np.where(at - 1 >= first, marks[at - 1], np.uint64(0))
    two = np.where(at - 2 >= first, marks[np.maximum(at - 2, 0)], np.uint64(0))
    alone = (at - 1 >= first) & (codes[at - 1] >= COMMON)
    return one * np.uint64(0x9E3779B97F4A7C15) + np.where(alone, np.uint64(1), two * np.uint64(0xC2B2AE3D27D4EB4F))


def hashed_row(key: np.ndarray, hashed: int) -> np.ndarray:
    mixed = (key ^ key >> np.uint64(31)) * np.uint64(0x165667B19E3779F9)
    return (mixed >> np.uint64(65 - hashed.bit_length())).astype(np.int64)


def class_rows(m: Model, c: np.ndarray, key: np.ndarray) -> np.ndarray:
    hashed = len(m.of_class) - SKIPS * CONTEXT
    return np.concatenate([c + np.arange(SKIPS)[:, None] * CONTEXT, hashed_row(key, hashed)[None] + SKIPS * CONTEXT])


def slot_rows(m: Model, c: np.ndarray, key: np.ndarray, group: np.ndarray) -> np.ndarray:
    hashed = len(m.of_slot) - CONTEXT * FREQUENT
    return np.stack([c[0] * FREQUENT + group, hashed_row(key + (group + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), hashed) + CONTEXT * FREQUENT])


def highest(x: np.ndarray) -> np.ndarray:
    """The largest value of each row, by halves of all rows at once: numpy's own maximum takes short rows one by one."""
    while x.shape[1] > 1:
        half = x.shape[1] + 1 >> 1
        x = np.maximum(x[:, :half], x[:, -half:])
    return x


def softmax(x: np.ndarray) -> np.ndarray:
    x -= highest(x)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def summed(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = weights.take(rows[0], axis=0)
    out += bias
    part = np.empty_like(out)
    for r in rows[1:]:
        out += weights.take(r, axis=0, out=part, mode="clip")  # no row is out of bounds; "raise" would copy `part`
    return out


def class_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < COMMON, codes // SLOTS, codes - COMMON + FREQUENT)


def log_chances(m: Model, codes: np.ndarray, marks: np.ndarray, begin: np.ndarray, rare_part: np.ndarray) -> np.ndarray:
    """Natural log probability of each token; rare_part: that of a rare word within its surface class."""
    out = np.empty(len(codes))
    for s in range(0, len(codes), BATCH):
        at = np.arange(s, min(s + BATCH, len(codes)))
        c, key, g = contexts(codes, begin, at), ngrams(codes, marks, begin, at), class_of(codes[s : s + BATCH])
        p = softmax(summed(m.of_class, class_rows(m, c, key), m.bias))
        out[s : s + BATCH] = np.log(np.maximum(1e-30, p[np.arange(len(g)), g]))
        often = np.nonzero(g < FREQUENT)[0]
        p = softmax(summed(m.of_slot, slot_rows(m, c[:, often], key[often], g[often]), m.slot_bias[g[often]]))
        out[s + often] += np.log(np.maximum(1e-30, p[np.arange(len(often)), codes[s + often] % SLOTS]))
    return out + np.where(codes < COMMON, 0.0, rare_part)


def ordered(r: np.ndarray) -> np.ndarray:
    """The stable order of row numbers (below 2^32), by 16 bits at a time: numpy sorts those by counting."""
    order = np.argsort(r.astype(np.uint16), kind="stable")
    return order if r.max() < 1 << 16 else order[np.argsort((r[order] >> 16).astype(np.uint16), kind="stable")]


def descend(weights: np.ndarray, power: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """One AdaGrad step by row: gradients of equal rows are added up first, two columns at a time as one complex number."""
    for r in rows:
        order = ordered(r)
        r = r[order]
        first = np.nonzero(np.diff(r, prepend=-1))[0]
        g = np.add.reduceat(gradient.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)
        at = r[first]
        power[at] += np.einsum("ij,ij->i", g, g) / g.shape[1]
        g *= (STEP / np.sqrt(power[at]))[:, None]
        weights[at] = weights.take(at, axis=0) - g


def train(m: Model, codes: np.ndarray, marks: np.ndarray, begin: np.ndarray, used: np.ndarray) -> None:
    """Mini-batches over the used positions, in place."""
    at = np.nonzero(used)[0]
    for s in range(0, len(at), BATCH):
        i = at[s : s + BATCH]
        c, key, g = contexts(codes, begin, i), ngrams(codes, marks, begin, i), class_of(codes[i])
        rows = class_rows(m, c, key)
        p = softmax(summed(m.of_class, rows, m.bias))
        p[np.arange(len(g)), g] -= 1
        descend(m.of_class, m.class_power, rows, p)
        often = np.nonzero(g < FREQUENT)[0]
        if len(often):
            rows = slot_rows(m, c[:, often], key[often], g[often])
            p = softmax(summed(m.of_slot, rows, m.slot_bias[g[often]]))
            p[np.arange(len(often)), codes[i[often]] % SLOTS] -= 1
            descend(m.of_slot, m.slot_power, rows, p)


def unpacked(ids: bytes, lens: bytes, held: bytes, tokens: bytes) -> tuple[np.ndarray, ...]:
    return np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64), np.frombuffer(held, bool), np.frombuffer(tokens, np.int32)


def used_in(number: int, ids: np.ndarray, lens: np.ndarray, held: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which positions a round trains on: over all rounds, each one of a training text."""
    turn = np.where(held, -1, (np.cumsum(lens) - lens - ids % THIN + number) % THIN)
    return np.tile(np.arange(THIN, dtype=np.int8), len(begin) // THIN + 1)[: len(begin)] == np.repeat(turn.astype(np.int8), lens)


PARTS = ("of_class", "of_slot", "class_power", "slot_power")
ROWS = 2048


def one_round(pieces: DataFrame, m: Model, number: int) -> Model:
    """The model after one round over all training texts. Each task sends one change for each block of weights; they are averaged in two steps.

    A task takes many pieces, one after the other, so that there is a task for each core and not one for each piece of input: what is
    sent then goes with the cluster and the model, not with the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, any_used = Model(**{**m.__dict__, **{k: getattr(m, k).copy() for k in PARTS}}), False
        for b in batches:
            for row in zip(*(b.column(k) for k in range(5))):
                ids, lens, held, tokens = unpacked(*map(plain, row[:4]))
                begin = np.repeat(np.cumsum(lens) - lens, lens)
                used = used_in(number, ids, lens, held, begin)
                words = plain(row[4]).split(b"\n")
                marks = word_marks(words)
                train(own, own.codes(words, marks)[tokens], marks[tokens], begin, used)
                any_used |= bool(used.any())
        if any_used:
            for name in PARTS:
                change = (getattr(own, name) - getattr(m, name)).reshape(len(getattr(m, name)), -1)
                for s in range(0, len(change), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([s // ROWS], pa.int32()), pa.array([1], pa.int64()), pa.array([change[s : s + ROWS].astype(np.float16).tobytes()], pa.binary())], ["part", "block", "tasks", "change"])

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py(), np.float16).astype(np.float64) * n.as_py() for x, n in zip(t.column("change"), t.column("tasks"))], axis=0)
        n = sum(t.column("tasks").to_pylist())
        return pa.table({"part": t.column("part")[:1], "block": t.column("block")[:1], "tasks": pa.array([n], pa.int64()), "change": pa.array([(total / n).astype(np.float16).tobytes()], pa.binary())})

    schema = "part string, block int, tasks long, change binary"
    tasks = pieces.sparkSession.sparkContext.defaultParallelism
    sent = pieces.select("ids", "lens", "held", "tokens", "words").coalesce(tasks).mapInArrow(run, schema).withColumn("share", F.spark_partition_id() % 64)
    some = sent.groupBy("part", "block", "share").applyInArrow(add, schema)
    new = {k: getattr(m, k).copy() for k in PARTS}
    for r in some.groupBy("part", "block").applyInArrow(add, schema).collect():
        part = new[r.part].reshape(len(new[r.part]), -1)
        rows = part[r.block * ROWS : (r.block + 1) * ROWS]
        rows += np.frombuffer(r.change, np.float16).astype(np.float32).reshape(rows.shape)
    return Model(**{**m.__dict__, **new})


def score(docs: DataFrame) -> DataFrame:
    """One row for each row of (doc_id, text, held): n_tokens, n_known, train_tokens, base_score, score.

    Counts and weights come from the rows that aren't held (`held` null counts as held). Null and empty texts are one end token. Without
    training rows every count is 0, and base_score is 0 for each token; equal texts get equal scores; an empty table gives an empty result.
    Texts count whole however long they are, repeated rows count each time, further columns are ignored.
    """
    pieces, _ = written(tokenised(docs.withColumn("held", F.coalesce("held", F.lit(True)))))
    # Words are summed before they are dealt out, so one that stands in every piece is a row for each task; back to the pieces goes an
    # equi-join, whose common words adaptive execution splits.
    rows = pieces.select("piece", "words", "train").mapInArrow(word_rows, "piece long, place int, word binary, n long")
    summed_up, _ = written(rows.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("pieces")))
    counts = summed_up.where("c > 0").select("word", "c")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, kinds = int(total[0]), int(total[1])
    common = [(bytes(r.word), r.c) for r in counts.orderBy(F.desc("c"), "word").limit(COMMON).collect()]
    listed = {w for w, _ in common}

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((SURFACE, 2), np.int64)
        for b in batches:
            kind = np.fromiter((-1 if w in listed else surface(w) for w in b.column(0).to_pylist()), np.int64, len(b))
            np.add.at(sums[:, 0], kind[kind >= 0], b.column(1).to_numpy()[kind >= 0])
            sums[:, 1] += np.bincount(kind[kind >= 0], minlength=SURFACE)
        yield pa.RecordBatch.from_arrays([pa.array(range(SURFACE), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["kind", "tokens", "words"])

    rare = counts.select("word", "c").mapInArrow(rare_words, "kind int, tokens long, words long").groupBy("kind").agg(F.sum("tokens").alias("t"), F.sum("words").alias("w")).collect()
    model = Model.start(common, {r.kind: (r.t, r.w) for r in rare}, hashed_rows(tokens))
    for number in range(ROUNDS):
        model = one_round(pieces, model, number)

    def measured(p: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        for row in p.select(["ids", "lens", "held", "tokens", "words", "train"]).to_batches():
            for values in zip(*row.columns):
                ids, lens, held, stream = unpacked(*map(plain, values[:4]))
                words = plain(values[4]).split(b"\n")
                known = np.frombuffer(plain(values[5]), np.int64).copy()  # right for words of this piece alone
                known[c.column("place").to_numpy()] = c.column("c").to_numpy()
                marks = word_marks(words)
                codes = model.codes(words, marks)
                rare_part = np.zeros(len(words))
                few = codes >= COMMON
                rare_part[few] = np.log((known[few] + 1) / model.rare_total[codes[few] - COMMON])
                starts = np.cumsum(lens) - lens
                lp = log_chances(model, codes[stream], marks[stream], np.repeat(starts, lens), rare_part[stream])
                base = np.log10((known + 1) / (tokens + kinds + 1))[stream]
                parts = [lens, np.add.reduceat((known > 0)[stream].astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(lp, starts) / np.log(10)]
                out.append(pa.table({"doc_id": pa.array(ids, mask=ids == NO_ID), "held_out": pa.array(held), "n_tokens": pa.array(parts[0]), "n_known": pa.array(parts[1]), "train_tokens": pa.array(np.full(len(ids), tokens)), "base_score": pa.array(parts[2]), "score": pa.array(parts[3])}))
        return pa.concat_tables(out) if out else NOTHING.empty_table()

    back = rows.join(summed_up.where("pieces > 1 and c > 0"), "word").where("c <> n").select("piece", "place", "c")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return pieces.groupBy("piece").cogroup(back.groupBy("piece")).applyInArrow(measured, schema)


NOTHING = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("held", fold(F.col("doc_id"), 7) == 2))
