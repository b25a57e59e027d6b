"""Byte-level BPE by a lazily determinised finite-state transducer; streaming decode by an incremental UTF-8 machine.

The merges of a rank file fix one encoding for every byte string, and the encoding of a prefix is known from its last
token: a token may follow another if and only if encoding their joined bytes gives these two again. While bytes are
read, several starts stay open: earlier positions from which a longer token may still come, each with a node of the
vocabulary trie and the last token before it. That set is one state of the transducer; each byte leads to the next state
and puts out the last token of the encoding so far. States and transitions are built when first met and kept. All that
lies before the position at which the open starts' tokenisations part is final: as no token is longer than the longest
entry, this takes bounded lookahead, and a pre-token of any length takes time in proportion to its length.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import held, small_batches, table, working

VOCABULARY = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """The ranks' own rule: join the two neighbours whose union ranks lowest, leftmost first, until none does."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > until:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 62:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class Transducer:
    """Bytes of one pre-token to token ids. `most`: states kept before the cache starts anew."""

    def __init__(self, ranks: dict[bytes, int], most: int = 150_000):
        self.ranks, self.most = ranks, most
        self.text = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # the trie: node and byte to node
        self.token: list[int] = [-1]
        self.inner: list[bool] = [True]
        self.depth: list[int] = [0]
        self.size = {i: len(t) for t, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        for t, i in ranks.items():
            if len(t) > 1:
                halves = merge(t, ranks, 2)
                if len(halves) != 2:
                    continue  # no sequence of merges ends in this token; only a whole pre-token can be it
                self.halves[i] = ranks[halves[0]], ranks[halves[1]]
            at = 0
            for byte in t:
                if at << 8 | byte not in self.child:
                    self.child[at << 8 | byte] = len(self.token)
                    self.inner[at] = True
                    self.inner.append(False)
                    self.depth.append(self.depth[at] + 1)
                    self.token.append(-1)
                at = self.child[at << 8 | byte]
            self.token[at] = i
        self.follows: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Lets all states go. They hold each other, so only the collector frees them."""
        self.states: dict[tuple, dict] = {}
        self.start = self.state((0, -1))
        gc.collect()

    def state(self, members: tuple) -> dict:
        """members: trie node and last token before its start, in turn, by start. A state holds its members at -1 and its steps by byte."""
        found = self.states.get(members)
        if found is None:
            found = self.states[members] = {-1: members}
        return found

    def edge(self, t: int, side: int) -> list[int]:
        """The tokens that stand at one edge of t while it is merged, from its byte to t itself."""
        found = [t]
        while found[-1] in self.halves:
            found.append(self.halves[found[-1]][side])
        return found[::-1]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether no merge over the boundary comes before those that make a and b. A merge's rank is its time."""
        if a < 0:
            return True
        pair = a << 32 | b
        if pair not in self.follows:
            if len(self.follows) > 150_000:
                self.follows.clear()
            left, right, never = [*self.edge(a, 1), 1 << 62], [*self.edge(b, 0), 1 << 62], 1 << 62
            x, y, text = 0, 0, self.text
            while True:
                over = self.ranks.get(text[left[x]] + text[right[y]], never)
                if over < left[x + 1] and over <= right[y + 1] and over < never:
                    self.follows[pair] = False
                    break
                if left[x + 1] == right[y + 1] == never:
                    self.follows[pair] = True
                    break
                if left[x + 1] <= right[y + 1]:
                    x += 1
                else:
                    y += 1
        return self.follows[pair]

    def advance(self, state: dict, byte: int) -> tuple[dict, int]:
        kept, last, child, token, inner, follows = [], -1, self.child, self.token, self.inner, self.follows
        members = iter(state[-1])
        for node, before in zip(members, members):
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            if inner[to]:
                kept += (to, before)
            if last < 0 and (t := token[to]) >= 0:
                fits = follows.get(before << 32 | t)
                if self.may_follow(before, t) if fits is None else fits:
                    last = t
        kept += (0, last)
        found = state[byte] = (self.state(tuple(kept)), last)
        return found

    def back(self, lasts: list[int], at: int, to: int = 0) -> list[int]:
        out = []
        while at > to:
            out.append(lasts[at - 1])
            at -= self.size[lasts[at - 1]]
        return out[::-1]

    def stream(self, data: Iterable[int], every: int = 4096) -> Iterator[list[int]]:
        """Ids of one run of bytes as soon as they are final; holds `every` bytes and the longest token at most."""
        state, lasts = self.start, []
        for byte in data:
            state, t = state.get(byte) or self.advance(state, byte)
            lasts.append(t)
            if len(lasts) >= every:
                ends = {len(lasts) - self.depth[node] for node in state[-1][::2]}
                while len(ends) > 1:  # the tokenisations of the open starts, back to where they meet
                    far = max(ends)
                    ends = ends - {far} | {far - self.size[lasts[far - 1]]}
                if (sure := ends.pop()) > 0:
                    yield self.back(lasts, sure)
                    lasts = lasts[sure:]
                if len(self.states) > self.most:
                    members = state[-1]
                    self.reset()
                    state = self.state(members)
        yield self.back(lasts, len(lasts))

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.states) > self.most:
            self.reset()
        if len(piece) > 8192:
            return [i for part in self.stream(piece) for i in part]
        state, lasts = self.start, []
        for byte in piece:
            try:
                state, t = state[byte]
            except KeyError:
                state, t = self.advance(state, byte)
            lasts.append(t)
        return self.back(lasts, len(lasts))


class Encoder:
    """Whole texts to ids: pre-tokens by the pattern, each through the transducer, with a bounded memory of short ones."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, remembered: int = 300_000):
        self.fst = Transducer(read_ranks(path))
        self.split = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.remembered = remembered

    def _learn(self, m: str) -> tuple[int, ...]:
        """Ids of a pre-token that is not in the newer half of the memory."""
        ids = self.older.get(m) or tuple(self.fst.encode(m.encode("utf-8")))
        if len(m) <= 64:
            if len(self.known) >= self.remembered:
                self.older, self.known = self.known, {}
            self.known[m] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for m in self._pieces(text):
            ids = known.get(m)
            if ids is None:
                ids, known = self._learn(m), self.known
            out += ids
        return out

    def _pieces(self, text: str) -> Iterable[str]:
        return self.split.findall(text) if len(text) < 1 << 22 else (m[0] for m in self.split.finditer(text))


class Utf8Stream:
    """Decodes bytes as they come: an unfinished character waits for its next bytes; wrong bytes become U+FFFD.

    The machine's state is the bytes of the open character. A lead byte tells how many must follow and which range the
    first of those may have (Unicode, table 3-7); only the last three bytes of a chunk can belong to an open character.
    """

    def __init__(self):
        self.open = b""

    @staticmethod
    def _unfinished(tail: bytes) -> int:
        """How many of the last bytes form a proper beginning of a character that goes on."""
        for n in range(1, min(3, len(tail)) + 1):
            lead = tail[-n]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            if n >= need:
                return 0
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
            return n if n == 1 or low <= tail[1 - n] <= high else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        n = self._unfinished(data)
        self.open = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def decode(ids: Iterable[int], text: dict[int, bytes], every: int = 4096) -> Iterator[str]:
    """Ids to pieces of text, `every` ids at a time."""
    stream, part = Utf8Stream(), []
    for i in ids:
        part.append(text[i])
        if len(part) == every:
            yield stream.feed(b"".join(part))
            part = []
    yield stream.feed(b"".join(part))
    yield stream.end()


def encoder(path: str) -> Encoder:
    return held(("bpe", path), lambda: Encoder(path))


def round_trip(docs: DataFrame, path: str, keep_ids: bool = False, place: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, and place from the column so named) of every row; a null or empty text has no tokens.

    Further columns of `docs` are ignored; equal rows give equal rows; an empty table an empty result. The texts are
    encoded where they are read: no shuffle.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", place long" * bool(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working():
            e = encoder(path)
            gc.disable()  # states make many small objects; reset() collects them when they are let go
            try:
                for b in batches:
                    for at in range(0, b.num_rows, 256):
                        yield encoded(e, b.slice(at, 256))
            finally:
                gc.enable()

    def encoded(e: Encoder, part: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, back, every, text = [], [], [], [], e.fst.text
        for t in part.column(1):
            ids = e.encode(t.as_py() or "")
            packed = np.array(ids, "<u4")
            plain = hashlib.sha256()
            for piece in decode(ids, text):
                plain.update(piece.encode("utf-8"))
            n.append(len(ids))
            sha.append(hashlib.sha256(packed.tobytes()).hexdigest())
            back.append(plain.hexdigest())
            if keep_ids:
                every.append(packed.astype(np.int32))
        more = [pa.array(every, pa.list_(pa.int32()))] * keep_ids + ([part.column(2)] if place else [])
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids + ["place"] * bool(place)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), *more], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([place] if place else [])).mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def placed(docs: DataFrame) -> DataFrame:
    """docs with __place, each row's place from 0 over its files, taken by part number, and the rows within them; rows that come from no files have their place in the partitions.

    How many rows come before a file is one row for each file, so it is broadcast.
    """
    if not docs.inputFiles():
        return docs.withColumn("__place", F.monotonically_increasing_id())
    path = F.col("_metadata.file_path")
    rows = docs.select(*docs.columns, path.alias("__file"), F.col("_metadata.row_index").alias("__index"))
    name = F.substring_index("__file", "/", -1)
    order = [F.regexp_extract(name, r"^part-(\d+)", 1).cast("long"), name]
    sizes = docs.select(path.alias("__file")).groupBy("__file").count()
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("__file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(start), "__file").select(*docs.columns, (F.col("__start") + F.col("__index")).alias("__place"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: ids of every document, with their digests, and its place in the order of the stage before; files and their rows follow it.

    The texts are dealt out by place before they are encoded, so that sampling their range encodes nothing.
    """
    small_batches(spark)
    rows = placed(docs).select("doc_id", "text", "__place")
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "__place").sortWithinPartitions("__place")
    return round_trip(rows, public_tokenizers.path(VOCABULARY), keep_ids=True, place="__place")
