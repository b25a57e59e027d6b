"""Token counts by the whole-token shortcut.

A pre-token whose string is in the vocabulary with its word end is one token if and only if the merges, run on that
string, end in it. That is proved once for every entry when the vocabulary is loaded, so a matching pre-token is counted by
one look-up; only the rest are merged, and their counts remembered up to a bound.

The library's Unicode tables are not Python's. A character is plain if the library, asked once when it is first met, normalises and
splits it as Python does, and if its version of normalisation can't matter; texts of plain characters are normalised and split here,
all others by the library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import held, table

VOCABULARY = "word_bpe_49k.json"


def byte_letters() -> dict[int, str]:
    """Fixed rule of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(others)}}


class Counts:
    """Token counts under a word-end BPE file of the `tokenizers` library; `remembered` bounds the memory of merged words."""

    def __init__(self, path: str, remembered: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.vocab = model["vocab"]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.library = tokenizers.Tokenizer.from_file(path)
        self.plain_ones, self.other_ones = set(), set()
        letters = byte_letters()
        self.letters = letters
        self.bytes = {c: b for b, c in letters.items()}
        self.whole = self._prove()
        self.remembered, self.known, self.older = remembered, {}, {}

    def _prove(self) -> set[str]:
        """The pre-tokens, as text, that the merges turn into one token."""
        proved = set()
        for entry in self.vocab:
            if entry.endswith(self.end) and len(entry) > len(self.end) and set(entry[: -len(self.end)]) <= self.bytes.keys():
                raw = bytes(self.bytes[c] for c in entry[: -len(self.end)])
                try:
                    text = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if self.merged(text) == 1:
                    proved.add(text)
        return proved

    def merged(self, word: str) -> int:
        """Tokens of one pre-token: neighbours with the lowest rank are joined, leftmost first, until none is left."""
        parts = [self.letters[b] for b in word.encode("utf-8")]
        if len(parts) > 256:
            return self._merged_long(parts)
        parts[-1] += self.end
        rank, never = self.rank, 1 << 60
        ranks = [rank.get(p, never) for p in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < never:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), never)
        return len(parts)

    def _merged_long(self, parts: list[str]) -> int:
        """The same by a heap over a linked list, for long pre-tokens."""
        import heapq

        parts[-1] += self.end
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            left -= 1
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if y < n and (r := self.rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return left

    def normal(self, text: str) -> str:
        """NFC, blanks to one space, and lower case by single characters (no final sigma). Blanks only split, so here they may stay."""
        text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def library_words(self, text: str) -> list[str]:
        """Pre-tokens as the library's normaliser and pre-tokeniser give them."""
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes[c] for c in word).decode("utf-8") for word, _ in found]

    def _is_plain(self, c: str) -> bool:
        """Normalisation is the same in all Unicode versions that know a text's characters; a later one joins no others if it is no mark and
        has no parts. Beside a letter and beside a sign, a character of each class splits differently."""
        known = unicodedata.ucd_3_2_0.category(c) != "Cn"
        category = unicodedata.category(c)
        if not known and (category[0] == "M" or category == "Cn" or unicodedata.combining(c) or unicodedata.decomposition(c)):
            return False
        around = f"a{c}a !{c}!"
        return self.split.findall(self.normal(around)) == self.library_words(around)

    def all_plain(self, text: str) -> bool:
        there = set(text)
        if not there <= self.plain_ones:
            if not there.isdisjoint(self.other_ones):
                return False
            for c in there - self.plain_ones:
                (self.plain_ones if self._is_plain(c) else self.other_ones).add(c)
            return there <= self.plain_ones
        return True

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if text.isascii():
            return self.split.findall(text.lower())
        if self.all_plain(text):
            normal = self.normal(text)
            if self.all_plain(normal):
                return self.split.findall(normal)
        return self.library_words(text)

    def count(self, text: str) -> int:
        total, at = 0, 0
        if self.special:
            for m in self.special.finditer(text):
                total += self._plain(text[at : m.start()]) + 1
                at = m.end()
        return total + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> int:
        total, whole, known, older = 0, self.whole, self.known, self.older
        for word, n in Counter(self.words(text)).items():
            if word in whole:
                total += n
                continue
            k = known.get(word)
            if k is None:
                k = older.get(word) or self.merged(word)
                if len(word) <= 64:
                    if len(known) >= self.remembered:
                        self.older, self.known = older, known = known, {}
                    known[word] = k
            total += n * k
        return total


def counts(path: str) -> Counts:
    return held(("counts", path), lambda: Counts(path))


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; null texts count as empty. Further columns are ignored,
    equal rows give equal rows, an empty table an empty result. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counts(path)
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            n = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
