"""Quality by weak supervision: rules vote good or bad or abstain, expectation-maximisation finds how far each can be
trusted, and a document is kept if its posterior probability of being good is at least one half."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, written

SYMBOL = re.compile(r"[#*$%&|<>]")
#: Words of punctuation alone.
BARE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
BLANKS = " \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_stops", "n_bare")


def repeat_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(number) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The MEASURES of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, dup, lines, stops = set(), 0, 0, 0
    for line in text.split("\n"):
        end = line.rstrip(BLANKS)
        if end.lstrip(BLANKS):
            lines += 1
            stops += end[-1] in ".!?"
            dup += line in seen
            seen.add(line)
    chars = len(text) - sum(map(text.count, BLANKS))
    letters, upper = _letters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return len(words), chars, len(SYMBOL.findall(text)), dup, repeat_words(words), lines, int(upper[points].sum()), int(letters[points].sum()), stops, len(BARE.findall(text))


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and which upper-case ones."""
    return np.array([chr(c).isalpha() for c in range(0x110000)]), np.array([chr(c).isupper() for c in range(0x110000)])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([measure(t.as_py() or "") for t in b.column(1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[:, k]) for k in range(len(MEASURES)))], ["doc_id", *MEASURES])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """Each rule's vote from the measures: 1 good, -1 bad, 0 abstains."""
    c = F.col
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    mean = share("word_chars", "n_words")
    return {
        "length": _vote(c("n_words") >= 80, c("n_words") < 50),
        "word_size": _vote(mean.between(3, 9), (mean < 2) | (mean > 14)),
        "symbols": _vote(share("n_symbols", "n_words") <= 0.05, share("n_symbols", "n_words") > 0.25),
        "dup_lines": _vote(share("n_dup_lines", "n_lines") <= 0.1, share("n_dup_lines", "n_lines") > 0.3),
        "repeats": _vote(share("n_repeat_words", "n_words") <= 0.2, share("n_repeat_words", "n_words") > 0.4),
        "capitals": _vote(share("n_upper", "n_letters") <= 0.15, share("n_upper", "n_letters") > 0.4),
        "sentences": _vote(share("n_stops", "n_lines") >= 0.6, share("n_stops", "n_lines") < 0.1),
        "letters": _vote(share("n_letters", "word_chars") >= 0.85, share("n_letters", "word_chars") < 0.75),
        "bare": _vote(share("n_bare", "n_words") <= 0.02, share("n_bare", "n_words") > 0.15),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray, np.ndarray]:
    """The log odds of good by themselves, and what each rule's good and bad vote add to them.

    patterns: distinct vote rows; counts: how many documents have each: sufficient for all documents. The model has two
    classes; in each, a rule votes good, bad or abstains with chances of its own. All rules start with the same trust. A good vote
    never counts against a document and a bad one never for it, which fixes which class is the good one; abstaining adds nothing.
    """
    is_up, is_down = patterns == 1, patterns == -1
    n = patterns.shape[1]
    base, up, down = float(np.log(4)), np.full(n, 0.4), np.full(n, -2.5)
    for _ in range(rounds):
        p = posterior(patterns, base, up, down)
        good, bad = counts * p, counts * (1 - p)
        chance = lambda w, votes: (w @ votes + 0.5) / (w.sum() + 1.5)
        new = float(np.log((good.sum() + 1) / (bad.sum() + 1)))
        new_up = np.maximum(0, np.log(chance(good, is_up) / chance(bad, is_up)))
        new_down = np.minimum(0, np.log(chance(good, is_down) / chance(bad, is_down)))
        moved = max(abs(new - base), np.abs(new_up - up).max(initial=0), np.abs(new_down - down).max(initial=0))
        base, up, down = new, new_up, new_down
        if moved < 1e-9:
            break
    return base, up, down


def posterior(patterns: np.ndarray, base: float, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(base + (patterns == 1) @ up + (patterns == -1) @ down)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, p_good and kept of every row of (doc_id, text).

    Every document is measured once; the votes' patterns (3 to the number of rules at most) are counted over all of
    them, and only those counts come to the driver. Null and empty texts have no words and fail; an empty table gives an empty
    result; equal rows get equal verdicts; further columns are ignored.
    """
    found, _ = written(measures(docs))
    rules = votes()
    voted = found.select("*", *(v.alias(f"vote_{k}") for k, v in rules.items()))
    names = [f"vote_{k}" for k in rules]
    rows = voted.groupBy(*names).count().collect()
    patterns = np.array([r[:-1] for r in rows], np.int64).reshape(-1, len(names))
    order = np.lexsort(patterns.T)
    base, up, down = fit(patterns[order], np.array([r[-1] for r in rows], float)[order])
    odds = F.lit(base)
    for n, a, b in zip(names, up.tolist(), down.tolist()):
        odds = odds + F.when(F.col(n) == 1, a).when(F.col(n) == -1, b).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= 0.5))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES[:5], "base_failed", "kept", "p_good")
