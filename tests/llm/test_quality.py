"""Measures against plain counting; verdicts against labels; edge cases."""

import random
import re
from collections import Counter

import numpy as np

from quadlark.llm import quality as ql
from quadlark.llm.common import table


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 3)}
    dup, seen = 0, set()
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_measures():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "ä\n", "\n", "#", " ", "x\x0b", "\x1c", "日 ", "| ", "a b c "]) for _ in range(rng.randint(0, 60)))
        assert ql.measure(text)[:5] == slow(text)


def test_fit():
    """Rules of known trust are recovered well enough to tell the classes apart."""
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.85
    votes = np.zeros((20000, 5), int)
    for k in range(5):
        right = rng.random(20000) < (0.95 if k < 4 else 0.6)
        votes[:, k] = np.where(good == right, 1, -1) * (rng.random(20000) < 0.9)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    base, up, down = ql.fit(patterns, counts.astype(float))
    assert np.mean((ql.posterior(votes, base, up, down) >= 0.5) == good) > 0.97
    assert (up >= 0).all() and (down <= 0).all() and up[0] > up[4]


def test_against_labels(spark):
    d = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    rows = [r for r in ql.op9(spark, d).collect() if r.doc_id in quality]
    junk = [r.kept for r in rows if quality[r.doc_id] == 0]
    clean = [r.kept for r in rows if quality[r.doc_id] == 1 and not r.base_failed]
    assert np.mean(junk) < 0.05 and np.mean(clean) > 0.98
    assert not any(r.kept for r in rows if r.base_failed)


def test_odd_rows(make, odd):
    got = sorted(((r.doc_id is None, r.doc_id), *(r[m] for m in ql.MEASURES[:5]), r.base_failed) for r in ql.judge(make(odd)).collect())
    want = []
    for i, text, *_ in odd:
        m = slow(text)
        want.append(((i is None, i), *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert got == sorted(want)
    assert ql.judge(make([])).count() == 0
