"""Counts and base scores against plain counting; probabilities that sum to one; held-out gain; edge cases."""

import time
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlark.llm import maxent as me
from quadlark.llm.common import fold, table


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def plain(rows, held):
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n, round(sum(log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows]


def test_base_and_gain(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]
    rows = me.op2(spark, d).collect()
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got) == sorted(plain(docs, lambda i: zlib.crc32(str(i).encode()) % 7 == 2))
    held = [r for r in rows if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.1


def test_chances_sum_to_one():
    """Over all common words and all surface classes."""
    rng = np.random.default_rng(0)
    common = [(f"w{i}".encode(), 1000 - i) for i in range(100)]
    m = me.Model.start(common, {c: (50, 20) for c in range(me.SURFACE)})
    m.of_class[:] = rng.normal(0, 0.3, m.of_class.shape)
    m.of_slot[:] = rng.normal(0, 0.3, m.of_slot.shape)
    before = np.array([3, 50, 520])
    total = 0.0
    for code in [*range(100), *range(me.COMMON, me.COMMON + me.SURFACE)]:
        codes = np.append(before, code)
        total += np.exp(me.log_chances(m, codes, np.arange(4, dtype=np.uint64), np.zeros(4, int), np.zeros(4))[-1])
    assert total == pytest.approx(1, abs=1e-4)


def test_training_helps():
    rng = np.random.default_rng(1)
    codes = np.array([k % 2 * 7 + (k // 2) % 3 for k in range(30000)]) + rng.integers(0, 2, 30000) * 0
    m = me.Model.start([(bytes([i + 1]), 100) for i in range(64)], {})
    begin = np.zeros(len(codes), int)
    marks = codes.astype(np.uint64) + np.uint64(1)
    first = me.log_chances(m, codes[:2000], marks[:2000], begin[:2000], np.zeros(2000)).sum()
    me.train(m, codes, marks, begin, np.ones(len(codes), bool))
    assert me.log_chances(m, codes[:2000], marks[:2000], begin[:2000], np.zeros(2000)).sum() > first / 2


def test_rare_words_are_context(monkeypatch):
    """Words without a class of their own, and alike in their first bytes, tell what follows."""
    monkeypatch.setattr(me, "BATCH", 256)
    rng = np.random.default_rng(2)
    which = rng.integers(0, 40, 8000)
    codes = np.stack([np.full(8000, me.COMMON + 3), which % 8 * 30], axis=1).ravel()
    marks = np.stack([which + 1000, which % 8 + 1], axis=1).ravel().astype(np.uint64)
    m = me.Model.start([(b"w%d" % i, 100) for i in range(256)], {3: (8000, 40)})
    begin = np.zeros(len(codes), int)
    me.train(m, codes[:12000], marks[:12000], begin[:12000], np.ones(12000, bool))
    chances = me.log_chances(m, codes, marks, begin, np.zeros(len(codes)))[12001::2]
    assert np.exp(chances).mean() > 0.25  # one of eight without the words


def test_against_a_slow_model():
    """Feature by feature, token by token, with plain loops and dictionaries of weights."""
    rng = np.random.default_rng(4)
    m = me.Model.start([(f"w{i}".encode(), 900 - i) for i in range(me.COMMON)], {c: (60, 20) for c in range(me.SURFACE)})
    m.of_class[:] = rng.normal(0, 0.3, m.of_class.shape)
    m.of_slot[:] = rng.normal(0, 0.3, m.of_slot.shape)
    words = [f"w{i}".encode() for i in rng.integers(0, 700, 120)] + [b""]
    codes, marks, begin = m.codes(words), me.word_marks(words), np.repeat([0, 50], [50, 71])
    got = me.log_chances(m, codes, marks, begin, np.full(121, -1.5))
    mask = (1 << 64) - 1

    def row(key, bits=12):
        return ((key ^ key >> 31) * 0x165667B19E3779F9 & mask) >> 64 - bits

    for i in range(121):
        before = [i - k if i - k >= begin[i] else None for k in range(1, 5)]
        c = [me.COMMON + me.SURFACE if b is None else int(codes[b]) for b in before]
        one, two = (0 if b is None else int(marks[b]) for b in before[:2])
        rare = before[0] is not None and c[0] >= me.COMMON
        key = (one * 0x9E3779B97F4A7C15 + (1 if rare else two * 0xC2B2AE3D27D4EB4F)) & mask
        x = m.bias.astype(float) + sum(m.of_class[c[k] + k * me.CONTEXT] for k in range(4)) + m.of_class[4 * me.CONTEXT + row(key)]
        g = codes[i] // me.SLOTS if codes[i] < me.COMMON else codes[i] - me.COMMON + me.FREQUENT
        want = x[g] - np.log(np.exp(x).sum())
        if codes[i] < me.COMMON:
            y = m.slot_bias[g] + m.of_slot[c[0] * me.FREQUENT + g] + m.of_slot[me.CONTEXT * me.FREQUENT + row((key + (int(g) + 1) * 0xD6E8FEB86659FD93) & mask)]
            want += y[codes[i] % me.SLOTS] - np.log(np.exp(y).sum())
        else:
            want += -1.5
        assert got[i] == pytest.approx(want, abs=1e-3)


def test_hashed_rows_grow():
    assert me.hashed_rows(0) == me.HASHED
    assert all(n**0.5 <= me.hashed_rows(n) <= max(me.HASHED, 2 * n**0.5) for n in (10**3, 10**7, 10**9, 10**12))


@pytest.mark.parametrize("piece", [40, me.PIECE])
def test_odd_rows(make, odd, monkeypatch, piece):
    """Small pieces give the same counts."""
    monkeypatch.setattr(me, "PIECE", piece)
    docs = make(odd).withColumn("held", F.coalesce(F.col("doc_id") == 6, F.lit(False)))
    rows = me.score(docs).collect()
    got = [((r.doc_id is None, r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    want = [((i is None, i), *rest[1:]) for i, *rest in plain([(r[0], r[1]) for r in odd], lambda i: i == 6)]
    assert sorted(got) == sorted(want)
    assert all(np.isfinite(r.score) and r.score <= 0 for r in rows)


def test_no_training_rows_and_no_rows(make, odd):
    rows = me.score(make(odd).withColumn("held", F.lit(True))).collect()
    assert len(rows) == len(odd) and all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in rows)
    assert me.score(make([]).withColumn("held", fold(F.col("doc_id"), 7) == 2)).count() == 0


def test_every_position_trains():
    """Over the rounds, each position of the texts that are not held is used, and none of the others."""
    ids, lens, held = np.array([5, 6, -3]), np.array([13, 7, 9]), np.array([False, True, False])
    begin = np.repeat(np.cumsum(lens) - lens, lens)
    used = sum(me.used_in(k, ids, lens, held, begin).astype(int) for k in range(me.ROUNDS))
    assert (used[~np.repeat(held, lens)] >= 1).all() and not used[np.repeat(held, lens)].any()


def plain_descend(weights, power, rows, gradient):
    for r in rows:
        order = np.argsort(r, kind="stable")
        first = np.nonzero(np.diff(r[order], prepend=-1))[0]
        g = np.add.reduceat(gradient[order], first, axis=0)
        at = r[order[first]]
        power[at] += np.einsum("ij,ij->i", g, g) / g.shape[1]
        weights[at] -= me.STEP * g / np.sqrt(power[at])[:, None]


def mini_batch(hashed, width):
    """Rows as training has them: skewed context codes and hashed n-grams."""
    rng = np.random.default_rng(5)
    codes = np.minimum(rng.pareto(0.6, (4, me.BATCH)) * 2, me.CONTEXT - 1).astype(np.int64) + np.arange(4)[:, None] * me.CONTEXT
    ngrams = 4 * me.CONTEXT + rng.zipf(1.2, (1, me.BATCH)) * 40503 % hashed
    rows = 4 * me.CONTEXT + hashed
    return np.zeros((rows, width), np.float32), np.full(rows, 1e-2, np.float32), np.concatenate([codes, ngrams]), rng.normal(0, 0.2, (me.BATCH, width)).astype(np.float32)


@pytest.mark.parametrize("hashed,width", [(1 << 14, me.CLASSES), (1 << 18, me.SLOTS)])
def test_step_equals_the_plain_one(hashed, width):
    """Also where row numbers take more than 16 bits."""
    weights, power, rows, gradient = mini_batch(hashed, width)
    want, want_power = weights.copy(), power.copy()
    for _ in range(2):
        me.descend(weights, power, rows, gradient)
        plain_descend(want, want_power, rows, gradient)
    assert np.allclose(weights, want, atol=1e-5) and np.allclose(power, want_power, rtol=1e-4)
    assert np.count_nonzero(weights) == np.count_nonzero(want)


def test_step_costs_less_than_the_plain_one():
    """The query's CPU budget hangs on this step: at most 0.8 of the plain one's CPU time (least of some runs, taken in turn)."""
    weights, power, rows, gradient = mini_batch(1 << 14, me.CLASSES)
    least = {me.descend: 1e9, plain_descend: 1e9}
    for _ in range(15):
        for step in least:
            start = time.thread_time()
            step(weights, power, rows, gradient)
            least[step] = min(least[step], time.thread_time() - start)
    assert least[me.descend] < 0.8 * least[plain_descend]


def test_softmax_of_any_width():
    rng = np.random.default_rng(6)
    for width in (1, 2, 3, 31, 32, 48):
        x = rng.normal(0, 200, (50, width)).astype(np.float32)
        x[:, 1:][rng.random((50, width - 1)) < 0.1] = -np.inf
        assert (me.highest(x) == x.max(axis=1, keepdims=True)).all()
        want = np.exp(x.astype(float) - x.max(axis=1, keepdims=True))
        assert np.allclose(me.softmax(x.copy()), want / want.sum(axis=1, keepdims=True), atol=1e-6)
    assert me.softmax(np.empty((0, me.SLOTS), np.float32)).shape == (0, me.SLOTS)


@pytest.mark.parametrize("held", [False, True])
def test_one_empty_text(make, held):
    """A piece of a single token."""
    row = me.score(make([(1, None)]).withColumn("held", F.lit(held))).first()
    assert (row.doc_id, row.n_tokens, row.n_known, row.train_tokens) == (1, 1, int(not held), int(not held)) and np.isfinite(row.score)


def test_codes_and_turns_equal_the_plain_ones():
    """Word by word and position by position, over odd words and ids."""
    words = [b"", b"a", b"\0", b"\0\0", b"ab", b"\xff", b"\xff\xff\xff", *(f"w{i}".encode() for i in range(3000))]
    m = me.Model.start([(w, 9) for w in words[1 : 2 * me.COMMON : 2][: me.COMMON]], {})
    plain_codes = [m.place[w] if w in m.place else me.COMMON + zlib.crc32(w[:2]) % me.SURFACE for w in words]
    assert m.codes(words).tolist() == m.codes(words, me.word_marks(words)).tolist() == plain_codes
    assert len(m.codes([])) == 0
    ids, lens, held = np.array([me.NO_ID, -7, 3, 2**63 - 1]), np.array([5, 1, 9, 6]), np.array([False, False, True, False])
    begin = np.repeat(np.cumsum(lens) - lens, lens)
    for k in range(me.ROUNDS):
        want = [not h and (j + int(i)) % me.THIN == k for i, n, h in zip(ids, lens, held) for j in range(n)]
        assert me.used_in(k, ids, lens, held, begin).tolist() == want


def test_turns_cost_little():
    """The positions of a round are found in less than half of the CPU time of plain arithmetic for each (least of some runs, taken in turn)."""

    def plain_turns(number, ids, lens, held, begin):
        return ~np.repeat(held, lens) & ((np.arange(len(begin)) - begin + np.repeat(ids, lens)) % me.THIN == number % me.THIN)

    ids, lens, held = np.arange(2000), np.full(2000, 250), np.arange(2000) % 7 == 2
    begin = np.repeat(np.cumsum(lens) - lens, lens)
    least = {me.used_in: 1e9, plain_turns: 1e9}
    for _ in range(9):
        for turns in least:
            start = time.thread_time()
            turns(1, ids, lens, held, begin)
            least[turns] = min(least[turns], time.thread_time() - start)
    assert least[me.used_in] < 0.5 * least[plain_turns]
