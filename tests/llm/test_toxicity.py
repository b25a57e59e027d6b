"""The index against plain cosines; calibration against a plain leave-one-out; held-out labels; edge cases."""

import random
from collections import Counter

import numpy as np
import pytest

from quadlark.llm import toxicity as tx
from quadlark.llm.common import table

NAMES = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]


def example(rng, i):
    toxic = int(i % 3 == 0)
    text = " ".join(rng.choices(NAMES[:150] if toxic else NAMES[50:], k=rng.choice([0, *range(8, 30)])))
    return i, toxic, text


@pytest.fixture(scope="module", params=[0, 20, 512])
def index(request):
    rng = random.Random(1)
    texts = [example(rng, i) for i in range(400)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tx, "FULL_ROWS", request.param)
        return tx.build([(i, y, *tx.counted(t)) for i, y, t in texts]), {i: (y, t) for i, y, t in texts}


class Plain:
    """Full vectors over all words of the examples, compared one by one."""

    def __init__(self, examples):
        counts = {i: Counter(tx.words(t)) for i, (_, t) in examples.items()}
        n, toxic = len(examples), sum(y for y, _ in examples.values())
        df, bad = Counter(), Counter()
        for i, c in counts.items():
            df.update(c.keys())
            if examples[i][0]:
                bad.update(c.keys())
        self.idf = {w: float(tx.delta_idf(np.array([df[w]]), np.array([bad[w]]), n, toxic)[0]) for w in df}
        self.vectors = {i: self.unit(c) for i, c in counts.items()}

    def unit(self, counts):
        w = {x: (1 + np.log(n)) * self.idf[x] for x, n in counts.items() if x in self.idf}
        norm = sum(v * v for v in w.values()) ** 0.5
        return {x: v / norm for x, v in w.items()}

    def cosines(self, text, without=None):
        q = self.unit(Counter(tx.words(text)))
        got = {i: sum(x * v.get(t, 0.0) for t, x in q.items()) for i, v in self.vectors.items() if i != without}
        return {i: c for i, c in got.items() if c > 0}


def test_nearest_is_exact(index):
    """Blocks left out by their bounds hold nothing that a plain scan of the full vectors would find; a shared word is enough."""
    found, examples = index
    plain, rng = Plain(examples), random.Random(2)
    for _ in range(150):
        text = " ".join(rng.choices([*NAMES, "unknown"], k=rng.randint(1, 12)))
        want = plain.cosines(text)
        got = found.nearest([found.vector(text)])[0]
        best = sorted(want.values(), reverse=True)[: tx.NEIGHBOURS]
        assert np.allclose([s for s, _ in got], best, atol=1e-6)
        assert all(abs(want[found.ids[i]] - s) < 1e-6 for s, i in got)


def test_calibration(spark, make, index):
    """Scores are what plain cosines, a plain leave-one-out and the same pooling give."""
    _, examples = index
    plain = Plain(examples)

    def vote(text, without=None):
        near = sorted(plain.cosines(text, without).items(), key=lambda x: -x[1])[: tx.NEIGHBOURS]
        return sum(c for i, c in near if examples[i][0]) / sum(c for _, c in near) if near else -1.0

    docs = make([(i, t) for i, (_, t) in examples.items()])
    learned = tx.learn(docs, spark.createDataFrame([(i, y) for i, (y, _) in examples.items()], "doc_id long, toxic int"))
    votes = {i: vote(t, i) for i, (_, t) in examples.items()}
    met = [i for i in examples if votes[i] >= 0]
    edges, values = tx.isotonic(np.array([votes[i] for i in met]), np.array([float(examples[i][0]) for i in met]), np.ones(len(met)))
    lone = [examples[i][0] for i in examples if votes[i] < 0]
    rng = random.Random(3)
    texts = [" ".join(rng.choices(NAMES, k=rng.randint(8, 20))) for _ in range(60)] + ["", "nothing known"]
    got = {r.doc_id: r.score for r in tx.scores(make(list(enumerate(texts))), learned).collect()}
    for k, t in enumerate(texts):
        v = vote(t)
        assert abs(got[k] - (np.interp(v, edges, values) if v >= 0 else sum(lone) / (len(lone) + 1))) < 1e-3


def test_isotonic():
    x, y = tx.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert list(y) == [0.0, 0.5, 1.0] and np.all(np.diff(x) > 0)


def test_bound_of_postings():
    assert tx.within([(1, 5), (2, 9), (3, 4), (4, 1)], 10) == [1, 3, 4]


def test_held_out(spark):
    """On rows whose labels it has not seen."""
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, d, "labels").collect()}
    every = tx.op5(spark, d).collect()
    rows = [r for r in every if r.held_out and r.doc_id in labels]
    caught = [r.predicted for r in rows if labels[r.doc_id]]
    kept = [1 - r.predicted for r in rows if not labels[r.doc_id]]
    assert np.mean(caught) >= 0.9 and np.mean(kept) >= 0.985
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in every)
    assert np.mean([len(r.evidence) > 0 for r in every]) > 0.95 and len({r.score for r in every}) > 20


def test_odd_rows(spark, make, odd):
    docs = make(odd)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    learned = tx.learn(docs, none)
    assert [r.score for r in tx.scores(docs, learned).collect()] == [0.0] * len(odd)
    only = tx.learn(docs, spark.createDataFrame([(5, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int"))
    assert {r.score for r in tx.scores(docs, only).collect()} == {2 / 3}
    many = make([(1000 + i, "you idiot moron" if i % 2 else "good and kind words") for i in range(60)] + odd)
    labels = spark.createDataFrame([(1000 + i, 1, i % 2) for i in range(60)] + [(1, 0, None), (1000, 1, 0)], "doc_id long, quality int, toxic int")
    learned = tx.learn(many, labels)
    long = "kind good words " * 400_000
    got = {r.doc_id: r for r in tx.scores(make([(100, "such an idiot"), (101, "kind words"), (102, None), (103, ""), (104, long)]), learned).collect()}
    assert [got[i].predicted for i in (100, 101, 102, 103, 104)] == [1, 0, 0, 0, 0]
    assert got[100].evidence[0].example % 2 == 1
    assert tx.scores(make([]), learned).count() == 0
