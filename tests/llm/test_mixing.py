"""The schedule's deviation, and places against a plain simulation."""

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from quadlark.llm import mixing as mx


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(1, 60), min_size=1, max_size=12))
def test_less_than_one_block_off(shares):
    period, given_out = sum(shares.values()), Counter()
    for slot, k in enumerate(mx.schedule(shares), 1):
        given_out[k] += 1
        assert all(abs(given_out[s] * period - slot * n) < period for s, n in shares.items())
    assert given_out == shares


def test_whole_shares():
    assert mx.whole_shares({"a": 1, "b": 1}) == {"a": 1, "b": 1}
    shares = mx.whole_shares({"a": 0.7, "b": 0.2999, "c": 0.0001}, 100)
    assert shares["c"] == 1 and shares["a"] == 70
    with pytest.raises(ValueError):
        mx.whole_shares({"a": 0})


def test_interleave(make):
    """A source with most rows, a null source, repeated ids: every row has its own place, and prefixes keep the weights."""
    rows = [(i, "t", "en", "big") for i in range(300)] + [(1000 + i, "t", "en", "small") for i in range(100)] + [(2000 + i % 50, "t", None, None) for i in range(100)]
    weights, block = {"big": 1, "small": 1, None: 2}, 5
    got = mx.interleave(make(rows), weights, block).collect()
    assert len(got) == len(rows)
    ranks = defaultdict(list)
    for r in got:
        ranks[r.source].append(r["__rank"])
        assert r["__block"] == r["__rank"] // block
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())
    order = mx.schedule(mx.whole_shares(weights))
    turn, want = Counter(), {}
    for slot in range(1000):
        k = order[slot % len(order)]
        want[k, turn[k]] = slot
        turn[k] += 1
    assert all(r["__slot"] == want[r.source, r["__block"]] for r in got)


def test_odd_rows_and_stage(spark, make, odd, tmp_path):
    docs = make(odd)
    out = mx.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == len(odd)
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert mx.stage(spark, make([]), "").count() == 0


def test_deviation_from_weights_given(spark):
    """Weights that no 2,000 whole shares express, over many stretches."""
    weights = {"hot": 2236068, **{f"m{k}": 547723 for k in range(30)}, "tiny": 4472}
    shares = mx.exact_shares(weights)
    assert all(shares["hot"] * w == s * weights["hot"] for s, w in zip(shares.values(), weights.values()))
    blocks, total = {k: 400 if k[0] == "m" else 2000 if k == "hot" else 2 for k in weights}, sum(weights.values())
    rows = mx.slots(spark, shares, blocks).collect()
    assert len(rows) == len({r.slot for r in rows}) == sum(blocks.values())
    for r in rows:
        exact = weights[r["__source"]]
        assert exact * r.slot < (r.block + 1) * total and (r.slot + 1) * exact > r.block * total


NAMES = "share turn slot block count n place source2 __row __source __none __place __tie __bins __bin __in __start __first __slots __rank __slot __block i h".split()


def test_any_further_names(spark):
    """Every name that the plan uses inside may be a column of the documents."""
    columns = ", ".join(f"`{n}` string" for n in NAMES)
    rows = [(i % 40, f"text {i}", "en", "ab"[i % 3 > 0], *(f"{n}{i}" for n in NAMES)) for i in range(120)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {columns}")
    out = mx.stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))
    assert mx.interleave(docs).count() == 120


def test_ties_are_settled(make):
    """Rows of one id, or of none, with unlike texts: the same places however the rows lie; equal rows next to each other."""
    rows = [(i % 3 if i % 4 else None, f"text {i}", "en", "a") for i in range(90)] + [(7, "same", "en", "a")] * 5
    first, second = ({r.text: r["__rank"] for r in mx.interleave(make(x).repartition(n)).collect()} for x, n in ((rows, 1), (rows[::-1], 7)))
    assert {t: k for t, k in first.items() if t != "same"} == {t: k for t, k in second.items() if t != "same"}
    ranks = sorted(r["__rank"] for r in mx.interleave(make(rows)).collect() if r.text == "same")
    assert ranks == list(range(ranks[0], ranks[0] + 5))


def test_rows_without_ids_are_spread(make):
    """A third of all rows without an id don't meet in one bin."""
    docs = make([(None if i % 3 == 0 else i, f"text {i}", "en", "a") for i in range(3000)])
    lost = mx.packed(docs).where("__row.doc_id is null").select("__place").distinct().count()
    assert lost == 1000
