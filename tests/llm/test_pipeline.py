"""The stages in order, each on what the one before kept."""

import corpus_pipeline
from quadlark.llm.common import table, written


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "source_mixing", "byte_bpe"]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = written(stage(spark, docs, d))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        if name in ("line_dedup", "source_mixing", "byte_bpe"):
            assert now == ids
        if name != "byte_bpe":
            assert docs.columns == columns
        ids = now
    assert len(ids) > 100 and docs.where("n_tokens <> size(ids)").count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert "pipeline" in found and all(any(k.startswith(f"op{n}_") for k in found) for n in range(1, 11))


def test_odd_rows_in_every_stage(spark, make, odd):
    """Nulls, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    d = "/root/testdata/sf0.001"
    for rows in (odd, []):
        docs = make(rows)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs, _ = written(stage(spark, docs, d))
            assert name == "byte_bpe" or docs.columns == columns
        kept = [r.doc_id for r in docs.collect()]
        assert len(kept) == len(set(kept)) and (len(kept) > 3) == bool(rows)


def test_schedule_reaches_the_end(spark, make):
    """Over several files of unlike sizes, the last stage's places and files follow the slots of the mixing stage."""
    from quadlark.llm import bpe, mixing

    rows = [(i, f"text {i} " * (1 + i % 90), "en", "big" if i % 5 else "small") for i in range(600)]
    docs = make(rows)
    plan = {r.doc_id: (r["__slot"], r["__rank"]) for r in mixing.interleave(docs).collect()}
    mixed, _ = written(mixing.stage(spark, docs, ""))
    assert len(mixed.inputFiles()) > 2
    out, _ = written(bpe.stage(spark, mixed, ""))
    got = out.select("doc_id", "place", "_metadata.file_name", "_metadata.row_index").collect()
    by_place = [r.doc_id for r in sorted(got, key=lambda r: r.place)]
    assert by_place == sorted(plan, key=plan.get) and sorted(r.place for r in got) == list(range(600))
    assert by_place == [r.doc_id for r in sorted(got, key=lambda r: (r.file_name, r.row_index))]
