"""The corpus pipeline, stage by stage."""

import corpus_pipeline as pipeline
from driftwatch.llm.copies import exact_duplicates
from driftwatch.llm.minhash import near_duplicates
from tests.conftest import SF
from tests.llm.conftest import ODD
from tests.llm.test_copies import brute


def test_stages_are_in_order():
    assert [k for k, _ in pipeline.STAGES] == ["language", "exact_copies", "near_copies", "decontaminate", "mixture"]


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept, at = set(text), docs
    for name, step in pipeline.STAGES[:-1]:
        at = step(spark, at, SF)
        assert at.columns == docs.columns
        now = {r["doc_id"] for r in at.select("doc_id").collect()}
        assert at.count() == len(now) and now <= kept
        gone = kept - now
        if name == "language":
            assert all(not any(c.isalpha() for c in text[i]) for i in gone)
        elif name == "exact_copies":
            first = {}
            for i in sorted(kept):
                first.setdefault(text[i], i)
            assert now == set(first.values())
        elif name == "near_copies":
            component = brute([(i, text[i]) for i in sorted(kept)], 5, 80, 100)
            assert now == set(component.values())
        else:
            assert gone == {i for i in kept if any(b in text[i] for b in bench)}
        kept = now
    out = pipeline.mixture(spark, at, SF)
    assert out.columns == [*docs.columns, "epoch"]
    rows = [(r["doc_id"], r["epoch"]) for r in out.select("doc_id", "epoch").collect()]
    assert rows and len(set(rows)) == len(rows) and {i for i, _ in rows} <= kept


def test_stages_of_odd_rows(spark, odd, empty):
    for name, step in pipeline.STAGES:
        out = step(spark, odd, SF)
        assert out.count() <= 2 * len(ODD)
        assert set(odd.columns) <= set(out.columns), name
        assert step(spark, empty, SF).count() == 0
    assert pipeline.exact_copies(spark, odd, SF).count() == exact_duplicates(odd).where("kept").count()
    gone = {r["doc_id"] for r in near_duplicates(odd).where("not kept and doc_id is not null").collect()}
    assert {r["doc_id"] for r in pipeline.near_copies(spark, odd, SF).collect()} == {i for i, _ in ODD} - gone
