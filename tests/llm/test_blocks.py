"""Helpers for long arrays, and the operators that use them, on very long rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from driftwatch.llm import blocks, chat, personal


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 256, 1000])
def test_running_results(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(50) for _ in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(
        blocks.scan(F.col("v")).alias("sum"), blocks.scan(F.col("v"), F.greatest).alias("most")).first()
    assert row["sum"] == [sum(values[: k + 1]) for k in range(n)]
    assert row["most"] == [max(values[: k + 1]) for k in range(n)]


@pytest.mark.parametrize("n", [0, 1, 128, 700])
def test_cuts_and_overlaps(spark, n):
    rng = random.Random(n)
    text = "".join(rng.choice("aé漢\U0001f600 ") for _ in range(2000))
    some = lambda k: [(a, a + rng.randrange(12)) for a in (rng.randrange(1990) for _ in range(k))]
    spans, others = some(n), some(n // 4)
    row = spark.createDataFrame([(text, spans, others)], "t string, s array<struct<start:int,end:int>>, o array<struct<start:int,end:int>>").select(
        blocks.cut(F.col("t"), F.col("s")).alias("cut"), blocks.apart(F.col("s"), F.col("o")).alias("apart")).first()
    assert row["cut"] == [text[a:b] for a, b in spans]
    assert sorted(map(tuple, row["apart"])) == sorted(
        (a, b) for a, b in spans if not any(c < b and a < d for c, d in others))


def test_a_conversation_of_100000_turns(spark):
    turns = spark.range(100_000).selectExpr(
        "5L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role",
        "if(id % 1000 = 1, '</s>[INST] ok', concat('é ', id)) AS text")
    start = time.time()
    got = chat.digests(chat.formatted(turns)).first()
    assert time.time() - start < 60
    texts = ["</s>[INST] ok" if k % 1000 == 1 else f"é {k}" for k in range(100_000)]
    assert got["n_turns"] == 100_000 and got["loss_chars"] == sum(map(len, texts[1::2]))


def test_a_document_of_100000_addresses(table):
    text = " ".join(f"a{k}@host{k}.org (at) 10.0.0.{k % 300}:7" for k in range(100_000))
    leaf = {"trees": [((14, 0.5, -1.0, 1.0), 1.0)], "thresholds": {0: 0.5, 1: 0.5}}
    docs = table([(1, text), (2, None), (3, "é a@b.org")])
    start = time.time()
    found = personal.find(docs, leaf)
    got = {r["doc_id"]: r for r in personal.digests(found).collect()}
    assert time.time() - start < 60
    assert got[1]["n_email"] == 100_000 and got[2]["n_email"] == 0
    assert got[1]["n_ip"] == sum(k % 300 <= 255 for k in range(100_000))
    hidden = {r["doc_id"]: r["text"] for r in personal.redact(found).collect()}
    assert len(hidden[1]) == len(text) and "@" not in hidden[1] and hidden[3] == "é *******" and hidden[2] == ""


def test_batches_come_in_slices_with_all_rows():
    import pyarrow as pa

    from driftwatch.llm import batches

    batch = pa.RecordBatch.from_pydict({"id": list(range(1001)), "text": [None if k % 7 == 0 else f"t{k}" for k in range(1001)]})
    sizes = []

    def choose(texts):
        sizes.append(len(texts))
        return [t is not None for t in texts]

    out = pa.Table.from_batches(batches.chosen([batch, batch.slice(0, 0), batch.slice(5, 3)], 1, choose))
    assert out.column("id").to_pylist() == [k for k in [*range(1001), 5, 6, 7] if k % 7]
    assert sum(sizes) == 1004 and max(sizes) <= batches.ROWS


def test_stages_judge_every_slice(table, spark):
    from driftwatch.llm import batches, decontaminate, language

    held = "an item of a few words that one document holds"
    docs = table([(k, held if k == 450 else "plain words of a text " * 3 if k % 3 else None, "en") for k in range(2 * batches.ROWS + 100)], 1)
    benchmark = spark.createDataFrame([(1, held)], "item_id long, text string")
    want = [k for k in range(2 * batches.ROWS + 100) if k % 3 or k == 450]
    kept = language.accepted(docs, language.fit(docs))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == want
    assert sorted(r.doc_id for r in decontaminate.clean(kept, benchmark).select("doc_id").collect()) == [k for k in want if k != 450]
